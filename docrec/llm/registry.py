"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from docrec.llm import conversation_repair, exact_dedup, html_extraction, language_id, language_model, media, mixing, near_dedup, packing, sharding, suffix_dedup, tool_calls, whitening

QUERIES = {
    "op1_flac_media": media.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_html_extraction": html_extraction.query,
    "op4_tool_calls": tool_calls.query,
    "op5_mixing": mixing.query,
    "op6_near_dedup": near_dedup.query,
    "op7_sharding": sharding.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_packing": packing.query,
    "op10_language_id": language_id.query,
    "op11_whitening": whitening.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_language_model": language_model.query,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_tool_calls": tool_calls.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_language_model": language_model.ORACLE,
}
