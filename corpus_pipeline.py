"""A corpus pipeline of five stages over ``documents``; each works on all rows that the one before it kept.

* null, empty and letterless texts go in the first stage; a null id, language or source is a value like any other, and no stage reads ``n_chars``
* rows that repeat an id stay rows of their own; of equal or near texts one stays: exact copies by the largest id, near ones by the smallest
* an empty table gives an empty result; columns beyond those of ``documents`` are carried along up to the last stage
* near copies are told by five-word shingles, the corpus default, where ``op6_near_dedup`` takes the four words of its contract
* this file needs the subpackage ``docrec.llm``; the driver's entry leaves the pipeline out where that is missing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docrec.llm import exact_dedup, language_id, mixing, near_dedup, packing
from docrec.session import new_folder, with_code

#: DuckDB has no naive Bayes, bottom-k sketches or tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be said (no text, no letter) go."""
    return language_id.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for the case of A-Z), the one with the largest id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, the document with the smallest id stays."""
    return near_dedup.distinct_enough(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens: one row a piece."""
    return packing.packed(docs)


STAGES = [(f.__name__, with_code(f)) for f in (languages, exact, near, mix, pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
