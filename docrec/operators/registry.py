"""The registry of learned formats, and the evaluation of templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrec.functions.scalar import slug


def template_usable(rules: Column, patterns: Column, marker: Column) -> Column:
    """Spatial rules, a marker, or at least one row pattern."""
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    return some(rules) | some(patterns) | (F.trim(F.coalesce(marker, F.lit(""))) != "")


def upsert(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """``name, model, carrier, template, row_count, usable, samples``: the template with strictly more rows stays, a tie goes to the new one; a handcrafted one is never replaced and an unusable one never replaces."""
    new = incoming.select("name", *(F.col(c).alias(f"n_{c}") for c in ("model", "carrier", "template", "row_count", "usable")), F.lit(True).alias("n_"))
    j = registry.join(new, "name", "full_outer")
    take = F.col("n_").isNotNull() & F.coalesce("n_usable", F.lit(False)) & ~F.col("model").eqNullSafe("handcrafted") & ~((F.coalesce("row_count", F.lit(0)) > F.coalesce("n_row_count", F.lit(0))) & F.coalesce("usable", F.lit(False)))
    pick = lambda c: F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    text = lambda c: F.coalesce(F.nullif(f"n_{c}", F.lit("")), c).alias(c)
    return j.select("name", text("model"), text("carrier"), pick("template"), pick("row_count"), pick("usable"), (F.coalesce("samples", F.lit(0)) + F.coalesce(F.col("n_").cast("int"), F.lit(0))).alias("samples"))


def feedback_append(entries: DataFrame, most: int = 10, key: int = 80) -> DataFrame:
    """``name, comment, ts, seq``: of comments that share their first ``key`` characters the newest, and of these the newest ``most``."""
    newest = (F.desc("ts"), F.desc("seq"))
    once = entries.withColumn("r", F.row_number().over(Window.partitionBy("name", F.substring("comment", 1, key)).orderBy(*newest))).where("r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(*newest))).where(F.col("place") <= most).drop("r")


def template_coverage(rows: DataFrame, expected: DataFrame, share: float = 0.5) -> DataFrame:
    """``doc_id, n_rows, ok``: whether a template gives at least max(1, half of the expected bills)."""
    got = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    least = F.greatest(F.lit(1), F.floor(F.col("bills") * share))
    return expected.join(got, "doc_id", "left").fillna(0, ["n_rows"]).select("doc_id", "n_rows", (F.col("n_rows") >= least).alias("ok"))


#: The fields that a template should fill.
IMPORTANT = ("shipper", "consignee", "weight", "port_of_loading", "port_of_discharge")


def never_filled(rows: DataFrame) -> DataFrame:
    """``doc_id, missing``: for each document with rows, the important fields that none of them fills (an absent column fills none)."""
    filled = lambda f: F.max(F.coalesce(F.col(f).cast("string"), F.lit("")) != "") if f in rows.columns else F.max(F.lit(False))
    own = rows.groupBy("doc_id").agg(*(filled(f).alias(f) for f in IMPORTANT))
    return own.select("doc_id", F.array_compact(F.array(*(F.when(~F.col(f), f) for f in IMPORTANT))).alias("missing"))


def rank_candidates(results: DataFrame) -> DataFrame:
    """``doc_id, provider, ok, n_rows, bonus`` -> the winner of each document: fit first, then rows, then bonus, then name."""
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("ok"), F.desc("n_rows"), F.desc("bonus"), "provider"))
    return results.withColumn("r", best).where("r = 1").drop("r")


def accept_refinement(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id, n_rows, gaps``: a refinement is taken if it closes a gap and keeps 95 % of the rows."""
    a = after.select("doc_id", F.col("n_rows").alias("rows_after"), F.col("gaps").alias("gaps_after"))
    return before.join(a, "doc_id").select("doc_id", ((F.col("gaps_after") < F.col("gaps")) & (F.col("rows_after") >= 0.95 * F.col("n_rows"))).alias("accepted"))


def row_pattern_hits(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """``doc_id, text`` -> lines of each document that match any pattern."""
    any_ = F.coalesce(*(F.when(F.regexp_like("text", F.lit(p)), True) for p in patterns), F.lit(False))
    return lines.groupBy("doc_id").agg(F.count_if(any_).alias("hits"))


def learning_triage(known: Column, has_rules: Column, diffs: Column) -> Column:
    """What to do for a format: discover it, patch it if its feedback (array of arrays of differences) has any, upgrade it without spatial rules, else discover again."""
    some = F.exists(F.coalesce(diffs, F.array()), lambda d: F.size(d) > 0)
    return F.when(~known, "discover").when(some, "patch").when(~has_rules, "upgrade").otherwise("discover")


def lookup(registry: DataFrame, names: DataFrame) -> DataFrame:
    """``wanted`` -> the registered format with that name or slug."""
    own = registry.select("name", slug(F.col("name")).alias("_slug"))
    by_name = names.join(own, F.col("wanted") == F.col("name")).select("wanted", "name", F.lit(0).alias("how"))
    by_slug = names.join(own, slug(F.col("wanted")) == F.col("_slug")).select("wanted", "name", F.lit(1).alias("how"))
    return by_name.unionByName(by_slug).groupBy("wanted").agg(F.min_by("name", F.struct("how", "name")).alias("name"))


def patch(registry: DataFrame, patches: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """``patches (name, columns)``: given values overwrite, and ``updated_at`` moves on."""
    own = patches.select("name", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = registry.join(own, "name", "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in registry.columns))


def delete(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Without the formats of which a name or slug is given (``wanted``)."""
    gone = names.select(slug(F.col("wanted")).alias("_slug"))
    return registry.withColumn("_slug", slug(F.col("name"))).join(gone, "_slug", "left_anti").drop("_slug")
