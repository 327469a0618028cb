"""Corrections over extracted fields and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD = ["doc_id", "page_no", "field_key"]


def latest(log: DataFrame) -> DataFrame:
    """A change log (``doc_id, page_no, field_key, value, ts, seq, op`` and, where boxes are drawn, ``box``) -> its state: the last write of each field, none after a clear."""
    kept = [c for c in ("value", "box") if c in log.columns]
    last = log.groupBy(*FIELD).agg(F.max_by(F.struct(*kept, "op"), F.struct("ts", "seq")).alias("l"))
    return last.where("l.op <> 'clear'").select(*FIELD, *(f"l.{c}" for c in kept))


def overlay(fields: DataFrame, state: DataFrame) -> DataFrame:
    """Stored values replace or add fields, with their lines; a stored box replaces the field's own, which stays where none was drawn; ``corrected`` marks them."""
    none = F.lit(None).cast("array<int>")
    box = lambda df: F.col("box") if "box" in df.columns else none
    own = state.select(*FIELD, F.col("value").alias("stored"), box(state).alias("drawn"), F.lit(True).alias("hit"))
    out = fields.select(*FIELD, "value", box(fields).alias("box")).join(own, FIELD, "full_outer")
    hit = F.coalesce("hit", F.lit(False))
    value = F.when(hit, F.coalesce("stored", F.lit(""))).otherwise(F.col("value"))
    drawn = F.when(F.size("drawn") > 0, F.col("drawn"))
    return out.select(*FIELD, value.alias("value"), F.split(value, r"\R").alias("lines"), F.coalesce(drawn, "box").alias("box"), hit.alias("corrected"))


def update_rows(records: DataFrame, patches: DataFrame, columns: list[str], read_only: tuple[str, ...] = ()) -> DataFrame:
    """``patches (doc_id, row_no, one column for each of columns)``: values that are given replace; touched rows are flagged; rows that are not there and read-only columns are left alone."""
    open_ = [c for c in columns if c not in read_only]
    own = patches.select("doc_id", "row_no", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in open_))
    out = records.join(own, ["doc_id", "row_no"], "left")
    cols = [F.coalesce(f"_{c}", c).alias(c) if c in open_ else F.coalesce("_hit", "user_edited").alias(c) if c == "user_edited" else F.col(c) for c in records.columns]
    return out.select(*cols)


def reconcile(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of a document win if there are as many as in the fresh parse; else the fresh ones."""
    n = lambda df, c: df.groupBy("doc_id").agg(F.count("*").alias(c))
    same = n(stored, "a").join(n(fresh, "b"), "doc_id").where("a = b").select("doc_id")
    return stored.join(same, "doc_id", "left_semi").unionByName(fresh.join(same, "doc_id", "left_anti"))


def reset_edited(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """Drop the flag of chosen rows (``doc_id, row_no``), keep their values."""
    out = records.join(chosen.select("doc_id", "row_no", F.lit(True).alias("_hit")), ["doc_id", "row_no"], "left")
    return out.withColumn("user_edited", F.when(F.col("_hit"), False).otherwise(F.col("user_edited"))).select(*records.columns)


def apply_fixes(records: DataFrame, fixes: DataFrame, column: str) -> DataFrame:
    """``fixes (doc_id, row_no, value)``: non-blank values that differ override a column and flag the row."""
    out = records.join(fixes.select("doc_id", "row_no", F.nullif(F.trim("value"), F.lit("")).alias("_v")), ["doc_id", "row_no"], "left")
    new = F.col("_v").isNotNull() & ~F.col("_v").eqNullSafe(F.col(column))
    return out.withColumns({"user_edited": F.when(new, True).otherwise(F.col("user_edited")), column: F.when(new, F.col("_v")).otherwise(F.col(column))}).select(*records.columns)
