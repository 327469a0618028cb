"""Running page headers and defaults of carrier manifests; their lines are read by ``carrier``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(pages: DataFrame, *cols: str) -> DataFrame:
    """Page headers become running state: the last value seen up to each page."""
    seen = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumns({c: F.last(F.nullif(c, F.lit("")), ignorenulls=True).over(seen) for c in cols})


def default_shipowner(records: DataFrame, owner: str) -> DataFrame:
    return records.withColumn("shipowner", F.coalesce(F.nullif(F.trim("shipowner"), F.lit("")), F.lit(owner)))
