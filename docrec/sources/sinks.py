"""Exports: column order, fixed layouts and gaps as empty texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts under the union of their columns in the order first seen; what a part lacks is empty."""
    if not parts:
        raise ValueError("nothing to export")
    texts = [p.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in p.columns)) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texts).fillna("")


def drop_internal(df: DataFrame) -> DataFrame:
    """Without columns whose names start with _."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def layout_compatible(*parts: DataFrame) -> list[DataFrame]:
    """The parts that have a bill or vessel column, whatever its values."""
    return [p for p in parts if {"bl_number", "vessel"} & set(p.columns)]


def write_csv(df: DataFrame, path: str) -> None:
    df.fillna("").write.mode("overwrite").csv(path, header=True, emptyValue="")


#: The standard fields of an extraction, in order.
STANDARD = (
    "BL_Number", "Booking_Number", "Container_Number", "Seal_Number", "Vessel_Name", "Voyage_Number", "Date", "Port_of_Loading",
    "Port_of_Discharge", "Shipper", "Consignee", "Notify_Party", "Gross_Weight", "Net_Weight", "Quantity", "Description",
)


def standard_fields(df: DataFrame) -> DataFrame:
    """Source, Template, Page and the 16 standard fields as texts; what is not there is empty."""
    cols = ("Source", "Template", "Page", *STANDARD)
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in cols))
