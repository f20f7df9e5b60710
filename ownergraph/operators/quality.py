"""Q1: the key and not-null contract the source declares but never enforces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Declared keys of the three tables.
TABLE_KEYS: dict[str, list[str]] = {
    "lei_records": ["lei"],
    "relationships": ["start_node_id", "end_node_id", "relationship_type"],
    "reporting_exceptions": ["lei", "exception_category"],
}


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a NULL part, with their row
    count. Reports only; the table itself is left as it is. The grouping is
    combined map-side, so a hot duplicated key costs one row per task."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    any_null = None
    for k in keys:
        part = F.col(k).isNull()
        any_null = part if any_null is None else (any_null | part)
    return counted.where((F.col("row_count") > 1) | any_null).select(
        *keys,
        F.col("row_count").cast("long").alias("row_count"),
        any_null.alias("has_null_key"),
    )
