"""Load bookkeeping (one row per dataset kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.schema import DATASET_LABELS, METADATA_SCHEMA


def empty_metadata(spark: SparkSession) -> DataFrame:
    """The metadata table before any load."""
    return spark.createDataFrame([], METADATA_SCHEMA)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The stored metadata table, or an empty one when nothing was loaded: when
    the path's own file system says that it does not exist. Other errors rise."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return empty_metadata(spark)
    return spark.read.schema(METADATA_SCHEMA).parquet(path)


def metadata_rows(loads: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Rows to upsert from ``(dataset_type, publish_date, record_count)``;
    a missing publish date becomes 'unknown', ``loaded_at`` defaults to now."""
    stamp = loaded_at if loaded_at is not None else F.current_timestamp()
    return loads.select(
        F.col("dataset_type").cast("string"),
        F.coalesce(F.col("publish_date"), F.lit("unknown")).alias("publish_date"),
        stamp.cast("timestamp").alias("loaded_at"),
        F.col("record_count").cast("int").alias("record_count"),
    )


def upsert_metadata(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace the rows of the updated dataset kinds, keep the others."""
    kept = current.join(
        updates.select("dataset_type"), "dataset_type", "left_anti"
    )
    return kept.unionByName(updates.select(*current.columns))


def write_metadata(updated: DataFrame, path: str) -> None:
    """Persist with one folder per kind; dynamic partition overwrite replaces
    only the kinds present in ``updated``."""
    (
        updated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_type")
        .parquet(path)
    )


def status(metadata: DataFrame) -> DataFrame:
    """Metadata rows ordered by kind."""
    return metadata.select(*[f.name for f in METADATA_SCHEMA.fields]).orderBy("dataset_type")


def label_of(kind_col: str = "dataset_type") -> Column:
    """Display label of a kind (falls back to the raw kind); a literal map,
    so no join is needed."""
    pairs = []
    for kind, label in DATASET_LABELS.items():
        pairs += [F.lit(kind), F.lit(label)]
    return F.coalesce(F.create_map(*pairs)[F.col(kind_col)], F.col(kind_col))


def status_report(metadata: DataFrame) -> DataFrame:
    """Display rows - label, publish date, time to the second, count
    with thousands separators."""
    return status(metadata).select(
        "dataset_type",
        label_of().alias("dataset"),
        F.col("publish_date").cast("string").alias("publish_date"),
        F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"),
        F.format_number(F.col("record_count"), 0).alias("records"),
    )
