"""Load every downloaded dataset, then record the loads."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ownergraph.schema import DATASET_KINDS, KIND_ENTITIES, KIND_RELATIONSHIPS
from ownergraph.sources import csv_ingest, metadata, name_index, store


class MissingDatasetError(FileNotFoundError):
    """A dataset kind has no CSV file to load."""


def load_all(
    spark: SparkSession,
    files: dict[str, str | list[str] | None],
    table_dir: str,
    publish_dates: dict[str, str | None] | None = None,
    metadata_path: str | None = None,
) -> dict[str, int]:
    """Replace the table of every kind in ``files`` in the store ``table_dir`` and
    upsert its metadata row. Returns kind -> row count.

    Every kind is read once; its rows are counted while they are written. The edges
    are then written twice more, by either end, and the names' grams once (I13). All tables and copies become
    current together: a load that fails leaves the previous one as it was, its load
    records included. A kind mapped to ``None`` (no file found) is an error, as in the
    source; a missing publish date is recorded as 'unknown'.
    """
    publish_dates = publish_dates or {}
    missing = [k for k, p in files.items() if not p]
    if missing:
        raise MissingDatasetError(f"no CSV file for {missing}")
    load = store.Load(spark, table_dir)
    counts = {kind: csv_ingest.load_into(load, kind, files[kind]) for kind in DATASET_KINDS if kind in files}
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if KIND_ENTITIES in counts:
        name_index.layout_names(load, load.read(KIND_ENTITIES), shuffles)
    if KIND_RELATIONSHIPS in counts:
        csv_ingest.layout_relationships(load, load.read(KIND_RELATIONSHIPS), shuffles)
    load.publish()
    if metadata_path:
        loads = spark.createDataFrame(
            [(k, publish_dates.get(k), n) for k, n in counts.items()],
            "dataset_type string, publish_date string, record_count int",
        )
        # Only the loaded kinds are rewritten (dynamic partition overwrite).
        metadata.write_metadata(metadata.metadata_rows(loads), metadata_path)
    return counts
