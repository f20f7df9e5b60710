"""Pick the newest snapshot file per kind; decide what to refresh."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.schema import SNAPSHOT_KIND_PATTERN


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """File listing of a folder as a DataFrame ``(path)`` (no contents read)."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files


def latest_snapshots(files: DataFrame, publisher: str, path_col: str = "path") -> DataFrame:
    """``(dataset_type, path)`` - per kind the lexicographically last
    file whose name matches the snapshot naming; kinds without a file are
    absent. ``publisher`` is the publisher's part of the file names: files of
    others are not taken."""
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    kind = F.regexp_extract(name, SNAPSHOT_KIND_PATTERN.format(publisher=re.escape(publisher)), 1)
    tagged = files.select(kind.alias("dataset_type"), F.col(path_col).alias("path"))
    return tagged.where(F.col("dataset_type") != "").groupBy("dataset_type").agg(
        F.max("path").alias("path")
    )


def stale_datasets(
    remote: DataFrame, local: DataFrame, snapshots: DataFrame, force: bool = False
) -> DataFrame:
    """I8: which kinds to download.

    ``remote``    - ``(dataset_type, publish_date)`` announced by the
                    publisher ('unknown' when the lookup failed);
    ``local``     - ``(dataset_type, local_date)`` of the last download;
    ``snapshots`` - ``(dataset_type, path)`` of the files present (I7).

    A kind is skipped only when its local date equals the remote date and its
    file exists, unless ``force``.
    """
    joined = remote.join(local, "dataset_type", "left").join(snapshots, "dataset_type", "left")
    same = F.coalesce(F.col("local_date") == F.col("publish_date"), F.lit(False))
    needed = F.lit(force) | ~same | F.col("path").isNull()
    return joined.select(
        "dataset_type",
        F.col("publish_date").alias("remote_date"),
        "local_date",
        "path",
        needed.alias("needs_download"),
    )
