"""Spark session defaults and the shared scratch / checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings every job of the library relies on. AQE re-plans joins at run time
# (broadcast when a side turns out small, splits skewed partitions), so no
# operator hard-codes a broadcast of data whose size is not bounded.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Top-k above this many rows is planned as a sort, not a per-task heap.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # The walks checkpoint every level; delete the files of levels no longer
    # referenced instead of letting them pile up in the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "ownergraph",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset and let the launcher decide; set
    ``shuffle_partitions`` to roughly (input bytes / 128 MB) - AQE coalesces
    small partitions at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``.
    Only when nothing is configured on a local master (tests) a private
    temporary folder is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001 - conf lookup may fail in Connect mode
            configured = None
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ownergraph-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ownergraph-scratch/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the scratch folder. Cuts the lineage as a
    checkpoint does, and tells the planner its size: a checkpoint counts as huge, so
    Spark would build a filter of the other side for it and give up pruning by it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(
    df: DataFrame, by: tuple[str, list] | None = None
) -> tuple[DataFrame, int | list[int]]:
    """Reliable checkpoint plus row counts, observed while the checkpoint job
    runs (no extra job to ask whether the result is empty).

    With ``by=(column, values)`` the counts per value are returned as a list.
    """
    ensure_checkpoint_dir(df.sparkSession)
    obs = Observation(f"rows_{uuid.uuid4().hex}")
    if by is None:
        metrics = [F.count(F.lit(1)).alias("n0")]
    else:
        column, values = by
        metrics = [
            F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(f"n{i}") for i, v in enumerate(values)
        ]
    out = df.observe(obs, *metrics).checkpoint(eager=True)
    got = obs.get
    counts = [int(got[f"n{i}"] or 0) for i in range(len(metrics))]
    return out, (counts[0] if by is None else counts)
