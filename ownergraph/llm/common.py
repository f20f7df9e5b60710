"""Shared helpers: reading tables, written intermediate tables, batch limits."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession

from ownergraph.session import ensure_checkpoint_dir, scratch_path

# Python workers get texts in batches of at most this many rows and bytes, so a
# run of very long texts does not pile up in one batch.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20


_SHIPPED: set[str] = set()  # applications whose executors have this package


def _ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (its code, no data)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    name = os.path.join(tempfile.mkdtemp(prefix="ownergraph-code-"), "ownergraph.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(os.path.join(top, "ownergraph")):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, code on the executors and Arrow batch limits."""
    ensure_checkpoint_dir(spark)
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back:
    the lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that no later step reads."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps: they go when the
    driver's garbage collector has dropped the plans that made them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
