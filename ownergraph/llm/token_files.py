"""Token ids of documents as flat binary files.

Documents in ascending (doc_id, text hash) order are cut into ranges; each task
writes one range as

* ``part-NNNNN.bin``  ids one after the other, unsigned 16 bit, or 32 bit if
  the vocabulary needs it, little-endian;
* ``part-NNNNN.idx``  unsigned 64-bit offsets (in ids) of the documents within
  the part, one more than documents;
* ``part-NNNNN.doc``  per document a byte (1: the id is known, 0: null) and the
  signed 64-bit doc_id.

The parts' bases in the whole corpus are prefix sums over the parts' counts.
Readers map the files into memory. Files appear under their final name only when
complete, and a repeated task writes the same bytes, so lost executors do no harm.

Null and empty texts hold the end id alone. Rows with the same doc_id stand next
to each other in the order of a hash of their texts; a null doc_id comes first.
An empty table gives parts without documents. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.llm.word_ids import word_ids
from ownergraph.session import scratch_path

DOC = np.dtype([("known", "u1"), ("doc_id", "<i8")])
PART_SCHEMA = "part int, n_docs long, n_ids long"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority of the file system that Spark uses."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop).toString()


class SharedFolder:
    """Whole files in a folder that all executors share; local paths (mounted
    shared disks) are mapped into memory, other stores read by pyarrow."""

    def __init__(self, uri: str) -> None:
        at = urlparse(uri)
        self.local = at.scheme in ("", "file")
        if self.local:
            self.base, self.fs = unquote(at.path) if at.scheme else uri, None
        else:
            self.fs, self.base = pyarrow.fs.FileSystem.from_uri(uri)

    def write(self, name: str, blocks) -> int:
        """Write the byte blocks under a name of this attempt, then rename."""
        context = TaskContext.get()
        trial = f"{self.base}/.{name}.{context.taskAttemptId() if context else os.getpid()}"
        written = 0
        if self.local:
            os.makedirs(self.base, exist_ok=True)
        else:
            self.fs.create_dir(self.base, recursive=True)
        with open(trial, "wb") if self.local else self.fs.open_output_stream(trial) as out:
            for block in blocks:
                out.write(block)
                written += len(block)
        if self.local:
            os.replace(trial, f"{self.base}/{name}")
        else:
            self.fs.move(trial, f"{self.base}/{name}")
        return written

    def array(self, name: str, dtype: np.dtype) -> np.ndarray:
        path = f"{self.base}/{name}"
        if not self.local:
            with self.fs.open_input_file(path) as f:
                return np.frombuffer(f.read(), dtype=dtype)
        if os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        return np.memmap(path, dtype=dtype, mode="r")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Write the files of ``docs(doc_id, text)`` into ``folder`` and return
    ``(part, n_docs, n_ids, base)``, a row per part."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)

    def write(batches):
        part = TaskContext.get().partitionId()
        words, store = word_ids(tokenizer), SharedFolder(folder)
        end, size = words.pack([end_id]), words.dtype.itemsize
        offsets, ids_of, known = [np.zeros(1, "<u8")], [], []

        def blocks():
            at = 0
            for batch in batches:
                rows = [x + end for x in words.encode(batch.column("text").to_pylist())]
                ends = at + np.cumsum([len(x) // size for x in rows], dtype="<u8")
                offsets.append(ends.astype("<u8"))
                at = int(ends[-1]) if len(ends) else at
                doc = batch.column("doc_id")
                known.append(doc.is_valid().to_numpy(zero_copy_only=False))
                ids_of.append(doc.fill_null(0).to_numpy(zero_copy_only=False))
                yield b"".join(rows)

        n_ids = store.write(f"part-{part:05d}.bin", blocks()) // size
        index = np.concatenate(offsets)
        doc = np.zeros(len(index) - 1, DOC)
        if len(doc):
            doc["known"], doc["doc_id"] = np.concatenate(known), np.concatenate(ids_of)
        store.write(f"part-{part:05d}.idx", [index.tobytes()])
        store.write(f"part-{part:05d}.doc", [doc.tobytes()])
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(doc)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())}
        )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("__h").asc()]
    written = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__h"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(write, PART_SCHEMA)
        .collect()  # a row per part
    )
    written.sort(key=lambda r: r.part)
    bases = np.concatenate([[0], np.cumsum([r.n_ids for r in written], dtype="int64")]).tolist()
    return spark.createDataFrame(
        [(r.part, r.n_docs, r.n_ids, b) for r, b in zip(written, bases)], PART_SCHEMA + ", base long"
    )


def read_token_files(parts: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` from the files."""
    spark = parts.sparkSession
    folder = qualified(spark, folder)

    def read(batches):
        dtype, store = word_ids(tokenizer).dtype, SharedFolder(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                index = store.array(f"part-{part:05d}.idx", np.dtype("<u8")).astype("int64")
                ids = store.array(f"part-{part:05d}.bin", dtype)
                doc = store.array(f"part-{part:05d}.doc", DOC)
                for i in range(0, len(doc), 4096):
                    cut, own = index[i : i + 4097], doc[i : i + 4096]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(own["doc_id"].astype("int64"), mask=own["known"] == 0),
                            "start": pa.array(cut[:-1] + base),
                            "n_tokens": pa.array(np.diff(cut)),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write and read back; ``folder`` must be shared by all executors."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id), folder, tokenizer)
