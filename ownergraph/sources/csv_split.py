"""One CSV file, many tasks: records with quoted line breaks from byte ranges.

The file is read as lines, which Spark deals out in blocks. A line break lies inside
a quoted field if the number of quotes before it is odd (a doubled quote counts
twice). So the parities of the blocks, summed up in file order, tell for every block
whether it begins inside a field; from there each task finds the records of its
block. A record that goes on past its block comes in pieces, at most two a block,
which are put together apart from the rest.

This holds for files quoted as RFC 4180 has it. Files with a quote in the middle of
an unquoted field, or with an odd number of quotes, are named by ``ill_quoted``, and
their reader takes them one task per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownergraph.session import materialize

# A quote with neither a delimiter, a quote nor a line end at either side.
STRAY = r'[^,"\r]"[^,"\r]'
RECORD = "file string, start long, place int, record string"
RECORD_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("record", pa.string())])
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3  # places; the header comes as place -1
HEADER = -1


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, start, odd, open, total, strays, returns)`` per block: whether it
    holds an odd number of quotes, whether it begins inside a field, whether its file
    holds an odd number in all, how many stray quotes the file has, and whether its
    first line ends with a carriage return. One row a block."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per_block = (
        _lines(spark, paths)
        .groupBy("file", "start")
        .agg((F.sum(quotes) % 2).alias("odd"), F.count(F.when(F.col("value").rlike(STRAY), 1)).alias("s"),
             F.first(F.col("value").endswith("\r")).alias("r"))
    )
    in_file = Window.partitionBy("file").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    return materialize(
        per_block.select(
            "file",
            "start",
            "odd",
            (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("open"),
            (F.sum("odd").over(whole) % 2).alias("total"),
            F.sum("s").over(whole).alias("strays"),
            F.max(F.col("r") & (F.col("start") == 0)).over(whole).alias("returns"),
        )
    )


def ill_quoted(found: DataFrame) -> list[str]:
    """Files that can't be split by their quotes (one name a file)."""
    return [r["file"] for r in found.where("total = 1 OR strays > 0").select("file").distinct().collect()]


def _records(batches) -> Iterator[pa.RecordBatch]:
    at = None  # (file, start) of the block
    held: list[bytes] = []
    odd = first_of_file = False
    place = WHOLE
    out: list[tuple] = []

    def put(kind: int) -> bool:
        text = b"\n".join(held)
        held.clear()
        if kind in (WHOLE, HEAD, HEADER) and text.endswith(b"\r"):
            text = text[:-1]
        if not text and kind in (WHOLE, HEADER):  # blank lines are no records
            return False
        out.append((*at, kind, text.decode("latin-1")))
        return True

    def close() -> None:
        """The block's last lines: a field is still open."""
        if held:
            put(MIDDLE if place == HEAD else TAIL)

    for b in batches:
        values = b.column("value").to_pylist()
        for file, start, opened, value in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), b.column("open").to_pylist(), values):
            if at != (file, start):
                close()
                at, odd, first_of_file = (file, start), bool(opened), start == 0
                place = HEAD if odd else WHOLE
            held.append(value)
            odd ^= value.count(b'"') % 2 == 1
            if not odd:
                found = put(HEADER if first_of_file and place == WHOLE else place)
                place, first_of_file = WHOLE, first_of_file and not found
        if len(out) >= 2_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), RECORD_ARROW)], schema=RECORD_ARROW)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), RECORD_ARROW)], schema=RECORD_ARROW)


def _joined(records: DataFrame) -> DataFrame:
    """``(file, record)`` of the records that come in pieces: a tail opens one, middles
    go on with it, a head ends it."""
    pieces = records.where(F.col("place") > WHOLE)
    order = Window.partitionBy("file").orderBy("start", "place")
    numbered = pieces.withColumn("n", F.count(F.when(F.col("place") == TAIL, 1)).over(order))
    joined = numbered.groupBy("file", "n").agg(
        F.sort_array(F.collect_list(F.struct("start", "place", "record"))).alias("p"), F.min("start").alias("from")
    )
    text = F.array_join(F.transform("p", lambda x: x["record"]), "\n")
    # A header that goes past the first block opens with a tail at 0, where no whole
    # header is found: the file's first joined record is the header then.
    headers = records.where(F.col("place") == HEADER).select("file").distinct().withColumn("has", F.lit(True))
    return joined.join(headers, "file", "left").where("has OR n > 1 OR from > 0").select("file", text.alias("record"))


def split_records(spark: SparkSession, paths: list[str], found: DataFrame) -> DataFrame:
    """``(file, record)``: every record of the files but their headers, its bytes as
    Latin-1 text. ``found`` is ``blocks`` of these files."""
    lines = _lines(spark, paths).select("file", "start", F.col("value").cast("binary").alias("value"))

    def records_of(some: DataFrame) -> DataFrame:
        opened = some.select(F.col("file").alias("__f"), F.col("start").alias("__s"), "open")
        # A row a block; the lines keep their order in a broadcast join.
        known = lines.join(F.broadcast(opened), (F.col("file") == F.col("__f")) & (F.col("start") == F.col("__s")))
        return known.select("file", "start", "open", "value").mapInArrow(_records, RECORD)

    out = records_of(found).where(F.col("place") == WHOLE).select("file", "record")
    # Blocks with a record that goes over their bounds; they are read once more.
    cut = found.where("open = 1 OR (open + odd) % 2 = 1")
    if not cut.isEmpty():
        out = out.unionByName(_joined(records_of(cut)))
    # Where lines end with both, the pair inside a field is one line break.
    ends = found.select(F.col("file").alias("__f"), "returns").distinct()
    both = out.join(F.broadcast(ends), F.col("file") == F.col("__f"))
    return both.select(
        "file", F.when(F.col("returns"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record")).alias("record")
    )
