"""Load the daily CSV files into Parquet tables.

Parity points with the source's CSV reader:

* every column is read as text, a header row names the columns; a byte order mark
  before it is no part of the first name;
* an empty field, quoted or not, becomes NULL;
* ``""`` inside a quoted field is a literal quote (``escape='"'``);
* quoted fields may hold line breaks (``multi_line``); one such file is read by many
  tasks (``split``, see ``csv_split``), the rows are those of Spark's own
  ``multiLine`` reader;
* malformed rows (too few or too many fields) and rows with invalid UTF-8 in a mapped
  column are not loaded. The latter are found from the bytes: a valid U+FFFD that the
  publisher wrote stays. Both are counted and kept in a table of rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ownergraph.operators.edges import bucket_column
from ownergraph.schema import COLUMN_MAPS, KIND_ENTITIES, KIND_EXCEPTIONS, KIND_RELATIONSHIPS
from ownergraph.sources import csv_split, store

# Clustered copies of the edges, beside the tables of the three kinds.
BY_CHILD, BY_PARENT = "rr_by_child", "rr_by_parent"
# The index of the names (``sources.name_index``).
NAME_GRAMS, NAME_GRAM_COUNTS = "name_grams", "name_gram_counts"
# Tables made from that of a kind: they go when it is replaced without them.
DERIVED = {KIND_ENTITIES: (NAME_GRAMS, NAME_GRAM_COUNTS), KIND_RELATIONSHIPS: (BY_CHILD, BY_PARENT)}
REJECTS = "_rejects"  # table name of a kind's rejects: the kind and this
MARK = "\u00ef\u00bb\u00bf"  # a UTF-8 byte order mark, read as Latin-1
# Buckets of a table by the hash of its key: few for small inputs, else so many that
# a list of ten keys reads under a tenth, and more when they would grow too large.
FEW_BUCKETS, BUCKETS, MOST_BUCKETS = 16, 128, 4_096
SMALL_INPUT, BUCKET_BYTES = 64 << 20, 32 << 20
REJECT_SCHEMA = T.StructType(
    [T.StructField("source_file", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("line", T.StringType())]
)


class MissingColumnsError(ValueError):
    """The CSV lacks columns of the column map (the load must fail)."""


def _headers(spark: SparkSession, paths: list[str], multi_line: bool) -> list[str]:
    names = spark.read.csv(paths, header=True, inferSchema=False, escape='"', multiLine=multi_line, encoding="ISO-8859-1").columns
    if names and names[0].startswith(MARK):
        names[0] = names[0][len(MARK) :].strip('"')
    return names


def _options(multi_line: bool) -> dict[str, str]:
    return {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "encoding": "ISO-8859-1",
            "multiLine": str(multi_line).lower()}


def _parsed(spark: SparkSession, paths: list[str], headers: list[str], multi_line: bool, split: bool) -> DataFrame:
    """Rows of ``__0``, ``__1``, ... (the fields as Latin-1 text), ``__bad`` (the
    record if its number of fields is wrong) and ``__file``."""
    names = [f"__{i}" for i in range(len(headers))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "__bad"]])

    def scanned(some: list[str]) -> DataFrame:
        # Column pruning is off in the scan: a parser that skips columns no longer
        # sees that a row is too short or too long.
        read = spark.read.schema(schema).options(header="true", columnPruning="false", **_options(multi_line))
        return read.csv(some).select(*names, "__bad", F.col("_metadata.file_path").alias("__file"))

    if not (multi_line and split):
        return scanned(paths)
    found = csv_split.blocks(spark, paths)
    odd_ones = csv_split.ill_quoted(found)
    good = found.join(spark.createDataFrame([(f,) for f in odd_ones], "file string"), "file", "left_anti") if odd_ones else found
    files = [r["file"] for r in good.select("file").distinct().collect()]  # one name a file
    parts = []
    if files:
        record = F.from_csv("record", ", ".join(f"{f.name} string" for f in schema), _options(True))
        parts.append(
            csv_split.split_records(spark, files, good)
            .select(record.alias("r"), F.col("file").alias("__file"))
            .select("r.*", "__file")
        )
    if odd_ones:
        parts.append(scanned(odd_ones))
    if not parts:
        return scanned(paths)  # no file has a line
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_with_rejects(
    spark: SparkSession, path: str | list[str], kind: str, multi_line: bool = True, split: bool = False
) -> DataFrame:
    """I1 + I2 with the rows that can't be loaded: the mapped columns, ``reason``
    (NULL for good rows, else 'fields' or 'encoding'), ``line`` (the rejected record)
    and ``source_file``."""
    column_map = COLUMN_MAPS[kind]
    paths = [path] if isinstance(path, str) else list(path)
    headers = _headers(spark, paths, multi_line)
    missing = [h for h in column_map if h not in headers]
    if missing:
        raise MissingColumnsError(f"{kind}: missing columns {missing}")
    raw = _parsed(spark, paths, headers, multi_line, split)
    at = {h: f"__{i}" for i, h in reversed(list(enumerate(headers)))}
    names = list(column_map.values())
    # The bytes were read one to one (as Latin-1) and are taken as UTF-8 here. Each
    # step is a projection of its own: what several columns need is worked out once.
    text = [F.encode(F.col(at[h]), "ISO-8859-1").cast("string").alias(name) for h, name in column_map.items()]
    fields = F.concat_ws(",", *[F.col(at[h]) for h in headers])
    kept = raw.select(*text, F.col("__bad"), F.col("__file"), fields.alias("__fields"))
    invalid = F.lit(False)
    for name in names:
        invalid = invalid | ~F.is_valid_utf8(name)
    reason = F.when(F.col("__bad").isNotNull(), F.lit("fields")).when(F.coalesce(invalid, F.lit(False)), F.lit("encoding"))
    judged = kept.withColumn("reason", reason)
    line = F.make_valid_utf8(F.encode(F.coalesce("__bad", "__fields"), "ISO-8859-1").cast("string"))
    good = F.col("reason").isNull()
    return judged.select(
        *[F.when(good, F.col(name)).alias(name) for name in names],
        "reason",
        F.when(~good, line).alias("line"),
        F.col("__file").alias("source_file"),
    )


def read_dataset_csv(
    spark: SparkSession, path: str | list[str], kind: str, multi_line: bool = True, split: bool = False
) -> DataFrame:
    """I1 + I2: scan the CSV file or files of one kind and project / rename by its
    column map; the good rows only."""
    rows = read_with_rejects(spark, path, kind, multi_line, split)
    # A filter is not moved below a count: below the parser it would parse every
    # field once more.
    counted = rows.observe(f"rows_of_{kind}", F.count(F.lit(1)).alias("rows"))
    return counted.where("reason IS NULL").select(*COLUMN_MAPS[kind].values())


def bucket_count(input_bytes: int) -> int:
    if input_bytes < SMALL_INPUT:
        return FEW_BUCKETS
    return max(BUCKETS, min(MOST_BUCKETS, input_bytes // BUCKET_BYTES))


def bucketed(df: DataFrame, key: str, n: int) -> tuple[DataFrame, str]:
    """The table with its bucket, the hash of ``key`` modulo ``n``, as a column
    whose name tells key and modulus (``edges.restrict`` reads it). Written as the
    partition column, a request list reads only the folders of its own buckets."""
    name = bucket_column(key, n)
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), name


def _write_rows(rows: DataFrame, load: store.Load, kind: str, partitions: int, buckets: int) -> tuple[int, int]:
    """Write good rows and rejects of a kind in one pass; their counts."""
    key = {KIND_ENTITIES: "lei", KIND_EXCEPTIONS: "lei"}.get(kind)
    tagged, parts = rows.withColumn("rejected", F.col("reason").isNotNull()), ["rejected"]
    if key:
        tagged, bucket = bucketed(tagged, key, buckets)
        parts.append(bucket)
        # One key's exceptions may be many: they are dealt out by their text too.
        spread = [F.pmod(F.xxhash64(*COLUMN_MAPS[kind].values()), F.lit(4))] if kind == KIND_EXCEPTIONS else []
        tagged = tagged.repartition(partitions, bucket, *spread).sortWithinPartitions("rejected", bucket, key)
    else:
        tagged = tagged.repartition(partitions)
    seen = Observation(f"load_{kind}")
    counted = tagged.observe(
        seen, F.count(F.when(~F.col("rejected"), 1)).alias("rows"), F.count(F.when(F.col("rejected"), 1)).alias("rejects")
    )
    counted.write.partitionBy(*parts).parquet(load.folder(kind))
    good, bad = int(seen.get["rows"]), int(seen.get["rejects"])
    columns = list(COLUMN_MAPS[kind].values()) + parts[1:]
    kept = T.StructType([T.StructField(c, T.IntegerType() if c in parts else T.StringType()) for c in columns])
    load.add(kind, kept, f"{kind}/rejected=false", rows=good, rejected=bad)
    load.add(kind + REJECTS, REJECT_SCHEMA, f"{kind}/rejected=true", rows=bad)
    return good, bad


def load_into(load: store.Load, kind: str, csv_path: str | list[str], multi_line: bool = True, partitions: int | None = None) -> int:
    """I3-I5 + I6 within a load: the table of ``kind`` and its rejects; the row count
    comes from the pass that writes them. What was made from the old table (``DERIVED``)
    leaves the store, unless the load writes it anew."""
    load.leave_out(*DERIVED.get(kind, ()))
    rows = read_with_rejects(load.spark, csv_path, kind, multi_line, split=True)
    buckets = bucket_count(store.size_of(load.spark, [csv_path] if isinstance(csv_path, str) else csv_path))
    return _write_rows(rows, load, kind, partitions or load.spark.sparkContext.defaultParallelism, buckets)[0]


def load_dataset(
    spark: SparkSession,
    kind: str,
    csv_path: str | list[str],
    store_path: str,
    multi_line: bool = True,
    out_partitions: int | None = None,
) -> int:
    """I3-I5 + I6: replace the table of ``kind`` in a store (see ``sources.store``)
    and return its row count. If the load fails the old table stays."""
    load = store.Load(spark, store_path)
    n = load_into(load, kind, csv_path, multi_line, out_partitions)
    load.publish()
    return n


def table_count(df: DataFrame, kind: str) -> DataFrame:
    """I6 as a DataFrame: ``(dataset_type, record_count)``."""
    return df.agg(F.count(F.lit(1)).cast("int").alias("record_count")).select(
        F.lit(kind).alias("dataset_type"), "record_count"
    )


def write_csv_with_headers(df: DataFrame, kind: str, out_path: str) -> None:
    """Write ``df`` (model column names) as a dataset CSV with the published
    headers; columns of the map that ``df`` lacks are written empty."""
    column_map = COLUMN_MAPS[kind]
    cols = [
        (F.col(name) if name in df.columns else F.lit(None).cast("string")).alias(header)
        for header, name in column_map.items()
    ]
    df.select(*cols).write.mode("overwrite").csv(out_path, header=True, escape='"', quoteAll=False)


def layout_relationships(load: store.Load, rels: DataFrame, partitions: int, buckets: int | None = None) -> None:
    """The access paths the source builds as indexes, as file layout.

    Two copies: by child and by parent. Each is partitioned by the hash bucket of
    its key, so a request list reads only the folders of its buckets (partition
    pruning at run time), and sorted by key inside. Rows are dealt out by ranges of
    (bucket, key, other end): a hot key (a parent owning a third of all edges) is cut
    across tasks and files.
    """
    if buckets is None:
        buckets = bucket_count(store.size_of(load.spark, [load.folder(KIND_RELATIONSHIPS)]))
    for key, other, name in (
        ("start_node_id", "end_node_id", BY_CHILD),
        ("end_node_id", "start_node_id", BY_PARENT),
    ):
        placed, bucket = bucketed(rels, key, buckets)
        (
            placed.repartitionByRange(partitions, bucket, key, other)
            .sortWithinPartitions(bucket, key, other, "relationship_type")
            .write.partitionBy(bucket)
            .parquet(load.folder(name))
        )
        load.add(name, placed.schema)
