"""I13 for names: a stored index of the legal names' grams.

Every position of a lower-cased name gives the gram of three characters that begins
there; two end marks behind the name complete the last ones. So a text of one or two
characters occurs in a name just where a gram begins with it. Two tables, written when
entities are loaded:

* ``name_grams``: ``(gram, lei)``, each pair once, partitioned by the hash bucket of
  the gram and sorted by gram inside. Rows are dealt out by ranges of (bucket, gram,
  lei): a gram of a third of all names is cut across tasks and files.
* ``name_gram_counts``: ``(gram, names)``, the dictionary. Its size follows the
  distinct grams, not the names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.schema import KIND_ENTITIES
from ownergraph.session import written
from ownergraph.sources import csv_ingest, store

GRAMS, COUNTS = csv_ingest.NAME_GRAMS, csv_ingest.NAME_GRAM_COUNTS
GRAM = 3
END = "\u0003"  # end mark; a name that holds it only gives candidates more


@dataclass
class NameIndex:
    postings: DataFrame  # gram, lei, bucket
    counts: DataFrame  # gram, names


def name_grams(name: Column) -> Column:
    """The distinct grams of a name, lower-cased as ILIKE compares it."""
    marked = F.concat(F.lower(name), F.lit(END * (GRAM - 1)))
    starts = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(marked, i, F.lit(GRAM))))


def layout_names(load: store.Load, entities: DataFrame, partitions: int, buckets: int | None = None) -> None:
    """Write the index of ``entities`` (lei, legal_name) within a load."""
    if buckets is None:
        buckets = csv_ingest.bucket_count(store.size_of(load.spark, [load.folder(KIND_ENTITIES)]))
    names = entities.where("lei IS NOT NULL AND legal_name IS NOT NULL")
    # A name's grams are distinct; equal pairs come only of a LEI that is there twice.
    repeated = written(names.groupBy("lei").count().where("count > 1").select("lei"), "repeated-leis")
    grams = F.explode(name_grams(F.col("legal_name"))).alias("gram")
    once = names.join(repeated, "lei", "left_anti").select(grams, "lei")
    again = names.join(repeated, "lei", "left_semi").select(grams, "lei").distinct()
    placed, bucket = csv_ingest.bucketed(once.unionByName(again), "gram", buckets)
    (
        placed.repartitionByRange(partitions, bucket, "gram", "lei")
        .sortWithinPartitions(bucket, "gram", "lei")
        .write.partitionBy(bucket)
        .parquet(load.folder(GRAMS))
    )
    load.add(GRAMS, placed.schema)
    # Counted from the stored rows, combined per task.
    counts = load.read(GRAMS).groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    counts.sortWithinPartitions("gram").write.parquet(load.folder(COUNTS))
    load.add(COUNTS, counts.schema)


def open_index(spark: SparkSession, store_path: str) -> NameIndex | None:
    """The index of the store's current entities, if it has one."""
    tables = store.manifest(spark, store_path)
    if GRAMS not in tables or COUNTS not in tables:
        return None
    return NameIndex(store.read_table(spark, store_path, GRAMS), store.read_table(spark, store_path, COUNTS))
