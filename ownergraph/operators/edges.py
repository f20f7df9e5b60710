"""Shared edge helpers: active edges, request restriction, one chosen parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.schema import ACTIVE

SHORT_LIST = 20_000  # requested LEIs (of 20 characters) that are broadcast

EDGE_COLUMNS = ["start_node_id", "end_node_id", "relationship_type", "relationship_status"]


def bucket_column(key: str, n: int) -> str:
    """Name of the partition column that holds the hash of ``key`` modulo ``n``."""
    return f"{key}__in_{n}"


def _bucket_of(df: DataFrame, key: str) -> tuple[str, int] | None:
    """The bucket column of ``key`` and its modulus, if the table has one."""
    for name in df.columns:
        before, _, n = name.rpartition("__in_")
        if before == key and n.isdigit() and int(n):
            return name, int(n)
    return None


def active_edges(rels: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges with status ACTIVE (NULL status is dropped), optionally of
    the given types. Both filters reach the Parquet scan as pushed filters."""
    edges = rels.where(F.col("relationship_status") == ACTIVE)
    if types:
        edges = edges.where(F.col("relationship_type").isin(*types))
    buckets = [b[0] for b in (_bucket_of(rels, "start_node_id"), _bucket_of(rels, "end_node_id")) if b]
    return edges.select(*EDGE_COLUMNS, *buckets)


def restrict(df: DataFrame, column: str, requests: DataFrame | None) -> DataFrame:
    """Keep rows of ``df`` whose ``column`` is a requested LEI.

    ``requests`` is a DataFrame with a ``lei`` column (None = everything).
    A semi join never duplicates rows, whatever the request list holds. If the table
    is partitioned by the hash bucket of ``column``, the requests' buckets are joined
    too: a list of up to ``SHORT_LIST`` rows, counted first, is broadcast, and Spark
    reads only these partitions (dynamic partition pruning). A longer list asks for
    nearly all buckets anyway and is joined by a shuffle.
    """
    if requests is None:
        return df
    keys = requests.select(F.col("lei").alias("__req_lei"))
    bucket = _bucket_of(df, column)
    if bucket is None:
        return df.join(keys, df[column] == keys["__req_lei"], "left_semi")
    name, n = bucket
    # A filter on the requests' side is what lets Spark prune by it.
    keys = keys.where(F.length("__req_lei") > 0).withColumn("__req_in", F.pmod(F.xxhash64("__req_lei"), F.lit(n)).cast("int"))
    if requests.limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        keys = F.broadcast(keys)
    same = (df[column] == keys["__req_lei"]) & (df[name] == keys["__req_in"])
    return df.join(keys, same, "left_semi").drop(name)


def chosen_parent(rels: DataFrame, rel_type: str, requests: DataFrame | None = None) -> DataFrame:
    """One parent per child for ``rel_type``: ``(start_node_id, end_node_id)``.

    The source leaves the choice among several active parents open; we take
    the smallest parent LEI. A grouped ``min`` is combined map-side, so a
    child with very many parents never lands whole in one task.
    """
    edges = restrict(active_edges(rels, [rel_type]), "start_node_id", requests)
    edges = edges.where(F.col("start_node_id").isNotNull())
    return edges.groupBy("start_node_id").agg(F.min("end_node_id").alias("end_node_id"))


def entity_names(entities: DataFrame, key: str = "__ent_lei") -> DataFrame:
    """(lei, legal_name) slice of the entity table for name joins."""
    return entities.select(F.col("lei").alias(key), F.col("legal_name").alias("__ent_name"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
