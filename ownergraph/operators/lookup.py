"""L1-L3: entity lookup, not-found detection, request cleaning, name search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.functions.normalize import entity_projection, is_valid_lei, normalize_lei
from ownergraph.operators.edges import restrict
from ownergraph.schema import DEFAULT_SEARCH_LIMIT, ENTITY_COLUMNS


def normalize_requests(raw: DataFrame, input_col: str = "lei_input") -> DataFrame:
    """E1 + E2: ``(lei_input, lei, is_valid)`` - stripped, upper-cased and
    checked for length 20. Invalid rows are kept and flagged, never dropped."""
    lei = normalize_lei(input_col)
    return raw.select(F.col(input_col), lei.alias("lei"), is_valid_lei(lei).alias("is_valid"))


def valid_requests(raw: DataFrame, input_col: str = "lei_input") -> DataFrame:
    """Requests that pass E2, as a ``lei`` column ready for the operators."""
    return normalize_requests(raw, input_col).where("is_valid").select("lei")


def get_entities(entities: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """L1: the 10-column entity projection for each requested LEI."""
    return restrict(entities, "lei", requests).select(*entity_projection())


def missing_leis(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """L2: requested LEIs that are not in the entity table (anti join)."""
    keys = entities.select(F.col("lei").alias("__ent_lei"))
    return requests.join(keys, requests["lei"] == keys["__ent_lei"], "left_anti")


def like_pattern(text: str) -> str:
    """ILIKE pattern ``%text%``: ``%`` and ``_`` in the text stay wildcards,
    a backslash stays a plain character (doubled for Spark's escape rule)."""
    return "%" + text.replace("\\", "\\\\") + "%"


def search_by_name(
    entities: DataFrame, text: str, limit: int | None = DEFAULT_SEARCH_LIMIT
) -> DataFrame:
    """L3: case-insensitive substring search on the legal name, ordered by
    name then LEI, first ``limit`` rows (None = all matches).

    A small limit plans as TakeOrderedAndProject (each task keeps only its own
    top ``limit``); limits above ``spark.sql.execution.topKSortFallbackThreshold``
    fall back to a distributed sort.
    """
    hits = entities.select(*ENTITY_COLUMNS).where(F.col("legal_name").ilike(like_pattern(text)))
    top = hits.orderBy(F.col("legal_name").asc_nulls_last(), F.col("lei").asc())
    if limit is not None:
        top = top.limit(limit)
    return top.select(*entity_projection())


def search_title(hits: DataFrame, text: str) -> DataFrame:
    """A3: one row ``title`` - "Name Search: 'text' (N results)" ('result'
    when N is 1), or "No entities found matching 'text'." when empty."""
    n = F.count(F.lit(1))
    title = F.when(n == 0, F.lit(f"No entities found matching '{text}'.")).otherwise(
        F.concat(
            F.lit(f"Name Search: '{text}' ("),
            n.cast("string"),
            F.when(n == 1, F.lit(" result)")).otherwise(F.lit(" results)")),
        )
    )
    return hits.agg(title.alias("title"), n.cast("long").alias("result_count"))
