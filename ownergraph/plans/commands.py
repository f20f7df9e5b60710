"""The source's commands as compositions of the operators, for request lists.

* ``lei_report``  - ``lei CODE...``: clean the inputs (E1/E2), report unknown
  LEIs (L2), build the report (P1) and its display lines (P2).
* ``lei_tree``    - ``lei CODE... --tree``: corporate group of each input (H4)
  and the numbered listing of each group (H7).
* ``name_search`` - ``name TEXT``: top-k search (L3), title (A3), ISINs (S4).
* ``status``      - ``status``: the metadata table for display (I11/I12).

All take and return DataFrames; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.operators import hierarchy, listing, lookup, report, search
from ownergraph.schema import (
    DEFAULT_SEARCH_LIMIT,
    KIND_ENTITIES,
    KIND_EXCEPTIONS,
    KIND_RELATIONSHIPS,
    MAX_HIERARCHY_DEPTH,
)
from ownergraph.sources import csv_ingest, name_index, store
from ownergraph.sources import isin as isin_src
from ownergraph.sources import metadata


@dataclass
class Tables:
    entities: DataFrame
    relationships: DataFrame
    exceptions: DataFrame
    isins: DataFrame | None = None  # (lei, isins array) from isin_map
    relationships_by_parent: DataFrame | None = None  # the same edges, clustered by parent
    names: name_index.NameIndex | None = None  # stored index of the entities' names


def open_tables(spark: SparkSession, table_dir: str, isin_payloads: str | None = None) -> Tables:
    """The current tables of the store that ``load_all`` writes; edges come from the
    copies partitioned by either end and names from their index, where the last load
    wrote them."""
    current = store.manifest(spark, table_dir)
    isins = None
    if isin_payloads:
        isins = isin_src.isin_map(spark.read.parquet(isin_payloads))
    return Tables(
        store.read_table(spark, table_dir, KIND_ENTITIES),
        store.read_table(spark, table_dir, csv_ingest.BY_CHILD if csv_ingest.BY_CHILD in current else KIND_RELATIONSHIPS),
        store.read_table(spark, table_dir, KIND_EXCEPTIONS),
        isins,
        store.read_table(spark, table_dir, csv_ingest.BY_PARENT) if csv_ingest.BY_PARENT in current else None,
        name_index.open_index(spark, table_dir),
    )


@dataclass
class LeiReport:
    rejected: DataFrame  # inputs that are not 20 characters after cleaning
    missing: DataFrame  # valid LEIs that are not entities
    report: DataFrame  # P1 long form
    lines: DataFrame  # P2 display lines
    panel: DataFrame  # entity panel (with ISINs when available)


def lei_report(t: Tables, raw: DataFrame, input_col: str = "lei_input") -> LeiReport:
    cleaned = lookup.normalize_requests(raw, input_col)
    valid = cleaned.where("is_valid").select("lei").distinct()
    long = report.full_report_long(t.entities, t.relationships, t.exceptions, valid, t.relationships_by_parent)
    return LeiReport(
        rejected=cleaned.where(~F.col("is_valid")),
        missing=lookup.missing_leis(t.entities, valid),
        report=long,
        lines=report.report_display(long, registry=False, isins=t.isins),
        panel=report.entity_panel(t.entities, valid, t.isins),
    )


@dataclass
class LeiTree:
    roots: DataFrame  # (lei, root_lei)
    sizes: DataFrame  # (lei, root_lei, total_entities)
    listing: DataFrame  # (root_lei, line_no, depth, node_lei, label)


def lei_tree(t: Tables, raw: DataFrame, input_col: str = "lei_input", max_depth: int = MAX_HIERARCHY_DEPTH) -> LeiTree:
    valid = lookup.valid_requests(raw, input_col).distinct()
    roots, _, sizes = hierarchy.corporate_groups(t.entities, t.relationships, valid, max_depth)
    distinct_roots = roots.select(F.col("root_lei").alias("lei")).distinct()
    lines = listing.hierarchy_listing(t.entities, t.relationships, distinct_roots, max_depth, t.isins)
    return LeiTree(roots, sizes, lines)


@dataclass
class NameSearch:
    title: DataFrame  # one row: title, result_count
    results: DataFrame  # entity rows (+ isins when available)


def name_search(t: Tables, text: str, limit: int = DEFAULT_SEARCH_LIMIT) -> NameSearch:
    if t.names is None:
        hits = lookup.search_by_name(t.entities, text, limit)
    else:
        asked = t.entities.sparkSession.createDataFrame([(text,)], "query string")
        hits = search.search_by_name_stored(t.entities, t.names, asked, limit).orderBy("rank").drop("query", "rank")
    results = isin_src.attach_isins(hits, t.isins) if t.isins is not None else hits
    return NameSearch(lookup.search_title(hits, text), results)


def status(spark: SparkSession, metadata_path: str) -> DataFrame:
    return metadata.status_report(metadata.read_metadata(spark, metadata_path))
