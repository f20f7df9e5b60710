"""Registered queries: one Spark plan per operator plus its DuckDB oracle.

Every query reads the driver's tables through the adapter views and runs over
the whole registry, or over a request list made from all of it. Oracle SQL is
written from the definition of each operator, not from our plans: trails for the
simple paths, shortest distances for the trees, correlated counts for siblings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ownergraph.plans.adapter import adapter_tables, oracle_prefix
from ownergraph.schema import DIRECT_PARENT, ULTIMATE_PARENT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def tables(spark: SparkSession, sf_dir: str):
    return adapter_tables(spark, sf_dir)


# ---------------------------------------------------------------------------
# SQL fragments for the oracle
# ---------------------------------------------------------------------------

D = f"'{DIRECT_PARENT}'"
U = f"'{ULTIMATE_PARENT}'"
ACTIVE_SQL = "relationship_status = 'ACTIVE'"


def entity_cols_sql(alias: str, lei_alias: str = "lei") -> str:
    a = alias
    return (
        f"{a}.lei AS {lei_alias}, coalesce({a}.legal_name, '') AS legal_name, "
        f"coalesce({a}.entity_status, '') AS entity_status, "
        f"coalesce({a}.registration_status, '') AS registration_status, "
        f"nullif({a}.entity_category, '') AS entity_category, "
        f"nullif({a}.legal_jurisdiction, '') AS legal_jurisdiction, "
        f"nullif({a}.legal_address_city, '') AS legal_address_city, "
        f"nullif({a}.legal_address_country, '') AS legal_address_country, "
        f"nullif({a}.hq_address_city, '') AS hq_address_city, "
        f"nullif({a}.hq_address_country, '') AS hq_address_country"
    )


def node_cols_sql(alias: str) -> str:
    a = alias
    return (
        f"nullif({a}.legal_name, '') AS legal_name, nullif({a}.entity_status, '') AS entity_status, "
        f"nullif({a}.entity_category, '') AS entity_category, "
        f"nullif({a}.legal_jurisdiction, '') AS legal_jurisdiction"
    )


# Every LEI the source could be asked about with a non-empty answer.
ALL_NODES_SQL = (
    "all_nodes AS (SELECT start_node_id AS q FROM relationships WHERE start_node_id IS NOT NULL "
    "UNION SELECT end_node_id FROM relationships WHERE end_node_id IS NOT NULL "
    "UNION SELECT lei FROM lei_records)"
)


def first_parent_sql(q: str, rel_type: str) -> str:
    """The source's ``LIMIT 1`` parent pick, with our tie-break (smallest)."""
    return (
        f"(SELECT min(r1.end_node_id) FROM relationships r1 WHERE r1.start_node_id = {q} "
        f"AND r1.relationship_type = {rel_type} AND r1.{ACTIVE_SQL})"
    )


def _direct_sql(name: str) -> str:
    return (
        f"{name}(child, parent, kind) AS (SELECT start_node_id, end_node_id, relationship_type FROM relationships "
        f"WHERE {ACTIVE_SQL} AND relationship_type = {D} AND start_node_id IS NOT NULL AND end_node_id IS NOT NULL)"
    )


def ancestors_cte(max_depth: int) -> str:
    """H1: every trail (list of the LEIs passed) upwards without a repeat."""
    return f"""{_direct_sql('ups')},
  trails(trail, kind) AS (
    SELECT [lei], CAST(NULL AS VARCHAR) FROM lei_records
    UNION ALL
    SELECT trail || [ups.parent], ups.kind FROM ups, trails
    WHERE ups.child = trail[-1] AND len(trail) <= {max_depth} AND len(list_intersect(trail, [ups.parent])) = 0),
  anc AS (
    SELECT trail[1] AS start_lei, trail[-1] AS node_lei, kind AS via_type, len(trail) - 1 AS depth,
           CASE WHEN len(trail) > 1 THEN trail[-2] END AS parent_lei
    FROM trails)"""


def descendants_cte(max_depth: int, anchor: str = "SELECT lei FROM lei_records") -> str:
    """H2: shortest distances below each root, then the least parent one step
    nearer."""
    return f"""{_direct_sql('downs')},
  steps(root_lei, node_lei, depth) AS (
    SELECT lei, lei, 0 FROM ({anchor}) heads
    UNION
    SELECT steps.root_lei, downs.child, steps.depth + 1 FROM steps, downs
    WHERE downs.parent = steps.node_lei AND steps.depth < {max_depth}),
  nearest AS (SELECT root_lei, node_lei, min(depth) AS depth FROM steps GROUP BY ALL),
  des1 AS (
    SELECT root_lei, node_lei, depth, CAST(NULL AS VARCHAR) AS via_type, CAST(NULL AS VARCHAR) AS parent_lei
    FROM nearest WHERE depth = 0
    UNION ALL
    SELECT low.root_lei, low.node_lei, low.depth, {D}, min(high.node_lei)
    FROM nearest low, downs, nearest high
    WHERE downs.child = low.node_lei AND high.node_lei = downs.parent AND high.root_lei = low.root_lei
      AND high.depth = low.depth - 1
    GROUP BY low.root_lei, low.node_lei, low.depth)"""


# Both ends of every active edge that is no consolidation; a loop has one end.
OTHER_ENDS_SQL = f"""links AS (
    SELECT start_node_id AS a, end_node_id AS b, relationship_type, coalesce(relationship_status, '') AS status
    FROM relationships WHERE {ACTIVE_SQL} AND relationship_type NOT IN ({D}, {U})),
  ends AS (
    SELECT unnest(CASE WHEN a = b THEN [{{'x': a, 'y': b}}] ELSE [{{'x': a, 'y': b}}, {{'x': b, 'y': a}}] END) AS e,
           relationship_type, status
    FROM links),
  other_ends AS (
    SELECT e.x AS lei, e.y AS related_lei, relationship_type, status FROM ends WHERE e.x IS NOT NULL)"""


def tree_select_sql(src: str, key: str) -> str:
    return (
        f"SELECT t.{key}, t.node_lei, {node_cols_sql('l')}, nullif(t.via_type, '') AS relationship_type, "
        f"CAST(t.depth AS INTEGER) AS depth, t.parent_lei "
        f"FROM {src} t LEFT JOIN lei_records l ON l.lei = t.node_lei"
    )


def roots_cte() -> str:
    return """roots AS (
    SELECT start_lei AS lei,
           coalesce((SELECT e.lei FROM lei_records e
                     WHERE e.lei = arg_min(node_lei, {'up': -depth, 'node': node_lei})), start_lei) AS root_lei
    FROM anc GROUP BY start_lei)"""


def oracle(select: str, *ctes: str, recursive: bool = False) -> str:
    """Full oracle text: adapter views, extra CTEs, then the main SELECT."""
    parts = [oracle_prefix(recursive)] + [c.strip() for c in ctes]
    return ",\n".join(parts) + "\n" + select.strip()


ISIN_LIST_SQL = (
    "isin_lists AS (SELECT lei, list_filter(json_extract_string(payload, '$.data[*].attributes.isin'), "
    "lambda x: x IS NOT NULL AND x <> '') AS l FROM isin_payloads)"
)
ISIN_TEXT_SQL = (
    "isin_text AS (SELECT lei, array_to_string(l, ', ') AS isins FROM isin_lists WHERE len(l) > 0)"
)


# Import the query definitions (they call ``register``).
from ownergraph.plans import queries_core, queries_io, queries_report  # noqa: E402,F401
