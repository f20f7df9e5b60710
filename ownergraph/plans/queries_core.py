"""Registered queries: lookups, relationships and hierarchy (L, R, H rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ownergraph.operators import hierarchy, lookup, relations
from ownergraph.operators.edges import chosen_parent
from ownergraph.plans.catalogue import (
    ACTIVE_SQL,
    ALL_NODES_SQL,
    D,
    OTHER_ENDS_SQL,
    U,
    ancestors_cte,
    descendants_cte,
    entity_cols_sql,
    first_parent_sql,
    node_cols_sql,
    oracle,
    register,
    roots_cte,
    tables,
    tree_select_sql,
)
from ownergraph.schema import DIRECT_PARENT

# ---------------------------------------------------------------------------
# E1 / E2 / L1 / L2
# ---------------------------------------------------------------------------


@register(
    "normalize_leis",
    oracle(
        "SELECT lei_input, upper(trim(lei_input)) AS lei, "
        "coalesce(length(upper(trim(lei_input))) = 20, false) AS is_valid FROM lei_requests"
    ),
)
def q_normalize_leis(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lookup.normalize_requests(t["lei_requests"])


@register(
    "get_entities",
    oracle(
        f"SELECT {entity_cols_sql('l')} FROM lei_records l "
        "WHERE l.lei IN (SELECT upper(trim(lei_input)) FROM lei_requests "
        "WHERE length(upper(trim(lei_input))) = 20)"
    ),
)
def q_get_entities(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lookup.get_entities(t["lei_records"], lookup.valid_requests(t["lei_requests"]))


@register(
    "missing_leis",
    oracle(
        "SELECT upper(trim(lei_input)) AS lei FROM lei_requests "
        "WHERE length(upper(trim(lei_input))) = 20 "
        "AND upper(trim(lei_input)) NOT IN (SELECT lei FROM lei_records)"
    ),
)
def q_missing_leis(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lookup.missing_leis(t["lei_records"], lookup.valid_requests(t["lei_requests"]))


# ---------------------------------------------------------------------------
# L3 name search (a top-k: the limit is the feature)
# ---------------------------------------------------------------------------

SEARCH_TEXT = "mer#0000001"
SEARCH_LIMIT = 25


@register(
    "search_by_name",
    oracle(
        f"SELECT {entity_cols_sql('l')} FROM lei_records l "
        f"WHERE l.legal_name ILIKE '%{SEARCH_TEXT}%' ORDER BY l.legal_name, l.lei LIMIT {SEARCH_LIMIT}"
    ),
)
def q_search_by_name(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lookup.search_by_name(t["lei_records"], SEARCH_TEXT, SEARCH_LIMIT)


@register(
    "search_by_name_all",
    oracle(f"SELECT {entity_cols_sql('l')} FROM lei_records l WHERE l.legal_name ILIKE '%SUPPLIER#%'"),
)
def q_search_by_name_all(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lookup.search_by_name(t["lei_records"], "SUPPLIER#", limit=None)


@register(
    "search_title",
    oracle(
        "SELECT CASE WHEN count(*) = 0 THEN 'No entities found matching ''" + SEARCH_TEXT + "''.' "
        "ELSE 'Name Search: ''" + SEARCH_TEXT + "'' (' || CAST(count(*) AS VARCHAR) || "
        "CASE WHEN count(*) = 1 THEN ' result)' ELSE ' results)' END END AS title, "
        "count(*) AS result_count FROM (SELECT lei FROM lei_records "
        f"WHERE legal_name ILIKE '%{SEARCH_TEXT}%' ORDER BY legal_name, lei LIMIT {SEARCH_LIMIT}) s"
    ),
)
def q_search_title(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lookup.search_title(lookup.search_by_name(t["lei_records"], SEARCH_TEXT, SEARCH_LIMIT), SEARCH_TEXT)


# ---------------------------------------------------------------------------
# R1 - R6
# ---------------------------------------------------------------------------


def _parent_oracle(rel_type_sql: str) -> str:
    return oracle(
        f"SELECT c.q AS lei, {entity_cols_sql('l', 'parent_lei')} "
        "FROM chosen c JOIN lei_records l ON l.lei = c.p",
        ALL_NODES_SQL,
        f"chosen AS (SELECT q, {first_parent_sql('all_nodes.q', rel_type_sql)} AS p FROM all_nodes)",
    )


@register("direct_parents", _parent_oracle(D))
def q_direct_parents(spark, sf_dir):
    e, r, _ = (tables(spark, sf_dir)[k] for k in ("lei_records", "relationships", "reporting_exceptions"))
    return relations.direct_parents(e, r)


@register("ultimate_parents", _parent_oracle(U))
def q_ultimate_parents(spark, sf_dir):
    t = tables(spark, sf_dir)
    return relations.ultimate_parents(t["lei_records"], t["relationships"])


@register(
    "children",
    oracle(
        "SELECT n.q AS lei, r.start_node_id AS related_lei, nullif(l.legal_name, '') AS legal_name, "
        "r.relationship_type, coalesce(r.relationship_status, '') AS relationship_status, "
        "'child' AS direction "
        "FROM all_nodes n JOIN relationships r ON r.end_node_id = n.q "
        "LEFT JOIN lei_records l ON l.lei = r.start_node_id "
        f"WHERE r.{ACTIVE_SQL}",
        ALL_NODES_SQL,
    ),
)
def q_children(spark, sf_dir):
    t = tables(spark, sf_dir)
    return relations.children(t["lei_records"], t["relationships"])


@register(
    "sibling_counts",
    oracle(
        "SELECT c.q AS lei, c.p AS parent_lei, "
        "(SELECT count(*) FROM relationships r2 WHERE r2.end_node_id = c.p "
        f"AND r2.relationship_type = {D} AND r2.{ACTIVE_SQL} AND r2.start_node_id != c.q) "
        "AS sibling_count FROM chosen c WHERE c.p IS NOT NULL",
        ALL_NODES_SQL,
        f"chosen AS (SELECT q, {first_parent_sql('all_nodes.q', D)} AS p FROM all_nodes)",
    ),
)
def q_sibling_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return relations.sibling_counts(t["relationships"])


@register(
    "sibling_groups",
    oracle(
        "SELECT r.end_node_id AS parent_lei, r.start_node_id AS related_lei, "
        "nullif(l.legal_name, '') AS legal_name, r.relationship_type, "
        "coalesce(r.relationship_status, '') AS relationship_status, 'sibling' AS direction "
        "FROM relationships r LEFT JOIN lei_records l ON l.lei = r.start_node_id "
        f"WHERE r.relationship_type = {D} AND r.{ACTIVE_SQL} "
        "AND r.end_node_id IN (SELECT p FROM chosen WHERE p IS NOT NULL)",
        ALL_NODES_SQL,
        f"chosen AS (SELECT q, {first_parent_sql('all_nodes.q', D)} AS p FROM all_nodes)",
    ),
)
def q_sibling_groups(spark, sf_dir):
    t = tables(spark, sf_dir)
    return relations.sibling_groups(t["lei_records"], t["relationships"])


def sibling_requests(spark, sf_dir):
    """A request list made from all direct edges: of every chosen parent the
    smallest child, so that the siblings asked for stay linear in the edges."""
    chosen = chosen_parent(tables(spark, sf_dir)["relationships"], DIRECT_PARENT)
    return chosen.groupBy("end_node_id").agg(F.min("start_node_id").alias("lei")).select("lei")


# The same list, from the definition: children no child of whose parent is less.
SIBLING_REQUESTS_SQL = (
    f"own_parent AS (SELECT q, p FROM (SELECT q, {first_parent_sql('all_nodes.q', D)} AS p FROM all_nodes) c "
    "WHERE p IS NOT NULL), "
    "asked AS (SELECT q AS lei, p FROM own_parent x WHERE NOT EXISTS "
    "(SELECT 1 FROM own_parent y WHERE y.p = x.p AND y.q < x.q))"
)


@register(
    "siblings",
    oracle(
        "SELECT x.lei, r.start_node_id AS related_lei, nullif(l.legal_name, '') AS legal_name, "
        "r.relationship_type, coalesce(r.relationship_status, '') AS relationship_status, "
        "'sibling' AS direction FROM asked x JOIN relationships r ON r.end_node_id = x.p "
        f"AND r.{ACTIVE_SQL} AND r.relationship_type = {D} AND r.start_node_id <> x.lei "
        "LEFT JOIN lei_records l ON l.lei = r.start_node_id",
        ALL_NODES_SQL,
        SIBLING_REQUESTS_SQL,
    ),
)
def q_siblings(spark, sf_dir):
    t = tables(spark, sf_dir)
    return relations.siblings(t["lei_records"], t["relationships"], sibling_requests(spark, sf_dir))


@register(
    "other_relationships",
    oracle(
        "SELECT o.lei, o.related_lei, nullif(l.legal_name, '') AS legal_name, o.relationship_type, "
        "o.status AS relationship_status, 'other' AS direction "
        "FROM other_ends o LEFT JOIN lei_records l ON l.lei = o.related_lei",
        OTHER_ENDS_SQL,
    ),
)
def q_other_relationships(spark, sf_dir):
    t = tables(spark, sf_dir)
    return relations.other_relationships(t["lei_records"], t["relationships"])


@register(
    "reporting_exceptions",
    oracle(
        "SELECT lei, exception_category, nullif(exception_reason_1, '') AS exception_reason, "
        "nullif(exception_reference_1, '') AS exception_reference FROM reporting_exceptions"
    ),
)
def q_reporting_exceptions(spark, sf_dir):
    t = tables(spark, sf_dir)
    return relations.reporting_exceptions(t["reporting_exceptions"])


# ---------------------------------------------------------------------------
# H1 - H6
# ---------------------------------------------------------------------------


@register(
    "ancestor_chain",
    oracle(
        f"SELECT a.start_lei AS lei, a.node_lei, {node_cols_sql('l')}, "
        "nullif(a.via_type, '') AS relationship_type, CAST(a.depth AS INTEGER) AS depth, a.parent_lei "
        "FROM anc a LEFT JOIN lei_records l ON l.lei = a.node_lei",
        ancestors_cte(50),
        recursive=True,
    ),
)
def q_ancestor_chain(spark, sf_dir):
    t = tables(spark, sf_dir)
    return hierarchy.ancestor_chain(t["lei_records"], t["relationships"])


@register("descendant_tree", oracle(tree_select_sql("des1", "root_lei"), descendants_cte(50), recursive=True))
def q_descendant_tree(spark, sf_dir):
    t = tables(spark, sf_dir)
    return hierarchy.descendant_tree(t["lei_records"], t["relationships"])


@register(
    "descendant_tree_depth2",
    oracle(tree_select_sql("des1", "root_lei"), descendants_cte(2), recursive=True),
)
def q_descendant_tree_depth2(spark, sf_dir):
    t = tables(spark, sf_dir)
    return hierarchy.descendant_tree(t["lei_records"], t["relationships"], max_depth=2)


@register(
    "corporate_group_roots",
    oracle("SELECT lei, root_lei FROM roots", ancestors_cte(50), roots_cte(), recursive=True),
)
def q_corporate_group_roots(spark, sf_dir):
    t = tables(spark, sf_dir)
    return hierarchy.group_roots(t["lei_records"], t["relationships"])


_GROUP_CTES = (
    ancestors_cte(50),
    roots_cte(),
    descendants_cte(50, anchor="SELECT root_lei AS lei FROM roots"),
)


@register(
    "corporate_group_members",
    oracle(tree_select_sql("des1", "root_lei"), *_GROUP_CTES, recursive=True),
)
def q_corporate_group_members(spark, sf_dir):
    t = tables(spark, sf_dir)
    _, members, _ = hierarchy.corporate_groups(t["lei_records"], t["relationships"])
    return members


@register(
    "corporate_group_sizes",
    oracle(
        "SELECT r.lei, r.root_lei, CAST(c.n AS BIGINT) AS total_entities FROM roots r "
        "JOIN (SELECT root_lei, count(*) AS n FROM des1 GROUP BY root_lei) c ON c.root_lei = r.root_lei",
        *_GROUP_CTES,
        recursive=True,
    ),
)
def q_corporate_group_sizes(spark, sf_dir):
    t = tables(spark, sf_dir)
    _, _, sizes = hierarchy.corporate_groups(t["lei_records"], t["relationships"])
    return sizes



# ---------------------------------------------------------------------------
# L3b batch name search: texts from the nation table plus edge-case texts
# (short piece, single characters, wildcard only, too many '_').
# ---------------------------------------------------------------------------

BATCH_LIMIT = 10
EXTRA_TEXTS = ["Su", "", "_" * 20, "ER#%1", "0_1"]


def _batch_texts_sql() -> str:
    extra = " ".join(f"UNION ALL SELECT '{t}'" for t in EXTRA_TEXTS)
    return (
        "searches AS (SELECT 'r#0000' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS query "
        f"FROM nation {extra})"
    )


@register(
    "search_by_name_batch",
    oracle(
        f"SELECT query, CAST(rank AS INTEGER) AS rank, {entity_cols_sql('x')} FROM ("
        "SELECT s.query, e.*, row_number() OVER (PARTITION BY s.query ORDER BY e.legal_name, e.lei) AS rank "
        "FROM searches s JOIN lei_records e ON e.legal_name ILIKE '%' || s.query || '%') x "
        f"WHERE rank <= {BATCH_LIMIT}",
        _batch_texts_sql(),
    ),
)
def q_search_by_name_batch(spark, sf_dir):
    from ownergraph.operators.search import search_by_name_batch
    from ownergraph.plans.adapter import base_table

    nation = base_table(spark, sf_dir, "nation")
    texts = nation.select(
        F.concat(F.lit("r#0000"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("query")
    )
    extra = spark.createDataFrame([(t,) for t in EXTRA_TEXTS], "query string")
    t = tables(spark, sf_dir)
    return search_by_name_batch(t["lei_records"], texts.unionByName(extra), BATCH_LIMIT)
