"""Registered queries: reports, display text, hierarchy listing (P, U, E, H7/H8)."""

from __future__ import annotations

from ownergraph.functions.display import node_label
from ownergraph.operators import hierarchy, listing, report
from ownergraph.plans.catalogue import (
    ACTIVE_SQL,
    ALL_NODES_SQL,
    D,
    ISIN_LIST_SQL,
    ISIN_TEXT_SQL,
    OTHER_ENDS_SQL,
    U,
    ancestors_cte,
    descendants_cte,
    oracle,
    register,
    roots_cte,
    tables,
)
from ownergraph.plans.queries_core import SIBLING_REQUESTS_SQL, sibling_requests
from ownergraph.sources import isin

def label_sql(lei, name, jur, status, isins=None) -> str:
    parts = [
        lei,
        f"nullif({name}, '')",
        f"'(' || nullif(concat_ws(', ', nullif({jur}, ''), nullif({status}, '')), '') || ')'",
    ]
    if isins:
        parts.append(f"CASE WHEN {isins} <> '' THEN 'ISINs: ' || {isins} END")
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def parent_line_sql(a: str, isins: str | None = None) -> str:
    parts = [
        f"{a}.lei",
        f"coalesce({a}.legal_name, '')",
        f"coalesce({a}.entity_status, '')",
        f"coalesce(nullif({a}.legal_jurisdiction, ''), 'N/A')",
    ]
    if isins:
        parts.append(f"CASE WHEN {isins} <> '' THEN 'ISINs: ' || {isins} END")
    return "concat_ws(' | ', " + ", ".join(parts) + ")"


# ---------------------------------------------------------------------------
# E18 - E20, P2
# ---------------------------------------------------------------------------


@register(
    "node_labels",
    oracle(
        "SELECT e.lei, "
        + label_sql("e.lei", "e.legal_name", "e.legal_jurisdiction", "e.entity_status", "coalesce(i.isins, '')")
        + " AS label FROM lei_records e LEFT JOIN isin_text i ON i.lei = e.lei",
        ISIN_LIST_SQL,
        ISIN_TEXT_SQL,
    ),
)
def q_node_labels(spark, sf_dir):
    t = tables(spark, sf_dir)
    e = isin.attach_isins(t["lei_records"], isin.isin_map(t["isin_payloads"]))
    return e.select(
        "lei", node_label("lei", "legal_name", "legal_jurisdiction", "entity_status", "isins").alias("label")
    )


@register(
    "entity_panel",
    oracle(
        "SELECT e.lei, coalesce(e.legal_name, '') AS name, coalesce(e.entity_status, '') AS status, "
        "coalesce(nullif(e.entity_category, ''), 'N/A') AS category, "
        "coalesce(nullif(e.legal_jurisdiction, ''), 'N/A') AS jurisdiction, "
        "coalesce(nullif(e.legal_address_city, ''), '') || ', ' || coalesce(nullif(e.legal_address_country, ''), '') "
        "AS legal_address, "
        "coalesce(nullif(e.hq_address_city, ''), '') || ', ' || coalesce(nullif(e.hq_address_country, ''), '') "
        "AS hq_address, coalesce(e.registration_status, '') AS registration_status, "
        "coalesce(i.isins, '') AS isins FROM lei_records e LEFT JOIN isin_text i ON i.lei = e.lei",
        ISIN_LIST_SQL,
        ISIN_TEXT_SQL,
    ),
)
def q_entity_panel(spark, sf_dir):
    t = tables(spark, sf_dir)
    return report.entity_panel(t["lei_records"], isins=isin.isin_map(t["isin_payloads"]))


def _chosen_parent_sql(name: str, rel_type: str) -> str:
    return (
        f"{name} AS (SELECT start_node_id AS lei, min(end_node_id) AS p FROM relationships "
        f"WHERE relationship_type = {rel_type} AND {ACTIVE_SQL} GROUP BY start_node_id)"
    )


@register(
    "parent_lines",
    oracle(
        "SELECT e.lei, "
        f"coalesce((SELECT {parent_line_sql('pe', 'coalesce(i.isins, ' + chr(39) * 2 + ')')} FROM cd "
        "JOIN lei_records pe ON pe.lei = cd.p LEFT JOIN isin_text i ON i.lei = pe.lei WHERE cd.lei = e.lei), "
        "'None') AS direct_parent, "
        f"coalesce((SELECT {parent_line_sql('pe', 'coalesce(i.isins, ' + chr(39) * 2 + ')')} FROM cu "
        "JOIN lei_records pe ON pe.lei = cu.p LEFT JOIN isin_text i ON i.lei = pe.lei WHERE cu.lei = e.lei), "
        "'None') AS ultimate_parent "
        "FROM lei_records e",
        ISIN_LIST_SQL,
        ISIN_TEXT_SQL,
        _chosen_parent_sql("cd", D),
        _chosen_parent_sql("cu", U),
    ),
)
def q_parent_lines(spark, sf_dir):
    t = tables(spark, sf_dir)
    return report.parent_lines(t["lei_records"], t["relationships"], isins=isin.isin_map(t["isin_payloads"]))


# ---------------------------------------------------------------------------
# Over the whole registry (sibling group line) and for a request list
# made from all direct edges (the siblings themselves)
# ---------------------------------------------------------------------------

SECTION_NO_SQL = (
    "CAST(CASE section WHEN 'entity' THEN 1 WHEN 'direct_parent' THEN 2 WHEN 'ultimate_parent' THEN 3 "
    "WHEN 'children' THEN 4 WHEN 'other' THEN 6 WHEN 'exceptions' THEN 7 ELSE 5 END AS INTEGER)"
)
REPORT_COLUMNS = (
    "lei, section, section_no, related_lei, legal_name, entity_status, legal_jurisdiction, relationship_type, "
    "relationship_status, exception_category, exception_reason, exception_reference, sibling_count, stored_name"
)


def report_ctes(requested: bool) -> list[str]:
    """``report_rows``: what a report holds, from its definition."""
    into_parent = (
        f"FROM relationships r WHERE r.end_node_id = x.p AND r.{ACTIVE_SQL} AND r.relationship_type = {D} "
        "AND r.start_node_id <> x.lei"
    )
    if requested:
        head = [SIBLING_REQUESTS_SQL, "subjects AS (SELECT lei FROM lei_records WHERE lei IN (SELECT lei FROM asked))"]
        siblings = (
            "SELECT x.lei, 'siblings', r.start_node_id, r.relationship_type, coalesce(r.relationship_status, ''), "
            f"CAST(NULL AS VARCHAR) FROM cd x, relationships r WHERE r.end_node_id = x.p AND r.{ACTIVE_SQL} "
            f"AND r.relationship_type = {D} AND r.start_node_id <> x.lei"
        )
    else:
        head = ["subjects AS (SELECT lei FROM lei_records)"]
        siblings = (
            "SELECT lei, 'sibling_group', p, NULL, NULL, CAST(n AS VARCHAR) FROM "
            f"(SELECT x.lei, x.p, (SELECT count(*) {into_parent}) AS n FROM cd x) g WHERE n > 0"
        )
    return [
        ALL_NODES_SQL,
        *head,
        _chosen_parent_sql("cd", D),
        _chosen_parent_sql("cu", U),
        OTHER_ENDS_SQL,
        f"""places(lei, section, related_lei, relationship_type, relationship_status, sibling_count) AS MATERIALIZED (
    SELECT lei, 'entity', lei, NULL, NULL, CAST(NULL AS VARCHAR) FROM lei_records
    UNION ALL SELECT lei, 'direct_parent', p, NULL, NULL, NULL FROM cd WHERE p IN (SELECT lei FROM lei_records)
    UNION ALL SELECT lei, 'ultimate_parent', p, NULL, NULL, NULL FROM cu WHERE p IN (SELECT lei FROM lei_records)
    UNION ALL SELECT end_node_id, 'children', start_node_id, relationship_type, coalesce(relationship_status, ''), NULL
              FROM relationships WHERE {ACTIVE_SQL}
    UNION ALL SELECT lei, 'other', related_lei, relationship_type, status, NULL FROM other_ends
    UNION ALL {siblings})""",
        f"""report_rows AS MATERIALIZED (
    SELECT s.lei, section, {SECTION_NO_SQL} AS section_no, p.related_lei,
           CASE WHEN section IN ('entity', 'direct_parent', 'ultimate_parent') THEN coalesce(l.legal_name, '')
                WHEN section <> 'sibling_group' THEN nullif(l.legal_name, '') END AS legal_name,
           CASE WHEN section IN ('entity', 'direct_parent', 'ultimate_parent') THEN coalesce(l.entity_status, '') END
             AS entity_status,
           CASE WHEN section IN ('entity', 'direct_parent', 'ultimate_parent') THEN nullif(l.legal_jurisdiction, '') END
             AS legal_jurisdiction,
           p.relationship_type, p.relationship_status, NULL AS exception_category, NULL AS exception_reason,
           NULL AS exception_reference, p.sibling_count,
           CASE WHEN section <> 'sibling_group' THEN l.legal_name END AS stored_name
    FROM subjects s JOIN places p ON p.lei = s.lei LEFT JOIN lei_records l ON l.lei = p.related_lei
    UNION ALL
    SELECT s.lei, 'exceptions', 7, NULL, NULL, NULL, NULL, NULL, NULL, x.exception_category,
           nullif(x.exception_reason_1, ''), nullif(x.exception_reference_1, ''), NULL, NULL
    FROM subjects s JOIN reporting_exceptions x ON x.lei = s.lei)""",
    ]


def _report(spark, sf_dir, requested: bool):
    t = tables(spark, sf_dir)
    requests = sibling_requests(spark, sf_dir) if requested else None
    return report.full_report_long(t["lei_records"], t["relationships"], t["reporting_exceptions"], requests)


@register("full_report_long", oracle(f"SELECT {REPORT_COLUMNS} FROM report_rows", *report_ctes(False)))
def q_full_report_long(spark, sf_dir):
    return _report(spark, sf_dir, requested=False)


@register("full_report_requests", oracle(f"SELECT {REPORT_COLUMNS} FROM report_rows", *report_ctes(True)))
def q_full_report_requests(spark, sf_dir):
    return _report(spark, sf_dir, requested=True)


@register(
    "report_leis",
    oracle(
        "SELECT lei, related_lei, section_no, row_number() OVER (PARTITION BY lei ORDER BY place) AS first_pos FROM ("
        "SELECT lei, related_lei, min(section_no) AS section_no, min(place) AS place FROM ("
        "SELECT lei, related_lei, section_no, row_number() OVER (PARTITION BY lei ORDER BY section_no, "
        "stored_name NULLS LAST, related_lei) AS place FROM report_rows "
        "WHERE related_lei IS NOT NULL AND section <> 'exceptions') seen GROUP BY lei, related_lei) firsts",
        *report_ctes(True),
    ),
)
def q_report_leis(spark, sf_dir):
    return report.report_leis(_report(spark, sf_dir, requested=True))


@register(
    "full_report_counts",
    oracle(
        "SELECT e.lei, "
        "EXISTS (SELECT 1 FROM cd JOIN lei_records p ON p.lei = cd.p WHERE cd.lei = e.lei) AS has_direct_parent, "
        "EXISTS (SELECT 1 FROM cu JOIN lei_records p ON p.lei = cu.p WHERE cu.lei = e.lei) AS has_ultimate_parent, "
        f"(SELECT count(*) FROM relationships r WHERE r.end_node_id = e.lei AND r.{ACTIVE_SQL}) AS n_children, "
        "coalesce((SELECT count(*) FROM relationships r2 JOIN cd ON r2.end_node_id = cd.p "
        f"WHERE cd.lei = e.lei AND r2.relationship_type = {D} AND r2.{ACTIVE_SQL} "
        "AND r2.start_node_id != e.lei), 0) AS n_siblings, "
        "(SELECT count(*) FROM other_ends o WHERE o.lei = e.lei) AS n_other, "
        "(SELECT count(*) FROM reporting_exceptions x WHERE x.lei = e.lei) AS n_exceptions "
        "FROM lei_records e",
        _chosen_parent_sql("cd", D),
        _chosen_parent_sql("cu", U),
        OTHER_ENDS_SQL,
    ),
)
def q_full_report_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return report.full_report_counts(t["lei_records"], t["relationships"], t["reporting_exceptions"])


# ---------------------------------------------------------------------------
# H7, H8 over every corporate group
# ---------------------------------------------------------------------------

_GROUP_TREE_CTES = (
    ancestors_cte(50),
    roots_cte(),
    descendants_cte(50, anchor="SELECT root_lei AS lei FROM roots"),
)


def _listing_oracle(with_isins: bool) -> str:
    isins = "coalesce(i.isins, '')" if with_isins else None
    return oracle(
        "SELECT w.root_lei, row_number() OVER (PARTITION BY w.root_lei ORDER BY w.sp) AS line_no, "
        "k.depth, w.node_lei, k.label FROM walk w JOIN des_k k ON k.root_lei = w.root_lei "
        "AND k.node_lei = w.node_lei UNION ALL "
        "SELECT root_lei, CAST(0 AS BIGINT), CAST(-1 AS INTEGER), root_lei, "
        "'Corporate Group (' || CAST(count(*) AS VARCHAR) || ' entities)' FROM des1 GROUP BY root_lei",
        *_GROUP_TREE_CTES,
        ISIN_LIST_SQL,
        ISIN_TEXT_SQL,
        "des_k AS (SELECT d.root_lei, d.node_lei, d.parent_lei, CAST(d.depth AS INTEGER) AS depth, "
        "{'k0': l.legal_name IS NULL, 'k1': l.legal_name, 'k2': d.node_lei} AS k, "
        + label_sql("d.node_lei", "l.legal_name", "l.legal_jurisdiction", "l.entity_status", isins)
        + " AS label FROM des1 d LEFT JOIN lei_records l ON l.lei = d.node_lei "
        "LEFT JOIN isin_text i ON i.lei = d.node_lei)",
        "walk AS (SELECT root_lei, node_lei, [k] AS sp FROM des_k WHERE depth = 0 "
        "UNION ALL SELECT c.root_lei, c.node_lei, list_append(w.sp, c.k) FROM walk w "
        "JOIN des_k c ON c.root_lei = w.root_lei AND c.parent_lei = w.node_lei AND c.depth > 0)",
        recursive=True,
    )


@register("hierarchy_listing", _listing_oracle(False))
def q_hierarchy_listing(spark, sf_dir):
    t = tables(spark, sf_dir)
    return listing.registry_listing(t["lei_records"], t["relationships"])


@register("hierarchy_listing_isins", _listing_oracle(True))
def q_hierarchy_listing_isins(spark, sf_dir):
    t = tables(spark, sf_dir)
    return listing.registry_listing(t["lei_records"], t["relationships"], isins=isin.isin_map(t["isin_payloads"]))


@register(
    "children_map",
    oracle(
        "SELECT d.root_lei, d.parent_lei, row_number() OVER (PARTITION BY d.root_lei, d.parent_lei "
        "ORDER BY d.depth, l.legal_name NULLS LAST, d.node_lei) AS pos, d.node_lei "
        "FROM des1 d LEFT JOIN lei_records l ON l.lei = d.node_lei",
        *_GROUP_TREE_CTES,
        recursive=True,
    ),
)
def q_children_map(spark, sf_dir):
    t = tables(spark, sf_dir)
    _, levels = hierarchy.group_levels(t["lei_records"], t["relationships"])
    return listing.children_map(levels, t["lei_records"])


def _display_oracle(requested: bool, with_isins: bool) -> str:
    isin_part = "CASE WHEN i.isins <> '' THEN 'ISINs: ' || i.isins END" if with_isins else "NULL"
    last = "siblings" if requested else "sibling_group"
    return oracle(
        "SELECT lei, section_no, section, row_number() OVER (PARTITION BY lei, section ORDER BY "
        "stored_name IS NULL, stored_name, related_lei, relationship_type, exception_category, text) AS pos, text "
        "FROM lines UNION ALL "
        "SELECT e.lei, CAST(s.no AS INTEGER), s.section, CAST(0 AS BIGINT), 'None' FROM subjects e "
        f"CROSS JOIN (VALUES ('direct_parent', 2), ('ultimate_parent', 3), ('children', 4), ('{last}', 5)) "
        "s(section, no) WHERE NOT EXISTS (SELECT 1 FROM report_rows l WHERE l.lei = e.lei AND l.section = s.section)",
        *report_ctes(requested),
        ISIN_LIST_SQL,
        ISIN_TEXT_SQL,
        "lines AS MATERIALIZED (SELECT r.lei, section_no, section, CASE "
        "WHEN section = 'entity' THEN coalesce(legal_name, '') "
        "WHEN section IN ('direct_parent', 'ultimate_parent') THEN concat_ws(' | ', related_lei, "
        "coalesce(legal_name, ''), coalesce(entity_status, ''), coalesce(nullif(legal_jurisdiction, ''), 'N/A'), "
        f"{isin_part}) "
        "WHEN section = 'sibling_group' THEN concat_ws(' | ', related_lei, sibling_count) "
        "WHEN section = 'exceptions' THEN concat_ws(' | ', exception_category, coalesce(exception_reason, ''), "
        "coalesce(exception_reference, '')) "
        f"ELSE concat_ws(' | ', related_lei, coalesce(legal_name, 'N/A'), relationship_type, {isin_part}) END AS text, "
        "stored_name, related_lei, relationship_type, exception_category "
        "FROM report_rows r LEFT JOIN isin_text i ON i.lei = r.related_lei)",
    )


@register("report_display", _display_oracle(False, False))
def q_report_display(spark, sf_dir):
    return report.report_display(_report(spark, sf_dir, requested=False), registry=True)


@register("report_display_requests", _display_oracle(True, False))
def q_report_display_requests(spark, sf_dir):
    return report.report_display(_report(spark, sf_dir, requested=True), registry=False)


@register("report_display_isins", _display_oracle(True, True))
def q_report_display_isins(spark, sf_dir):
    isins = isin.isin_map(tables(spark, sf_dir)["isin_payloads"])
    return report.report_display(_report(spark, sf_dir, requested=True), registry=False, isins=isins)
