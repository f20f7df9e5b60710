"""The full relationship report of each requested entity.

The report is a long table keyed by the requested LEI: one row per related
entity and section. For a request list the siblings section holds the siblings,
one row each. For the whole registry that would be every pair of every group, so
the registry form has a section ``sibling_group`` instead: one row with the
chosen parent and the number of siblings (``sibling_groups`` holds the members
once per parent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.functions.display import address, or_na, parent_line
from ownergraph.functions.normalize import null_to_empty
from ownergraph.operators import relations
from ownergraph.operators.edges import union_all
from ownergraph.operators.lookup import get_entities
from ownergraph.operators.ranking import ordinal_within_group
from ownergraph.session import written
from ownergraph.sources.isin import attach_isins

# Section order of the report.
SECTIONS = {
    "entity": 1,
    "direct_parent": 2,
    "ultimate_parent": 3,
    "children": 4,
    "siblings": 5,
    "sibling_group": 5,
    "other": 6,
    "exceptions": 7,
}
LONG_COLUMNS = [
    "lei",
    "section",
    "section_no",
    "related_lei",
    "legal_name",
    "entity_status",
    "legal_jurisdiction",
    "relationship_type",
    "relationship_status",
    "exception_category",
    "exception_reason",
    "exception_reference",
    "sibling_count",
    "stored_name",
]


def _shape(df: DataFrame, section: str, **cols) -> DataFrame:
    out = []
    for name in LONG_COLUMNS:
        if name == "section":
            out.append(F.lit(section).alias(name))
        elif name == "section_no":
            out.append(F.lit(SECTIONS[section]).alias(name))
        elif name in cols:
            out.append(cols[name].alias(name))
        else:
            out.append(F.lit(None).cast("string").alias(name))
    return df.select(*out)


def full_report_long(
    entities: DataFrame,
    rels: DataFrame,
    exceptions: DataFrame,
    requests: DataFrame | None = None,
    rels_by_parent: DataFrame | None = None,
) -> DataFrame:
    """P1 long form. Only requested LEIs that are entities get a report.

    ``requests`` None is the registry form (section ``sibling_group``), a list
    gets the siblings themselves. ``rels_by_parent`` is a copy of ``rels``
    laid out by parent for the lookups by parent (children, siblings, other ends).
    ``stored_name`` is the name as stored, the key of the display order.
    """
    subjects = get_entities(entities, requests)
    if requests is not None:
        # Looked up once, not once per section.
        subjects = written(subjects, "report-subjects")
    keys = subjects.select("lei")
    names = entities.select(F.col("lei").alias("__own"), F.col("legal_name").alias("stored_name"))
    c = F.col
    own = subjects.join(names, subjects["lei"] == names["__own"], "left")
    parts = [
        _shape(own, "entity", lei=c("lei"), related_lei=c("lei"), legal_name=c("legal_name"),
               entity_status=c("entity_status"), legal_jurisdiction=c("legal_jurisdiction"),
               stored_name=c("stored_name")),
    ]
    for section, fn in (("direct_parent", relations.direct_parents), ("ultimate_parent", relations.ultimate_parents)):
        p = fn(entities, rels, keys, stored_name=True)
        parts.append(_shape(p, section, lei=c("lei"), related_lei=c("parent_lei"), legal_name=c("legal_name"),
                            entity_status=c("entity_status"), legal_jurisdiction=c("legal_jurisdiction"),
                            stored_name=c("stored_name")))
    related = [("children", relations.children(entities, rels if rels_by_parent is None else rels_by_parent, keys, True)),
               ("other", relations.other_relationships(entities, rels, keys, True, rels_by_parent))]
    if requests is not None:
        related.append(("siblings", relations.siblings(entities, rels, keys, True, rels_by_parent)))
    for section, df in related:
        parts.append(_shape(df, section, lei=c("lei"), related_lei=c("related_lei"), legal_name=c("legal_name"),
                            relationship_type=c("relationship_type"),
                            relationship_status=c("relationship_status"), stored_name=c("stored_name")))
    if requests is None:
        group = relations.sibling_counts(rels).join(keys, "lei", "left_semi").where("sibling_count > 0")
        parts.append(_shape(group, "sibling_group", lei=c("lei"), related_lei=c("parent_lei"),
                            sibling_count=c("sibling_count").cast("string")))
    exc = relations.reporting_exceptions(exceptions, keys)
    parts.append(_shape(exc, "exceptions", lei=c("lei"), exception_category=c("exception_category"),
                        exception_reason=c("exception_reason"), exception_reference=c("exception_reference")))
    return union_all(parts)


def full_report_counts(
    entities: DataFrame, rels: DataFrame, exceptions: DataFrame, requests: DataFrame | None = None
) -> DataFrame:
    """P1 summary per requested entity: parent presence and section sizes.

    The section rows are unioned and counted in one grouped aggregate (one
    shuffle on the LEI, combined map-side) instead of one join per section;
    siblings are counted without pairing members (``sibling_counts``).
    """
    subjects = get_entities(entities, requests).select("lei")
    keys = subjects
    sections = [
        ("has_direct_parent", relations.direct_parents(entities, rels, keys)),
        ("has_ultimate_parent", relations.ultimate_parents(entities, rels, keys)),
        ("n_children", relations.children(entities, rels, keys)),
        ("n_other", relations.other_relationships(entities, rels, keys)),
        ("n_exceptions", relations.reporting_exceptions(exceptions, keys)),
    ]
    tagged = union_all([df.select(F.col("lei").alias("__l"), F.lit(name).alias("__s")) for name, df in sections])
    counts = tagged.groupBy("__l").agg(
        *[F.sum(F.when(F.col("__s") == name, 1).otherwise(0)).alias(name) for name, _ in sections]
    )
    sib = relations.sibling_counts(rels, keys).select(F.col("lei").alias("__sl"), "sibling_count")
    out = subjects.join(counts, subjects["lei"] == counts["__l"], "left").join(
        sib, subjects["lei"] == sib["__sl"], "left"
    )
    return out.select(
        "lei",
        (F.coalesce("has_direct_parent", F.lit(0)) > 0).alias("has_direct_parent"),
        (F.coalesce("has_ultimate_parent", F.lit(0)) > 0).alias("has_ultimate_parent"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("sibling_count", F.lit(0)).cast("long").alias("n_siblings"),
        F.coalesce("n_other", F.lit(0)).cast("long").alias("n_other"),
        F.coalesce("n_exceptions", F.lit(0)).cast("long").alias("n_exceptions"),
    )


def report_leis(report: DataFrame) -> DataFrame:
    """The distinct LEIs of each report of a request list (entity, parents,
    children, siblings, others): ``(lei, related_lei, section_no, first_pos)``,
    ``first_pos`` being the place (from 1) at which the LEI is first seen in
    display order: section, stored name (NULLs last), LEI."""
    rows = report.where(~F.col("section").isin("exceptions", "sibling_group")).where(F.col("related_lei").isNotNull())
    key = F.struct(
        F.col("section_no").alias("s"),
        F.col("stored_name").isNull().alias("n0"),
        F.col("stored_name").alias("n1"),
    )
    first = rows.groupBy("lei", "related_lei").agg(F.min(key).alias("k"))
    numbered = ordinal_within_group(first, ["lei"], [F.col("k"), F.col("related_lei")], "first_pos")
    return numbered.select("lei", "related_lei", F.col("k.s").alias("section_no"), "first_pos")


def entity_panel(entities: DataFrame, requests: DataFrame | None = None, isins: DataFrame | None = None) -> DataFrame:
    """The entity panel lines as columns."""
    e = get_entities(entities, requests)
    if isins is not None:
        e = attach_isins(e, isins)
    cols = [
        "lei",
        null_to_empty("legal_name").alias("name"),
        null_to_empty("entity_status").alias("status"),
        or_na("entity_category").alias("category"),
        or_na("legal_jurisdiction").alias("jurisdiction"),
        address("legal_address_city", "legal_address_country").alias("legal_address"),
        address("hq_address_city", "hq_address_country").alias("hq_address"),
        null_to_empty("registration_status").alias("registration_status"),
    ]
    if isins is not None:
        cols.append(F.col("isins"))
    return e.select(*cols)


def parent_lines(
    entities: DataFrame, rels: DataFrame, requests: DataFrame | None = None, isins: DataFrame | None = None
) -> DataFrame:
    """P2 / E19: 'Direct Parent' and 'Ultimate Parent' lines per entity,
    'None' when there is no (known) parent."""
    subjects = get_entities(entities, requests).select("lei")
    out = subjects
    for col_name, fn in (("direct_parent", relations.direct_parents), ("ultimate_parent", relations.ultimate_parents)):
        p = fn(entities, rels, subjects)
        isin_col = None
        if isins is not None:
            p = attach_isins(p, isins, "parent_lei", "__pi")
            isin_col = "__pi"
        line = p.select(
            F.col("lei").alias(f"__{col_name}"),
            parent_line("parent_lei", "legal_name", "entity_status", "legal_jurisdiction", isin_col).alias(col_name),
        )
        out = out.join(line, out["lei"] == line[f"__{col_name}"], "left").drop(f"__{col_name}")
    return out.select(
        "lei",
        F.coalesce("direct_parent", F.lit("None")).alias("direct_parent"),
        F.coalesce("ultimate_parent", F.lit("None")).alias("ultimate_parent"),
    )


# Sections that are always shown, with "None" when empty; the fifth is that of
# the report's form.
ALWAYS_SHOWN = ("direct_parent", "ultimate_parent", "children")


def report_display(report_long: DataFrame, registry: bool, isins: DataFrame | None = None) -> DataFrame:
    """One display line per report entry ``(lei, section_no, section, pos, text)``.

    Parents as 'lei | name | status | jurisdiction-or-N/A'; related entities
    as 'lei | name-or-N/A | type'; exceptions as 'category | reason | reference'
    ('' for missing parts); the entity itself as its name; the sibling group of
    the registry form (``registry``) as 'parent | count'. With ``isins``
    parents and related entities get an ISIN part where there are any. Parent,
    children and sibling sections that are empty get one 'None' line (pos 0);
    other relationships and exceptions are then simply absent. The report is written
    first: its lines, their ranges and the empty sections read it without making it again.
    """
    report_long = written(report_long, "report-long")
    sec = F.col("section")
    rows, part = report_long, F.lit("")
    if isins is not None:
        rows, part = attach_isins(report_long, isins, "related_lei", "__isin_text"), F.col("__isin_text")
    isin_part = F.when(part != "", F.concat(F.lit("ISINs: "), part))
    related = F.concat_ws(
        " | ", F.col("related_lei"), F.coalesce(F.col("legal_name"), F.lit("N/A")), F.col("relationship_type"), isin_part
    )
    exc = F.concat_ws(
        " | ",
        F.col("exception_category"),
        F.coalesce(F.col("exception_reason"), F.lit("")),
        F.coalesce(F.col("exception_reference"), F.lit("")),
    )
    parent = parent_line("related_lei", "legal_name", "entity_status", "legal_jurisdiction", part)
    text = (
        F.when(sec == "entity", F.coalesce(F.col("legal_name"), F.lit("")))
        .when(sec.isin("direct_parent", "ultimate_parent"), parent)
        .when(sec == "exceptions", exc)
        .when(sec == "sibling_group", F.concat_ws(" | ", F.col("related_lei"), F.col("sibling_count")))
        .otherwise(related)
    )
    lines = rows.select("lei", "section_no", "section", text.alias("text"),
                        "stored_name", "related_lei", "relationship_type", "exception_category")
    numbered = ordinal_within_group(
        lines,
        ["lei", "section"],
        [F.col("stored_name").isNull(), F.col("stored_name"), F.col("related_lei"),
         F.col("relationship_type"), F.col("exception_category"), F.col("text")],
        "pos",
    ).select("lei", "section_no", "section", "pos", "text")
    shown = [*ALWAYS_SHOWN, "sibling_group" if registry else "siblings"]
    subjects = report_long.where(sec == "entity").select("lei")
    wanted = subjects.select("lei", F.explode(F.array(*[F.lit(s) for s in shown])).alias("section"))
    present = report_long.select("lei", "section").distinct()
    empty = wanted.join(present, ["lei", "section"], "left_anti")
    section_no = F.create_map(*[x for s in shown for x in (F.lit(s), F.lit(SECTIONS[s]))])
    none_rows = empty.select(
        "lei", section_no[F.col("section")].alias("section_no"), "section",
        F.lit(0).cast("long").alias("pos"), F.lit("None").alias("text"),
    )
    return numbered.unionByName(none_rows)


def order_report(df: DataFrame) -> DataFrame:
    """O1-O3 display order of report lines."""
    return df.orderBy("lei", "section_no", "pos")


def order_tree(df: DataFrame, entities: DataFrame, key: str = "root_lei") -> DataFrame:
    """O2: tree rows by (depth, stored name NULLs last, LEI); chains by depth."""
    names = entities.select(F.col("lei").alias("__nl"), F.col("legal_name").alias("__nn"))
    joined = df.join(names, df["node_lei"] == names["__nl"], "left")
    ordered = joined.orderBy(F.col(key), "depth", F.col("__nn").asc_nulls_last(), "node_lei")
    return ordered.drop("__nl", "__nn")
