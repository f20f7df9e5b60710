"""Parents, children, siblings, other relationships, exceptions.

All operators are set-at-a-time: ``requests`` (a DataFrame with ``lei``)
limits the answer to some LEIs, ``None`` answers for the whole registry.
Rows are keyed by the requested LEI in column ``lei``. Output is unordered;
``order_related`` gives the display order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.functions.normalize import empty_to_null, entity_projection, related_projection
from ownergraph.operators.edges import active_edges, chosen_parent, entity_names, restrict
from ownergraph.schema import DIRECT_PARENT, ENTITY_COLUMNS, ULTIMATE_PARENT


def parents(
    entities: DataFrame, rels: DataFrame, rel_type: str, requests: DataFrame | None = None, stored_name: bool = False
) -> DataFrame:
    """The parent entity of each child for ``rel_type``.

    The parent is chosen first (smallest LEI among active edges) and only
    then looked up; a chosen parent missing from the entity table gives no
    row even if another parent exists - the source applies its LIMIT 1
    before the existence check.
    """
    chosen = chosen_parent(rels, rel_type, requests)
    ent = entities.select(*ENTITY_COLUMNS).alias("p")
    joined = chosen.join(ent, chosen["end_node_id"] == F.col("p.lei"), "inner")
    return joined.select(
        F.col("start_node_id").alias("lei"),
        *entity_projection("p", lei_alias="parent_lei"),
        *([F.col("p.legal_name").alias("stored_name")] if stored_name else []),
    )


def direct_parents(entities, rels, requests=None, stored_name: bool = False) -> DataFrame:
    return parents(entities, rels, DIRECT_PARENT, requests, stored_name)


def ultimate_parents(entities, rels, requests=None, stored_name: bool = False) -> DataFrame:
    return parents(entities, rels, ULTIMATE_PARENT, requests, stored_name)


def children(
    entities: DataFrame, rels: DataFrame, requests: DataFrame | None = None, stored_name: bool = False
) -> DataFrame:
    """Every active edge into the LEI, of any type, with the child name.

    No type filter: a child with a direct and an ultimate edge to the same
    parent appears twice, and non-consolidation links appear here too.
    """
    edges = restrict(active_edges(rels), "end_node_id", requests)
    names = entity_names(entities)
    joined = edges.join(names, edges["start_node_id"] == names["__ent_lei"], "left")
    return joined.select(
        *related_projection(
            F.col("end_node_id"),
            F.col("start_node_id"),
            F.col("__ent_name"),
            F.col("relationship_type"),
            F.col("relationship_status"),
            "child",
            stored_name,
        )
    )


def siblings(
    entities: DataFrame,
    rels: DataFrame,
    requests: DataFrame,
    stored_name: bool = False,
    rels_by_parent: DataFrame | None = None,
) -> DataFrame:
    """R4 for a request list: entities sharing the chosen direct parent.

    The answer for one LEI is all other members of its parent's group, so a
    request list of n members of one group yields n x group rows. For the
    whole registry use ``sibling_groups`` + ``sibling_counts`` instead, which
    keep the group once rather than once per member. ``rels_by_parent`` is the same
    edges laid out by parent: the groups are looked up there.
    """
    chosen = chosen_parent(rels, DIRECT_PARENT, requests).select(
        F.col("start_node_id").alias("__self"), F.col("end_node_id").alias("__parent")
    )
    members = active_edges(rels if rels_by_parent is None else rels_by_parent, [DIRECT_PARENT])
    members = restrict(members, "end_node_id", chosen.select(F.col("__parent").alias("lei")))
    pairs = chosen.join(members, members["end_node_id"] == chosen["__parent"]).where(
        F.col("start_node_id") != F.col("__self")
    )
    names = entity_names(entities)
    joined = pairs.join(names, pairs["start_node_id"] == names["__ent_lei"], "left")
    return joined.select(
        *related_projection(
            F.col("__self"),
            F.col("start_node_id"),
            F.col("__ent_name"),
            F.col("relationship_type"),
            F.col("relationship_status"),
            "sibling",
            stored_name,
        )
    )


def sibling_groups(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """R4, factorised: the members of every parent that is some child's
    chosen direct parent, once per parent (``parent_lei``).

    Siblings of X = members of the group of X's chosen parent, minus X.
    """
    parents_used = chosen_parent(rels, DIRECT_PARENT).select(
        F.col("end_node_id").alias("__parent")
    ).distinct()
    members = active_edges(rels, [DIRECT_PARENT])
    grouped = members.join(parents_used, members["end_node_id"] == parents_used["__parent"], "left_semi")
    names = entity_names(entities)
    joined = grouped.join(names, grouped["start_node_id"] == names["__ent_lei"], "left")
    return joined.select(
        *related_projection(
            F.col("end_node_id"),
            F.col("start_node_id"),
            F.col("__ent_name"),
            F.col("relationship_type"),
            F.col("relationship_status"),
            "sibling",
        )
    ).withColumnRenamed("lei", "parent_lei")


def sibling_counts(rels: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """R4, factorised: ``(lei, parent_lei, sibling_count)`` per child.

    sibling_count = direct active edges into the parent minus the child's own
    edges to it - exactly the row count of R4. One (child, parent) edge count
    feeds both the chosen parent (smallest parent, carrying its own edge
    count) and the parents' in-degrees; every step is a map-side combined
    aggregate and no pair of members is formed.
    """
    direct = active_edges(rels, [DIRECT_PARENT])
    pairs = direct.groupBy("start_node_id", "end_node_id").agg(F.count(F.lit(1)).alias("__own"))
    chosen = (
        restrict(pairs, "start_node_id", requests)
        .where(F.col("start_node_id").isNotNull() & F.col("end_node_id").isNotNull())
        .groupBy("start_node_id")
        .agg(F.min(F.struct(F.col("end_node_id").alias("p"), F.col("__own").alias("n"))).alias("__c"))
    )
    indegree = (
        pairs.where(F.col("start_node_id").isNotNull())
        .groupBy(F.col("end_node_id").alias("__p"))
        .agg(F.sum("__own").alias("__in"))
    )
    out = chosen.join(indegree, chosen["__c.p"] == indegree["__p"], "left")
    return out.select(
        F.col("start_node_id").alias("lei"),
        F.col("__c.p").alias("parent_lei"),
        (F.coalesce(F.col("__in"), F.lit(0)) - F.col("__c.n")).cast("long").alias("sibling_count"),
    )


def other_relationships(
    entities: DataFrame,
    rels: DataFrame,
    requests: DataFrame | None = None,
    stored_name: bool = False,
    rels_by_parent: DataFrame | None = None,
) -> DataFrame:
    """Active edges of a non-consolidation type at either end.

    The source's ``start = x OR end = x`` is split into two equi-joins (an OR
    condition cannot hash-join); a self-loop is kept on the start side only,
    so it yields one row like the source. The end side is looked up in
    ``rels_by_parent``, the same edges laid out by parent, where given.
    """
    other = ~F.col("relationship_type").isin(DIRECT_PARENT, ULTIMATE_PARENT)
    edges = active_edges(rels).where(other)
    edges_in = edges if rels_by_parent is None else active_edges(rels_by_parent).where(other)
    as_start = restrict(edges, "start_node_id", requests).select(
        F.col("start_node_id").alias("__req"),
        F.col("end_node_id").alias("__other"),
        "relationship_type",
        "relationship_status",
    )
    as_end = (
        restrict(edges_in, "end_node_id", requests)
        .where(F.col("start_node_id") != F.col("end_node_id"))
        .select(
            F.col("end_node_id").alias("__req"),
            F.col("start_node_id").alias("__other"),
            "relationship_type",
            "relationship_status",
        )
    )
    both = as_start.unionByName(as_end)
    names = entity_names(entities)
    joined = both.join(names, both["__other"] == names["__ent_lei"], "left")
    return joined.select(
        *related_projection(
            F.col("__req"),
            F.col("__other"),
            F.col("__ent_name"),
            F.col("relationship_type"),
            F.col("relationship_status"),
            "other",
            stored_name,
        )
    )


def reporting_exceptions(exceptions: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Reporting exceptions of each requested LEI (reason and reference
    NULL when empty)."""
    rows = restrict(exceptions, "lei", requests)
    return rows.select(
        "lei",
        "exception_category",
        empty_to_null("exception_reason_1").alias("exception_reason"),
        empty_to_null("exception_reference_1").alias("exception_reference"),
    )


def order_related(df: DataFrame) -> DataFrame:
    """Display order of related rows: stored name (an empty one first, NULLs
    last), LEI, type. ``df`` is the output of an operator above, best with
    ``stored_name``; without it the normalised name (empty is NULL) is used."""
    name = "stored_name" if "stored_name" in df.columns else "legal_name"
    return df.orderBy(
        F.col("lei").asc(),
        F.col(name).asc_nulls_last(),
        F.col("related_lei").asc(),
        F.col("relationship_type").asc(),
    )
