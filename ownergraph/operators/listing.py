"""H7, H8: numbered hierarchy listing and the parent -> children map.

A node's line is the line of its parent, plus one, plus the sizes of the subtrees of
its elder siblings. So it is the sum of these offsets over the node and its
ancestors in the tree. The (node, ancestor) pairs over the kept parents come from
pointer jumping, at most six rounds for depth 50; their count per ancestor is the
size of its subtree, and their sum of offsets is the line. Nothing but keys, names of
single nodes and numbers moves: no row holds the names of its ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.functions.display import node_label
from ownergraph.functions.normalize import empty_to_null
from ownergraph.operators.hierarchy import descendant_levels, group_levels, with_node_info
from ownergraph.operators.ranking import running_sums_within_group
from ownergraph.schema import MAX_HIERARCHY_DEPTH
from ownergraph.session import materialize, materialize_counted
from ownergraph.sources.isin import attach_isins


def ancestor_pairs(levels: DataFrame) -> DataFrame:
    """``(root_lei, node_lei, up, steps)``: every node of the trees with each of its
    ancestors over the kept parents, by pointer jumping: the ancestors within 2^k
    steps, and those of the ancestor that is exactly 2^k steps up."""
    tree = ["root_lei", "node_lei"]
    pairs, (far,) = materialize_counted(
        levels.where("depth > 0").select(*tree, F.col("parent_lei").alias("up"), F.lit(1).alias("steps")), by=("steps", [1])
    )
    reach = 1
    while far:
        jump = pairs.where(F.col("steps") == reach).select("root_lei", "node_lei", F.col("up").alias("__mid"))
        rest = pairs.select(
            F.col("root_lei").alias("__r"), F.col("node_lei").alias("__n"), "up", (F.col("steps") + reach).alias("steps")
        )
        reach *= 2
        more, (far,) = materialize_counted(
            jump.join(rest, (jump["root_lei"] == rest["__r"]) & (jump["__mid"] == rest["__n"])).select(*tree, "up", "steps"),
            by=("steps", [reach]),
        )
        pairs = pairs.unionByName(more)
    return pairs


def _child_order(levels: DataFrame, entities: DataFrame) -> tuple[DataFrame, list]:
    """Tree rows with the stored name, and the order of children: name (NULLs last),
    then LEI. The children of a kept parent have one depth."""
    names = entities.groupBy(F.col("lei").alias("__nl")).agg(F.min("legal_name").alias("__name"))
    named = levels.join(names, levels["node_lei"] == names["__nl"], "left").drop("__nl")
    return named, [F.col("__name").asc_nulls_last(), F.col("node_lei").asc()]


def line_numbers(levels: DataFrame, entities: DataFrame) -> DataFrame:
    """``(root_lei, node_lei, line_no)``: pre-order numbers from 1 of the nodes of
    each tree, children in the order of the listing."""
    levels = materialize(levels.select("root_lei", "node_lei", "depth", "parent_lei"))
    pairs = ancestor_pairs(levels)
    below = pairs.groupBy(F.col("root_lei").alias("__r"), F.col("up").alias("__n")).agg(F.count(F.lit(1)).alias("__below"))
    kids = levels.where("depth > 0")
    sized = kids.join(below, (kids["root_lei"] == below["__r"]) & (kids["node_lei"] == below["__n"]), "left").select(
        "root_lei", "node_lei", "parent_lei", (F.coalesce("__below", F.lit(0)) + 1).alias("size")
    )
    named, order = _child_order(sized, entities)
    summed = running_sums_within_group(named, ["root_lei", "parent_lei"], order, {"upto": F.col("size")})
    # Lines between the parent's and the node's own.
    offsets = materialize(summed.select("root_lei", "node_lei", (F.col("upto") - F.col("size") + 1).alias("offset")))
    above = offsets.select(F.col("root_lei").alias("__r"), F.col("node_lei").alias("__n"), "offset")
    carried = pairs.join(above, (pairs["root_lei"] == above["__r"]) & (pairs["up"] == above["__n"])).select(
        "root_lei", "node_lei", "offset"
    )
    lines = carried.unionByName(offsets).groupBy("root_lei", "node_lei").agg((F.sum("offset") + 1).alias("line_no"))
    return lines.unionByName(levels.where("depth = 0").select("root_lei", "node_lei", F.lit(1).cast("long").alias("line_no")))


def _numbered(levels: DataFrame, entities: DataFrame, isins: DataFrame | None, with_header: bool) -> DataFrame:
    """Labels, line numbers and header lines."""
    lines = line_numbers(levels, entities)
    placed = levels.join(lines, ["root_lei", "node_lei"])
    nodes = with_node_info(placed, entities, ["root_lei", "line_no"])
    isin_col = None
    if isins is not None:
        nodes = attach_isins(nodes, isins, "node_lei", "__isins")
        isin_col = "__isins"
    label = node_label("node_lei", "legal_name", "legal_jurisdiction", "entity_status", isin_col)
    out = nodes.select("root_lei", "line_no", "depth", "node_lei", label.alias("label"))
    if with_header:
        sizes = levels.groupBy("root_lei").agg(F.count(F.lit(1)).alias("__n"))
        header = sizes.select(
            "root_lei",
            F.lit(0).cast("long").alias("line_no"),
            F.lit(-1).cast("int").alias("depth"),
            F.col("root_lei").alias("node_lei"),
            F.concat(F.lit("Corporate Group ("), F.col("__n").cast("string"), F.lit(" entities)")).alias("label"),
        )
        out = out.unionByName(header)
    return out


def hierarchy_listing(
    entities: DataFrame,
    rels: DataFrame,
    roots: DataFrame,
    max_depth: int = MAX_HIERARCHY_DEPTH,
    isins: DataFrame | None = None,
    with_header: bool = True,
) -> DataFrame:
    """H7: ``(root_lei, line_no, depth, node_lei, label)`` per tree node of
    the given roots.

    With ``with_header`` each root also gets line 0 (depth -1), 'Corporate
    Group (N entities)', N counted by a map-side combined aggregate.

    Pre-order from the root, children ordered by (name NULLs last, LEI). Since the
    tree holds each node once, the source's "(see above)" line for repeated nodes
    can never occur and is not produced.
    """
    return _numbered(descendant_levels(entities, rels, roots, max_depth), entities, isins, with_header)


def registry_listing(
    entities: DataFrame,
    rels: DataFrame,
    max_depth: int = MAX_HIERARCHY_DEPTH,
    isins: DataFrame | None = None,
    with_header: bool = True,
) -> DataFrame:
    """H7 for every corporate group of the registry."""
    _, levels = group_levels(entities, rels, None, max_depth)
    return _numbered(levels, entities, isins, with_header)


def children_map(tree: DataFrame, entities: DataFrame) -> DataFrame:
    """H8 long form: ``(root_lei, parent_lei, pos, node_lei)`` - the children
    of each parent in listing order (depth, stored name NULLs last, LEI), 1-based;
    the root has parent NULL. ``tree`` is ``descendant_levels`` or
    ``group_levels``."""
    named, order = _child_order(tree.select("root_lei", "parent_lei", "node_lei"), entities)
    placed = running_sums_within_group(named, ["root_lei", "parent_lei"], order, {"pos": F.lit(1)})
    return placed.select("root_lei", empty_to_null("parent_lei").alias("parent_lei"), "pos", "node_lei")
