"""H1-H6: ancestor chains, descendant trees, corporate groups.

* Ancestors (H1) are by definition one row per simple path upwards: a level by
  level walk that carries the path for the cycle guard.
* Descendants (H2) keep one row per (root, node) with the smallest depth and
  then the smallest parent LEI. From given roots this is a breadth-first walk
  with a visited anti join (``descendant_levels``). With every entity as a root
  the distances are doubled instead (``_shortest``): what lies within 2^k of a
  node follows from what lies within 2^(k-1), so six rounds cover depth 50.
* Group roots (H3) are the deepest nodes of the simple upward paths. Edges that lie
  on a cycle (their parent leads back to their child) are told apart. Only inside the cycles a path
  is kept; it becomes one step from where the cycle is entered to where it is left.
  Over these steps and the other edges every walk is simple, so the depths that
  join two nodes tell, by doubling and without paths: one row per (start, node)
  with the depths as the bits of a long (``_simple_masks``; beyond 62 levels one row
  per depth, ``_row_walks``).
* Corporate groups (H4) of the whole registry are read off the same rows: the
  shortest depth per (root, node), then the smallest parent one step nearer. For
  request lists they are breadth-first trees of the distinct roots.

Every level or round is a reliable checkpoint (a lost executor only recomputes
the last one); row counts are observed while it runs, so the driver learns that
a walk is over without another job and no rows pass through it. Joins are left
to the planner: both sides come from stored rows and have an exchange of their
own, so AQE broadcasts a small side or splits a hot key (a parent owning a third
of the registry), and the grouping after a join is on other keys, behind its own
exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.functions.normalize import empty_to_null
from ownergraph.operators.edges import active_edges, restrict, union_all
from ownergraph.schema import DIRECT_PARENT, MAX_HIERARCHY_DEPTH
from ownergraph.session import materialize, materialize_counted

NODE_COLUMNS = ["legal_name", "entity_status", "entity_category", "legal_jurisdiction"]


def _direct_edges(rels: DataFrame) -> DataFrame:
    return active_edges(rels, [DIRECT_PARENT]).select(
        F.col("start_node_id").alias("__child"),
        F.col("end_node_id").alias("__parent"),
        F.col("relationship_type").alias("__type"),
    ).where("__child IS NOT NULL AND __parent IS NOT NULL")


def _anchors(entities: DataFrame, requests: DataFrame | None, key: str) -> DataFrame:
    """Start nodes: requested LEIs that are entities (unknown LEIs give no
    rows even when edges mention them)."""
    return restrict(entities.select(F.col("lei").alias(key)), key, requests)


def with_node_info(levels: DataFrame, entities: DataFrame, key_cols: list[str]) -> DataFrame:
    """Left join node names and normalise like the source's node rows."""
    ent = entities.select(F.col("lei").alias("__n_lei"), *NODE_COLUMNS)
    joined = levels.join(ent, levels["node_lei"] == ent["__n_lei"], "left")
    return joined.select(
        *key_cols,
        "node_lei",
        *[empty_to_null(c).alias(c) for c in NODE_COLUMNS],
        empty_to_null("via_type").alias("relationship_type"),
        F.col("depth").cast("int").alias("depth"),
        empty_to_null("parent_lei").alias("parent_lei"),
    )


# ---------------------------------------------------------------------------
# Level-synchronous walk
# ---------------------------------------------------------------------------

# Levels planned into one job before a checkpoint. Planning two levels into
# one job (the second on top of the first) measured slower at sf0.1 (5.7 s
# vs 8.4 s for all descendant trees): the first level's post-shuffle work is
# recomputed for each of its uses. One level per job is the default.
LEVELS_PER_JOB = 1


def _walk(
    start: DataFrame,
    step: Callable[[DataFrame, DataFrame | None, int], DataFrame],
    max_depth: int,
    visited_keys: list[str] | None = None,
    levels_per_job: int | None = None,
) -> DataFrame:
    """Run ``step(frontier, seen, depth)`` level by level from ``start``
    (depth 0) until a level is empty or ``max_depth`` is reached.

    ``seen`` is the union of ``visited_keys`` of all earlier levels (None when
    no visited set is kept). Each block of levels is one reliable checkpoint;
    the rows per depth are observed while it runs, so the driver learns that
    the walk is over without another job.
    """
    levels_per_job = levels_per_job or LEVELS_PER_JOB
    blocks = [start]
    visited = [start.select(*visited_keys)] if visited_keys else None
    frontier, depth = start, 1
    while depth <= max_depth:
        k = min(levels_per_job, max_depth - depth + 1)
        seen = union_all(visited) if visited_keys else None
        planned, cur = [], frontier
        for i in range(k):
            nxt = step(cur, seen, depth + i)
            planned.append(nxt)
            if visited_keys:
                seen = seen.unionByName(nxt.select(*visited_keys))
            cur = nxt
        depths = [depth + i for i in range(k)]
        block, counts = materialize_counted(union_all(planned), by=("depth", depths))
        blocks.append(block)
        if visited_keys:
            visited.append(block.select(*visited_keys))
        if counts[-1] == 0:
            break
        frontier = block.where(F.col("depth") == depths[-1])
        depth += k
    return union_all(blocks)


# ---------------------------------------------------------------------------
# H1 ancestor chain
# ---------------------------------------------------------------------------


def _upward_walk(starts: DataFrame, rels: DataFrame, max_depth: int) -> DataFrame:
    """Every simple upward path from each start (column ``lei``):
    ``(lei, node_lei, via_type, depth, parent_lei)``.

    ``parent_lei`` is the previous node of the walk (the child side).
    """
    edges = _direct_edges(rels).persist(StorageLevel.MEMORY_AND_DISK)
    level = starts.select(
        "lei",
        F.col("lei").alias("node_lei"),
        F.lit(None).cast("string").alias("via_type"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_lei"),
        F.array(F.col("lei")).alias("path"),
    )

    def step(cur: DataFrame, _seen, depth: int) -> DataFrame:
        nxt = cur.join(edges, cur["node_lei"] == edges["__child"]).where(
            ~F.array_contains(F.col("path"), F.col("__parent"))
        )
        return nxt.select(
            "lei",
            F.col("__parent").alias("node_lei"),
            F.col("__type").alias("via_type"),
            F.lit(depth).alias("depth"),
            F.col("node_lei").alias("parent_lei"),
            F.array_append(F.col("path"), F.col("__parent")).alias("path"),
        )

    walked = _walk(level, step, max_depth)
    edges.unpersist()
    return walked.drop("path")


def ancestor_levels(
    entities: DataFrame,
    rels: DataFrame,
    requests: DataFrame | None = None,
    max_depth: int = MAX_HIERARCHY_DEPTH,
) -> DataFrame:
    """H1 rows without names: ``(lei, node_lei, via_type, depth, parent_lei)``.

    Every simple upward path is kept (not de-duplicated); ``parent_lei`` is
    the previous node of the walk (the child side), as in the source.
    """
    starts = _anchors(entities, requests, "lei")
    return _upward_walk(starts, rels, max_depth)


def ancestor_chain(
    entities: DataFrame,
    rels: DataFrame,
    requests: DataFrame | None = None,
    max_depth: int = MAX_HIERARCHY_DEPTH,
) -> DataFrame:
    """H1: walk up direct active edges from each requested entity."""
    levels = ancestor_levels(entities, rels, requests, max_depth)
    return with_node_info(levels, entities, ["lei"])


# ---------------------------------------------------------------------------
# H2 descendant tree
# ---------------------------------------------------------------------------


def descendant_levels(
    entities: DataFrame,
    rels: DataFrame,
    roots: DataFrame | None = None,
    max_depth: int = MAX_HIERARCHY_DEPTH,
) -> DataFrame:
    """H2 rows without names: ``(root_lei, node_lei, via_type, depth, parent_lei)``.

    ``roots`` is a DataFrame with ``lei`` (None = every entity is a root).
    """
    edges = _direct_edges(rels).persist(StorageLevel.MEMORY_AND_DISK)
    level = _anchors(entities, roots, "root_lei").distinct().select(
        "root_lei",
        F.col("root_lei").alias("node_lei"),
        F.lit(None).cast("string").alias("via_type"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_lei"),
    )

    def step(cur: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
        nxt = cur.join(edges, cur["node_lei"] == edges["__parent"]).select(
            "root_lei",
            F.col("__child").alias("node_lei"),
            F.struct(F.col("node_lei").alias("p"), F.col("__type").alias("t")).alias("__via"),
        )
        # H5: one row per node of this level, smallest parent first.
        best = nxt.groupBy("root_lei", "node_lei").agg(F.min("__via").alias("__via"))
        fresh = best.join(seen, ["root_lei", "node_lei"], "left_anti")
        return fresh.select(
            "root_lei",
            "node_lei",
            F.col("__via.t").alias("via_type"),
            F.lit(depth).alias("depth"),
            F.col("__via.p").alias("parent_lei"),
        )

    levels = _walk(level, step, max_depth, visited_keys=["root_lei", "node_lei"])
    edges.unpersist()
    return levels


def _shortest(rels: DataFrame, max_depth: int) -> DataFrame:
    """``(root_lei, node_lei, depth, parent_lei)`` of every pair joined by a
    downward walk of 1 to ``max_depth`` edges: shortest depth, then smallest
    parent, found by doubling the distance.

    Every shortest walk longer than 2^k passes a node at distance 2^k from its
    root, so the pairs at that distance, continued by all pairs known so far,
    give all pairs up to 2^(k+1), with the right parent: the least over all those
    nodes is the least over all shortest walks.
    """
    pair = ["root_lei", "node_lei"]
    known = _direct_edges(rels).where("__child <> __parent").groupBy(
        F.col("__parent").alias("root_lei"), F.col("__child").alias("node_lei")
    ).agg(F.min(F.struct(F.lit(1).alias("d"), F.col("__parent").alias("p"))).alias("__b"))
    reach = 1
    known, (at_reach,) = materialize_counted(
        known.select(*pair, F.col("__b.d").alias("depth"), F.col("__b.p").alias("parent_lei")), by=("depth", [reach])
    )
    while at_reach and reach < max_depth:
        far = known.where(F.col("depth") == reach).select("root_lei", F.col("node_lei").alias("__mid"))
        more = known.select(
            F.col("root_lei").alias("__from"), "node_lei", (F.col("depth") + reach).alias("d"), F.col("parent_lei").alias("p")
        ).where(F.col("d") <= max_depth)
        found = far.join(more, far["__mid"] == more["__from"]).where(F.col("root_lei") != F.col("node_lei"))
        best = (
            known.select(*pair, F.struct(F.col("depth").alias("d"), F.col("parent_lei").alias("p")).alias("__b"))
            .unionByName(found.select(*pair, F.struct("d", "p").alias("__b")))
            .groupBy(*pair)
            .agg(F.min("__b").alias("__b"))
        )
        reach *= 2
        known, (at_reach,) = materialize_counted(
            best.select(*pair, F.col("__b.d").alias("depth"), F.col("__b.p").alias("parent_lei")), by=("depth", [reach])
        )
    return known


def descendant_tree(
    entities: DataFrame,
    rels: DataFrame,
    roots: DataFrame | None = None,
    max_depth: int = MAX_HIERARCHY_DEPTH,
) -> DataFrame:
    """H2: one row per node below each root (root itself at depth 0). With
    ``roots`` None every entity is a root."""
    if roots is not None:
        return with_node_info(descendant_levels(entities, rels, roots, max_depth), entities, ["root_lei"])
    own = _anchors(entities, None, "root_lei").distinct()
    top = own.select(
        "root_lei",
        F.col("root_lei").alias("node_lei"),
        F.lit(None).cast("string").alias("via_type"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_lei"),
    )
    if max_depth < 1:
        return with_node_info(top, entities, ["root_lei"])
    below = _shortest(rels, max_depth).join(own, "root_lei", "left_semi")
    levels = top.unionByName(
        below.select("root_lei", "node_lei", F.lit(DIRECT_PARENT).alias("via_type"), "depth", "parent_lei")
    )
    return with_node_info(levels, entities, ["root_lei"])


# ---------------------------------------------------------------------------
# H3 / H4 corporate groups
# ---------------------------------------------------------------------------


def _walk_lengths(steps: DataFrame, max_depth: int, single: bool = True) -> DataFrame:
    """Distinct ``(lei, node_lei, depth)`` of all walks over one or more of ``steps``
    (the same columns) of depth up to ``max_depth``, by doubling: a walk of more than
    2^k steps is one of exactly 2^k steps followed by a shorter one. At most nodes x
    ancestors x depth rows, however many walks there are.

    With ``single`` every step has depth 1, so walks of different numbers of steps
    never coincide; otherwise what is known already is merged in every round.
    ``exact`` marks the walks of exactly 2^k steps.
    """
    cols = ["lei", "node_lei", "depth"]
    walks, (longest,) = materialize_counted(
        steps.select(*cols).distinct().withColumn("exact", F.lit(True)), by=("exact", [True])
    )
    reach = 1
    while longest and reach < max_depth:
        first = walks.where("exact").select("lei", F.col("node_lei").alias("__mid"), F.col("depth").alias("__d"))
        rest = walks.select(F.col("lei").alias("__from"), "node_lei", "depth", "exact")
        more = (
            first.join(rest, first["__mid"] == rest["__from"])
            .select("lei", "node_lei", (F.col("__d") + F.col("depth")).alias("depth"), "exact")
            .where(F.col("depth") <= max_depth)
        )
        known = walks.withColumn("exact", F.lit(False))
        if single:
            more, (longest,) = materialize_counted(more.distinct(), by=("exact", [True]))
            walks = known.unionByName(more)
        else:
            both = known.unionByName(more).groupBy(*cols).agg(F.max("exact").alias("exact"))
            walks, (longest,) = materialize_counted(both, by=("exact", [True]))
        reach *= 2
    return walks.select(*cols)


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(edges, rows)`` without the edges that can't lie on a cycle because nothing
    leads to their child or nothing leads on from their parent, repeated until none
    goes. A chain loses both its ends in a round."""
    pairs, (n,) = _pairs_counted(edges.select("__child", "__parent").where("__child <> __parent").distinct())
    while n:
        above = pairs.select(F.col("__parent").alias("__child")).distinct()
        below = pairs.select(F.col("__child").alias("__parent")).distinct()
        left = pairs.join(above, "__child", "left_semi").join(below, "__parent", "left_semi").select("__child", "__parent")
        left, (m,) = _pairs_counted(left)
        if m == n:
            break
        pairs, n = left, m
    return pairs, n


def _pairs_counted(pairs: DataFrame) -> tuple[DataFrame, list[int]]:
    return materialize_counted(pairs.withColumn("__is", F.lit(True)), by=("__is", [True]))


def cyclic_edges(edges: DataFrame, max_depth: int) -> DataFrame | None:
    """The ``(__child, __parent)`` edges that lie on a closed walk of at most
    ``max_depth`` edges; None when there are none.

    What can't lie on a cycle is trimmed off first; in the rest, the nodes reached
    within 2^k steps are doubled, and an edge is cyclic if its parent reaches its
    child. A walk of up to ``max_depth`` edges that meets a node twice runs through
    cyclic edges alone between the two meetings. So it is simple if each of its runs
    of cyclic edges is, and runs can be worked out by themselves. Longer cycles need
    no care: no walk within the depth closes them.
    """
    core, n = _trimmed(edges)
    if not n:
        return None
    # The parent leads back to the child in max_depth - 1 steps at most.
    reach = core.select(F.col("__child").alias("a"), F.col("__parent").alias("b"), F.lit(True).alias("exact"))
    size, met = 1, n
    while size < max_depth - 1:
        first = reach.where("exact").select("a", F.col("b").alias("__mid"))
        rest = reach.select(F.col("a").alias("__from"), "b", "exact")
        more = first.join(rest, first["__mid"] == rest["__from"]).select("a", "b", "exact")
        both = reach.withColumn("exact", F.lit(False)).unionByName(more).groupBy("a", "b").agg(F.max("exact").alias("exact"))
        reach, (far, other) = materialize_counted(both, by=("exact", [True, False]))
        size *= 2
        if not far or far + other == met:
            break
        met = far + other
    back = reach.select(F.col("a").alias("__parent"), F.col("b").alias("__child"))
    found, (n,) = _pairs_counted(core.select("__child", "__parent").join(back, ["__child", "__parent"], "left_semi"))
    return found.select("__child", "__parent") if n else None


def _runs(cyclic: DataFrame, max_depth: int) -> DataFrame:
    """Distinct ``(lei, node_lei, depth)`` of the simple paths of 1 to ``max_depth``
    cyclic edges. Paths are kept here, and here alone: how far a simple path can go
    inside a cycle is not told by shorter facts."""
    start = cyclic.select(F.col("__child").alias("lei")).distinct().select(
        "lei", F.col("lei").alias("node_lei"), F.lit(0).alias("depth"), F.array("lei").alias("path")
    )

    def step(cur: DataFrame, _seen, depth: int) -> DataFrame:
        nxt = cur.join(cyclic, cur["node_lei"] == cyclic["__child"]).where(~F.array_contains("path", F.col("__parent")))
        return nxt.select(
            "lei", F.col("__parent").alias("node_lei"), F.lit(depth).alias("depth"), F.array_append("path", F.col("__parent")).alias("path")
        )

    return _walk(start, step, max_depth).where("depth > 0").select("lei", "node_lei", "depth").distinct()


def _row_walks(edges: DataFrame, max_depth: int) -> DataFrame:
    """``simple_walks`` with one row per depth, for limits that a mask can't hold."""
    single = edges.where("__child <> __parent").select(
        F.col("__child").alias("lei"), F.col("__parent").alias("node_lei"), F.lit(1).alias("depth")
    )
    cyclic = cyclic_edges(edges, max_depth)
    if cyclic is None:
        return _walk_lengths(single, max_depth)
    runs = materialize(_runs(cyclic, max_depth))
    outside = single.distinct().join(
        cyclic.select(F.col("__child").alias("lei"), F.col("__parent").alias("node_lei")), ["lei", "node_lei"], "left_anti"
    )
    # A step: one edge outside the cycles, then nothing or a run.
    entered = runs.select(F.col("lei").alias("__at"), F.col("node_lei").alias("__to"), F.col("depth").alias("__d"))
    steps = outside.unionByName(
        outside.join(entered, outside["node_lei"] == entered["__at"])
        .select("lei", F.col("__to").alias("node_lei"), (F.col("depth") + F.col("__d")).alias("depth"))
        .where(F.col("depth") <= max_depth)
    )
    walks = _walk_lengths(steps, max_depth, single=False)
    # A start on a cycle may begin with a run.
    onward = walks.select(F.col("lei").alias("__at"), F.col("node_lei").alias("__to"), F.col("depth").alias("__d"))
    begun = (
        runs.join(onward, runs["node_lei"] == onward["__at"])
        .select("lei", F.col("__to").alias("node_lei"), (F.col("depth") + F.col("__d")).alias("depth"))
        .where(F.col("depth") <= max_depth)
    )
    return materialize(walks.unionByName(runs).unionByName(begun).distinct())


# ---------------------------------------------------------------------------
# Walk depths as bits of a long: one row per (start, node)
# ---------------------------------------------------------------------------

MASK_DEPTH = 62  # bit d of a mask stands for a walk of depth d


def _kept_bits(max_depth: int):
    return F.lit((1 << (max_depth + 1)) - 1).cast("long")


def _masked_walks(edges: DataFrame, max_depth: int) -> tuple[DataFrame, bool]:
    """``(lei, node_lei, mask)`` of all walks of 1 to ``max_depth`` edges, and whether
    one leads back to its start. Doubling: a walk of more than 2^k edges is one of
    2^k edges (bit 2^k of the first mask) followed by a shorter one (the second mask,
    moved up by 2^k bits)."""
    pair = ["lei", "node_lei"]

    def counted(df: DataFrame, reach: int):
        far = (F.col("mask").bitwiseAND(F.lit(1 << reach).cast("long")) != 0).cast("int")
        back = (F.col("lei") == F.col("node_lei")).cast("int")
        out, (far, back, both) = materialize_counted(df.withColumn("__tag", far + 2 * back), by=("__tag", [1, 2, 3]))
        return out.drop("__tag"), far + both, back + both

    start = edges.select(F.col("__child").alias("lei"), F.col("__parent").alias("node_lei")).where("lei <> node_lei").distinct()
    reach = 1
    walks, far, back = counted(start.withColumn("mask", F.lit(2).cast("long")), reach)
    while far and reach < max_depth:
        first = walks.where(F.col("mask").bitwiseAND(F.lit(1 << reach).cast("long")) != 0).select("lei", F.col("node_lei").alias("__mid"))
        moved = F.shiftleft("mask", reach).bitwiseAND(_kept_bits(max_depth))
        rest = walks.select(F.col("lei").alias("__from"), "node_lei", moved.alias("mask")).where("mask <> 0")
        more = first.join(rest, first["__mid"] == rest["__from"]).select(*pair, "mask")
        reach *= 2
        # Bits past the limit are cut off, so no walk looks longer than it may be.
        walks, far, back = counted(
            walks.unionByName(more).groupBy(*pair).agg(F.bit_or("mask").alias("mask")), min(reach, MASK_DEPTH)
        )
    return walks, back > 0


def _sums_of(a, b, max_depth: int):
    """Mask of all sums of a depth of ``a`` and one of ``b`` up to the limit."""
    one = F.lit(1).cast("long")
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(max_depth)),
        F.lit(0).cast("long"),
        lambda got, d: got.bitwiseOR(
            F.when(F.expr("0") == F.call_function("shiftright", a, d).bitwiseAND(one), F.lit(0).cast("long")).otherwise(
                F.call_function("shiftleft", b, d)
            )
        ),
    )
    return total.bitwiseAND(_kept_bits(max_depth))


def _simple_masks(edges: DataFrame, max_depth: int) -> DataFrame:
    """``(lei, node_lei, mask)``: the depths of the simple upward paths per pair."""
    walks, circular = _masked_walks(edges, max_depth)
    if not circular:
        return walks
    # An edge is cyclic if its parent reaches its child.
    back = walks.select(F.col("lei").alias("__parent"), F.col("node_lei").alias("__child"))
    pairs = edges.select("__child", "__parent").where("__child <> __parent").distinct()
    cyclic = materialize(pairs.join(back, ["__child", "__parent"], "left_semi"))
    on_cycle = cyclic.select(F.col("__child").alias("node_lei")).distinct()
    # Only walks from nodes that lead to a cycle can be other than simple.
    tangled = materialize(
        walks.join(on_cycle, "node_lei", "left_semi").select("lei").unionByName(on_cycle.select(F.col("node_lei").alias("lei"))).distinct()
    )
    plain = walks.join(tangled, "lei", "left_anti")
    near = tangled.unionByName(walks.join(tangled, "lei", "left_semi").select(F.col("node_lei").alias("lei"))).distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))
    runs = materialize(_runs(cyclic, max_depth).groupBy("lei", "node_lei").agg(F.bit_or(bit).alias("mask")))
    outside = (
        pairs.join(cyclic, ["__child", "__parent"], "left_anti")
        .select(F.col("__child").alias("lei"), F.col("__parent").alias("node_lei"))
        .join(near, "lei", "left_semi")
    )
    # A step: one edge outside the cycles, then nothing or a run.
    entered = runs.select(F.col("lei").alias("__at"), F.col("node_lei").alias("__to"), "mask")
    through = outside.join(entered, outside["node_lei"] == entered["__at"]).select(
        "lei", F.col("__to").alias("node_lei"), F.shiftleft("mask", 1).bitwiseAND(_kept_bits(max_depth)).alias("mask")
    )
    steps = outside.withColumn("mask", F.lit(2).cast("long")).unionByName(through)
    known = steps.groupBy("lei", "node_lei").agg(F.bit_or("mask").alias("mask")).where("mask <> 0")
    # ``exact``: the depths of walks of exactly 2^k steps.
    known, (far,) = materialize_counted(known.select("*", F.col("mask").alias("exact"), F.lit(True).alias("far")), by=("far", [True]))
    reach = 1
    while far and reach < max_depth:
        first = known.where("exact <> 0").select("lei", F.col("node_lei").alias("__mid"), F.col("exact").alias("__e"))
        rest = known.select(F.col("lei").alias("__from"), "node_lei", F.col("mask").alias("__m"), F.col("exact").alias("__x"))
        more = first.join(rest, first["__mid"] == rest["__from"]).select(
            "lei",
            "node_lei",
            _sums_of(F.col("__e"), F.col("__m"), max_depth).alias("mask"),
            _sums_of(F.col("__e"), F.col("__x"), max_depth).alias("exact"),
        )
        both = (
            known.select("lei", "node_lei", "mask", F.lit(0).cast("long").alias("exact"))
            .unionByName(more)
            .groupBy("lei", "node_lei")
            .agg(F.bit_or("mask").alias("mask"), F.bit_or("exact").alias("exact"))
            .where("mask <> 0")
        )
        known, (far,) = materialize_counted(both.withColumn("far", F.col("exact") != 0), by=("far", [True]))
        reach *= 2
    # A start on a cycle may begin with a run.
    onward = known.select(F.col("lei").alias("__at"), F.col("node_lei").alias("__to"), F.col("mask").alias("__m"))
    begun = runs.join(onward, runs["node_lei"] == onward["__at"]).select(
        "lei", F.col("__to").alias("node_lei"), _sums_of(F.col("mask"), F.col("__m"), max_depth).alias("mask")
    )
    own = known.join(tangled, "lei", "left_semi").select("lei", "node_lei", "mask")
    mended = own.unionByName(runs).unionByName(begun).groupBy("lei", "node_lei").agg(F.bit_or("mask").alias("mask")).where("mask <> 0")
    return plain.unionByName(mended)


def simple_walks(edges: DataFrame, max_depth: int) -> DataFrame:
    """``(lei, node_lei, least, most)``: the smallest and the largest depth of the
    simple upward paths of 1 to ``max_depth`` edges of every pair that has one."""
    if max_depth > MASK_DEPTH:
        rows = _row_walks(edges, max_depth)
        return rows.groupBy("lei", "node_lei").agg(F.min("depth").alias("least"), F.max("depth").alias("most"))
    lowest = F.col("mask").bitwiseAND(-F.col("mask"))
    return materialize(
        _simple_masks(edges, max_depth).select(
            "lei", "node_lei", (F.length(F.bin(lowest)) - 1).alias("least"), (F.length(F.bin("mask")) - 1).alias("most")
        )
    )


def _edges_above(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """The edges that upward walks from ``starts`` can use."""
    top = starts.select(F.col("lei").alias("node"), F.lit(0).alias("depth")).distinct()

    def step(cur: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
        nxt = cur.join(edges, cur["node"] == edges["__child"]).select(F.col("__parent").alias("node")).distinct()
        return nxt.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"))

    met = _walk(top, step, max_depth, visited_keys=["node"])
    return materialize(edges.join(met.select(F.col("node").alias("__child")).distinct(), "__child", "left_semi"))


def _roots_of(starts: DataFrame, walks: DataFrame, entities: DataFrame) -> DataFrame:
    """H3 from the walks: the deepest node, ties the smallest LEI."""
    deepest = (
        walks.join(starts.select("lei").distinct(), "lei", "left_semi")
        .groupBy("lei")
        .agg(F.min(F.struct((-F.col("most")).alias("d"), F.col("node_lei").alias("n"))).alias("__top"))
    )
    known = entities.select(F.col("lei").alias("__known")).distinct().withColumn("__is_entity", F.lit(True))
    tops = deepest.join(known, deepest["__top.n"] == known["__known"], "left").select(
        F.col("lei").alias("__l"), F.when(F.col("__is_entity"), F.col("__top.n")).alias("__root")
    )
    return starts.join(tops, starts["lei"] == tops["__l"], "left").select(
        "lei", F.coalesce("__root", "lei").alias("root_lei")
    )


def group_roots(
    entities: DataFrame,
    rels: DataFrame,
    requests: DataFrame | None = None,
    max_depth: int = MAX_HIERARCHY_DEPTH,
) -> DataFrame:
    """H3: ``(lei, root_lei)`` - the deepest node of the ancestor walk
    (ties: smallest LEI); when that node is not an entity, the entity itself
    is the root."""
    starts = _anchors(entities, requests, "lei")
    if max_depth < 1:
        return starts.select("lei", F.col("lei").alias("root_lei"))
    edges = _direct_edges(rels)
    if requests is not None:
        edges = _edges_above(edges, starts, max_depth)
    return _roots_of(starts, simple_walks(edges, max_depth), entities)


def _trees_of(roots: DataFrame, walks: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first trees of the distinct ``roots(lei)`` from the walks of all
    nodes: a shortest walk is simple, so the least depth per (root, node) is there;
    the parent is the smallest one that stands one step nearer to the root."""
    nearest = materialize(
        walks.join(roots.select(F.col("lei").alias("node_lei")), "node_lei", "left_semi").select(
            F.col("node_lei").alias("root_lei"), F.col("lei").alias("node_lei"), F.col("least").alias("depth")
        )
    )
    top = roots.select(F.col("lei").alias("root_lei"), F.col("lei").alias("node_lei"), F.lit(0).alias("depth"))
    ups = edges.select(F.col("__child").alias("node_lei"), F.col("__parent").alias("__p")).distinct()
    above = nearest.unionByName(top).select(
        F.col("root_lei").alias("__r"), F.col("node_lei").alias("__n"), (F.col("depth") + 1).alias("__d")
    )
    asked = nearest.join(ups, "node_lei")
    met = asked.join(
        above, (asked["root_lei"] == above["__r"]) & (asked["__p"] == above["__n"]) & (asked["depth"] == above["__d"]), "left_semi"
    )
    below = met.groupBy("root_lei", "node_lei", "depth").agg(F.min("__p").alias("parent_lei"))
    return top.select(
        "root_lei", "node_lei", F.lit(None).cast("string").alias("via_type"), "depth", F.lit(None).cast("string").alias("parent_lei")
    ).unionByName(below.select("root_lei", "node_lei", F.lit(DIRECT_PARENT).alias("via_type"), "depth", "parent_lei"))


def group_levels(
    entities: DataFrame,
    rels: DataFrame,
    requests: DataFrame | None = None,
    max_depth: int = MAX_HIERARCHY_DEPTH,
) -> tuple[DataFrame, DataFrame]:
    """``(roots, levels)``: H3 per requested entity, and the breadth-first tree
    of every distinct root, once per root however many requests map to it. For the
    whole registry the trees come from the rows that gave the roots."""
    if requests is not None or max_depth < 1:
        roots = materialize(group_roots(entities, rels, requests, max_depth))
        distinct_roots = roots.select(F.col("root_lei").alias("lei")).distinct()
        return roots, descendant_levels(entities, rels, distinct_roots, max_depth)
    edges = _direct_edges(rels)
    walks = simple_walks(edges, max_depth)
    roots = materialize(_roots_of(_anchors(entities, None, "lei"), walks, entities))
    distinct_roots = materialize(roots.select(F.col("root_lei").alias("lei")).distinct())
    return roots, materialize(_trees_of(distinct_roots, walks, edges))


def corporate_groups(
    entities: DataFrame,
    rels: DataFrame,
    requests: DataFrame | None = None,
    max_depth: int = MAX_HIERARCHY_DEPTH,
):
    """H4: ``(roots, members, sizes)``.

    * roots   - ``(lei, root_lei)`` per requested entity (H3);
    * members - the descendant tree of every distinct root, with names;
    * sizes   - ``(lei, root_lei, total_entities)``.
    """
    roots, levels = group_levels(entities, rels, requests, max_depth)
    members = with_node_info(levels, entities, ["root_lei"])
    # sizes from the bare levels: no name join needed to count
    counts = levels.groupBy("root_lei").agg(F.count(F.lit(1)).cast("long").alias("total_entities"))
    sizes = roots.join(counts, "root_lei", "left").select(
        "lei", "root_lei", F.coalesce("total_entities", F.lit(0)).cast("long").alias("total_entities")
    )
    return roots, members, sizes
