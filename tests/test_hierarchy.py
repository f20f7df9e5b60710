"""H1-H8: chains, trees, groups, listing - fixtures plus brute-force checks."""

from __future__ import annotations

import random

import pytest

from conftest import (
    CHILD_A,
    CHILD_B,
    GRANDCHILD,
    PARENT,
    SHARED,
    ULTIMATE,
    entity,
    make_entities,
    make_rels,
    requests_of,
    rows,
)

from ownergraph.operators import hierarchy, listing
from ownergraph.schema import DIRECT_PARENT

# --- H1 ancestor chain -------------------------------------------------------


def test_ancestor_chain_full(spark, deep):
    e, r = deep
    out = rows(hierarchy.ancestor_chain(e, r, requests_of(spark, GRANDCHILD)), "depth", "node_lei", "parent_lei")
    assert out == [(0, GRANDCHILD, None), (1, CHILD_A, GRANDCHILD), (2, PARENT, CHILD_A), (3, ULTIMATE, PARENT)]


def test_ancestor_chain_root_and_missing(spark, deep):
    e, r = deep
    assert rows(hierarchy.ancestor_chain(e, r, requests_of(spark, ULTIMATE)), "depth", "node_lei") == [(0, ULTIMATE)]
    assert hierarchy.ancestor_chain(e, r, requests_of(spark, "X" * 20)).count() == 0


def test_ancestor_chain_max_depth(spark, deep):
    e, r = deep
    out = hierarchy.ancestor_chain(e, r, requests_of(spark, GRANDCHILD), max_depth=1)
    assert rows(out, "depth", "node_lei") == [(0, GRANDCHILD), (1, CHILD_A)]
    out = hierarchy.ancestor_chain(e, r, requests_of(spark, GRANDCHILD), max_depth=0)
    assert rows(out, "depth") == [(0,)]


def test_ancestor_chain_fields(spark, deep):
    e, r = deep
    row = hierarchy.ancestor_chain(e, r, requests_of(spark, GRANDCHILD)).where("depth = 1").collect()[0]
    assert row["legal_name"] == "Amber Mills Ltda"
    assert row["relationship_type"] == DIRECT_PARENT
    assert row["legal_jurisdiction"] == "US"


# --- H2 descendant tree ------------------------------------------------------


def test_descendant_tree_full(spark, deep):
    e, r = deep
    out = rows(hierarchy.descendant_tree(e, r, requests_of(spark, ULTIMATE)), "depth", "node_lei", "parent_lei")
    assert out == [
        (0, ULTIMATE, None),
        (1, PARENT, ULTIMATE),
        (2, CHILD_A, PARENT),
        (2, CHILD_B, PARENT),
        (3, GRANDCHILD, CHILD_A),
    ]


def test_descendant_tree_leaf_mid_missing(spark, deep):
    e, r = deep
    assert rows(hierarchy.descendant_tree(e, r, requests_of(spark, GRANDCHILD)), "node_lei") == [(GRANDCHILD,)]
    mid = rows(hierarchy.descendant_tree(e, r, requests_of(spark, CHILD_A)), "node_lei")
    assert mid == [(CHILD_A,), (GRANDCHILD,)]
    assert hierarchy.descendant_tree(e, r, requests_of(spark, "X" * 20)).count() == 0


def test_descendant_tree_depth_limit(spark, deep):
    e, r = deep
    out = hierarchy.descendant_tree(e, r, requests_of(spark, ULTIMATE), max_depth=1)
    assert rows(out, "node_lei") == [(PARENT,), (ULTIMATE,)]


def test_descendant_tree_diamond_first_parent_wins(spark, diamond):
    e, r = diamond
    out = hierarchy.descendant_tree(e, r, requests_of(spark, PARENT))
    shared = out.where(f"node_lei = '{SHARED}'").collect()
    assert len(shared) == 1
    assert shared[0]["depth"] == 2 and shared[0]["parent_lei"] == CHILD_A


# --- H3 / H4 corporate groups -------------------------------------------------


def _group(spark, e, r, lei):
    roots, members, sizes = hierarchy.corporate_groups(e, r, requests_of(spark, lei))
    root = rows(roots, "root_lei")
    return root, rows(members, "node_lei"), rows(sizes, "total_entities")


def test_corporate_group_from_leaf_mid_root(spark, deep):
    e, r = deep
    for lei in (GRANDCHILD, CHILD_A, ULTIMATE):
        root, members, size = _group(spark, e, r, lei)
        assert root == [(ULTIMATE,)]
        assert len(members) == 5 and size == [(5,)]


def test_corporate_group_missing_and_standalone(spark, deep):
    e, r = deep
    roots, members, _ = hierarchy.corporate_groups(e, r, requests_of(spark, "X" * 20))
    assert roots.count() == 0
    e2 = e.unionByName(make_entities(spark, [entity("SOLO0000000000000001", "Solo", "Rome", "IT")]))
    root, members, size = _group(spark, e2, r, "SOLO0000000000000001")
    assert root == [("SOLO0000000000000001",)] and size == [(1,)]


def test_group_root_falls_back_to_entity_when_top_is_dangling(spark):
    e = make_entities(spark, [entity("A" * 20, "A", "x", "US"), entity("B" * 20, "B", "x", "US")])
    r = make_rels(spark, [("A" * 20, "B" * 20, DIRECT_PARENT, "ACTIVE"), ("B" * 20, "G" * 20, DIRECT_PARENT, "ACTIVE")])
    roots = rows(hierarchy.group_roots(e, r), "lei", "root_lei")
    assert roots == [("A" * 20, "A" * 20), ("B" * 20, "B" * 20)]


def test_cycle_roots_each_other(spark):
    a, b = "A" * 20, "B" * 20
    e = make_entities(spark, [entity(a, "A", "x", "US"), entity(b, "B", "x", "US")])
    r = make_rels(spark, [(a, b, DIRECT_PARENT, "ACTIVE"), (b, a, DIRECT_PARENT, "ACTIVE")])
    assert rows(hierarchy.group_roots(e, r), "lei", "root_lei") == [(a, b), (b, a)]
    tree = rows(hierarchy.descendant_tree(e, r, requests_of(spark, a)), "node_lei", "depth")
    assert tree == [(a, 0), (b, 1)]


# --- H7 / H8 listing -----------------------------------------------------------


def test_hierarchy_listing_preorder(spark, diamond):
    e, r = diamond
    out = listing.hierarchy_listing(e, r, requests_of(spark, ULTIMATE)).orderBy("line_no").collect()
    assert out[0]["label"] == "Corporate Group (6 entities)"
    out = out[1:]
    assert [x["node_lei"] for x in out] == [ULTIMATE, PARENT, CHILD_A, SHARED, GRANDCHILD, CHILD_B]
    assert [x["line_no"] for x in out] == [1, 2, 3, 4, 5, 6]
    assert out[0]["label"] == f"{ULTIMATE} Skarven Shipping ASA (GB, ACTIVE)"


def test_children_map(spark, deep):
    e, r = deep
    tree = hierarchy.descendant_levels(e, r, requests_of(spark, ULTIMATE))
    out = rows(listing.children_map(tree, e), "parent_lei", "pos", "node_lei")
    assert (PARENT, 1, CHILD_A) in out and (PARENT, 2, CHILD_B) in out and (None, 1, ULTIMATE) in out


# --- property: loops equal brute-force path enumeration ----------------------


def _brute(edges, entities, max_depth):
    """Reference semantics by direct enumeration of simple paths."""
    up, down = {}, {}
    for c, p in edges:
        up.setdefault(c, []).append(p)
        down.setdefault(p, []).append(c)
    chains, trees = [], []
    for s in entities:
        stack = [(s, 0, None, [s])]
        while stack:
            n, d, prev, path = stack.pop()
            chains.append((s, n, d, prev))
            if d < max_depth:
                for p in up.get(n, []):
                    if p not in path:
                        stack.append((p, d + 1, n, path + [p]))
        best = {}
        stack = [(s, 0, None, [s])]
        while stack:
            n, d, prev, path = stack.pop()
            key = (d, prev or "")
            if n not in best or key < best[n]:
                best[n] = key
            if d < max_depth:
                for c in down.get(n, []):
                    if c not in path:
                        stack.append((c, d + 1, n, path + [c]))
        trees += [(s, n, d, p or None) for n, (d, p) in best.items()]
    return sorted(chains), sorted(trees)


def test_walks_match_brute_force_on_random_graphs(spark):
    rnd = random.Random(7)
    for trial in range(3):
        nodes = [f"N{trial}{i:018d}" for i in range(9)]
        edges = set()
        for _ in range(14):
            a, b = rnd.choice(nodes), rnd.choice(nodes + ["DANGLING000000000000"])
            if a != b:
                edges.add((a, b))
        ents = nodes[:7]
        e = make_entities(spark, [entity(n, n, "c", "US") for n in ents])
        r = make_rels(spark, [(a, b, DIRECT_PARENT, "ACTIVE") for a, b in sorted(edges)])
        want_chain, want_tree = _brute(sorted(edges), ents, 4)
        got_chain = rows(hierarchy.ancestor_chain(e, r, max_depth=4), "lei", "node_lei", "depth", "parent_lei")
        got_tree = rows(hierarchy.descendant_tree(e, r, max_depth=4), "root_lei", "node_lei", "depth", "parent_lei")
        assert got_chain == want_chain
        assert got_tree == want_tree


def test_hub_with_a_third_of_all_entities(spark):
    hub = "HUB00000000000000000"
    kids = [f"K{i:019d}" for i in range(100)]
    loners = [f"L{i:019d}" for i in range(200)]
    e = make_entities(spark, [entity(n, n, "x", "US") for n in [hub, *kids, *loners]])
    r = make_rels(spark, [(k, hub, DIRECT_PARENT, "ACTIVE") for k in kids] + [("X" * 20, kids[0], DIRECT_PARENT, "ACTIVE")])
    assert hierarchy.descendant_tree(e, r, requests_of(spark, hub)).count() == 102
    roots, members, sizes = hierarchy.corporate_groups(e, r)
    assert dict(rows(roots))[kids[7]] == hub and dict(rows(roots))[loners[3]] == loners[3]
    assert members.where(f"root_lei = '{hub}'").count() == 102
    # the group's rows are dealt out by (root, node) before they are grouped
    _, levels = hierarchy.group_levels(e, r)
    walk = hierarchy._shortest(r, 4)
    assert rows(walk.where(f"root_lei = '{hub}'"), "depth").count((1,)) == 100
    assert levels.count() == members.count()
    assert {n for _, _, n in rows(sizes)} == {1, 102}


def _layers(spark, depth, width):
    names = [[f"Y{d:02d}{w}" + "0" * 16 for w in range(width)] for d in range(depth)]
    e = make_entities(spark, [entity(n, n, "x", "US") for layer in names for n in layer])
    edges = [(c, p, DIRECT_PARENT, "ACTIVE") for up, down in zip(names, names[1:]) for c in down for p in up]
    return names, e, make_rels(spark, edges), edges


def test_layered_registry_needs_no_paths(spark):
    # nine layers of three: 3^8 paths from the lowest layer, few distinct rows
    names, e, r, edges = _layers(spark, 9, 3)
    walks = hierarchy.simple_walks(hierarchy._direct_edges(r), 50)
    assert walks.count() == 9 * 3 * 3 * 8 // 2  # each start, each node above, one depth
    assert dict(rows(hierarchy.group_roots(e, r))) == {n: names[0][0] if d else n for d, layer in enumerate(names) for n in layer}
    tree = hierarchy.descendant_tree(e, r)
    assert tree.count() == 27 + 9 * 3 * 3 * 8 // 2
    best = {(x.root_lei, x.node_lei): (x.depth, x.parent_lei) for x in tree.where("depth > 0").collect()}
    for d, layer in enumerate(names):
        for i, top in enumerate(layer):
            for k in range(d + 1, 9):
                assert best[top, names[k][2]] == (k - d, top if k == d + 1 else names[k - 1][0])


def test_layers_below_a_cycle_need_no_paths(spark, layers=9):
    # layers of three below a cycle of two: 3^layers paths, few distinct rows
    names, e, r, _ = _layers(spark, layers, 3)
    x, y = "X" * 20, "Z" * 20
    more = [(n, x) for n in names[0]] + [(x, y), (y, x)]
    r = r.unionByName(make_rels(spark, [(a, b, DIRECT_PARENT, "ACTIVE") for a, b in more]))
    e = e.unionByName(make_entities(spark, [entity(k, k, "x", "US") for k in (x, y)]))
    walks = hierarchy.simple_walks(hierarchy._direct_edges(r), 50)
    # each start: the nodes above it in the layers, then x and y, all at one depth
    assert walks.count() == 9 * layers * (layers - 1) // 2 + 2 * 3 * layers + 2
    roots = dict(rows(hierarchy.group_roots(e, r)))
    assert roots == {n: y for layer in names for n in layer} | {x: y, y: x}


def _simple_paths(edges, max_depth):
    up, out = {}, set()
    for c, p in edges:
        up.setdefault(c, []).append(p)
    for s in {c for c, _ in edges}:
        stack = [[s]]
        while stack:
            path = stack.pop()
            if len(path) > 1:
                out.add((s, path[-1], len(path) - 1))
            if len(path) <= max_depth:
                stack += [[*path, p] for p in up.get(path[-1], []) if p not in path]
    return sorted(out)


def _depths(masks):
    return sorted((x.lei, x.node_lei, d) for x in masks.collect() for d in range(64) if x.mask >> d & 1)


def _random_registry(rnd, graphs, nodes, edges):
    """Many small random graphs that share no node, in one edge list."""
    found = set()
    for g in range(graphs):
        found |= {(f"G{g:02d}N{rnd.randrange(nodes):02d}", f"G{g:02d}N{rnd.randrange(nodes):02d}") for _ in range(edges)}
    return sorted(found)


@pytest.mark.parametrize("nodes, edges, depth", [(9, 15, 50)])
def test_simple_walks_on_random_cyclic_graphs(spark, nodes, edges, depth):
    found = _random_registry(random.Random(nodes), 25, nodes, edges)
    r = make_rels(spark, [(a, b, DIRECT_PARENT, "ACTIVE") for a, b in found])
    want = _simple_paths([p for p in found if p[0] != p[1]], depth)
    assert _depths(hierarchy._simple_masks(hierarchy._direct_edges(r), depth)) == want
    assert rows(hierarchy._row_walks(hierarchy._direct_edges(r), depth), "lei", "node_lei", "depth") == want
    spans = {}
    for lei, node, d in want:
        low, high = spans.get((lei, node), (d, d))
        spans[lei, node] = (min(low, d), max(high, d))
    got = hierarchy.simple_walks(hierarchy._direct_edges(r), depth).collect()
    assert {(x.lei, x.node_lei): (x.least, x.most) for x in got} == spans and len(got) == len(spans)


def test_long_and_short_cycles(spark):
    ring = [f"C{i:02d}" for i in range(12)]
    edges = list(zip(ring, ring[1:] + ring[:1])) + [("TAIL", "C03"), ("C05", "TOP"), ("TOP", "HIGH"), ("C07", "C06")]
    r = make_rels(spark, [(a, b, DIRECT_PARENT, "ACTIVE") for a, b in edges])
    for depth in (62,):
        assert _depths(hierarchy._simple_masks(hierarchy._direct_edges(r), depth)) == _simple_paths(edges, depth)


def test_cycle_behind_a_diamond(spark):
    # d -> b, c -> a -> x <-> y, and z -> d: starts below the cycle need paths
    n = {k: k.upper() * 20 for k in "abcdxyz"}
    pairs = ["db", "dc", "ba", "ca", "ax", "xy", "yx", "zd"]
    e = make_entities(spark, [entity(v, v, "c", "US") for v in n.values()])
    r = make_rels(spark, [(n[a], n[b], DIRECT_PARENT, "ACTIVE") for a, b in pairs])
    want = {n[k]: n["y"] for k in "abcdxz"} | {n["y"]: n["x"]}
    assert dict(rows(hierarchy.group_roots(e, r))) == want
    assert dict(rows(hierarchy.group_roots(e, r, requests_of(spark, n["d"], n["y"])))) == {n["d"]: n["y"], n["y"]: n["x"]}
    chains = hierarchy.ancestor_chain(e, r)
    deepest = {}
    for x in chains.collect():
        deepest[x.lei] = min(deepest.get(x.lei, (1, "")), (-x.depth, x.node_lei))
    assert {k: v[1] for k, v in deepest.items()} == want


def test_registry_groups_equal_downward_walk_on_random_graphs(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(11)
    for trial in range(3):
        nodes = [f"R{trial}{i:018d}" for i in range(10)]
        edges = set()
        for _ in range(16):
            a = rnd.choice(nodes + ["ORPHAN00000000000001"])
            b = rnd.choice(nodes + ["DANGLING000000000000"])
            if a != b:
                edges.add((a, b, rnd.choice(["ACTIVE", "ACTIVE", "ACTIVE", "INACTIVE"])))
        e = make_entities(spark, [entity(n, n, "c", "US") for n in nodes[:8]])
        r = make_rels(spark, [(a, b, DIRECT_PARENT, st) for a, b, st in sorted(edges)])
        roots, levels = hierarchy.group_levels(e, r, max_depth=5)
        deepest = {}
        for x in hierarchy.ancestor_chain(e, r, max_depth=5).collect():
            deepest[x.lei] = min(deepest.get(x.lei, (1, "")), (-x.depth, x.node_lei))
        want_roots = sorted((k, v if v in nodes[:8] else k) for k, (_, v) in deepest.items())
        assert rows(roots, "lei", "root_lei") == want_roots
        assert rows(hierarchy.group_roots(e, r, e.select("lei"), max_depth=5), "lei", "root_lei") == want_roots
        distinct = roots.select(F.col("root_lei").alias("lei")).distinct()
        want = rows(hierarchy.descendant_levels(e, r, distinct, max_depth=5), "root_lei", "node_lei", "depth", "parent_lei", "via_type")
        assert rows(levels, "root_lei", "node_lei", "depth", "parent_lei", "via_type") == want


def test_registry_listing_equals_per_root_listing(spark, diamond):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    cases = [diamond]
    for trial in range(2):
        nodes = [f"L{trial}{i:018d}" for i in range(9)]
        edges = {(rnd.choice(nodes), rnd.choice(nodes + ["DANGLING000000000000"])) for _ in range(12)}
        e = make_entities(spark, [entity(n, f"Name {rnd.randint(0, 3)}", "c", "US") for n in nodes[:7]])
        r = make_rels(spark, [(a, b, DIRECT_PARENT, "ACTIVE") for a, b in sorted(edges) if a != b])
        cases.append((e, r))
    for e, r in cases:
        fast = rows(listing.registry_listing(e, r), "root_lei", "line_no", "depth", "node_lei", "label")
        roots = hierarchy.group_roots(e, r).select(F.col("root_lei").alias("lei")).distinct()
        slow = rows(listing.hierarchy_listing(e, r, roots), "root_lei", "line_no", "depth", "node_lei", "label")
        assert fast == slow


def test_line_numbers_of_a_deep_and_a_wide_tree(spark):
    # a chain of 30 with a fan of 40 on its tenth node, names in reverse
    chain, fan = [f"P{i:019d}" for i in range(30)], [f"F{i:019d}" for i in range(40)]
    pairs = list(zip(chain[1:], chain)) + [(f, chain[9]) for f in fan]
    e = make_entities(spark, [entity(n, f"{99 - i:02d}", "x", "US") for i, n in enumerate(chain + fan)])
    r = make_rels(spark, [(a, b, DIRECT_PARENT, "ACTIVE") for a, b in pairs])
    order = {n: 99 - i for i, n in enumerate(chain + fan)}
    kids = {}
    for a, b in pairs:
        kids.setdefault(b, []).append(a)
    want, stack = [], [chain[0]]
    while stack:
        n = stack.pop()
        want.append(n)
        stack += sorted(kids.get(n, []), key=order.get, reverse=True)
    lines = listing.registry_listing(e, r).where("line_no > 0").orderBy("line_no")
    assert [x["node_lei"] for x in lines.collect()] == want
    plan = lines._jdf.queryExecution().toString()
    assert "sort_path" not in plan


def test_empty_name_sorts_first_and_null_last(spark):
    top, a, b, c = "T" * 20, "A" * 20, "B" * 20, "C" * 20
    e = make_entities(spark, [entity(top, "Top", "x", "US"), entity(a, "Zed", "x", "US"),
                              entity(b, "", "x", "US"), entity(c, None, "x", "US")])
    r = make_rels(spark, [(k, top, DIRECT_PARENT, "ACTIVE") for k in (a, b, c)])
    lines = listing.registry_listing(e, r).where("line_no > 0").orderBy("line_no").collect()
    assert [x["node_lei"] for x in lines] == [top, b, a, c]
    tree = hierarchy.descendant_levels(e, r, requests_of(spark, top))
    kids = [x["node_lei"] for x in listing.children_map(tree, e).where(f"parent_lei = '{top}'").orderBy("pos").collect()]
    assert kids == [b, a, c]


def test_deep_descendant_trees_match_brute_force(spark):
    rnd = random.Random(23)
    for trial in range(2):
        nodes = [f"D{trial}{i:018d}" for i in range(10)]
        edges = set()
        for _ in range(15):
            a, b = rnd.choice(nodes), rnd.choice(nodes + ["DANGLING000000000000"])
            if a != b:
                edges.add((a, b))
        ents = nodes[:8]
        e = make_entities(spark, [entity(n, n, "c", "US") for n in ents])
        r = make_rels(spark, [(a, b, DIRECT_PARENT, "ACTIVE") for a, b in sorted(edges)])
        _, want_tree = _brute(sorted(edges), ents, 6)
        got = rows(hierarchy.descendant_tree(e, r, max_depth=6), "root_lei", "node_lei", "depth", "parent_lei")
        assert got == want_tree


def test_degenerate_inputs(spark):
    from ownergraph.operators import report, search

    e = make_entities(spark, [entity("A" * 20, "Alpha", "x", "US"), entity("B" * 20, "Beta", "x", "US")])
    no_edges = make_rels(spark, [])
    no_entities = make_entities(spark, [])
    x = spark.createDataFrame([], "lei string, exception_category string, exception_reason_1 string, exception_reference_1 string")
    # no edges: every entity is its own group of one
    assert rows(hierarchy.corporate_groups(e, no_edges)[2], "lei", "total_entities") == [("A" * 20, 1), ("B" * 20, 1)]
    assert rows(listing.registry_listing(e, no_edges), "line_no") == [(0,), (0,), (1,), (1,)]
    assert hierarchy.descendant_tree(e, no_edges).count() == 2
    assert report.full_report_counts(e, no_edges, x).count() == 2
    # no entities: empty answers, no errors
    r = make_rels(spark, [("A" * 20, "B" * 20, DIRECT_PARENT, "ACTIVE")])
    assert hierarchy.corporate_groups(no_entities, r)[1].count() == 0
    assert listing.registry_listing(no_entities, r).count() == 0
    assert hierarchy.ancestor_chain(no_entities, r).count() == 0
    texts = spark.createDataFrame([("a",), ("",)], "query string")
    assert search.search_by_name_batch(no_entities, texts).count() == 0
