"""R1-R6 on the reference-shaped fixtures plus the cases it leaves untested."""

from __future__ import annotations

from conftest import (
    BASE_ENTITIES,
    CHILD_A,
    CHILD_B,
    PARENT,
    ULTIMATE,
    entity,
    make_entities,
    make_exceptions,
    make_rels,
    requests_of,
    rows,
)

from ownergraph.operators import relations
from ownergraph.schema import DIRECT_PARENT, ULTIMATE_PARENT


def test_direct_parent(spark, base):
    e, r, _ = base
    out = relations.direct_parents(e, r, requests_of(spark, CHILD_A))
    assert rows(out, "lei", "parent_lei", "legal_name") == [(CHILD_A, PARENT, "Middlewood Trading AB")]


def test_ultimate_parent(spark, base):
    e, r, _ = base
    out = relations.ultimate_parents(e, r, requests_of(spark, CHILD_A))
    assert rows(out, "parent_lei", "legal_name") == [(ULTIMATE, "Skarven Shipping ASA")]


def test_no_parent(spark, base):
    e, r, _ = base
    assert relations.direct_parents(e, r, requests_of(spark, ULTIMATE)).count() == 0
    assert relations.ultimate_parents(e, r, requests_of(spark, CHILD_B)).count() == 0


def test_children(spark, base):
    e, r, _ = base
    out = relations.children(e, r, requests_of(spark, PARENT))
    assert rows(out, "related_lei", "legal_name", "direction") == [
        (CHILD_A, "Amber Mills Ltda", "child"),
        (CHILD_B, "Brisk Canals BV", "child"),
    ]
    # Ultimate holds a direct child (PARENT) and an ultimate-type child (CHILD_A).
    out = relations.children(e, r, requests_of(spark, ULTIMATE))
    assert rows(out, "related_lei", "relationship_type") == [
        (CHILD_A, ULTIMATE_PARENT),
        (PARENT, DIRECT_PARENT),
    ]


def test_no_children(spark, base):
    e, r, _ = base
    assert relations.children(e, r, requests_of(spark, CHILD_A)).count() == 0


def test_siblings(spark, base):
    e, r, _ = base
    out = relations.siblings(e, r, requests_of(spark, CHILD_A))
    assert rows(out, "lei", "related_lei", "legal_name", "direction") == [
        (CHILD_A, CHILD_B, "Brisk Canals BV", "sibling")
    ]
    assert relations.siblings(e, r, requests_of(spark, ULTIMATE)).count() == 0


def test_sibling_counts_and_groups_match_expanded_form(spark, base):
    e, r, _ = base
    counts = dict(rows(relations.sibling_counts(r), "lei", "sibling_count"))
    assert counts == {CHILD_A: 1, CHILD_B: 1, PARENT: 0}
    groups = rows(relations.sibling_groups(e, r), "parent_lei", "related_lei")
    assert groups == [(PARENT, CHILD_A), (PARENT, CHILD_B), (ULTIMATE, PARENT)]


def test_other_relationships_empty(spark, base):
    e, r, _ = base
    assert relations.other_relationships(e, r, requests_of(spark, CHILD_A)).count() == 0


def test_reporting_exceptions(spark, base):
    _, _, x = base
    out = relations.reporting_exceptions(x, requests_of(spark, ULTIMATE))
    assert rows(out, "exception_category", "exception_reason", "exception_reference") == [
        ("ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT", "NO_KNOWN_PERSON", None)
    ]
    assert relations.reporting_exceptions(x, requests_of(spark, CHILD_A)).count() == 0


# --- cases the source does not test ---------------------------------------

FUND, MANAGER, GHOST, LOOP = "FUND0000000000000001", "MANAGER0000000000001", "GHOST000000000000001", "LOOP0000000000000001"


def _edge_cases(spark):
    ents = BASE_ENTITIES + [
        entity(FUND, "Fund One", "Dublin", "IE"),
        entity(MANAGER, "Manager Co", "Dublin", "IE"),
        entity(LOOP, "Loop Ltd", "Oslo", "NO"),
        entity("NONAME00000000000001", "", "", "FR"),
    ]
    edges = [
        (FUND, MANAGER, "IS_FUND-MANAGED_BY", "ACTIVE"),
        (LOOP, LOOP, "IS_FEEDER_TO", "ACTIVE"),
        (LOOP, LOOP, DIRECT_PARENT, "ACTIVE"),
        # dangling chosen parent (smallest LEI) hides the known one
        (CHILD_B, GHOST, DIRECT_PARENT, "ACTIVE"),
        (CHILD_B, PARENT, DIRECT_PARENT, "ACTIVE"),
        # inactive and NULL status are ignored everywhere
        (CHILD_A, MANAGER, DIRECT_PARENT, "INACTIVE"),
        (CHILD_A, FUND, "IS_FEEDER_TO", None),
        # dangling child
        ("ORPHAN00000000000001", PARENT, DIRECT_PARENT, "ACTIVE"),
        # direct and ultimate edge to the same parent
        (CHILD_A, PARENT, DIRECT_PARENT, "ACTIVE"),
        (CHILD_A, PARENT, ULTIMATE_PARENT, "ACTIVE"),
    ]
    return make_entities(spark, ents), make_rels(spark, edges)


def test_fund_link_in_other_of_both_ends_and_in_children(spark):
    e, r = _edge_cases(spark)
    other = rows(relations.other_relationships(e, r, requests_of(spark, FUND, MANAGER)), "lei", "related_lei")
    assert other == [(FUND, MANAGER), (MANAGER, FUND)]
    kids = rows(relations.children(e, r, requests_of(spark, MANAGER)), "related_lei", "relationship_type")
    assert kids == [(FUND, "IS_FUND-MANAGED_BY")]


def test_self_loop_other_once(spark):
    e, r = _edge_cases(spark)
    out = rows(relations.other_relationships(e, r, requests_of(spark, LOOP)), "lei", "related_lei")
    assert out == [(LOOP, LOOP)]


def test_dangling_chosen_parent_gives_none(spark):
    e, r = _edge_cases(spark)
    assert relations.direct_parents(e, r, requests_of(spark, CHILD_B)).count() == 0
    # siblings still use the chosen (dangling) parent: nobody else points there
    assert relations.siblings(e, r, requests_of(spark, CHILD_B)).count() == 0


def test_children_keep_dangling_child_and_duplicate_types(spark):
    e, r = _edge_cases(spark)
    out = rows(relations.children(e, r, requests_of(spark, PARENT)), "related_lei", "legal_name", "relationship_type")
    assert (("ORPHAN00000000000001", None, DIRECT_PARENT)) in out
    assert (CHILD_A, "Amber Mills Ltda", DIRECT_PARENT) in out
    assert (CHILD_A, "Amber Mills Ltda", ULTIMATE_PARENT) in out
    # ordering puts the NULL name last
    ordered = relations.order_related(relations.children(e, r, requests_of(spark, PARENT), stored_name=True)).collect()
    assert ordered[-1]["legal_name"] is None


def test_inactive_and_null_status_dropped(spark):
    e, r = _edge_cases(spark)
    assert relations.children(e, r, requests_of(spark, MANAGER)).where("related_lei = '%s'" % CHILD_A).count() == 0
    assert relations.other_relationships(e, r, requests_of(spark, CHILD_A)).count() == 0


def test_empty_strings_normalised(spark):
    e, r = _edge_cases(spark)
    from ownergraph.operators.lookup import get_entities

    row = get_entities(e, requests_of(spark, "NONAME00000000000001")).collect()[0]
    assert row["legal_name"] == ""
    assert row["legal_address_city"] is None
    assert row["legal_jurisdiction"] == "FR"


def test_whole_registry_equals_per_lei_union(spark, base):
    e, r, _ = base
    leis = [x[0] for x in BASE_ENTITIES]
    whole = rows(relations.children(e, r), "lei", "related_lei", "relationship_type")
    per = []
    for lei in leis:
        per += rows(relations.children(e, r, requests_of(spark, lei)), "lei", "related_lei", "relationship_type")
    assert whole == sorted(per)


def test_exceptions_fixture_shape(spark):
    x = make_exceptions(spark, [("A" * 20, "DIRECT_ACCOUNTING_CONSOLIDATION_PARENT", "", None)])
    out = relations.reporting_exceptions(x).collect()[0]
    assert out["exception_reason"] is None and out["exception_reference"] is None


def test_empty_names_come_first_in_display_order(spark):
    from ownergraph.operators import hierarchy, report

    top, kids = "T" * 20, {"A" * 20: "Alpha", "B" * 20: "", "C" * 20: None}
    e = make_entities(spark, [entity(top, "Top", "x", "US"), *[entity(k, v, "x", "US") for k, v in kids.items()]])
    r = make_rels(spark, [(k, top, DIRECT_PARENT, "ACTIVE") for k in kids])
    asked = requests_of(spark, top)
    want = ["B" * 20, "A" * 20, "C" * 20]
    got = relations.order_related(relations.children(e, r, asked, stored_name=True)).collect()
    assert [x["related_lei"] for x in got] == want
    tree = report.order_tree(hierarchy.descendant_tree(e, r, asked), e).collect()
    assert [x["node_lei"] for x in tree] == [top, *want]
    x = spark.createDataFrame([], "lei string, exception_category string, exception_reason_1 string, exception_reference_1 string")
    long = report.full_report_long(e, r, x, asked)
    lines = report.report_display(long, registry=False).where("section = 'children'").orderBy("pos").collect()
    assert [v["text"][:20] for v in lines] == want
    leis = report.report_leis(long).orderBy("first_pos").collect()
    assert [v["related_lei"] for v in leis] == [top, *want]
