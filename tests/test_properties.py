"""Properties on random small registries (hypothesis-generated)."""

from __future__ import annotations

from collections import Counter

from conftest import entity, make_entities, make_rels, requests_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ownergraph.operators import relations, report
from ownergraph.schema import DIRECT_PARENT, ULTIMATE_PARENT

NODES = [f"P{i:019d}" for i in range(8)]
TYPES = [DIRECT_PARENT, ULTIMATE_PARENT, "IS_FUND-MANAGED_BY"]
STATUSES = ["ACTIVE", "ACTIVE", "INACTIVE", None]

edge = st.tuples(st.sampled_from(NODES), st.sampled_from(NODES + ["GHOST000000000000001"]),
                 st.sampled_from(TYPES), st.sampled_from(STATUSES))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(edge, min_size=1, max_size=18))
def test_factorised_siblings_equal_expanded(spark, edges):
    e = make_entities(spark, [entity(n, n, "c", "US") for n in NODES[:6]])
    r = make_rels(spark, edges)
    req = requests_of(spark, *NODES)
    expanded = Counter(row["lei"] for row in relations.siblings(e, r, req).collect())
    counts = {row["lei"]: row["sibling_count"] for row in relations.sibling_counts(r, req).collect()}
    assert {k: v for k, v in counts.items() if v} == dict(expanded)
    # the groups hold exactly the expanded siblings once the member is removed
    groups = {}
    for row in relations.sibling_groups(e, r).collect():
        groups.setdefault(row["parent_lei"], []).append(row["related_lei"])
    parents = {row["lei"]: row["parent_lei"] for row in relations.sibling_counts(r, req).collect()}
    for lei, parent in parents.items():
        members = [m for m in groups.get(parent, []) if m != lei]
        assert len(members) == expanded.get(lei, 0)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(edge, min_size=1, max_size=18))
def test_report_counts_match_long_report(spark, edges):
    e = make_entities(spark, [entity(n, n, "c", "US") for n in NODES[:6]])
    r = make_rels(spark, edges)
    x = spark.createDataFrame([(NODES[0], "CAT", None, None)], "lei string, exception_category string, exception_reason_1 string, exception_reference_1 string")
    long = report.full_report_long(e, r, x, requests_of(spark, *NODES))
    per = Counter((row["lei"], row["section"]) for row in long.collect())
    for row in report.full_report_counts(e, r, x).collect():
        lei = row["lei"]
        assert row["n_children"] == per[(lei, "children")]
        assert row["n_siblings"] == per[(lei, "siblings")]
        assert row["n_other"] == per[(lei, "other")]
        assert row["n_exceptions"] == per[(lei, "exceptions")]
        assert row["has_direct_parent"] == (per[(lei, "direct_parent")] > 0)


item = st.one_of(
    st.just({"type": "isins"}),
    st.builds(lambda v: {"type": "isins", "attributes": {"lei": "X", "isin": v}},
              st.one_of(st.none(), st.just(""), st.text(alphabet="ABCDEFGHIJ0123456789", min_size=2, max_size=12))),
    st.just({"type": "isins", "attributes": {"lei": "X"}}),
)
payload = st.one_of(st.none(), st.builds(lambda items: {"data": items}, st.lists(item, max_size=5)))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(payload, min_size=1, max_size=8))
def test_isin_parsing_matches_python_json(spark, payloads):
    import json

    from ownergraph.sources import isin

    data = [(f"L{i:019d}", None if p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(data, "lei string, payload string")
    want = {}
    for lei, text in data:
        if text is None:
            continue
        found = [it.get("attributes", {}).get("isin") for it in json.loads(text)["data"]]
        found = [x for x in found if x]
        if found:
            want[lei] = found
    got = {r["lei"]: list(r["isins"]) for r in isin.isin_map(df).collect()}
    assert got == want
    # S2 keys are a subset of the requested LEIs
    assert set(got) <= {lei for lei, _ in data}


PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
lei_text = st.text(alphabet=PY_WHITESPACE + "abcxyzABC0189", max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(lei_text, min_size=1, max_size=20))
def test_lei_normalisation_matches_python_strip_upper(spark, texts):
    from ownergraph.operators import lookup

    df = spark.createDataFrame([(t,) for t in texts], "lei_input string")
    got = [(r["lei_input"], r["lei"], r["is_valid"]) for r in lookup.normalize_requests(df).collect()]
    want = [(t, t.strip().upper(), len(t.strip().upper()) == 20) for t in texts]
    assert sorted(got) == sorted(want)


def _ilike_contains(name: str, text: str) -> bool:
    import re

    rx = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in text.lower())
    return re.fullmatch(".*" + rx + ".*", name.lower(), flags=re.S) is not None


search_alpha = "aAb%_\\ "


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=search_alpha, max_size=6), min_size=1, max_size=10),
       st.lists(st.text(alphabet=search_alpha, max_size=3), min_size=1, max_size=4))
def test_name_search_matches_ilike_model(spark, names, texts):
    from ownergraph.operators import lookup, search

    ents = [entity(f"S{i:019d}", n, "x", "US") for i, n in enumerate(names)]
    e = make_entities(spark, ents)
    for text in texts:
        want = sorted((n, f"S{i:019d}") for i, n in enumerate(names) if _ilike_contains(n, text))[:3]
        got = [(r["legal_name"], r["lei"]) for r in lookup.search_by_name(e, text, 3).collect()]
        assert got == want
    batch = search.search_by_name_batch(e, spark.createDataFrame([(t,) for t in texts], "query string"), 3)
    got_b = sorted((r["query"], r["rank"], r["lei"]) for r in batch.collect())
    want_b = []
    for text in set(texts):
        hits = sorted((n, f"S{i:019d}") for i, n in enumerate(names) if _ilike_contains(n, text))[:3]
        want_b += [(text, k + 1, lei) for k, (_, lei) in enumerate(hits)]
    assert got_b == sorted(want_b)


field = st.text(alphabet='ab ,"\n\tZ1', max_size=8)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(field, field, field), min_size=1, max_size=8))
def test_csv_values_round_trip(spark, records):
    import csv
    import os
    import tempfile

    from ownergraph.schema import EXCEPTION_COLUMNS
    from ownergraph.sources import csv_ingest

    folder = tempfile.mkdtemp(prefix="ownergraph-prop-csv-")
    path = os.path.join(folder, "x.csv")
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
        w.writerow(list(EXCEPTION_COLUMNS))
        for i, (a, b, c) in enumerate(records):
            w.writerow([f"L{i:019d}", a, b, c])
    got = sorted(
        tuple(r[k] for k in EXCEPTION_COLUMNS.values())
        for r in csv_ingest.read_dataset_csv(spark, path, "repex").collect()
    )
    want = sorted((f"L{i:019d}", a or None, b or None, c or None) for i, (a, b, c) in enumerate(records))
    assert got == want
