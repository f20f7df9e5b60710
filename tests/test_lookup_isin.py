"""L1-L3, E1/E2, S1-S4."""

from __future__ import annotations

from conftest import CHILD_A, PARENT, ULTIMATE, entity, make_entities, requests_of, rows

from pyspark.sql import functions as F

from ownergraph.operators import lookup
from ownergraph.sources import isin


def test_get_entity_and_missing(spark, base):
    e, _, _ = base
    got = lookup.get_entities(e, requests_of(spark, PARENT, "NONEXISTENT000000001"))
    assert rows(got, "lei", "legal_name", "legal_address_city") == [(PARENT, "Middlewood Trading AB", "New York")]
    missing = lookup.missing_leis(e, requests_of(spark, PARENT, "NONEXISTENT000000001"))
    assert rows(missing, "lei") == [("NONEXISTENT000000001",)]


def test_normalize_requests(spark):
    raw = spark.createDataFrame([("  ambermill00000000052 ",), ("SHORT",), (" SKARVENSHIP000000090 ",), (None,)], "lei_input string")
    out = rows(lookup.normalize_requests(raw), "lei", "is_valid")
    assert (CHILD_A, True) in out and ("SHORT", False) in out and (ULTIMATE, True) in out
    assert (None, False) in out


def test_search_by_name(spark, base):
    e, _, _ = base
    assert rows(lookup.search_by_name(e, "s"), "lei") == [(CHILD_A,), ("BRISKCANAL0000000053",), (ULTIMATE,)]
    assert rows(lookup.search_by_name(e, "MIDDLE"), "lei") == [(PARENT,)]
    assert lookup.search_by_name(e, "nothing here").count() == 0
    assert lookup.search_by_name(e, "", limit=2).count() == 2
    assert [r["lei"] for r in lookup.search_by_name(e, "", limit=2).collect()] == ["AMBERMILL00000000052", "BRISKCANAL0000000053"]


def test_search_wildcards_and_backslash(spark):
    e = make_entities(
        spark,
        [
            entity("A" * 20, "100% Owned", "x", "US"),
            entity("B" * 20, "ABC_DEF", "x", "US"),
            entity("C" * 20, "Back\\slash Co", "x", "US"),
            entity("D" * 20, "Same", "x", "US"),
            entity("E" * 20, "Same", "x", "US"),
            entity("F" * 20, None, "x", "US"),
        ],
    )
    # % and _ stay wildcards, a backslash is a plain character
    assert rows(lookup.search_by_name(e, "c_d"), "lei") == [("B" * 20,)]
    assert rows(lookup.search_by_name(e, "k\\s"), "lei") == [("C" * 20,)]
    assert lookup.search_by_name(e, "0%o").count() == 1
    # ties on the name are broken by LEI; NULL names never match
    assert [r["lei"] for r in lookup.search_by_name(e, "same").collect()] == ["D" * 20, "E" * 20]
    assert lookup.search_by_name(e, "", limit=None).count() == 5


PAYLOADS = [
    ("LEI_A", '{"data":[{"type":"isins","attributes":{"lei":"LEI_A","isin":"US111"}}]}'),
    ("LEI_B", '{"data":[{"attributes":{"isin":"DE1"}},{"attributes":{"isin":""}},{"type":"x"},{"attributes":{"isin":"DE2"}}]}'),
    ("LEI_C", '{"data": []}'),
    ("LEI_D", None),
    ("LEI_E", "not json"),
]


def test_isin_parse_and_map(spark):
    p = spark.createDataFrame(PAYLOADS, "lei string, payload string")
    assert rows(isin.parse_isins(p), "lei", "pos", "isin") == [
        ("LEI_A", 0, "US111"),
        ("LEI_B", 0, "DE1"),
        ("LEI_B", 1, "DE2"),
    ]
    m = {r["lei"]: list(r["isins"]) for r in isin.isin_map(p).collect()}
    assert m == {"LEI_A": ["US111"], "LEI_B": ["DE1", "DE2"]}


def test_attach_isins(spark):
    p = spark.createDataFrame(PAYLOADS, "lei string, payload string")
    df = spark.createDataFrame([("LEI_B",), ("LEI_C",)], "lei string")
    out = rows(isin.attach_isins(df, isin.isin_map(p)), "lei", "isins")
    assert out == [("LEI_B", "DE1, DE2"), ("LEI_C", "")]


def _like(name: str, text: str) -> bool:
    import re

    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in text)
    return re.fullmatch(".*" + rx + ".*", name.lower(), flags=re.S) is not None


def test_batch_search_matches_brute_force(spark):
    from ownergraph.operators.search import search_by_name_batch

    names = ["Alpha Holdings", "alphabet inc", "Beta_Corp", "Gamma 100% Ltd", "Back\\slash", "ab", "A", "Delta ab Co"]
    e = make_entities(spark, [entity(f"L{i:019d}", n, "x", "US") for i, n in enumerate(names)] + [entity("N" * 20, None, "x", "US")])
    texts = ["alpha", "ALPHA", "a_c", "%", "", "__", "ab", "k\\s", "0%", "zzz", "a", "ta a"]
    got = search_by_name_batch(e, spark.createDataFrame([(t,) for t in texts], "query string"), limit=3)
    got_rows = sorted((r["query"], r["rank"], r["lei"]) for r in got.collect())
    want = []
    for t in texts:
        hits = sorted((n, f"L{i:019d}") for i, n in enumerate(names) if _like(n, t.lower()))
        want += [(t, k + 1, lei) for k, (_, lei) in enumerate(hits[:3])]
    assert got_rows == sorted(want)


def test_batch_search_deals_names_out_and_keeps_no_postings(spark, monkeypatch):
    """Names from one file are dealt out to several tasks; the grams of all names are
    not written, only the names once, the texts' grams and the answers."""
    from ownergraph.operators import search
    from ownergraph.session import written

    seen = {}

    def recorded(df, name):
        out = written(df, name)
        seen[name] = (len({f for f in out.inputFiles()}), out.count())
        return out

    def refused(df):
        raise AssertionError("postings of all names were stored")

    monkeypatch.setattr(search, "written", recorded)
    monkeypatch.setattr(search, "materialize", refused)
    e = make_entities(spark, [entity(f"L{i:019d}", f"name {i:04d}", "x", "US") for i in range(500)]).coalesce(1)
    got = search.search_by_name_batch(e, spark.createDataFrame([("AME 00",), ("e 0123",), ("none",)], "query string"), limit=2)
    assert rows(got, "query", "rank", "legal_name") == [("AME 00", 1, "name 0000"), ("AME 00", 2, "name 0001"), ("e 0123", 1, "name 0123")]
    assert seen["name-search-names"][0] > 1 and seen["name-search-names"][1] == 500
    assert max(n for _, n in seen.values()) == 500


def _store_of(spark, entities, buckets=8):
    import tempfile

    from ownergraph.schema import KIND_ENTITIES
    from ownergraph.sources import csv_ingest, name_index, store

    load = store.Load(spark, tempfile.mkdtemp(prefix="ownergraph-names-"))
    placed, bucket = csv_ingest.bucketed(entities, "lei", buckets)
    placed.write.partitionBy(bucket).parquet(load.folder(KIND_ENTITIES))
    load.add(KIND_ENTITIES, placed.schema)
    name_index.layout_names(load, entities, 4, buckets)
    load.publish()
    return load.store


def test_stored_search_matches_brute_force(spark):
    from ownergraph.operators.search import search_by_name_stored
    from ownergraph.schema import KIND_ENTITIES
    from ownergraph.sources import name_index, store

    names = ["Alpha Holdings", "alphabet inc", "Beta_Corp", "Gamma 100% Ltd", "Back\\slash", "ab", "A", "Delta ab Co", "",
             "\u0141\u00f3d\u017a \U0001f600 AG", "ab", "x\u0003y", "alpha beta"]
    e = make_entities(spark, [entity(f"L{i:019d}", n, "x", "US") for i, n in enumerate(names)] + [entity("N" * 20, None, "x", "US")])
    at = _store_of(spark, e)
    stored, index = store.read_table(spark, at, KIND_ENTITIES), name_index.open_index(spark, at)
    texts = ["alpha", "ALPHA", "a_c", "%", "", "__", "ab", "k\\s", "0%", "zzz", "a", "ta a", "b%a", "alp%hol", "\u0142\u00f3D", "\U0001f600", "\u0003", "lpha%zzz"]
    for limit in (3, None):
        asked = spark.createDataFrame([(t,) for t in [*texts, "alpha", None]], "query string")
        got = search_by_name_stored(stored, index, asked, limit)
        got_rows = sorted((r["query"], r["rank"], r["lei"]) for r in got.collect())
        want = []
        for t in texts:
            hits = sorted((n, f"L{i:019d}") for i, n in enumerate(names) if _like(n, t.lower()))
            want += [(t, k + 1, lei) for k, (_, lei) in enumerate(hits[:limit])]
        assert got_rows == sorted(want)
    empty = search_by_name_stored(stored, index, spark.createDataFrame([], "query string"))
    assert empty.count() == 0


def test_index_of_repeated_leis_holds_each_pair_once(spark, monkeypatch):
    """A LEI that is there twice gives each gram once; the pairs of the others are
    not compared for it."""
    from ownergraph.sources import name_index

    def refused(self, *columns):
        raise AssertionError("all pairs were compared")

    monkeypatch.setattr(type(spark.range(1)), "dropDuplicates", refused)
    e = make_entities(spark, [entity("A" * 20, "abcd", "x", "US"), entity("A" * 20, "abce", "x", "US"), entity("B" * 20, "abc", "x", "US")])
    index = name_index.open_index(spark, _store_of(spark, e))
    want = [(g, "A" * 20) for g in ("abc", "bcd", "bce", "cd\u0003", "ce\u0003", "d\u0003\u0003", "e\u0003\u0003")]
    want += [(g, "B" * 20) for g in ("abc", "bc\u0003", "c\u0003\u0003")]
    assert rows(index.postings, "gram", "lei") == sorted(want)
    assert {r["gram"]: r["names"] for r in index.counts.collect()}["abc"] == 2


def test_stored_search_reads_its_own_buckets(spark):
    """Names and postings are read by buckets that Spark prunes at run time."""
    from test_ingest import _files_read

    from ownergraph.operators.edges import restrict
    from ownergraph.operators.search import search_by_name_stored
    from ownergraph.schema import KIND_ENTITIES
    from ownergraph.sources import name_index, store

    made = spark.range(3000).selectExpr("format_string('L%019d', id) AS lei", "concat('name ', hex(xxhash64(id))) AS legal_name")
    blank = make_entities(spark, []).drop("lei", "legal_name")
    e = made.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in blank.dtypes])
    at = _store_of(spark, e, 64)
    stored, index = store.read_table(spark, at, KIND_ENTITIES), name_index.open_index(spark, at)
    name = made.where("lei LIKE '%0077'").first()["legal_name"]
    found = search_by_name_stored(stored, index, spark.createDataFrame([(name[5:],)], "query string"))
    assert [r["legal_name"] for r in found.collect()] == [name]
    plan = found._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    assert 0 < _files_read(plan) * 10 < len(stored.inputFiles())
    lists = restrict(index.postings, "gram", spark.createDataFrame([(name[5:8].lower(),)], "lei string"))
    assert lists.count() > 0
    plan = lists._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()


def test_entities_replaced_alone_lose_their_index(spark, base):
    from ownergraph.plans import commands
    from ownergraph.schema import KIND_ENTITIES, KIND_EXCEPTIONS, KIND_RELATIONSHIPS
    from ownergraph.sources import csv_ingest, loader, name_index, store

    import tempfile

    e, r, x = base
    out = tempfile.mkdtemp(prefix="ownergraph-index-")
    files = {}
    for kind, df in ((KIND_ENTITIES, e), (KIND_RELATIONSHIPS, r), (KIND_EXCEPTIONS, x)):
        files[kind] = f"{out}/csv/{kind}"
        csv_ingest.write_csv_with_headers(df, kind, files[kind])
    loader.load_all(spark, files, out + "/tables")
    before = commands.open_tables(spark, out + "/tables")
    found = commands.name_search(before, "amber", limit=1)
    plain = commands.name_search(commands.Tables(e, r, x), "amber", limit=1)
    assert before.names is not None and rows(found.results) == rows(plain.results)
    csv_ingest.load_dataset(spark, KIND_ENTITIES, files[KIND_ENTITIES], out + "/tables")
    after = commands.open_tables(spark, out + "/tables")
    assert after.names is None and name_index.open_index(spark, out + "/tables") is None
    assert after.relationships_by_parent is not None  # made from a table that stayed
    assert rows(commands.name_search(after, "amber", limit=1).results) == rows(plain.results)
    csv_ingest.load_dataset(spark, KIND_RELATIONSHIPS, files[KIND_RELATIONSHIPS], out + "/tables")
    assert not store.exists(spark, out + "/tables", csv_ingest.BY_CHILD)
    assert commands.open_tables(spark, out + "/tables").relationships_by_parent is None


def test_search_title(spark, base):
    e, _, _ = base
    one = lookup.search_title(lookup.search_by_name(e, "middle"), "middle").collect()[0]
    assert one["title"] == "Name Search: 'middle' (1 result)"
    two = lookup.search_title(lookup.search_by_name(e, "ls"), "ls").collect()[0]
    assert two["title"] == "Name Search: 'ls' (2 results)"
    none = lookup.search_title(lookup.search_by_name(e, "zzz"), "zzz").collect()[0]
    assert none["title"] == "No entities found matching 'zzz'." and none["result_count"] == 0


def test_normalize_strips_unicode_whitespace(spark):
    raw = spark.createDataFrame([(" ambermill00000000052 ",), ("\tmidwood0000000000071\n",)], "lei_input string")
    out = rows(lookup.normalize_requests(raw), "lei", "is_valid")
    assert out == [("AMBERMILL00000000052", True), ("MIDWOOD0000000000071", True)]
