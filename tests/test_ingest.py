"""CSV parity, loads, bookkeeping, key checks."""

from __future__ import annotations

import os
import tempfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ownergraph.operators import quality
from ownergraph.schema import EXCEPTION_COLUMNS, LEVEL1_COLUMNS, RELATIONSHIP_COLUMNS
from ownergraph.sources import csv_ingest, csv_split, metadata, snapshots, store


def _write(text: str, raw: bytes | None = None) -> str:
    d = tempfile.mkdtemp(prefix="ownergraph-csv-")
    path = os.path.join(d, "x.csv")
    with open(path, "wb") as fh:
        fh.write(raw if raw is not None else text.encode("utf-8"))
    return path


HEADER = ",".join(EXCEPTION_COLUMNS)


def test_exception_csv_parity(spark):
    body = "\n".join(
        [
            HEADER,
            'A0000000000000000001,CAT,"says ""hi""",ref1',
            'A0000000000000000002,CAT,"two\nlines",',
            'A0000000000000000003,CAT,"",""',
            "A0000000000000000004,CAT,short",
            "A0000000000000000005,CAT,r,ref,extra",
        ]
    )
    df = csv_ingest.read_dataset_csv(spark, _write(body), "repex")
    got = {r["lei"]: (r["exception_reason_1"], r["exception_reference_1"]) for r in df.collect()}
    assert got == {
        "A0000000000000000001": ('says "hi"', "ref1"),
        "A0000000000000000002": ("two\nlines", None),
        "A0000000000000000003": (None, None),
    }


def test_invalid_utf8_row_dropped(spark):
    raw = (HEADER + "\nA0000000000000000001,CAT,ok,r\nA0000000000000000002,CAT,b\xffd,r\n").encode("latin-1")
    df = csv_ingest.read_dataset_csv(spark, _write("", raw), "repex")
    assert rows(df, "lei") == [("A0000000000000000001",)]


def test_written_replacement_character_is_kept(spark):
    raw = (HEADER + "\nA0000000000000000001,CAT,caf\u00e9 \ufffd,r\nA0000000000000000002,CAT,ok,\u0141\u00f3d\u017a\n").encode("utf-8")
    raw += b"A0000000000000000003,CAT,\xc3\x28,r\n"  # no UTF-8
    for multi_line in (True, False):
        df = csv_ingest.read_dataset_csv(spark, _write("", raw), "repex", multi_line=multi_line)
        assert rows(df, "lei", "exception_reason_1", "exception_reference_1") == [
            ("A0000000000000000001", "caf\u00e9 \ufffd", "r"),
            ("A0000000000000000002", "ok", "\u0141\u00f3d\u017a"),
        ]


def test_several_files_of_one_kind(spark):
    paths = [_write(HEADER + f"\nA000000000000000000{i},CAT,r,x\n") for i in range(3)]
    assert csv_ingest.read_dataset_csv(spark, paths, "repex").count() == 3


def test_missing_column_fails(spark):
    path = _write("LEI,Exception.Category\nA0000000000000000001,CAT\n")
    with pytest.raises(csv_ingest.MissingColumnsError):
        csv_ingest.read_dataset_csv(spark, path, "repex")


def test_level1_wide_file_projection_and_load_count(spark):
    headers = list(LEVEL1_COLUMNS) + ["Extra.Unused"]
    line = ["L%019d" % 1, "Name One"] + [""] * (len(headers) - 2)
    line2 = ["L%019d" % 2, "Name Two"] + ["v"] * (len(headers) - 2)
    path = _write(",".join(headers) + "\n" + ",".join(line) + "\n" + ",".join(line2) + "\n")
    df = csv_ingest.read_dataset_csv(spark, path, "lei2")
    assert df.columns == list(LEVEL1_COLUMNS.values())
    out = tempfile.mkdtemp(prefix="ownergraph-pq-")
    n = csv_ingest.load_dataset(spark, "lei2", path, out + "/t")
    assert n == 2 and store.read_table(spark, out + "/t", "lei2").count() == 2


def test_metadata_upsert_status(spark):
    empty = metadata.read_metadata(spark, "/nonexistent/metadata")
    assert empty.count() == 0
    loads = spark.createDataFrame([("lei2", "2031-02-17", 1234567), ("rr", None, 7654321)], "dataset_type string, publish_date string, record_count int")
    first = metadata.metadata_rows(loads, F.lit("2031-02-18 03:05:41").cast("timestamp"))
    upd = metadata.metadata_rows(
        spark.createDataFrame([("rr", "2031-02-18", 5)], "dataset_type string, publish_date string, record_count int"),
        F.lit("2031-02-19 04:00:00").cast("timestamp"),
    )
    merged = metadata.upsert_metadata(first, upd)
    rep = rows(metadata.status_report(merged), "dataset", "publish_date", "loaded_at", "records")
    assert rep == [
        ("Level 1 - LEI Records", "2031-02-17", "2031-02-18 03:05:41", "1,234,567"),
        ("Level 2 - Relationships", "2031-02-18", "2031-02-19 04:00:00", "5"),
    ]
    path = tempfile.mkdtemp(prefix="ownergraph-meta-") + "/m"
    metadata.write_metadata(first, path)
    metadata.write_metadata(upd, path)
    stored = rows(metadata.read_metadata(spark, path), "dataset_type", "record_count")
    assert stored == [("lei2", 1234567), ("rr", 5)]


def test_snapshots_and_staleness(spark):
    files = spark.createDataFrame(
        [
            ("/d/20310216-0615-pub-goldencopy-rr-golden-copy.csv",),
            ("/d/20310217-0615-pub-goldencopy-rr-golden-copy.csv",),
            ("/d/20310217-0615-pub-goldencopy-lei2-golden-copy.csv",),
            ("/d/20310218-0615-other-goldencopy-rr-golden-copy.csv",),
            ("/d/notes.txt",),
        ],
        "path string",
    )
    latest = snapshots.latest_snapshots(files, "pub")
    assert rows(latest) == [
        ("lei2", "/d/20310217-0615-pub-goldencopy-lei2-golden-copy.csv"),
        ("rr", "/d/20310217-0615-pub-goldencopy-rr-golden-copy.csv"),
    ]
    remote = spark.createDataFrame([("lei2", "2031-02-17"), ("rr", "2031-02-18"), ("repex", "2031-02-17")], "dataset_type string, publish_date string")
    local = spark.createDataFrame([("lei2", "2031-02-17"), ("rr", "2031-02-17")], "dataset_type string, local_date string")
    out = dict(rows(snapshots.stale_datasets(remote, local, latest), "dataset_type", "needs_download"))
    assert out == {"lei2": False, "rr": True, "repex": True}
    forced = dict(rows(snapshots.stale_datasets(remote, local, latest, force=True), "dataset_type", "needs_download"))
    assert all(forced.values())


def test_key_violations(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), ("c", "y")], "k1 string, k2 string")
    out = rows(quality.key_violations(df, ["k1", "k2"]))
    assert out == [("a", "x", 2, False), ("b", None, 1, True)]


def _laid_out(spark, r, partitions, buckets=8):
    load = store.Load(spark, tempfile.mkdtemp(prefix="ownergraph-layout-"))
    csv_ingest.layout_relationships(load, r, partitions, buckets)
    load.publish()
    return load


def test_layout_relationships(spark, base, capsys):
    _, r, _ = base
    load = _laid_out(spark, r, 2)
    back = store.read_table(spark, load.store, csv_ingest.BY_CHILD)
    assert back.count() == r.count()
    back.where(F.col("start_node_id") == "X").explain()
    assert "PushedFilters: [IsNotNull(start_node_id), EqualTo(start_node_id,X)]" in capsys.readouterr().out


def test_request_list_reads_its_own_buckets(spark):
    """Ten LEIs: the scan is pruned at run time to under a tenth of the files."""
    from ownergraph.operators import relations
    from ownergraph.schema import DIRECT_PARENT

    pairs = spark.range(6000).select(
        F.format_string("C%019d", "id").alias("start_node_id"), F.format_string("P%019d", F.col("id") % 700).alias("end_node_id"),
        F.lit(DIRECT_PARENT).alias("relationship_type"), F.lit("ACTIVE").alias("relationship_status"))
    assert csv_ingest.bucket_count(1 << 20) < csv_ingest.bucket_count(1 << 30) == 128 < csv_ingest.bucket_count(1 << 40) == 4096
    load = _laid_out(spark, pairs, 4, csv_ingest.BUCKETS)
    by_parent = store.read_table(spark, load.store, csv_ingest.BY_PARENT)
    by_child = store.read_table(spark, load.store, csv_ingest.BY_CHILD)
    names = pairs.select(F.col("start_node_id").alias("lei"), F.lit("n").alias("legal_name"))
    asked = spark.createDataFrame([(f"P{i:019d}",) for i in range(10)], "lei string")
    kids = relations.children(names, by_parent, asked)
    got = kids.collect()
    assert sorted(x.related_lei for x in got) == sorted(f"C{i:019d}" for i in range(6000) if i % 700 < 10)
    plan = kids._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    assert _files_read(plan) * 10 < len(by_parent.inputFiles())
    some = spark.createDataFrame([("C" + "0" * 18 + "7",)], "lei string")
    there = relations.siblings(names, by_child, some, rels_by_parent=by_parent)
    assert there.count() == len(range(7, 6000, 700)) - 1
    assert "dynamicpruning" in there._jdf.queryExecution().executedPlan().toString()


def _files_read(plan) -> int:
    """Files read by the partitioned scans of an executed plan."""
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        else:
            if name == "FileSourceScanExec" and "__in_" in node.toString():
                total += node.metrics().apply("numFiles").value()
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
    return total


# --- a load replaces tables all at once ---------------------------------------


def _repex(n, tail=""):
    return HEADER + "\n" + "".join(f"A{i:019d},CAT,r,x\n" for i in range(n)) + tail


def test_failed_load_leaves_the_previous_one(spark, monkeypatch):
    from ownergraph.sources.loader import load_all

    out = tempfile.mkdtemp(prefix="ownergraph-atomic-")
    load_all(spark, {"repex": _write(_repex(3))}, out + "/tables", {"repex": "2031-02-17"}, out + "/meta")
    old = store.read_table(spark, out + "/tables", "repex")
    manifest, records = store.manifest(spark, out + "/tables"), rows(metadata.read_metadata(spark, out + "/meta"))
    with pytest.raises(csv_ingest.MissingColumnsError):  # the second kind fails
        load_all(spark, {"repex": _write(_repex(5)), "rr": _write("a,b\n1,2\n")}, out + "/tables", {}, out + "/meta")
    monkeypatch.setattr(csv_ingest, "layout_relationships", None)  # fails after all tables are written
    rr = _write(",".join(RELATIONSHIP_COLUMNS) + "\n")
    with pytest.raises(TypeError):
        load_all(spark, {"repex": _write(_repex(5)), "rr": rr}, out + "/tables", {}, out + "/meta")
    assert store.manifest(spark, out + "/tables") == manifest
    assert store.read_table(spark, out + "/tables", "repex").count() == 3
    assert rows(metadata.read_metadata(spark, out + "/meta")) == records
    monkeypatch.undo()
    assert csv_ingest.load_dataset(spark, "repex", _write(_repex(6)), out + "/tables") == 6
    assert store.read_table(spark, out + "/tables", "repex").count() == 6
    assert old.count() == 3  # a reader that began before goes on with its files


def test_two_loads_from_one_manifest_conflict(spark):
    out = tempfile.mkdtemp(prefix="ownergraph-conflict-")
    one, two = store.Load(spark, out), store.Load(spark, out)
    for load, n in ((one, 1), (two, 2)):
        csv_ingest.load_into(load, "repex", _write(_repex(n)))
    assert one.publish() == 1
    with pytest.raises(store.StoreConflict):
        two.publish()
    assert store.read_table(spark, out, "repex").count() == 1
    with pytest.raises(store.NoSuchTable):
        store.read_table(spark, out, "rr")
    assert not store.exists(spark, out + "/none", "repex")


def test_table_without_rows(spark):
    out = tempfile.mkdtemp(prefix="ownergraph-empty-")
    assert csv_ingest.load_dataset(spark, "repex", _write(HEADER + "\n"), out) == 0
    assert store.read_table(spark, out, "repex").count() == 0
    assert store.read_table(spark, out, "repex" + csv_ingest.REJECTS).count() == 0


# --- byte order mark, rejects, one file in many tasks ---------------------------


@pytest.mark.parametrize("quoted", [True, False])
def test_byte_order_mark(spark, quoted):
    header = ",".join(f'"{h}"' for h in EXCEPTION_COLUMNS) if quoted else HEADER
    body = "\ufeff" + header + "\nA0000000000000000001,CAT,r,x\n"
    for multi_line, split in ((True, False), (False, False), (True, True)):
        df = csv_ingest.read_dataset_csv(spark, _write(body), "repex", multi_line=multi_line, split=split)
        assert rows(df, "lei", "exception_reference_1") == [("A0000000000000000001", "x")]


def test_rejects_are_counted_and_kept(spark):
    raw = (_repex(4) + "short,row\nA1,CAT,r,x,more\n\n").encode() + b"A2,CAT,caf\xe9,x\n"
    out = tempfile.mkdtemp(prefix="ownergraph-rejects-")
    assert csv_ingest.load_dataset(spark, "repex", _write("", raw), out) == 4
    facts = store.manifest(spark, out)
    assert (facts["repex"]["rows"], facts["repex"]["rejected"]) == (4, 3)
    kept = store.read_table(spark, out, "repex" + csv_ingest.REJECTS)
    assert rows(kept, "reason", "line") == [
        ("encoding", "A2,CAT,caf\ufffd,x"), ("fields", "A1,CAT,r,x,more"), ("fields", "short,row")]
    assert all(x.source_file.endswith("x.csv") for x in kept.collect())


def _awkward(draw, n):
    """Rows whose quoted fields hold line breaks, commas, quotes and other letters."""
    out = []
    for i in range(n):
        field = "".join(draw.choice(["a", "\n", ",", '""', "\r\n", "\u0141", " ", "\n\n"]) for _ in range(draw.randint(0, 12)))
        out.append(f'A{i:019d},"{field}",{draw.choice(["r", "", chr(0x141)])},"x"')
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_tasks_equals_multi_line(spark, end):
    import random

    lines = _awkward(random.Random(len(end)), 300)
    lines[50] += ",too long"
    lines[60] = "short"
    lines.insert(70, "")
    paths = [_write("\ufeff" * k + HEADER + end + end.join(lines) + end * k) for k in (1, 0)]
    lone = _write(HEADER + end + 'A,"1' + "\n" * 3000 + '2",r,x')  # a field over many blocks
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    cols = ["lei", "exception_category", "exception_reason_1", "exception_reference_1", "reason", "line"]
    want = rows(csv_ingest.read_with_rejects(spark, [*paths, lone], "repex"), *cols)
    try:
        for size in (61, 256, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = csv_split.blocks(spark, [*paths, lone])
            assert csv_split.ill_quoted(found) == [] and found.count() > 10
            assert found.where("open = 1").count() > 3  # blocks that begin inside a field
            got = csv_ingest.read_with_rejects(spark, [*paths, lone], "repex", split=True)
            assert got.rdd.getNumPartitions() > 3 if size == 61 else True
            assert rows(got, *cols) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stray_quotes_are_read_whole(spark):
    body = HEADER + '\nA1,5" pipe,r,x\nA2,"two\nlines",r,x\nA3,c,r,x\n'
    good = _write(_repex(2))
    paths = [_write(body), good]
    assert len(csv_split.ill_quoted(csv_split.blocks(spark, paths))) == 1
    want = rows(csv_ingest.read_dataset_csv(spark, paths, "repex"), "lei", "exception_category")
    assert rows(csv_ingest.read_dataset_csv(spark, paths, "repex", split=True), "lei", "exception_category") == want


def test_load_all_counts_and_metadata(spark):
    from ownergraph.sources.loader import MissingDatasetError, load_all

    rr_header = ",".join(__import__("ownergraph.schema", fromlist=["x"]).RELATIONSHIP_COLUMNS)
    rr = _write(rr_header + "\n" + ",".join(["A" * 20, "LEI", "B" * 20, "LEI", "IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE"] + [""] * 16) + "\n")
    repex = _write(HEADER + "\nA0000000000000000001,CAT,r,x\nA0000000000000000002,CAT,r,y\n")
    out = tempfile.mkdtemp(prefix="ownergraph-loadall-")
    counts = load_all(spark, {"rr": rr, "repex": repex}, out + "/tables", {"rr": "2031-02-17"}, out + "/meta")
    assert counts == {"rr": 1, "repex": 2}
    meta = rows(metadata.read_metadata(spark, out + "/meta"), "dataset_type", "publish_date", "record_count")
    assert meta == [("repex", "unknown", 2), ("rr", "2031-02-17", 1)]
    with pytest.raises(MissingDatasetError):
        load_all(spark, {"lei2": None}, out + "/tables")


def test_malformed_rows_dropped_even_when_only_unselected_columns_differ(spark):
    header = ",".join(list(EXCEPTION_COLUMNS) + ["Extra.A", "Extra.B"])
    body = "\n".join(
        [
            header,
            "A0000000000000000001,CAT,r,ref,a,b",
            "A0000000000000000002,CAT,r,ref,a",
            "A0000000000000000003,CAT,r,ref,a,b,c",
        ]
    )
    for multi_line in (True, False):
        df = csv_ingest.read_dataset_csv(spark, _write(body), "repex", multi_line=multi_line)
        assert rows(df, "lei") == [("A0000000000000000001",)]


def test_unreadable_metadata_raises(spark):
    folder = tempfile.mkdtemp(prefix="ownergraph-meta-bad-")
    with open(folder + "/part-0.parquet", "w") as fh:
        fh.write("this is no parquet file")
    with pytest.raises(Exception):
        metadata.read_metadata(spark, folder).collect()
    with pytest.raises(Exception):
        metadata.read_metadata(spark, "nosuchscheme://x/y")
    assert metadata.read_metadata(spark, folder + "/absent").count() == 0


def test_layout_splits_a_hot_parent_across_files(spark):
    import glob

    from ownergraph.schema import DIRECT_PARENT

    rows_ = [(f"C{i:019d}", "H" * 20, DIRECT_PARENT, "ACTIVE") for i in range(400)]
    r = spark.createDataFrame(rows_, "start_node_id string, end_node_id string, relationship_type string, relationship_status string")
    load = _laid_out(spark, r, 4)
    files = glob.glob(load.folder(csv_ingest.BY_PARENT) + "/*/*.parquet")
    assert len(files) > 1
    back = store.read_table(spark, load.store, csv_ingest.BY_PARENT)
    assert back.where(F.col("end_node_id") == "H" * 20).count() == 400


def test_lookup_by_layout_asks_for_every_parent(spark):
    """A parent by links of another type alone, or by an ultimate edge alone, is
    looked up too."""
    from ownergraph.plans.queries_io import q_lookup_by_layout

    sf = tempfile.mkdtemp(prefix="ownergraph-sf-")
    customer = spark.range(1, 8).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "0 AS c_nationkey", "1.0D AS c_acctbal", "'X' AS c_mktsegment")
    supplier = spark.range(7, 9).selectExpr("id AS s_suppkey", "concat('Supplier#', id) AS s_name", "0 AS s_nationkey")
    customer.write.parquet(f"{sf}/customer.parquet")
    supplier.write.parquet(f"{sf}/supplier.parquet")
    spark.range(1).selectExpr("0 AS n_nationkey", "'N' AS n_name").write.parquet(f"{sf}/nation.parquet")
    spark.range(1).selectExpr("id AS o_orderkey").write.parquet(f"{sf}/orders.parquet")
    cust, supp = "CUST{:016d}".format, "SUPP{:016d}".format
    assert rows(q_lookup_by_layout(spark, sf), "lei", "n_children", "n_direct", "first_child") == [
        (cust(0), 11, 4, cust(1)),
        (cust(1), 3, 3, cust(5)),
        (cust(105), 1, 0, supp(7)),
        (cust(120), 1, 0, supp(8)),
    ]


def test_checkpoint_folder_must_be_named_on_a_cluster(monkeypatch):
    from ownergraph import session

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
