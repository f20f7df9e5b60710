"""Command-level compositions (lei, lei --tree, name, status)."""

from __future__ import annotations

from conftest import CHILD_A, GRANDCHILD, PARENT, ULTIMATE, make_exceptions, rows

from ownergraph.plans import commands


def test_lei_report_and_tree(spark, deep):
    e, r = deep
    t = commands.Tables(e, r, make_exceptions(spark, [(ULTIMATE, "CAT", "R", None)]))
    raw = spark.createDataFrame([(" ambermill00000000052 ",), ("SHORT",), ("NONEXISTENT000000001",)], "lei_input string")
    rep = commands.lei_report(t, raw)
    assert rows(rep.rejected, "lei") == [("SHORT",)]
    assert rows(rep.missing, "lei") == [("NONEXISTENT000000001",)]
    assert (CHILD_A, "children", 1) in rows(rep.lines, "lei", "section", "pos")
    isins = spark.createDataFrame([(PARENT, ["XS01", "US02"])], "lei string, isins array<string>")
    with_isins = commands.lei_report(commands.Tables(e, r, t.exceptions, isins), raw)
    lines = dict(rows(with_isins.lines.where("section = 'direct_parent'"), "lei", "text"))
    assert lines[CHILD_A].endswith(" | ISINs: XS01, US02")
    tree = commands.lei_tree(t, spark.createDataFrame([(GRANDCHILD,)], "lei_input string"))
    assert rows(tree.sizes, "root_lei", "total_entities") == [(ULTIMATE, 5)]
    labels = [x["label"] for x in tree.listing.orderBy("line_no").collect()]
    assert labels[0] == "Corporate Group (5 entities)"
    assert any("Teal Orchards OY" in x for x in labels)
    short = commands.lei_tree(t, spark.createDataFrame([(ULTIMATE,)], "lei_input string"), max_depth=1)
    assert not any("Teal Orchards OY" in x["label"] for x in short.listing.collect())


def test_name_search_command(spark, base):
    e, r, x = base
    out = commands.name_search(commands.Tables(e, r, x), "amber", limit=1)
    assert out.title.collect()[0]["title"] == "Name Search: 'amber' (1 result)"
    assert [row["lei"] for row in out.results.collect()] == [CHILD_A]


def test_end_to_end_from_csv_files(spark, deep):
    import os
    import tempfile

    from ownergraph.operators import hierarchy, report
    from ownergraph.sources import snapshots
    from ownergraph.sources.loader import load_all

    import csv

    from ownergraph.schema import COLUMN_MAPS

    e, r = deep
    x = make_exceptions(spark, [(ULTIMATE, "CAT", "R", "")])
    folder = tempfile.mkdtemp(prefix="ownergraph-e2e-")
    os.makedirs(f"{folder}/raw")
    for kind, df in (("lei2", e), ("rr", r), ("repex", x)):
        # one CSV file per dataset, named as the publisher names them
        cmap = COLUMN_MAPS[kind]
        with open(f"{folder}/raw/20310217-0615-pub-goldencopy-{kind}-golden-copy.csv", "w", newline="") as fh:
            w = csv.writer(fh, lineterminator="\n")
            w.writerow(list(cmap))
            for row in df.collect():
                w.writerow([row[c] if c in df.columns and row[c] is not None else "" for c in cmap.values()])
    files = snapshots.list_files(spark, f"{folder}/raw/*.csv")
    latest = {row["dataset_type"]: row["path"] for row in snapshots.latest_snapshots(files, "pub").collect()}
    assert set(latest) == {"lei2", "rr", "repex"}
    counts = load_all(spark, latest, f"{folder}/tables", {"lei2": "2031-02-17"}, f"{folder}/meta")
    assert counts == {"lei2": 5, "rr": 6, "repex": 1}
    t = commands.open_tables(spark, f"{folder}/tables")
    raw = spark.createDataFrame([(CHILD_A,)], "lei_input string")
    lines = report.order_report(commands.lei_report(t, raw).lines).collect()
    assert [x["section"] for x in lines][:3] == ["entity", "direct_parent", "ultimate_parent"]
    assert lines[1]["text"].startswith(PARENT)
    tree = report.order_tree(hierarchy.descendant_tree(t.entities, t.relationships, spark.createDataFrame([(ULTIMATE,)], "lei string")), t.entities)
    assert [x["node_lei"] for x in tree.collect()][0] == ULTIMATE
    status = rows(commands.status(spark, f"{folder}/meta"), "dataset", "records")
    assert ("Level 1 - LEI Records", "5") in status
