"""P1, P2, U2, ranking, and the driver contract against DuckDB at sf0.001."""

from __future__ import annotations

import math
import os
import random

import duckdb
import pytest
from conftest import CHILD_A, CHILD_B, PARENT, ULTIMATE, requests_of, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as se
from ownergraph.operators import ranking, report

SMOKE = "/root/testdata/sf0.001"


def test_full_report_child(spark, base):
    e, r, x = base
    out = report.full_report_long(e, r, x, requests_of(spark, CHILD_A))
    got = rows(out, "section", "related_lei")
    assert got == [
        ("direct_parent", PARENT),
        ("entity", CHILD_A),
        ("siblings", CHILD_B),
        ("ultimate_parent", ULTIMATE),
    ]


def test_full_report_parent_and_missing(spark, base):
    e, r, x = base
    out = rows(report.full_report_long(e, r, x, requests_of(spark, ULTIMATE)), "section", "related_lei", "exception_category")
    assert ("children", PARENT, None) in out and ("children", CHILD_A, None) in out
    assert ("exceptions", None, "ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT") in out
    assert report.full_report_long(e, r, x, requests_of(spark, "X" * 20)).count() == 0


def test_report_counts_and_leis(spark, base):
    e, r, x = base
    counts = {row["lei"]: row for row in report.full_report_counts(e, r, x).collect()}
    assert counts[CHILD_A]["has_direct_parent"] and counts[CHILD_A]["n_siblings"] == 1
    assert counts[ULTIMATE]["n_children"] == 2 and counts[ULTIMATE]["n_exceptions"] == 1
    long = report.full_report_long(e, r, x, requests_of(spark, CHILD_A))
    leis = report.report_leis(long).orderBy("first_pos").collect()
    assert [x["related_lei"] for x in leis] == [CHILD_A, PARENT, ULTIMATE, CHILD_B]


def test_display_columns(spark, base):
    e, r, _ = base
    panel = report.entity_panel(e, requests_of(spark, CHILD_A)).collect()[0]
    assert panel["legal_address"] == "Chicago, US" and panel["category"] == "GENERAL"
    lines = report.parent_lines(e, r, requests_of(spark, PARENT, ULTIMATE)).collect()
    by = {x["lei"]: x for x in lines}
    assert by[PARENT]["direct_parent"] == f"{ULTIMATE} | Skarven Shipping ASA | ACTIVE | GB"
    assert by[ULTIMATE]["direct_parent"] == "None"


def test_display_makes_the_report_once(spark, base, tmp_path):
    """The display lines read the written report, not the tables behind it again."""
    e, r, x = base
    e.write.parquet(str(tmp_path / "entity_source"))
    stored = spark.read.parquet(str(tmp_path / "entity_source"))
    long = report.full_report_long(stored, r, x, requests_of(spark, CHILD_A, ULTIMATE))
    lines = report.report_display(long, registry=False)
    assert "entity_source" not in lines._jdf.queryExecution().optimizedPlan().toString() + "".join(lines.inputFiles())
    got = rows(lines, "lei", "section", "pos", "text")
    assert (CHILD_A, "siblings", 1, f"{CHILD_B} | Brisk Canals BV | IS_DIRECTLY_CONSOLIDATED_BY") in got
    assert (ULTIMATE, "siblings", 0, "None") in got


def test_ordinal_within_group_matches_row_number(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.randint(0, 10_000), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, id int")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    got = ranking.ordinal_within_group(df, ["g"], [F.col("v"), F.col("id")], "pos", partitions=7)
    assert rows(got, "id", "pos") == rows(want, "id", "pos")


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["lei", "root_lei", "total_entities"]
    assert df.count() > 0


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def _sorted_rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver test data not present")
def test_every_query_matches_its_oracle(spark):
    con = duckdb.connect()
    for t in "customer supplier nation orders".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    from ownergraph.plans.catalogue import ORACLES as oracles
    from ownergraph.plans.catalogue import QUERIES

    types = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN"}
    bad = []
    for name in QUERIES:
        sdf = se.queries()[name](spark, SMOKE)
        spark_pdf = sdf.toPandas()
        if name not in oracles:
            continue
        duck_pdf = con.execute(oracles[name]).df()
        if _sorted_rows(spark_pdf) != _sorted_rows(duck_pdf):
            bad.append(name)
        spark_types = {f.name: types.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
        duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {oracles[name]}").fetchall()}
        if spark_types != duck_types:
            bad.append(name + ":types")
    assert bad == []


def test_registry_report_has_a_group_line(spark, base):
    e, r, x = base
    lines = {(row["lei"], row["section"]): row["text"] for row in report.report_display(report.full_report_long(e, r, x), registry=True).collect()}
    assert lines[(CHILD_A, "sibling_group")] == f"{PARENT} | 1"
    assert lines[(PARENT, "sibling_group")] == "None"  # an only child
    assert lines[(ULTIMATE, "sibling_group")] == "None"


def test_report_display_lines(spark, base):
    e, r, x = base
    long = report.full_report_long(e, r, x, requests_of(spark, ULTIMATE, CHILD_A))
    lines = {(row["lei"], row["section"], row["pos"]): row["text"] for row in report.report_display(long, registry=False).collect()}
    assert lines[(ULTIMATE, "direct_parent", 0)] == "None"
    assert lines[(ULTIMATE, "siblings", 0)] == "None"
    assert lines[(ULTIMATE, "children", 1)] == f"{CHILD_A} | Amber Mills Ltda | IS_ULTIMATELY_CONSOLIDATED_BY"
    assert lines[(ULTIMATE, "exceptions", 1)] == "ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT | NO_KNOWN_PERSON | "
    assert lines[(CHILD_A, "direct_parent", 1)] == f"{PARENT} | Middlewood Trading AB | ACTIVE | US"
    assert lines[(CHILD_A, "children", 0)] == "None"
    assert (CHILD_A, "other", 0) not in lines
