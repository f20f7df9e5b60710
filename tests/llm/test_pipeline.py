"""The pipeline on a small table, and every registered query's oracle."""

from __future__ import annotations

import os
import tempfile

import duckdb
import pytest

import corpus_pipeline
from ownergraph.llm import edit_match, language_gru, line_dedup, queries, simhash_anchor

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_stages(llm_spark):
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = tempfile.mkdtemp(prefix="ownergraph-stage-") + "/o"
        stage(llm_spark, docs, SF).write.parquet(out)
        after = llm_spark.read.parquet(out)
        if name != "packing":
            assert after.columns == columns
            sizes.append(after.count())
        if name == "line_dedup":
            assert line_dedup.removed_lines(after).where("line_no >= 0").count() == 0
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "benchmark_decontamination":
            items = llm_spark.read.parquet(f"{SF}/benchmark.parquet")
            assert edit_match.contamination(after, items).where("contaminated").count() == 0
        docs = after
    assert sizes[0] == sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0.8 * sizes[0]
    assert docs.selectExpr("max(offset + length)").first()[0] <= 2048


def test_oracles(llm_spark):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](llm_spark, SF)
        want = con.execute(sql).fetchall()
        cols = [d[0] for d in con.description]
        assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(want)


def test_columns_named_like_the_stages_own_keep_their_values(llm_spark, odd_docs):
    items = llm_spark.createDataFrame([(1, "four five six seven eight nine")], "item_id long, text string")
    stages = [
        language_gru.in_known_language,
        line_dedup.dedup_lines,
        simhash_anchor.one_of_each,
        lambda docs: edit_match.clean_documents(docs, items),
    ]
    names = odd_docs.columns[5:]
    want = [r[5:] for r in odd_docs.limit(1).collect()]
    for stage in stages:
        out = stage(odd_docs)
        assert out.columns == odd_docs.columns
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(x) for x in want]
