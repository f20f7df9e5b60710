"""Learned decision lists: counts, covering and the query against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ownergraph.llm import decision_list as dl

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), len(set(words)), len(lines),
        sum("A" <= c <= "Z" for c in text), sum(c in ".!?" for c in text),
    )


def test_counts_of_odd_texts():
    draw = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b a b a b a", "x\x1cy \x85 z w", "#\n#\n #\n\n\n", "é É\r\né É"]
    texts += ["".join(draw.choice("ab é\n\t #A. ") for _ in range(draw.randint(0, 60))) for _ in range(600)]
    for t in texts:
        assert dl.text_counts(t) == brute_counts(t), repr(t)


def brute_best(x, bad):
    """The highest gain over every ratio, direction and pair of neighbours."""
    best = 0.0
    p0, n0 = bad.sum(), (~bad).sum()
    for k in range(x.shape[1]):
        for cut in sorted(set(x[:, k]))[:-1]:
            for hit in (x[:, k] <= cut, x[:, k] > cut):
                p, n = (hit & bad).sum(), (hit & ~bad).sum()
                if p:
                    best = max(best, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))))
    return best


def test_best_condition_has_the_highest_gain():
    draw = np.random.default_rng(3)
    for _ in range(20):
        x = draw.integers(0, 6, (40, 3)).astype("f8")
        bad = draw.random(40) < 0.2 + 0.1 * x[:, 1]
        if not bad.any() or bad.all():
            continue
        c = dl.best_condition(x, bad)
        if c is None:
            assert brute_best(x, bad) < 1e-9
            continue
        hit = c.holds(x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        gain = p * (np.log2(p / (p + n)) - np.log2(bad.mean()))
        assert gain == pytest.approx(brute_best(x, bad))


def _docs(draw, n):
    """Good prose; symbol litter (low) and short-word chains (low)."""
    rows = []
    for i in range(n):
        kind = i % 4
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 8))) for _ in range(draw.randint(60, 200))]
        if kind == 0:
            words = [w + draw.choice("#*%&") * 3 for w in words]
        if kind == 1:
            words = [w[:2].upper() for w in words]
        rows.append((i, " ".join(words), 0 if kind < 2 else 1))
    return rows


def test_learned_list_is_precise_and_whole(llm_spark):
    rows = _docs(random.Random(6), 400)
    docs = llm_spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = llm_spark.createDataFrame([(i, q) for i, _, q in rows if i < 240], "doc_id long, quality int")
    rules = dl.quality_rules(docs, labels)
    assert 1 <= len(rules) <= 8 and all(dl.describe(rules))
    got = {r.doc_id: r for r in dl.quality_report(docs, rules).collect()}
    truth = {i: q for i, _, q in rows}
    counts = np.array([brute_counts(t) for _, t, _ in rows])
    x = dl.ratios(counts)
    # the conditional expression says what the rules say, in their order
    for i, _, _ in rows:
        first = next((k for k, rule in enumerate(rules, 1) if all(c.holds(x[i : i + 1])[0] for c in rule)), 0)
        base = counts[i][0] < 50 or 100 * counts[i][4] > 50 * counts[i][0]
        assert (got[i].rule, got[i].base_failed, got[i].kept) == (first, base, not base and first == 0)
        assert tuple(got[i][c] for c in dl.TEXT_STATS) == tuple(counts[i])
    held = [i for i in truth if i >= 240 and not got[i].base_failed]
    assert all(got[i].kept for i in held if truth[i])
    assert np.mean([not got[i].kept for i in held if not truth[i]]) > 0.9


def test_list_learns_the_same_from_shuffled_rows(llm_spark):
    rows = _docs(random.Random(8), 200)
    docs = llm_spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = llm_spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    one = dl.quality_rules(docs.repartition(3), labels.repartition(2))
    assert one == dl.quality_rules(docs.repartition(7, F.rand(1)), labels)
    counts, bad = dl.labelled_counts(docs, labels, limit=50)
    assert len(counts) == len(bad) <= 50


def test_odd_rows_and_labels(llm_spark, odd_docs, no_docs):
    labels = llm_spark.createDataFrame(
        [(5, 0), (5, 1), (3, 1), (None, 0), (6, None), (7, 3)], "doc_id long, quality int"
    ).withColumn("text", F.lit("clash"))
    assert dl.quality_rules(odd_docs, labels) == []  # one label only: nothing to learn
    got = dl.quality(odd_docs, labels)
    want = sorted((str(r.doc_id), brute_counts(r.text)) for r in odd_docs.collect() if r.doc_id != 3 and r.doc_id != 4)
    out = got.collect()
    assert sorted((str(r.doc_id), tuple(r[c] for c in dl.TEXT_STATS)) for r in out if r.doc_id not in (3, 4)) == want
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 50)
    assert len(out) == odd_docs.count()
    assert dl.quality(no_docs, labels).count() == 0
    assert dl.quality(odd_docs, labels.limit(0)).count() == len(out)


def test_query_against_plain_python(llm_spark):
    from ownergraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in QUERIES["op13_quality_rules"](llm_spark, sf).collect()}
    docs = llm_spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        if len(d.text or "") < 6000:
            assert tuple(out[d.doc_id][c] for c in dl.TEXT_STATS[:5]) == brute_counts(d.text)[:5]
