"""Hard negatives against integer arithmetic in plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ownergraph.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, a int, q string, norm string, rank string, cell double"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    whole = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        whole.append((vec_id, [math.floor(256 * c) for c in x], label))

    def order(r):
        return (-r[0], r[1] is None, r[1] or 0)

    def score(x, y):
        return max(-hn.LARGEST, min(hn.LARGEST, sum(a * b for a, b in zip(x, y))))

    out = []
    for vec_id, q, label in whole:
        if vec_id is None or not is_anchor(vec_id):
            continue
        scored = [(score(q, y), v, m) for v, y, m in whole if len(y) == len(q)]
        same = sorted([r for r in scored if r[2] == label and r[1] != vec_id], key=order)[:positives]
        rest = sorted([r for r in scored if r[2] != label], key=order)
        for ps, p, _ in same:
            fits = [r for r in rest if low * ps <= 100 * r[0] <= high * ps][:negatives]
            out += [(vec_id, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    data = [(i, [None if c is None else float(c) for c in x] if x is not None else None, m, 1, "q", "n", "r", 0.5) for i, x, m in rows]
    return spark.createDataFrame(data, SCHEMA)


def test_bounds_hold_for_every_pair():
    draw = np.random.default_rng(5)
    for dim in (1, 2, 3, 16):
        x = np.floor(draw.normal(0, 200, (60, dim)) * draw.choice([0, 1e-2, 1, 1e3], (60, 1)))
        near = x[:30] + draw.integers(-1, 2, (30, dim))
        y = np.concatenate([near, -x[:10], np.floor(draw.normal(0, 90, (30, dim)))])
        (dx, nx), (dy, ny) = hn.unit(x), hn.unit(y)
        references = hn.far_apart(dx[nx > 0], hn.REFERENCES)
        ax, ay = hn.angles_to(dx, references), hn.angles_to(dy, references)
        low, high = hn.score_bounds(ax, nx, ay, ny)
        true = x @ y.T
        assert (low <= true).all() and (true <= high).all()
        rows = hn.Rows(np.arange(70), np.ones(70, bool), np.zeros(70, int), dim, True, [r.astype("<f8").tobytes() for r in y], ny, [r.tobytes() for r in ay])
        assert (true.max(1) <= hn.block_highest(ax, nx, rows)).all()


def test_large_components_are_whole_numbers():
    x, y = np.array([[2.0**60, 3.0]]), np.array([[2.0**40, 5.0], [1.0, 1.0]])
    got = hn.exact_scores(x, y, np.array([0, 0]), np.array([0, 1]), 2.0**100)
    assert got.tolist() == [hn.LARGEST, 2**60 + 3]


def _groups(draw, n, dim, label):
    centres = draw.normal(0, 1, (5, dim))
    which = draw.integers(0, 5, n)
    x = centres[which] + draw.normal(0, 0.3, (n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), label(i, k)) for i, (v, k) in enumerate(zip(x, which.tolist()))]


@pytest.mark.parametrize("at_once, block, keep", [(7, 16, 20), (2_048, 1_024, 200_000)])
def test_against_brute_force(llm_spark, monkeypatch, at_once, block, keep):
    for name, value in (("ANCHORS_AT_ONCE", at_once), ("BLOCK", block), ("KEEP", keep)):
        monkeypatch.setattr(hn, name, value)
    draw = np.random.default_rng(at_once)
    rows = _groups(draw, 500, 8, lambda i, k: (k + i % 3) % 4)
    rows += [(1000 + i, rows[3][1], i % 4) for i in range(250)]  # a third of all rows alike
    got = hn.hard_negatives(frame(llm_spark, rows).repartition(6), F.col("vec_id") % 25 == 0)
    assert collected(got) == brute(rows, lambda v: v % 25 == 0)


def test_odd_rows(llm_spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.4], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1], 2),
        (6, [inf, 1], 2), (7, [0.0, 0.0], 1), (8, [0.5, 0.4], 2), (8, [0.5, 0.4], 2), (None, [0.6, 0.4], 2), (None, [0.8, 0.4], 1),
        (9, [], 1), (100, [], 1), (101, [], 2), (10, [0.4, 0.3], None), (200, [1.0, 0.5], 1), (200, [1.0, 0.5], 1),
        (300, [1e30, 1.0], 1), (11, [1e30, 2.0], 1), (12, [5e29, 0.1], 3), (400, [1.0, 2.0, 3.0], 5), (401, [-1.0, -2.0, 0.0], 5),
        (402, [-0.5, 0.0, 0.0], 6),
    ]
    got = hn.hard_negatives(frame(llm_spark, rows).repartition(3), F.col("vec_id") % 100 == 0)
    assert collected(got) == brute(rows, lambda v: v % 100 == 0)
    none = frame(llm_spark, rows).limit(0)
    assert hn.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    assert hn.hard_negatives(frame(llm_spark, rows[3:7]), F.lit(True)).count() == 0


def test_filter_leaves_pairs_out(monkeypatch):
    """A third of all pairs have equal labels; in grouped vectors few are multiplied out."""
    import pandas as pd
    import pyarrow as pa

    draw = np.random.default_rng(1)
    rows = _groups(draw, 3000, 32, lambda i, k: i % 3)
    x = np.floor(256 * np.array([r[1] for r in rows]))
    direction, norm = hn.unit(x)
    angle = hn.angles_to(direction, hn.far_apart(direction, hn.REFERENCES))
    order = np.lexsort((angle.min(1), angle.argmin(1)))
    held = pd.DataFrame({"vec_id": order, "label": [rows[i][2] for i in order], "dim": 32, "wide": False, "norm": norm[order],
                         "q": [x[i].astype("<i4").tobytes() for i in order], "angles": [angle[i].tobytes() for i in order]})
    batch = pa.RecordBatch.from_pandas(held)
    anchors = hn.Anchors(held.iloc[::100].reset_index(drop=True), True, 5, 1)
    for a in range(30):
        anchors.reach(a, 0, int(0.9 * anchors.groups[32][2][a] ** 2), None)
    seen = []
    real = hn.exact_scores
    monkeypatch.setattr(hn, "exact_scores", lambda x, y, i, j, m: seen.append(len(i)) or real(x, y, i, j, m))
    list(anchors.search([batch]))
    assert sum(seen) < 0.1 * 30 * 3000


def test_query_equals_its_definition(llm_spark):
    from ownergraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10)
            for r in llm_spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert collected(QUERIES["op11_hard_negatives"](llm_spark, sf)) == brute(rows, lambda v: v % 100 == 0)
