"""Hard negatives of anchor vectors by angular triangle filtering.

Vectors are compared by the integer inner product of their floored components. Every
row is stored with its norm and its angles to a few reference directions, chosen far
apart from a bounded sample. Angles obey the triangle inequality: the angle between
an anchor and a row is at least the difference and at most the sum of their angles to
any reference (and at most the full turn less the sum). The cosines of these limits,
multiplied by both norms and widened for rounding, bound the score; only pairs whose
bounds overlap the scores asked for are multiplied out. Rows are stored by nearest
reference and angle to it, so that a block of rows has narrow angles and is left out
for an anchor as a whole where its bounds don't overlap.

Anchors meet all rows in blocks of ``ANCHORS_AT_ONCE``, which the tasks get as a
parameter (its size is the block's, however many anchors there are). For a block, one
row in ``SHARE`` (by hash) is searched first: the k-th best score found there is a
bound that the k-th best of all rows reaches, ties by vec_id included, so the tasks
that search all rows send back few rows, and none that could be lacking in the end.
Positives (the best rows of the anchor's label) set the windows of scores; the best
rows of other labels inside every window are the negatives.

Rows with a null label, a null vector, or a null or non-finite component take no part.
Vectors of different lengths don't meet; vectors of no components score 0. Null
vec_ids are no anchors, and come last in ties. Rows of the anchor's own vec_id are not
its positives; other repeated rows are rows of their own, as anchors too. Scores are
exact up to 2^62 in size and stop there. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownergraph.llm.common import stored
from ownergraph.session import scratch_path

REFERENCES = 8
SAMPLE = 2_048  # rows that the references are chosen from, at most
ANCHORS_AT_ONCE = 2_048
SHARE = 16
SHARE_ROWS = 8_192  # of that share, searched by one task
BLOCK = 1_024
PAIRS = 1 << 15  # multiplied out at once
KEEP = 200_000  # rows found that a task holds before it drops what can't be among the best
MARGIN = 1e-5  # radians; angles and cosines are worked out in single precision
LARGEST = 1 << 62

ROW = "vec_id long, label long, anchor boolean, dim int, wide boolean, q binary, norm double, cell int, near float, angles binary"
ROW_ARROW = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("dim", pa.int32()), ("wide", pa.bool_()),
     ("q", pa.binary()), ("norm", pa.float64()), ("cell", pa.int32()), ("near", pa.float32()), ("angles", pa.binary())]
)
FOUND = "a int, slot int, vec_id long, score long"
FOUND_ARROW = pa.schema([("a", pa.int32()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


# ---------------------------------------------------------------------------
# Stored rows
# ---------------------------------------------------------------------------


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, norms) of the rows; scaled first, so that squares stay finite."""
    if not x.shape[1]:
        return x, np.zeros(len(x))
    largest = np.abs(x).max(1)
    scaled = x / np.where(largest > 0, largest, 1)[:, None]
    size = np.sqrt((scaled * scaled).sum(1))
    return scaled / np.where(size > 0, size, 1)[:, None], largest * size


def angles_to(directions: np.ndarray, references: np.ndarray | None) -> np.ndarray:
    """Angles of directions to the references, in single precision. A zero vector
    has no direction; its norm makes every bound 0 whatever stands here."""
    if references is None:
        return np.zeros((len(directions), 0), "f4")
    return np.arccos(np.clip(directions @ references.T, -1, 1)).astype("f4")


def far_apart(directions: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` of the directions, each the farthest from those before it."""
    chosen = [0]
    near = directions @ directions[0]
    while len(chosen) < min(k, len(directions)):
        i = int(near.argmin())
        if near[i] > 0.9999:
            break
        chosen.append(i)
        near = np.maximum(near, directions @ directions[i])
    return directions[chosen]


def _whole(batch: pa.RecordBatch, scale: float):
    """(index of rows, floored components) per vector length, without the rows that
    take no part."""
    column = batch.column("embedding")
    sizes = np.array([-1 if s is None else s for s in column.value_lengths().to_pylist()])
    for dim in np.unique(sizes[sizes >= 0]):
        index = np.flatnonzero(sizes == dim)
        part = column.take(pa.array(index)).flatten()
        x = part.to_numpy(zero_copy_only=False).astype("f8").reshape(len(index), dim)
        ok = np.isfinite(x).all(1)  # a null component is not a number here
        yield index[ok], np.floor(scale * x[ok])


def _coded(scale: float, references: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            for index, q in _whole(b, scale):
                if not len(index):
                    continue
                n, dim = q.shape
                wide = bool(np.abs(q).max(initial=0) >= 1 << 31)
                direction, norm = unit(q)
                angle = angles_to(direction, references.get(dim))
                cell = angle.argmin(1) if angle.shape[1] else np.zeros(n, int)
                near = angle[np.arange(n), cell] if angle.shape[1] else np.zeros(n, "f4")
                raw = q.astype("<f8" if wide else "<i4")
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(take), b.column("label").take(take), b.column("anchor").take(take),
                     pa.array(np.full(n, dim), pa.int32()), pa.array([wide] * n, pa.bool_()),
                     pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(norm), pa.array(cell, pa.int32()),
                     pa.array(near, pa.float32()), pa.array([r.tobytes() for r in angle], pa.binary())],
                    schema=ROW_ARROW,
                )

    return run


def references_of(rows: DataFrame, scale: float, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Per vector length of the sample, reference directions."""
    some = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample)
    held = some.mapInArrow(_coded(scale, {}), ROW).select("dim", "wide", "q").toPandas()
    out = {}
    for dim, part in held.groupby("dim"):
        q = np.stack([np.frombuffer(r.q, "<f8" if r.wide else "<i4").astype("f8") for r in part.itertuples()])
        direction, norm = unit(q)
        if dim and (norm > 0).any():
            out[int(dim)] = far_apart(direction[norm > 0], REFERENCES)
    return out


# ---------------------------------------------------------------------------
# The search in a task
# ---------------------------------------------------------------------------


class Rows:
    """A block of stored rows of one vector length."""

    def __init__(self, vec_id, has_id, label, dim, wide, q, norm, angles) -> None:
        self.vec_id, self.has_id, self.label, self.norm = vec_id, has_id, label, norm
        self.q = np.frombuffer(b"".join(q), "<f8" if wide else "<i4").reshape(len(q), dim).astype("f8")
        self.angles = np.frombuffer(b"".join(angles), "<f4").reshape(len(q), -1)

    def __len__(self) -> int:
        return len(self.norm)


def blocks_of(batch: pa.RecordBatch):
    """(dim, rows) of at most ``BLOCK`` neighbouring rows of one length."""
    dims = batch.column("dim").to_numpy()
    wide = batch.column("wide").to_numpy(zero_copy_only=False).astype(bool)
    has_id = ~batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
    vec_id = batch.column("vec_id").fill_null(0).to_numpy()
    label, norm = batch.column("label").to_numpy(), batch.column("norm").to_numpy()
    q, angles = batch.column("q").to_pylist(), batch.column("angles").to_pylist()
    cuts = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (wide[1:] != wide[:-1])) + 1), len(dims)]
    for low, high in zip(cuts, cuts[1:]):
        for i in range(low, high, BLOCK):
            s = slice(i, min(i + BLOCK, high))
            yield int(dims[i]), Rows(vec_id[s], has_id[s], label[s], int(dims[i]), wide[i], q[s], norm[s], angles[s])


def score_bounds(angles_a, norm_a, angles_v, norm_v) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) possible scores of every anchor (rows) with every vector."""
    size = norm_a[:, None] * norm_v[None]
    least = np.zeros(size.shape, "f4")
    most = np.full(size.shape, np.pi, "f4")
    for r in range(angles_a.shape[1]):
        a, v = angles_a[:, r, None], angles_v[None, :, r]
        np.maximum(least, np.abs(a - v), out=least)
        total = a + v
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
    with np.errstate(invalid="ignore", over="ignore"):
        slack = size * MARGIN + 1
        high = size * np.cos(np.maximum(least - np.float32(MARGIN), 0)) + slack
        low = size * np.cos(np.minimum(most + np.float32(MARGIN), np.float32(np.pi))) - slack
    return low, high


def block_highest(angles_a, norm_a, rows: Rows) -> np.ndarray:
    """Per anchor a score that no row of the block exceeds."""
    gap = np.zeros(len(norm_a), "f4")
    if len(rows) and angles_a.shape[1]:
        low, high = rows.angles.min(0), rows.angles.max(0)
        gap = np.maximum(np.maximum(angles_a - high, low - angles_a).max(1), 0)
    cos = np.cos(np.maximum(gap - np.float32(MARGIN), 0))
    with np.errstate(invalid="ignore", over="ignore"):
        size = norm_a * np.where(cos > 0, rows.norm.max(initial=0), rows.norm.min(initial=np.inf))
        return size * cos + size * MARGIN + 1


def exact_scores(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products of the rows x[i] and y[j]. Below 2^52 every partial
    sum is a whole number that double precision holds, in any order."""
    if not largest < 1 << 52:
        whole = [sum(int(a) * int(b) for a, b in zip(x[m], y[n])) for m, n in zip(i, j)]
        return np.array([max(-LARGEST, min(LARGEST, w)) for w in whole], "i8").reshape(len(i))
    if len(i) * 8 > len(x) * len(y):  # most pairs are asked for
        return (x @ y.T)[i, j].astype("i8")
    out = np.empty(len(i), "i8")
    for k in range(0, len(i), PAIRS):
        s = slice(k, k + PAIRS)
        out[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]])
    return out


class Found:
    """Rows found per (anchor, slot), cut back to the ``k`` best of each."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.n = k, [], 0

    def add(self, a, slot, vec_id, has_id, score) -> None:
        if len(a):
            self.parts.append((a, slot, vec_id, has_id, score))
            self.n += len(a)
            if self.n > KEEP:
                self.parts = [self.best()]
                self.n = len(self.parts[0][0])

    def best(self) -> tuple:
        a, slot, vec_id, has_id, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((vec_id, ~has_id, -score, slot, a))
        a, slot = a[order], slot[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (slot[1:] != slot[:-1])]
        place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        keep = place < self.k
        order = order[keep]
        return a[keep], slot[keep], vec_id[order], has_id[order], score[order]


class Anchors:
    """A block of anchors and what is asked for them: per slot a window of scores
    and, from the share searched first, the score and vec_id to reach."""

    def __init__(self, held, same_label: bool, k: int, slots: int) -> None:
        self.same, self.k = same_label, k
        self.vec_id, self.label = held["vec_id"].to_numpy("i8"), held["label"].to_numpy("i8")
        n = len(held)
        self.low = np.full((n, slots), -LARGEST, "i8")
        self.high = np.full((n, slots), LARGEST if same_label else -LARGEST - 1, "i8")
        self.tie = np.full((n, slots), np.iinfo("i8").max)
        self.any_tie = np.ones((n, slots), bool)  # rows of any vec_id are wanted at ``low``
        self.groups = {}
        for dim, part in held.reset_index(drop=True).groupby("dim"):
            q = np.stack([np.frombuffer(r.q, "<f8" if r.wide else "<i4").astype("f8") for r in part.itertuples()])
            angles = np.stack([np.frombuffer(x, "<f4") for x in part["angles"]])
            self.groups[int(dim)] = (part.index.to_numpy(), q, part["norm"].to_numpy("f8"), angles)

    def window(self, a: int, slot: int, low: int, high: int) -> None:
        self.low[a, slot], self.high[a, slot] = max(low, -LARGEST), min(high, LARGEST)

    def reach(self, a: int, slot: int, score: int, vec_id: int | None) -> None:
        self.low[a, slot] = score
        self.any_tie[a, slot] = vec_id is None
        self.tie[a, slot] = 0 if vec_id is None else vec_id

    def search(self, batches):
        found = Found(self.k)
        # What is asked for at all; scores stop at LARGEST, their bounds don't.
        at_most, at_least = self.high.max(1), np.where(self.high >= self.low, self.low, LARGEST).min(1)
        at_most = np.where(at_most >= LARGEST, np.inf, at_most.astype("f8"))
        at_least = np.where(at_least <= -LARGEST, -np.inf, at_least.astype("f8"))
        asked = (self.high >= self.low).any(1)
        for batch in batches:
            for dim, rows in blocks_of(batch):
                if dim not in self.groups:
                    continue
                index, q, norm, angles = self.groups[dim]
                here = np.flatnonzero(asked[index] & ~(block_highest(angles, norm, rows) < at_least[index]))
                for i in range(0, len(here), BLOCK):
                    some = here[i : i + BLOCK]
                    self._meet(index[some], q[some], norm[some], angles[some], rows, at_least, at_most, found)
        if found.parts:
            a, slot, vec_id, has_id, score = found.best()
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int32()), pa.array(slot, pa.int32()), pa.array(vec_id, pa.int64(), mask=~has_id), pa.array(score, pa.int64())],
                schema=FOUND_ARROW,
            )

    def _meet(self, index, q, norm, angles, rows, at_least, at_most, found) -> None:
        low, high = score_bounds(angles, norm, rows.angles, rows.norm)
        with np.errstate(invalid="ignore"):
            meet = ~(high < at_least[index][:, None]) & ~(low > at_most[index][:, None])
        equal = self.label[index][:, None] == rows.label[None]
        if self.same:
            meet &= equal & ~(rows.has_id[None] & (self.vec_id[index][:, None] == rows.vec_id[None]))
        else:
            meet &= ~equal
        i, j = np.nonzero(meet)
        if not len(i):
            return
        score = exact_scores(q, rows.q, i, j, float(norm.max() * rows.norm.max()))
        a = index[i]
        for slot in range(self.low.shape[1]):
            least = self.low[a, slot]
            good = (score >= least) & (score <= self.high[a, slot])
            tie = (score == least) & ~self.any_tie[a, slot]
            good &= ~tie | (rows.has_id[j] & (rows.vec_id[j] <= self.tie[a, slot]))
            k = np.flatnonzero(good)
            found.add(a[k], np.full(len(k), slot), rows.vec_id[j[k]], rows.has_id[j[k]], score[k])


# ---------------------------------------------------------------------------
# Blocks of anchors against all rows
# ---------------------------------------------------------------------------


def _ranked(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """``FOUND`` with ``rank`` from 1, up to the k-th."""
    best = Window.partitionBy("a", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    found = rows.mapInArrow(anchors.search, FOUND)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= anchors.k)


def _searched(share: DataFrame, rows: DataFrame, anchors: Anchors) -> DataFrame:
    """The best of all rows: what the share gives first is a bound to reach."""
    for r in _ranked(share, anchors).where(F.col("rank") == anchors.k).collect():  # one per anchor and slot
        anchors.reach(r["a"], r["slot"], r["score"], r["vec_id"])
    return _ranked(rows, anchors)


def _anchor_blocks(rows: DataFrame):
    """Pandas frames of at most ``ANCHORS_AT_ONCE`` anchors, one at a time."""
    held = stored(rows.where("anchor").withColumn("place", F.monotonically_increasing_id()), "anchors")
    per_part = held.groupBy(F.shiftright("place", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    starts, seen = [], 0  # the place at which every block starts
    for r in per_part:  # two numbers a partition
        while len(starts) * ANCHORS_AT_ONCE < seen + r["n"]:
            starts.append((r["p"] << 33) + len(starts) * ANCHORS_AT_ONCE - seen)
        seen += r["n"]
    for low, high in zip(starts, [*starts[1:], np.iinfo("i8").max]):
        yield held.where((F.col("place") >= int(low)) & (F.col("place") < int(high))).orderBy("place").toPandas()


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """``RESULT`` rows for the rows of ``vectors(vec_id, label, embedding)`` that
    ``anchor`` marks: for each of an anchor's first ``positives`` rows of its label,
    the first ``negatives`` rows of other labels that score from ``low`` to ``high``
    percent of the positive's score."""
    spark = vectors.sparkSession
    taking_part = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("anchor"),
    )
    coded = taking_part.mapInArrow(_coded(scale, references_of(taking_part, scale)), ROW)
    keys = ["dim", "wide", "cell", "near", "vec_id"]
    rows = stored(coded.repartitionByRange(*keys).sortWithinPartitions(*keys), "angles")
    share = rows.where(F.pmod(F.xxhash64("vec_id", "q"), F.lit(SHARE)) == 0)
    tasks = max(1, -(-share.count() // SHARE_ROWS))
    share = stored(share.coalesce(tasks), "angles-share")
    folder = scratch_path(spark, "hard-negatives")
    empty = True
    for number, held in enumerate(_anchor_blocks(rows)):
        asking = Anchors(held, True, positives, 1)
        best = _searched(share, rows, asking).collect()  # ``positives`` rows an anchor of the block
        answers = Anchors(held, False, negatives, positives)
        pairs = []
        for r in best:
            a, slot, score = r["a"], r["rank"] - 1, r["score"]
            answers.window(a, slot, -(-low * score // 100), high * score // 100)
            pairs.append((a, slot, int(held["vec_id"][a]), r["vec_id"], score))
        named = spark.createDataFrame(pairs, "a int, slot int, anchor_id long, positive_id long, positive_score long")
        found = _searched(share, rows, answers)
        out = found.join(F.broadcast(named), ["a", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        out.write.parquet(f"{folder}/block={number}")
        empty = False
    if empty:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*[f"{folder}/block={n}" for n in range(number + 1)])
