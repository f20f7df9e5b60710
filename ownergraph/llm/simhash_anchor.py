"""SimHash near-duplicates by anchor points.

Anchors are the words of a covering code: every point of the space lies within
the covering radius R of one. Two fingerprints that differ in at most t bits have
a point in the middle, within ceil(t/2) of either; an anchor within R of that
point is within R + ceil(t/2) of both. So each fingerprint is replicated to every
anchor within the covering radius plus half the threshold, and fingerprints are
compared per anchor, in all 64 bits.

The code is two blocks of the perfect [23, 12] Golay code (R = 3) on bits 0-22 and
23-45: 2^24 anchors. As a block's code is perfect, what counts is the sum over
the blocks of the distance beyond 3, which must not exceed ceil(t/2): 61 anchors a
fingerprint on average for t = 4, and no cap on them. Rows with equal fingerprints
are collapsed before. An anchor's rows are compared in vector form when few and by
a search over the not yet reached ones when many, and a task emits a spanning
forest of its links, never all pairs. Anchors that may hold over ``BLOCK`` rows are
dealt out as pairs of blocks, so no task gets an unbounded group.

Null and empty texts have fingerprint zero and link like others; rows with the
same text have the same fingerprint; null doc_ids take part with their
fingerprint but never name a component (a group of only null ids has a null
one); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ownergraph.llm.common import stored
from ownergraph.llm.graph import Forest, components

BITS, CODE_BITS, RADIUS = 23, 12, 3
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SLOTS = 1 << 16  # anchors are counted in so many hashed slots
BLOCK = 50_000  # rows of an anchor compared in one go
FEW = 16  # rows of an anchor compared pair by pair


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash: A-Z lower-cased, words between ASCII white
    space, shingles of ``shingle`` words with repeats, XXH64 with seed 42; a bit
    is set if it is set in over half of the hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    tops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, tops)], dtype="<u8")
    ones = np.zeros(64, "int64")
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """Column of fingerprints as signed 64-bit integers."""

    @F.pandas_udf(T.LongType())
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype="<u8").view("<i8"))

    return make(F.coalesce(text, F.lit("")))


@lru_cache(maxsize=4)
def _code(slack: int):
    """(words, syndrome tables, leader per syndrome, anchors near each leader).

    Anchors are listed per coset leader e (an error pattern of weight <= 3): all
    code words within RADIUS + slack of e, sorted by their distance beyond
    RADIUS, as flat arrays with a start per syndrome and beyond-distance."""
    check = BITS - CODE_BITS

    def remainder(x: int) -> int:
        for i in range(BITS - 1, check - 1, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - check)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)])
    high = np.array([remainder(x << 12) for x in range(1 << (BITS - 12))])
    # The 2^12 words and 2^11 leaders are listed themselves: a table of all 2^23
    # points would take each worker some 250 MB.
    words = np.zeros(1, "int64")
    for i in range(CODE_BITS):
        words = np.concatenate([words, words ^ (GENERATOR << i)])
    words.sort()
    light = np.array([sum(1 << i for i in e) for w in range(RADIUS + 1) for e in combinations(range(BITS), w)], "int64")
    leader = np.zeros(1 << check, "int64")
    leader[low[light & 4095] ^ high[light >> 12]] = light  # a perfect code: one leader per syndrome
    near, starts = [], np.zeros((1 << check, slack + 2), "int64")
    at = 0
    words = words[np.bitwise_count(words) <= 2 * RADIUS + slack]
    for s, e in enumerate(leader):
        beyond = np.maximum(np.bitwise_count(words ^ e).astype("int64") - RADIUS, 0)
        for x in range(slack + 1):
            starts[s, x] = at
            chosen = words[beyond == x]
            near.append(chosen)
            at += len(chosen)
        starts[s, slack + 1] = at
    return low, high, leader, np.concatenate(near), starts


def anchors(fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs: every anchor whose distances beyond the covering
    radius in the two blocks sum up to at most ``slack``."""
    low, high, leader, near, starts = _code(slack)
    blocks = []
    for shift in (0, BITS):
        x = (fps.view("<u8") >> np.uint64(shift)).astype("int64") & ((1 << BITS) - 1)
        s = low[x & 4095] ^ high[x >> 12]
        blocks.append((x ^ leader[s], s))
    rows, keys = [], []
    for first in range(slack + 1):
        (word1, s1), (word2, s2) = blocks
        n1 = starts[s1, first + 1] - starts[s1, first]
        n2 = starts[s2, slack - first + 1] - starts[s2, 0]  # the second block may use what is left
        n = n1 * n2
        row = np.repeat(np.arange(len(fps)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        one = word1[row] ^ near[starts[s1[row], first] + k // n2[row]]
        two = word2[row] ^ near[starts[s2[row], 0] + k % n2[row]]
        rows.append(row)
        keys.append(one << BITS | two)
    return np.concatenate(rows), np.concatenate(keys)


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype("<u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("int64") % SLOTS


def _reach(fps: np.ndarray, bits: int):
    """Links of a spanning forest of the rows: a search that compares each
    reached row with the rows not reached yet."""
    left = fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = np.bitwise_count((left ^ x).view("<u8")) <= bits
            if hit.any():
                found = left[hit]
                left = left[~hit]
                front.extend(found)
                for y in found:
                    yield int(x), int(y)


def _compare(keys: np.ndarray, fps: np.ndarray, bits: int, forest: Forest):
    """Links within equal keys (sorted) that the forest needs."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([edge, [len(keys)]]))
    small = np.repeat(size <= FEW, size)
    last = np.repeat(edge + size, size)
    at = np.flatnonzero(small)
    for d in range(1, FEW):
        at = at[at + d < last[at]]
        if not len(at):
            break
        hit = at[np.bitwise_count((fps[at] ^ fps[at + d]).view("<u8")) <= bits]
        if len(hit):
            for a, b in np.unique(np.stack([fps[hit], fps[hit + d]], 1), axis=0).tolist():
                if forest.join(a, b):
                    yield a, b
    for i in np.flatnonzero(size > FEW):
        for a, b in _reach(np.unique(fps[edge[i] : edge[i] + size[i]]), bits):
            if forest.join(a, b):
                yield a, b


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints ``fps(fp)`` whose
    components are those of all pairs with at most ``bits`` differing bits."""
    spark = fps.sparkSession
    slack = -(-bits // 2)

    def count(batches):
        total = np.zeros(SLOTS, "int64")
        for batch in batches:
            _, keys = anchors(batch.column("fp").to_numpy(), slack)
            total += np.bincount(_slot(keys), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at), "n": pa.array(total[at])})

    load = fps.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    mean = (load.agg(F.sum("n")).first()[0] or 0) // SLOTS
    # At most SLOTS rows: slots in which one anchor may hold over BLOCK rows.
    hot = {r.slot: -(-r.n // BLOCK) for r in load.where(F.col("n") > 4 * mean + BLOCK).collect()}

    def replicate(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                fp = batch.column("fp").to_numpy()[i : i + 1000]
                row, keys = anchors(fp, slack)
                own, part = fp[row], np.zeros(len(row), "int64")
                if hot:
                    n = np.array([hot.get(s, 1) for s in _slot(keys).tolist()])
                    k = np.repeat(np.arange(len(n)), n)
                    other = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                    n, own, keys = n[k], own[k], keys[k]
                    mine = ((own.view("<u8") * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype("int64") % n
                    part = np.minimum(mine, other) << 32 | np.maximum(mine, other)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(keys), "part": pa.array(part), "fp": pa.array(own)})

    def compare(batches):
        forest, held = Forest(), None
        out: list[tuple[int, int]] = []

        def batch_of(pairs):
            a, b = zip(*pairs)
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        def step(keys, parts, fps):
            # One key per (anchor, part) run; the order is given.
            new = np.concatenate([[False], (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])])
            out.extend(_compare(np.cumsum(new), fps, bits, forest))

        rows, size = [], 0
        for batch in batches:
            rows.append([batch.column(c).to_numpy() for c in ("anchor", "part", "fp")])
            size += batch.num_rows
            if size < 200_000:
                continue
            k, p, f = (np.concatenate(x) for x in zip(*rows))
            # The last run may go on in the next batch: hold it back.
            cut = len(k) - 1
            while cut > 0 and k[cut - 1] == k[-1] and p[cut - 1] == p[-1]:
                cut -= 1
            if cut:
                step(k[:cut], p[:cut], f[:cut])
            rows, size = [[k[cut:], p[cut:], f[cut:]]], len(k) - cut
            if out:
                yield batch_of(out)
                out = []
        if size:
            step(*(np.concatenate(x) for x in zip(*rows)))
        if out:
            yield batch_of(out)

    return (
        fps.mapInArrow(replicate, "anchor long, part long, fp long")
        .repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part")
        .mapInArrow(compare, "a long, b long")
    )


def groups(docs: DataFrame, shingle: int = 4, bits: int = 4, row: Column | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, fp, component_id, row, stays.

    ``row`` numbers the rows (by default ``monotonically_increasing_id``); of every
    group the row with the smallest doc_id (known ids first, then the smallest row)
    stays."""
    own = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            fingerprints(F.col("text"), shingle).alias("fp"),
            (F.monotonically_increasing_id() if row is None else row).alias("row"),
        ),
        "fingerprints",
    )
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    least = stored(own.groupBy("fp").agg(F.min(first).alias("first")), "fingerprint-groups")
    linked = components(links(least.select("fp"), bits))
    # First document per component, then per fingerprint; each join reads two
    # written tables, so a hot component or fingerprint can be split.
    part = stored(
        least.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first", F.coalesce("component", "fp").alias("component")
        ),
        "fingerprint-components",
    )
    named = stored(part.groupBy("component").agg(F.min("first").alias("best")), "component-names")
    by_fp = stored(
        part.join(named, "component").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best_row")),
        "fingerprint-names",
    )
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id", "row", (F.col("row") == F.col("best_row")).alias("stays"))


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest
    doc_id reachable by links, itself included)."""
    return groups(docs, shingle, bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One document of every group, columns unchanged. The rows are numbered once
    and written with their numbers: another read may split the files elsewhere. A
    row travels as one struct, so no column of it can clash with the number. The last
    join is by sorted shuffles at every size, as the list of rows grows with them."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    numbered = stored(docs.select(whole, F.monotonically_increasing_id().alias("row")), "fingerprint-docs")
    texts = numbered.select("whole.doc_id", "whole.text", F.col("row").alias("at"))
    stay = stored(groups(texts, shingle, bits, F.col("at")).where("stays").select("row"), "fingerprint-stay")
    kept = numbered.join(stay.hint("merge"), "row", "left_semi")
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
