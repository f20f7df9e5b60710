"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: lower case, everything but letters and
digits to single spaces. An item of m characters may differ from a passage of a
document by k = floor(``ERROR_RATE`` m) insertions, deletions and replacements. It
is split into k + 1 pieces; k errors can't touch all of them, so a passage holds
at least one piece unchanged. An automaton finds all exact pieces in one go over
the text. A hit is verified with Myers' bit-parallel distance, first on the two
neighbouring pieces with one error, then on four with three and so on up to the
whole item: of n pieces with at most n - 1 errors one half has fewer errors than
pieces, so a true passage always has a hit that passes every step.

Every document is worked on whole, in one task, with all items of a block; items
come in blocks of at most ``BLOCK_CHARS`` characters (the block is what is sent to
the executors) and each block is a pass over the documents.

Null and empty texts, and items without a letter or digit, match nothing. Items
that repeat are reported each by its own id; a null item_id is reported as null.
Short items (k = 0) must occur exactly. Empty tables match nothing. All other
columns of the documents stay.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ownergraph.llm.common import free_name, stored

ERROR_RATE = 0.1
BLOCK_CHARS = 4 << 20
NOT_WORD = re.compile(r"[\W_]+")
HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def normalised(text: str | None) -> str:
    return NOT_WORD.sub(" ", (text or "").lower()).strip()


class Pattern:
    """Myers' bit-parallel matching of one pattern, any length."""

    def __init__(self, pattern: str) -> None:
        self.size = len(pattern)
        self.at: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.at[c] = self.at.get(c, 0) | 1 << i
        self.full = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)

    def best(self, text: str) -> tuple[int, int]:
        """(least distance to a part of ``text``, end of the first such part)."""
        plus, minus, score = self.full, 0, self.size
        least, end, get, full, top = score, 0, self.at.get, self.full, self.top
        for i, c in enumerate(text, 1):
            eq = get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < least:
                    least, end = score, i
            up = up << 1
            minus = up & vertical & full
            plus = ((down << 1) | (full & ~(vertical | up))) & full
        return least, end


class Item:
    """A test item with the tree of its pieces; steps are built when needed."""

    def __init__(self, item_id: int | None, text: str, rate: float) -> None:
        self.item_id, self.text, self.size = item_id, text, len(text)
        self.errors = int(rate * len(text) + 1e-9)
        n = self.errors + 1
        self.cuts = [i * self.size // n for i in range(n + 1)]
        self.patterns: dict[tuple[int, int], Pattern] = {}

    def pattern(self, a: int, b: int) -> Pattern:
        """Of pieces a to b - 1."""
        if (a, b) not in self.patterns:
            self.patterns[a, b] = Pattern(self.text[self.cuts[a] : self.cuts[b]])
        return self.patterns[a, b]

    def verify(self, text: str, piece: int, start: int) -> tuple[int, int] | None:
        """(distance, end) of the passage around the piece found at ``start``, or
        None if a step fails."""
        n = self.errors + 1
        # From the whole item down to the piece: halves of piece ranges.
        ranges, a, b = [], 0, n
        while b - a > 1:
            ranges.append((a, b))
            mid = (a + b) // 2
            a, b = (a, mid) if piece < mid else (mid, b)
        zero = start - self.cuts[piece]  # where the item would begin
        found = (0, start + self.cuts[piece + 1] - self.cuts[piece])
        for a, b in reversed(ranges):
            slack = b - a - 1
            low = max(0, zero + self.cuts[a] - slack)
            least, end = self.pattern(a, b).best(text[low : zero + self.cuts[b] + slack])
            if least > slack:
                return None
            found = (least, low + end)
        return found


class Matcher:
    def __init__(self, items: tuple[tuple[int | None, str], ...], rate: float) -> None:
        self.items = [Item(i, t, rate) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for p in range(item.errors + 1):
                pieces.setdefault(item.text[item.cuts[p] : item.cuts[p + 1]], []).append((k, p))
        self.find = ahocorasick.Automaton()
        for word, where in pieces.items():
            self.find.add_word(word, (len(word), where))
        if pieces:
            self.find.make_automaton()
        self.any = bool(pieces)

    def match(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, least distance, end in the normalised text) of every item
        that the text holds."""
        text = normalised(text)
        best: dict[int, tuple[int, int]] = {}
        if self.any and text:
            for end, (size, where) in self.find.iter(text):
                for k, p in where:
                    if best.get(k, (1,))[0] > 0 and (got := self.items[k].verify(text, p, end + 1 - size)):
                        best[k] = min(best.get(k, got), got)
        return [(self.items[k].item_id, d, e) for k, (d, e) in sorted(best.items())]


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int | None, str], ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS):
    """Normalised items (item_id, text) in blocks; rows stream to the driver one
    partition at a time."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        if text := normalised(r["text"]):
            block.append((r["item_id"], text))
            size += len(text)
            if size >= block_chars:
                yield tuple(block)
                block, size = [], 0
    if block:
        yield tuple(block)


def hits(text: Column, block: tuple[tuple[int | None, str], ...], rate: float) -> Column:
    """Array column of (item_id, distance, end) for the items of a block."""

    @F.pandas_udf(HIT)
    def find(texts: pd.Series) -> pd.Series:
        match = _matcher(block, rate).match
        return pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in match(t)] for t in texts])

    return find(F.coalesce(text, F.lit("")))


def with_hits(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, name: str = "benchmark_hits") -> DataFrame:
    """``docs`` plus an array column of all items found in ``text``. One block of
    items needs no shuffle; of several, a block's hits are written before the block
    after the next is read, so no plan and no process holds more than two."""
    blocks = item_blocks(items)
    block, ahead = next(blocks, ()), next(blocks, None)
    if ahead is None:
        return docs.withColumn(name, hits(F.col("text"), block, rate) if block else F.array().cast(HIT))
    row, parts = free_name(docs, "row"), free_name(docs, "parts")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "benchmark-docs")
    found, i = None, 0
    while block is not None:
        own = numbered.select(F.col(row).alias("at"), F.lit(i).alias("i"), hits(F.col("text"), block, rate).alias("h")).where(F.size("h") > 0)
        own = stored(own, "benchmark-hits")
        found = own if found is None else found.unionByName(own)
        block, ahead, i = ahead, next(blocks, None), i + 1
    # A document's hits together, in the order of the blocks.
    by_row = found.groupBy(F.col("at").alias(row)).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias(parts))
    all_hits = F.coalesce(F.flatten(F.transform(parts, lambda x: x["h"])), F.array().cast(HIT))
    return numbered.join(by_row, row, "left").withColumn(name, all_hits).drop(row, parts)


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item, columns unchanged."""
    found = free_name(docs, "hits")
    return with_hits(docs, items, rate, found).where(F.size(found) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def contamination(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_ids, least_distance."""
    return with_hits(docs.select("doc_id", "text"), items, rate, "__hits").select(
        "doc_id",
        (F.size("__hits") > 0).alias("contaminated"),
        F.size("__hits").cast("long").alias("n_items"),
        F.array_sort(F.transform("__hits", lambda h: h["item_id"])).alias("item_ids"),
        F.array_min(F.transform("__hits", lambda h: h["distance"])).alias("least_distance"),
    )
