"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into the tokenizer's pre-tokens; a pre-token's bytes are the
initial symbols, kept in a linked list; a heap holds the rank of every adjacent
pair. The pair of lowest rank (leftmost first) is popped and merged until the
heap is empty. The count is the number of initial symbols minus the merges; no
token identifiers are made.

Null and empty texts count zero tokens. A text's length is not limited: words
are counted one by one and their counts are remembered per Python worker in a
table of bounded size.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBER = 500_000  # words remembered per worker, in each of two tables


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable Latin-1 bytes stand
    for themselves, the others, in order, for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMerger:
    """Counts tokens with the merge list of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        latin = lambda s: "".join(chr(letters[c]) for c in s)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(latin(a), latin(b)): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.known: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one pre-token."""
        sym = list(word.encode("utf-8", "surrogatepass").decode("latin-1"))
        n = len(sym)
        if n < 2:
            return n
        rank = self.rank
        heap = [(r, i) for i, pair in enumerate(zip(sym, sym[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not sym[i] or j >= n or rank.get((sym[i], sym[j])) != r:
                continue  # one of the two has been merged meanwhile
            sym[i] += sym[j]
            sym[j] = ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def _chunk(self, chunk: str) -> int:
        """Tokens of a piece of text that no pre-token crosses."""
        total, known = 0, self.known
        for word in self.find(chunk):
            if (n := known.get(word)) is None:
                if len(known) >= REMEMBER:
                    known.clear()
                n = self.merged(word)
                if len(word) < 64:
                    known[word] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        """A space between two visible characters always begins a pre-token,
        and a line break between two visible characters is one by itself, so
        the text falls into pieces there; other white space is left in place."""
        total, chunks = 0, self.chunks
        lines = text.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            lines = [text]
        for line in lines:
            words = line.split(" ")
            if len(words) > 1:
                if "\n" in line or any(not w or w[0].isspace() or w[-1].isspace() for w in words):
                    words = regex.split(r"(?<=\S) (?=\S)", line)
                first, rest = words[0], words[1:]
            else:
                first, rest = line, ()
            total += self._chunk(first)
            for w in rest:
                if (n := chunks.get(w)) is None:
                    if len(chunks) >= REMEMBER:
                        chunks.clear()
                    n = self._chunk(" " + w)
                    if len(w) < 64:
                        chunks[w] = n
                total += n
        return total + len(lines) - 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.split_special or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split_special.split(text)  # a special string is one token by itself
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


@lru_cache(maxsize=4)
def _merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counter(path: str):
    """Column function: text -> number of tokens under the tokenizer file
    ``path``, which every executor must be able to open at that place."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        merger = _merger(path)
        return pd.Series(np.fromiter((merger.count(t) for t in texts), dtype="int64", count=len(texts)))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: doc_id, n_bytes, n_tokens,
    over_limit. No shuffle; repeated rows give repeated results; other columns
    are not read."""
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counter(path)(F.coalesce("text", F.lit(""))).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
