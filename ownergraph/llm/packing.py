"""Packing of documents into fixed-length training sequences.

A document's ids (end id included) are cut into full sequences and a remainder;
a remainder over half a sequence is cut once more, into a half and the rest.
Full pieces are sequences by themselves. The other pieces are dealt at random
(by a hash) into groups of about ``GROUP_PIECES``, and each group is packed by
first-fit decreasing: a tournament tree over the sequences' free room finds the
leftmost one that fits. As no piece is longer than half a sequence, first-fit
decreasing leaves a few unfilled sequences per group, whatever the group's size.

Null and empty texts are documents of the end id alone; repeated rows are packed
each for itself; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.llm.common import stored
from ownergraph.llm.word_ids import word_ids

SEQUENCE = 2048
GROUP_PIECES = 20_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class RoomTree:
    """Tournament tree over the free room of sequences 0, 1, 2, ...: every inner
    node holds the larger room of its two children. Unused sequences have full
    room, so one that fits always exists."""

    def __init__(self, sequences: int, room: int) -> None:
        self.size = 1 << max(0, (max(1, sequences) - 1).bit_length())
        self.room = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        """The leftmost sequence with room for ``need``."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < need:
                at += 1
        return at - self.size

    def take(self, sequence: int, need: int) -> int:
        """Use the room; returns the offset at which it begins, from the end."""
        room, at = self.room, sequence + self.size
        left = room[at]
        room[at] = left - need
        at //= 2
        while at and room[at] != (top := max(room[2 * at], room[2 * at + 1])):
            room[at] = top
            at //= 2
        return left


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece."""
    tree = RoomTree(len(lengths), room)
    sequence, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    order = np.argsort(-lengths, kind="stable").tolist()
    for i, need in zip(order, lengths[order].tolist()):
        at = tree.first(need)
        sequence[i], offset[i] = at, room - tree.take(at, need)
    return sequence, offset


def cuts(tokens: int, room: int) -> list[int]:
    """Lengths of a document's pieces."""
    full, rest = divmod(tokens, room)
    out = [room] * full
    if rest > room // 2:
        out.append(room // 2)
        rest -= room // 2
    return out + [rest] * (rest > 0)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int = SEQUENCE) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``; no shuffle."""

    def cut(batches):
        words = word_ids(tokenizer)
        end, size = words.pack([end_id]), words.dtype.itemsize
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, raw in enumerate(words.encode(batch.column("text").to_pylist())):
                ids = np.frombuffer(raw + end, words.dtype).astype("<u4").tobytes()
                n, at = len(raw) // size + 1, 0
                for k in cuts(n, room):
                    row.append(i)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + k)]))
                    total.append(n)
                    at += k
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                    **{k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))},
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int, room: int = SEQUENCE) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. The pieces are written first, so that ids are made once only."""
    cut = stored(pieces(docs, tokenizer, end_id, room), "pieces").withColumn(
        "__row", F.monotonically_increasing_id()
    )
    groups = max(1, -(-cut.where(F.col("length") < room).count() // GROUP_PIECES))
    out_schema = PIECE_SCHEMA + ", sequence_id long, offset long"

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("__row", "ascending")])
        sequence, offset = first_fit_decreasing(group.column("length").to_numpy(), room)
        base = int(group.column("__group")[0].as_py()) << 32
        return group.drop_columns(["__row", "__group"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    loose = (
        cut.where(F.col("length") < room)
        .withColumn("__group", F.pmod(F.xxhash64("__row", "doc_id"), F.lit(groups)))
        .groupBy("__group")
        .applyInArrow(fit, out_schema)
    )
    full = cut.where(F.col("length") >= room).select(
        *[c.split()[0] for c in PIECE_SCHEMA.split(", ")],
        (F.lit(1 << 62) + F.col("__row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return full.unionByName(loose)
