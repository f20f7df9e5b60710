"""Prefix trie of conversations by union-find over sorted neighbours.

Every turn (role, text) is known by 128 bits of its SHA-256, a conversation by the
row of these digests; equal conversations are collapsed and the different ones
sorted, so that conversations with a common beginning stand together. The number of
turns that two neighbours share is the label of the edge between them. A task takes
its edges in descending order of that depth and joins the components of their ends by
union-find: the component that a merge makes is a branching node at that depth (or
the shorter conversation itself, where it ends there). Between a node and the
branching node above it lie the nodes of a chain, which have the same members.

Sorted rows are dealt to tasks by ranges and taken in blocks there, so memory is
bounded by a block. A block knows how many turns its first and last conversation
share with their neighbours outside: nodes up to these depths reach over its
boundary. Of such a node a block gives its own share (members, new children, leaves,
saved tokens), and the shares of all blocks are added by the digest of the node's
turns; only these boundary nodes are merged, all others are whole in their block.
What a node saves is counted per block as members times length, less the length once
in the block where the node appears first, so the shares add up.

The conv_ids that end at a node are hashed in ascending order. They are dealt by
range and put together there as text of at most ``IDS_PER_PIECE`` ids; the pieces of
a conversation follow each other through one running hash, never all in memory.

A conversation's turns are ordered by turn (null first), then role, then the text's
digest; null role or text is empty. Rows without a conv_id take no part; repeated
rows are turns of their own. A conversation, like a text, is one row in a task. The
trie of no conversations has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.llm.common import stored
from ownergraph.session import materialize

DIGEST = 16  # bytes of a turn's digest
RANGE_BYTES = 512  # of a conversation's digests decide which task it goes to
BLOCK_ROWS, BLOCK_TURNS = 20_000, 400_000
IDS_PER_PIECE = 10_000
SALTS = 16  # a boundary node with very many children is joined in so many parts
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = (
    "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, turn_digest string"
)
NODE_ARROW = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
     ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
     ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("turn_digest", pa.string())]
)


# ---------------------------------------------------------------------------
# Conversations as rows of digests
# ---------------------------------------------------------------------------


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: per conversation the turns in order, each with its
    digest ``h`` (hex) and its text's code points ``n``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        F.substring(F.sha2(marked.cast("binary"), 256), 1, 2 * DIGEST).alias("h"),
        F.char_length(text).alias("n"),
    )
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    in_order = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(
        F.transform(in_order, lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n"))).alias("turns")
    )


def with_shared_openings(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations with the opening of another: conversation c takes the first h
    turns of c - c % every in place of its own first h, h = crc32(c) % most. An
    opening is copied to fewer than 2 * ``every`` conversations."""
    own = sequences.withColumn("__from", F.col("conv_id") - F.col("conv_id") % every).withColumn(
        "__h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    )
    heads = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("__head"), F.slice("turns", 1, most).alias("__opening")
    )
    # A sequence's size is at least 0, as slice() wants it.
    rest = F.slice("turns", F.col("__h") + 1, F.size("turns"))
    opening = F.when(F.col("__opening").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("__opening", F.lit(1), F.col("__h")))
    joined = own.join(heads, F.col("__from") == F.col("__head"), "left")
    return joined.select("conv_id", F.concat(opening, rest).alias("turns"))


# ---------------------------------------------------------------------------
# Union-find in a block
# ---------------------------------------------------------------------------


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two rows of digests share from the start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high - 1:  # the first ``low`` are shared, not all ``high``
        middle = (low + high) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle
    return low


def _prefix_digests(key: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` turns of ``key``."""
    running = hashlib.sha256()
    out = [running.digest()[:DIGEST]]
    for t in range(depth):
        running.update(key[t * DIGEST : (t + 1) * DIGEST])
        out.append(running.digest()[:DIGEST])
    return out


class Block:
    """The forest of a block of sorted, different conversations: ``rows`` of (key,
    text lengths, members, least conv_id, hash of the ids that end there).
    ``before`` and ``after`` are the turns shared with the neighbours outside (-1:
    there is none)."""

    def __init__(self, rows: list[tuple], before: int, after: int) -> None:
        self.keys = [r[0] for r in rows]
        self.before, self.after, self.rows = before, after, rows
        n = self.size = len(rows)
        self.depth = [len(k) // DIGEST for k in self.keys]
        self.left, self.right = list(range(n)), list(range(n))
        self.members, self.least = [r[2] for r in rows], [r[3] for r in rows]
        self.kids, self.saved, self.parent = [0] * n, [0] * n, [-1] * n
        self.sums: list[list[int]] = []
        for r in rows:
            total = [0]
            for x in r[1]:
                total.append(total[-1] + x)
            self.sums.append(total)
        edges = [0] + [shared_turns(a, b) for a, b in zip(self.keys, self.keys[1:])]
        self.leaves = [int(after_it < d) for d, after_it in zip(self.depth, [*edges[1:], after])]
        self._join(edges)

    def _owned(self, v: int, t: int) -> bool:
        """Whether the node at depth t above (or at) v appears here first."""
        return self.left[v] > 0 or t > self.before

    def _gain(self, v: int, low: int, high: int) -> int:
        """Share of the nodes at depths low + 1 to high of v's chain in the savings."""
        low = max(low, 0)
        sums = self.sums[self.left[v]]
        out = (self.members[v] - 1) * (sums[high] - sums[low])
        if self.left[v] == 0 and self.before > low:
            out += sums[min(high, self.before)] - sums[low]
        return out

    def _hang(self, child: int, w: int) -> None:
        d = self.depth[w]
        self.parent[child] = w
        self.kids[w] += self._owned(child, d + 1)
        self.saved[w] += self.saved[child] + self._gain(child, d, self.depth[child])
        self.leaves[w] += self.leaves[child]

    def _join(self, edges: list[int]) -> None:
        up = list(range(self.size))
        top = list(range(self.size))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i in sorted(range(1, self.size), key=lambda i: -edges[i]):
            a, b, d = find(i - 1), find(i), edges[i]
            u, v = top[a], top[b]
            if self.depth[u] > d:  # a branching node comes into being
                w = len(self.depth)
                for column, value in (
                    (self.depth, d), (self.left, self.left[u]), (self.right, self.right[u]), (self.members, self.members[u]),
                    (self.least, self.least[u]), (self.kids, 0), (self.saved, 0), (self.parent, -1), (self.leaves, 0),
                ):
                    column.append(value)
                self._hang(u, w)
            else:
                w = u
            self._hang(v, w)
            self.members[w] += self.members[v]
            self.least[w] = min(self.least[w], self.least[v])
            self.right[w] = self.right[v]
            up[b], top[a] = a, w

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``NODE``: every node with its chain. ``node`` is given for those
        that reach over the boundary, ``parent`` for those whose parent does."""
        before, after, last = self.before, self.after, self.size - 1
        lefts = _prefix_digests(self.keys[0], before) if before >= 0 else []
        rights = _prefix_digests(self.keys[last], after) if after >= 0 else []
        for v, d in enumerate(self.depth):
            w = self.parent[v]
            low = self.depth[w] if w >= 0 else -1
            at_left, at_right = self.left[v] == 0, self.right[v] == last
            # Up to this depth the nodes above v reach over a boundary.
            open_left, open_right = before if at_left else -1, after if at_right else -1
            key, members, least = self.keys[self.left[v]], self.members[v], self.least[v]
            for t in range(d, low, -1):
                node = lefts[t] if t <= open_left else rights[t] if t <= open_right else None
                parent = up_conv = None
                if t > 0:
                    # The parent's interval is wider, it may reach a boundary that v's does not.
                    same = t - 1 > low
                    x = v if same else w
                    if self.left[x] == 0 and t - 1 <= before:
                        parent = lefts[t - 1]
                    elif self.right[x] == last and t - 1 <= after:
                        parent = rights[t - 1]
                    else:
                        up_conv = self.least[x]
                bottom = t == d
                yield (
                    node,
                    parent,
                    least,
                    t,
                    up_conv,
                    members,
                    self.kids[v] if bottom else int(self._owned(v, t + 1)),
                    self.leaves[v],
                    self.saved[v] + self._gain(v, t - 1, d),
                    self.rows[v][4] if bottom and v < self.size else None,
                    key[(t - 1) * DIGEST : t * DIGEST].hex() if t else None,
                )


def _blocks(rows: Iterator[tuple], after_all: int, before: int) -> Iterator[Block]:
    block: list[tuple] = []
    turns = 0
    for row in rows:
        if block and (len(block) >= BLOCK_ROWS or turns >= BLOCK_TURNS):
            shared = shared_turns(block[-1][0], row[0])
            yield Block(block, before, shared)
            block, turns, before = [], 0, shared
        block.append(row)
        turns += len(row[1]) + 1
    if block:
        yield Block(block, before, after_all)


# ---------------------------------------------------------------------------
# Across tasks
# ---------------------------------------------------------------------------


def _rows(batches, names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in names])


def _ids_as_text(batches):
    """Sorted (sid, conv_id) rows to pieces (sid, first conv_id, text of ids)."""
    schema = pa.schema([("sid", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    sid, ids, out = None, [], []
    for s, c in _rows(batches, ["sid", "conv_id"]):
        if ids and (s != sid or len(ids) >= IDS_PER_PIECE):
            out.append((sid, ids[0], ",".join(map(str, ids))))
            ids = []
            if len(out) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        sid = s
        ids.append(c)
    if ids:
        out.append((sid, ids[0], ",".join(map(str, ids))))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _hashed(batches):
    """Pieces in the order of (sid, first) to (sid, hash of all ids)."""
    schema = pa.schema([("sid", pa.string()), ("ends_sha256", pa.string())])
    sid, running = None, None
    for b in batches:
        out = []
        for s, text in zip(b.column("sid").to_pylist(), b.column("ids").to_pylist()):
            if s == sid:
                running.update(b",")
            else:
                if running is not None:
                    out.append((sid, running.hexdigest()))
                sid, running = s, hashlib.sha256()
            running.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], schema=schema)
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (sid, running.hexdigest())], schema=schema)


def ends_hashes(ids: DataFrame) -> DataFrame:
    """``(sid, ends_sha256)``: SHA-256 of the ascending, comma-joined conv_ids of
    every sid of ``ids(sid, conv_id)``."""
    dealt = ids.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    pieces = dealt.mapInArrow(_ids_as_text, "sid string, first long, ids string")
    return pieces.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(_hashed, "sid string, ends_sha256 string")


def _first_and_last(batches):
    first = last = pid = None
    for b in batches:
        if b.num_rows:
            first = b.column("key")[0].as_py() if first is None else first
            last, pid = b.column("key")[b.num_rows - 1].as_py(), b.column("pid")[0].as_py()
    if pid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([first]), pa.array([last])], names=["pid", "first", "last"])


def _shared_with_next(batches):
    """(pid, turns that its last row shares with the first row of the next)."""
    pid = last = None
    for p, first, end in _rows(batches, ["pid", "first", "last"]):
        if pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([shared_turns(last, first)], pa.int32())], names=["pid", "shared"])
        pid, last = p, end
    if pid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([-1], pa.int32())], names=["pid", "shared"])


def _forests(after: dict[int, int]):
    before, shared = {}, -1
    for pid in sorted(after):
        before[pid], shared = shared, after[pid]

    def run(batches):
        rows, pid = [], None

        def stream():
            nonlocal pid
            for b in batches:
                if b.num_rows and pid is None:
                    pid = b.column("pid")[0].as_py()
                yield from _rows([b], ["key", "lengths", "n", "first", "ends_sha256"])

        stream_rows = stream()
        head = next(stream_rows, None)
        if head is None:
            return

        def all_rows():
            yield head
            yield from stream_rows

        for block in _blocks(all_rows(), after[pid], before[pid]):
            for node in block.nodes():
                rows.append(node)
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), NODE_ARROW)], schema=NODE_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), NODE_ARROW)], schema=NODE_ARROW)

    return run


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences(conv_id, turns)``, see ``turn_sequences``:
    conv_id (least member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 and turn_digest (of the node's
    last turn, null at the root)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["h"]), ""))
    flat = stored(
        sequences.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["n"]).alias("lengths")),
        "trie-conversations",
    )
    sid = F.substring(F.sha2("key", 256), 1, 2 * DIGEST)
    different = flat.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.first("lengths").alias("lengths")
    )
    hashes = ends_hashes(flat.select(sid.alias("sid"), "conv_id"))
    whole = different.withColumn("sid", sid).join(hashes, "sid").drop("sid")
    dealt = whole.repartitionByRange(F.substring("key", 1, RANGE_BYTES)).sortWithinPartitions("key")
    rows = materialize(dealt.withColumn("pid", F.spark_partition_id()))

    # One row per partition, in one task that holds two of them at a time.
    edges = rows.mapInArrow(_first_and_last, "pid int, first binary, last binary")
    shared = edges.repartition(1).sortWithinPartitions("pid").mapInArrow(_shared_with_next, "pid int, shared int")
    after = {r["pid"]: r["shared"] for r in shared.collect()}  # two numbers a partition

    nodes = stored(rows.mapInArrow(_forests(after), NODE), "trie-nodes")
    merged = stored(
        nodes.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("parent").alias("parent"),
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends_sha256"),
            F.min("turn_digest").alias("turn_digest"),
        ),
        "trie-boundary-nodes",
    )
    known = nodes.where("node IS NULL").unionByName(merged)
    # Rows that know their parent's member pass; the others ask for it.
    asking = known.where("parent IS NOT NULL").withColumn("__salt", (F.abs(F.xxhash64("conv_id", "depth") % SALTS)).cast("int"))
    names = merged.select(
        F.col("node").alias("__node"), F.col("conv_id").alias("__up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__part")
    )
    answered = asking.join(names, (F.col("parent") == F.col("__node")) & (F.col("__salt") == F.col("__part"))).withColumn(
        "parent_conv_id", F.col("__up")
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "turn_digest"]
    return known.where("parent IS NULL").select(*columns).unionByName(answered.select(*columns))
