"""The prefix trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from ownergraph.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, pid int, node string, depth string, t int"


def rebuilt(rows, every=100, most=6):
    """conv_id -> turns with the opening of another conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            h = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", h, text or ""))
    turns = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + v[h:]
    return out


def brute(conversations):
    """Rows of all nodes of conv_id -> turns."""
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def collected(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in NAMES) for r in df.collect())


def random_rows(draw, convs, most_turns=6, words=2):
    rows = []
    for c in range(convs):
        for turn in range(draw.randint(0, most_turns)):
            rows.append((c * draw.choice([1, 1, 7]), turn if turn else draw.choice([None, 0]), draw.choice("ua"), "xé"[: draw.randint(0, words)]))
    seen, out = set(), []
    for r in rows:  # one row a turn
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out


@pytest.mark.parametrize("block", [1, 2, 5, 20_000])
def test_blocks_add_up(block):
    """Any dealing of the sorted conversations into blocks gives the same nodes."""
    draw = random.Random(block)
    for _ in range(40):
        turns = {c: [("u", draw.choice(["", "a", "bb"])) for _ in range(draw.randint(0, 4))] for c in range(draw.randint(1, 14))}
        rows = {}
        for c, v in turns.items():
            key = b"".join(hashlib.sha256(repr(x).encode()).digest()[: pt.DIGEST] for x in v)
            rows.setdefault(key, ([len(x[1]) for x in v], []))[1].append(c)
        ordered = [(k, n, len(ids), min(ids), hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()) for k, (n, ids) in sorted(rows.items())]
        parts = [ordered[i : i + block] for i in range(0, len(ordered), block)]
        merged, before = {}, -1
        inner = []
        for i, part in enumerate(parts):
            after = pt.shared_turns(part[-1][0], parts[i + 1][0][0]) if i + 1 < len(parts) else -1
            for node in pt.Block(part, before, after).nodes():
                if node[0] is None:
                    inner.append(list(node))
                elif node[0] in merged:
                    m = merged[node[0]]
                    m[2] = min(m[2], node[2])
                    for k in (5, 6, 7, 8):
                        m[k] += node[k]
                    m[9] = m[9] or node[9]
                else:
                    merged[node[0]] = list(node)
            before = after
        got = []
        for x in [*inner, *merged.values()]:
            up = x[4] if x[1] is None else merged[x[1]][2]
            got.append((x[2], x[3], -1 if up is None else up, *x[5:9], x[9] or pt.NOTHING))
        assert sorted(got) == brute(turns)


def test_trie_against_brute_force(llm_spark, monkeypatch):
    monkeypatch.setattr(pt, "IDS_PER_PIECE", 2)
    draw = random.Random(12)
    for trial in range(2):
        rows = random_rows(draw, 160)
        rows += [(5000 + k, t, "u", "common") for k in range(70) for t in range(3)]  # a third alike
        df = llm_spark.createDataFrame([(*r, "k", 1, "n", "d", 2) for r in rows], SCHEMA).repartition(5)
        got = pt.prefix_trie(pt.turn_sequences(df))
        plain = {}
        for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
            plain.setdefault(c, []).append((role, text))
        assert collected(got) == brute(plain)
        again = pt.prefix_trie(pt.with_shared_openings(pt.turn_sequences(df)))
        assert collected(again) == brute(rebuilt(rows))


def test_odd_rows(llm_spark):
    rows = [
        (0, 0, None, None), (0, 0, None, None), (0, None, "a", "b"), (7, 5, "a", "x" * 200_000), (7, 6, "", ""),
        (None, 0, "u", "t"), (-5, 0, "ab", "c"), (-5, 1, "a", "bc"), (303, 1, "u", "t"), (8, 5, "a", "x" * 200_000),
    ]
    df = llm_spark.createDataFrame([(*r, "k", 1, "n", "d", 2) for r in rows], SCHEMA)
    assert collected(pt.prefix_trie(pt.with_shared_openings(pt.turn_sequences(df)))) == brute(rebuilt(rows))
    assert pt.prefix_trie(pt.turn_sequences(df.limit(0))).count() == 0
    one = df.where("conv_id = 303")
    assert collected(pt.prefix_trie(pt.with_shared_openings(pt.turn_sequences(one)))) == brute(rebuilt(rows[8:9]))


def test_long_conversation(llm_spark):
    rows = [(1, t, "u", f"turn {t}") for t in range(3000)] + [(2, t, "u", f"turn {t}") for t in range(2990)]
    df = llm_spark.createDataFrame([(*r, "k", 1, "n", "d", 2) for r in rows], SCHEMA)
    out = {(r.depth): r for r in pt.prefix_trie(pt.turn_sequences(df)).collect()}
    assert len(out) == 3001 and out[2990].n_children == 1 and out[2990].n_convs == 2 and out[2991].n_convs == 1
    assert out[0].saved_tokens == sum(len(f"turn {t}") for t in range(2990))


def test_query_against_brute_force(llm_spark):
    from ownergraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in llm_spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert collected(QUERIES["op12_conversation_trie"](llm_spark, sf)) == brute(rebuilt(rows))
