"""Embedding, SimHash and line near-duplicates against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from ownergraph.llm import embedding_pq, line_dedup, simhash_anchor
from ownergraph.llm.common import stored
from ownergraph.llm.embedding_pq import near_duplicates as near_vectors
from ownergraph.llm.graph import components


def _closure(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(llm_spark):
    draw = random.Random(2)
    for n, m in ((40, 30), (60, 80), (30, 0)):
        pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(9)] if m else [])
        got = components(llm_spark.createDataFrame(pairs or [], "a long, b long")).collect()
        want = _closure(n, pairs)
        met = {x for a, b in pairs for x in (a, b) if a != b}
        assert {r.node: r.component for r in got} == {x: want[x] for x in met} and len(got) == len(met)


# --- embeddings --------------------------------------------------------------


def _vectors(llm_spark, kind):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + 0.12 * draw.normal(size=(20, 24)), base[:5], 3 * base[:3], base[:1] + 0.2 * draw.normal(size=(150, 24))])
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [float("inf")] + [1.0] * 23), (1005, [None] * 24), (1006, rows[0][1][:7]), (1007, [2 * v for v in rows[0][1][:7]]), (3, rows[3][1])]
    return llm_spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"vec_id long, embedding array<{kind}>, label int, v int, rep int"), rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_equal_brute_force(llm_spark, kind):
    df, rows = _vectors(llm_spark, kind)
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    linked = []
    for a in ok:
        for b in ok:
            if len(rows[a][1]) == len(rows[b][1]) and a != b:
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    linked.append((a, b))
    part = _closure(len(rows), linked)
    least = {p: min(rows[i][0] for i in range(len(rows)) if part[i] == p) for p in set(part)}
    want = sorted((rows[i][0], sum(a == i for a, _ in linked), least[part[i]]) for i in range(len(rows)))
    got = near_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_vectors(llm_spark):
    assert near_vectors(llm_spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_of_the_index_on_the_given_vectors(llm_spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("driver test data not present")
    df = llm_spark.read.parquet(path)
    table = df.toPandas().sort_values("vec_id")
    x = np.stack([np.array(v, float) for v in table.embedding])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = dict(zip(table.vec_id, ((x @ x.T) >= 0.9).sum(1) - 1))
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    assert all(got[k] <= v for k, v in want.items())
    assert sum(got.values()) >= 0.9 * sum(want.values())


def _hot_vectors(rows, noise, axes):
    """A third of all rows in one group of cosine about 0.91, as unit vectors."""
    draw = np.random.default_rng(11)
    x = draw.normal(size=(rows, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    apart = np.zeros((rows // 3, 64))
    apart[:, :axes] = noise / np.sqrt(axes) * draw.normal(size=(rows // 3, axes))
    x[: rows // 3] = x[0] + apart
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("lists, axes", [(40, 64), (234, 16), (2048, 4)])
def test_probes_of_planted_groups_lose_no_pair(lists, axes):
    x = _hot_vectors(embedding_pq.SAMPLE, 0.31, axes)
    index = embedding_pq.Index(x, lists * embedding_pq.LIST_ROWS)
    assert len(index.centre) == lists
    some = np.concatenate([x[:1000], x[-500:]])
    home, row, probe = index.probes(some, np.sqrt(0.2) / 2 + embedding_pq.MARGIN)
    probed = np.zeros((len(some), lists), bool)
    probed[row, probe] = True
    found = probed[:, home]
    alike = some @ some.T >= 0.9
    assert alike.sum() > 100_000 and (found | found.T)[alike].all()


def test_links_are_counted_for_both_ends(llm_spark, monkeypatch):
    monkeypatch.setattr(embedding_pq, "LIST_ROWS", 12)
    monkeypatch.setattr(embedding_pq, "BLOCK", 64)  # lists are dealt out in blocks
    x = _hot_vectors(1500, 0.31, 16)
    x[-3:] = 2 * x[:3]  # same direction, other vector
    df = llm_spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, x[0].tolist())], "vec_id long, embedding array<double>")
    x = np.concatenate([x, x[:1]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    assert [got[i] for i in [*range(1500), 2000]] == want.tolist()


def test_asymmetric_distances_are_those_of_the_code_words():
    x = _hot_vectors(600, 0.31, 16)
    index = embedding_pq.Index(x, 600)
    codes, left = index.place(x[:50], 0)
    back = np.stack([index.words[p][codes[:, p]] for p in range(index.parts)], 1).reshape(50, -1)[:, : index.dim] + index.centre[0]
    got = index.asymmetric(x[100:130], 0, codes)
    # A row of the result for each coded vector: what its queries need lies together.
    assert got.shape == (50, 30) and got.flags.c_contiguous
    assert np.allclose(got, ((back[:, None] - x[None, 100:130]) ** 2).sum(2), atol=1e-5)


# --- SimHash -----------------------------------------------------------------


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_docs):
    got = simhash_anchor.near_duplicates(odd_docs).collect()
    docs = odd_docs.collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), f"{_fingerprint(r.text):016x}") for r in docs)
    fps = [_fingerprint(r.text) for r in docs]
    part = _closure(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    names = {p: min((docs[i].doc_id for i in range(len(docs)) if part[i] == p and docs[i].doc_id is not None), default=None) for p in set(part)}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(docs[i].doc_id), str(names[part[i]])) for i in range(len(docs)))
    stay = simhash_anchor.one_of_each(odd_docs)
    assert stay.count() == len(set(part)) and stay.columns == odd_docs.columns


def test_no_fingerprints(no_docs):
    assert simhash_anchor.near_duplicates(no_docs).count() == 0
    assert simhash_anchor.one_of_each(no_docs).count() == 0


def test_one_of_each_when_files_are_split_otherwise(llm_spark, tmp_path):
    texts = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts + texts[::-1] + texts[:7])]
    for i in range(0, len(rows), 4):
        llm_spark.createDataFrame(rows[i : i + 4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    stay = simhash_anchor.one_of_each(llm_spark.read.parquet(f"{tmp_path}/docs"))
    # As when an executor is lost between the two reads.
    old = llm_spark.conf.get("spark.sql.files.maxPartitionBytes")
    llm_spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert sorted((r.doc_id, r.text) for r in stay.collect()) == rows[:20]
    finally:
        llm_spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_close_fingerprints_share_an_anchor():
    draw = random.Random(5)
    for _ in range(150):
        x = draw.getrandbits(64)
        y = x
        for bit in draw.sample(range(64), draw.randint(0, 4)):
            y ^= 1 << bit
        near = [set(simhash_anchor.anchors(np.array([v], "<u8").view("<i8"), 2)[1].tolist()) for v in (x, y)]
        assert near[0] & near[1]


def test_anchor_tables_take_little_memory():
    tracemalloc.start()
    low, high, leader, near, starts = simhash_anchor._code.__wrapped__(2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # an executor's tasks make them at once
    # Every syndrome has its own leader, of weight 3 at most.
    assert np.bitwise_count(leader).max() == 3
    assert ((low[leader & 4095] ^ high[leader >> 12]) == np.arange(1 << 11)).all()
    # The Golay code has 253 words of weight 7 and 506 of weight 8; each is listed with
    # the leaders within 5 bits.
    words = np.unique(near)
    assert (low[words & 4095] == high[words >> 12]).all()
    assert np.bincount(np.bitwise_count(words)).tolist() == [1, 0, 0, 0, 0, 0, 0, 253, 506]
    for s in range(0, 1 << 11, 97):
        want = words[np.bitwise_count(words ^ leader[s]) <= 5]
        assert sorted(near[starts[s, 0] : starts[s, -1]].tolist()) == want.tolist()


def test_links_of_planted_groups(llm_spark, monkeypatch):
    monkeypatch.setattr(simhash_anchor, "BLOCK", 40)  # hot anchors are dealt out in blocks
    draw = random.Random(6)
    fps = {draw.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:3]:
        for _ in range(80):
            y = centre
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                y ^= 1 << bit
            fps.add(y)
    fps = sorted(fps)
    df = stored(llm_spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long"), "test-fps")
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    order = {v: i for i, v in enumerate(signed)}
    got = [(order[r.a], order[r.b]) for r in simhash_anchor.links(df).collect()]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    assert set(got) <= {(a, b) for x, y in want for a, b in ((x, y), (y, x))}
    assert _closure(len(fps), got) == _closure(len(fps), want)


# --- lines -------------------------------------------------------------------


def _removed(docs, threshold=0.8):
    lines = sorted(
        ((-1 if r.doc_id is None else r.doc_id, i, frozenset(re.findall(r"[^ \t\r\x0b\f]+", t)), r.text) for r in docs for i, t in enumerate((r.text or "").split("\n"))),
        key=lambda x: x[:2],
    )
    gone = set()
    for d, i, words, text in lines:
        for e, j, other, _ in lines:
            if (e, j) >= (d, i):
                break
            if words and len(words & other) >= threshold * len(words | other) - 1e-9:
                gone.add((d, i, text))
    return gone


def test_lines_equal_brute_force(llm_spark, odd_docs, no_docs):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(draw.randint(1, 6)):
            if rows and draw.random() < 0.5:
                line = draw.choice(draw.choice(rows)[1].split("\n")).split(" ")
                for _ in range(draw.randint(0, 3)):
                    line[draw.randrange(len(line))] = draw.choice(words)
            else:
                line = [draw.choice(words) for _ in range(draw.choice([1, 2, 4, 5, 9, 10, 20]))]
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    for docs in (llm_spark.createDataFrame(rows, "doc_id long, text string"), odd_docs):
        own = docs.collect()
        got = line_dedup.dedup_lines(docs)
        assert got.columns == docs.columns
        gone = _removed(own)
        keep = lambda r: None if r.text is None else "\n".join(t for i, t in enumerate(r.text.split("\n")) if (-1 if r.doc_id is None else r.doc_id, i, r.text) not in gone)
        assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(r.doc_id), str(keep(r))) for r in own)
        report = line_dedup.line_report(docs).collect()
        assert sum(r.n_removed for r in report) == sum((-1 if r.doc_id is None else r.doc_id, i, r.text) in gone for r in own for i in range(len((r.text or "").split("\n"))))
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert line_dedup.line_report(no_docs).count() == 0


def test_lines_of_rows_with_the_same_doc_id(llm_spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(draw.sample(words, 40))) for i in range(60)]
    for d in range(100, 140):
        first = draw.sample(words, 50)
        rows.append((d - 50, " ".join(first[:40])))
        # 35 of 45 words in common: not alike; the other row's line is alike.
        own, other = first[5:45], [*first[:39], first[49]]
        rows += [(None if d % 4 == 0 else d, " ".join(x)) for x in (own, other)]
        rows.append((d + 100, " ".join(own)))
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    gone = _removed(docs.collect())
    got = line_dedup.line_report(docs).collect()
    want = sorted((str(d), int((-1 if d is None else d, 0, t) in gone)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == want


def test_lines_that_have_found_one_ask_no_more(llm_spark, monkeypatch):
    draw = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    base = draw.sample(words, 80)
    rows = [(0, " ".join(base))]
    for d in range(1, 80):
        line = [*base]
        for i in draw.sample(range(80), 4):
            line[i] = f"own{d}x{i}"  # rarer than any shared word: the first round meets nothing
        rows.append((d, " ".join(line)))
    rows += [(100 + d, " ".join(draw.sample(words, 40))) for d in range(20)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    met, best = [], line_dedup._best

    def seen(*args):
        out = best(*args)
        met.append(out.select("s").distinct().collect())
        return out

    monkeypatch.setattr(line_dedup, "_best", seen)
    got = {(r.doc_id, r.n_removed) for r in line_dedup.line_report(docs).collect()}
    gone = _removed(docs.collect())
    assert got == {(d, int((d, 0, t) in gone)) for d, t in rows}
    # A set that is settled in a batch of keys meets no more sets in the next ones.
    alike = {d for d, _, _ in gone}
    sets = [{r.s for r in m} for m in met]
    assert len(alike) > 50 and sum(len(m) for m in sets) <= len(set().union(*sets)) + 30


def test_lines_whose_few_candidates_failed_are_done(llm_spark, monkeypatch):
    draw = random.Random(14)
    common = [f"c{i}" for i in range(24)]
    rows = []
    for p in range(80):
        # 39 of 51 words in common: not alike, but some signatures allow it.
        shared, own = [f"p{p}x{i}" for i in range(39)], draw.sample(common, 12)
        rows += [(2 * p, " ".join(shared + own[:6])), (2 * p + 1, "\t".join(shared + own[6:]))]
    rows += [(200, rows[0][1] + "\n\n " + rows[0][1]), (201, None)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    failed, asked, verified, more = [], [], line_dedup._verified, line_dedup._candidates

    def seen(*args):
        out = verified(*args)
        failed.append(out.where("not like").count())
        return out

    monkeypatch.setattr(line_dedup, "_verified", seen)
    monkeypatch.setattr(line_dedup, "_candidates", lambda *args: asked.append(args) or more(*args))
    got = {(r.doc_id, r.n_removed) for r in line_dedup.line_report(docs).collect()}
    gone = _removed(docs.collect())
    assert got == {(d, sum((d, i, t) in gone for i in range(3))) for d, t in rows} and (200, 2) in got
    # All candidates of a set were seen at once: it does not ask all keys again.
    assert sum(failed[1:]) > 0 and not asked


def test_line_dedup_runs_no_python_on_executors(odd_docs, capsys):
    line_dedup.dedup_lines(odd_docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
