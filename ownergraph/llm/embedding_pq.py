"""Near-duplicate embeddings by product quantisation.

An index is fitted on a bounded sample: centroids of coarse inverted lists, and
code books for the subspaces of the residuals (vector minus its list's centroid).
Every vector is indexed: it stands in the list of its nearest centroid with its
residual's codes and the length ``e`` of what the codes leave out. Every vector is
also a query to the lists near it. For a list the query's distances to all code
words of every subspace form a table; the asymmetric distance to an indexed vector
is a sum of table entries. As distances obey the triangle inequality, an indexed
vector can lie within the threshold's radius only if its asymmetric distance is at
most radius + e: these are the candidates, none within the list is missed, and
their exact cosine in double precision decides.

Probes: lists whose bisector with the home list is within half the radius. The
distances of a pair in two lists to these lists' bisector add up to at most the
pair's distance, so one of the two probes the other's list and no pair is lost. A
pair that only one end finds is counted for both by the task that finds it.

Equal vectors are collapsed before and counted. Lists over ``BLOCK`` rows are dealt
out in blocks of indexed rows and blocks of queries, so a task's group is bounded;
it sends back link counts and a spanning forest, not pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing and form their own components; so do vectors of different lengths with each
other (they are compared within equal length). Repeated vec_ids keep their own
rows. Null vec_ids count as partners, but never name a component. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.llm.common import stored
from ownergraph.llm.graph import Forest, components

SAMPLE = 16_384  # vectors that the index is fitted on, at most
LIST_ROWS = 256  # rows a list has on average, up to LISTS lists
LISTS = 2_048
SUBSPACES, WORDS = 16, 64
MARGIN = 1e-6  # added to half the radius for rounding
DEALT = 8_192  # rows of a batch that is dealt out
BLOCK = 4_096
SEED = 7


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of x and y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(x[i : i + 2048], centre).argmin(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centre))
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


class Index:
    """Centroids and code books for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, rows: int) -> None:
        self.dim = sample.shape[1]
        self.sub = -(-self.dim // min(SUBSPACES, self.dim))
        self.parts = -(-self.dim // self.sub)
        self.centre = k_means(sample, max(1, min(LISTS, len(sample) // 8, rows // LIST_ROWS)))
        home = np.concatenate([_distances(sample[i : i + 2048], self.centre).argmin(1) for i in range(0, len(sample), 2048)])
        rest = self._pad(sample - self.centre[home])
        self.words = [k_means(np.ascontiguousarray(rest[:, p]), WORDS) for p in range(self.parts)]
        self.between = np.sqrt(_distances(self.centre, self.centre))

    def _pad(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * self.sub))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, self.sub)

    def place(self, x: np.ndarray, list_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, e) of every row of a list, and nothing left out."""
        rest = self._pad(x - self.centre[list_id])
        codes = np.stack([_distances(rest[:, p], self.words[p]).argmin(1) for p in range(self.parts)], 1).astype("u1")
        back = np.stack([self.words[p][codes[:, p]] for p in range(self.parts)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum((1, 2)))

    def reaches(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray, slack: float) -> np.ndarray:
        """Whether the bisector of each row's ``home`` and ``lists`` is within
        ``slack``; worked out row by row, so it is the same in every task."""
        out = np.empty(len(x), bool)
        half = (self.centre * self.centre).sum(1) / 2
        for i in range(0, len(x), 4096):
            h, l = home[i : i + 4096], lists[i : i + 4096]
            gap = self.centre[h] - self.centre[l]
            out[i : i + 4096] = (x[i : i + 4096] * gap).sum(1) + half[l] - half[h] <= slack * np.sqrt((gap * gap).sum(1))
        return out

    def probes(self, x: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home lists, and the (row, list) pairs to search: home lists, and lists
        whose bisector with the home list is within ``slack``."""
        d = _distances(x, self.centre)
        home = d.argmin(1)
        over = (d - d[np.arange(len(x)), home][:, None]) / 2 - slack * self.between[home]
        row, probe = np.nonzero(over <= 1e-7)
        # Matrix products round as their shapes have it: the close ones again.
        close = np.flatnonzero(over[row, probe] > -1e-7)
        keep = np.ones(len(row), bool)
        keep[close] = (home[row[close]] == probe[close]) | self.reaches(x[row[close]], home[row[close]], probe[close], slack)
        return home, row[keep], probe[keep]

    def asymmetric(self, query: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the coded rows of a list (one after the other) to the
        queries: a row's table entries for all queries lie together."""
        rest = self._pad(query - self.centre[list_id])
        total, part = np.zeros((len(codes), len(query)), "f4"), np.empty((len(codes), len(query)), "f4")
        for p in range(self.parts):
            np.take(_distances(self.words[p], rest[:, p]).astype("f4"), codes[:, p], axis=0, out=part, mode="clip")
            total += part
        return total


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    x = flat.reshape(len(column), -1)  # a copy: divided in place
    # Scaled by the largest component first: its square may not be a number.
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x


def links(reps: DataFrame, dim: int, rows: int, threshold: float) -> DataFrame:
    """``reps(rep long, v array<double>, copies long)``, all of length ``dim``:
    a row (rep, n, other) per task and rep with n > 0 copies linked, or per link
    of a spanning forest (n = 0, other set)."""
    spark = reps.sparkSession
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow()
    index = Index(_unit(sample.column("v").combine_chunks()), rows)
    radius = math.sqrt(2 - 2 * threshold) if threshold < 1 else 0.0
    slack = radius / 2 + MARGIN

    # Rows and queries per list: at most LISTS rows come to the driver.
    def count(batches):
        homes, asks = np.zeros(len(index.centre), "i8"), np.zeros(len(index.centre), "i8")
        for batch in batches:
            if batch.num_rows:
                home, _, probe = index.probes(_unit(batch.column("v")), slack)
                homes += np.bincount(home, minlength=len(homes))
                asks += np.bincount(probe, minlength=len(asks))
        yield pa.RecordBatch.from_pydict({"list": pa.array(range(len(homes))), "homes": pa.array(homes), "asks": pa.array(asks)})

    sizes = reps.select("v").mapInArrow(count, "list long, homes long, asks long").groupBy("list").agg(F.sum("homes"), F.sum("asks")).collect()
    splits = np.ones((2, len(index.centre)), "i8")
    for r in sizes:
        splits[:, r[0]] = -(-r[1] // BLOCK) or 1, -(-r[2] // BLOCK) or 1

    def deal(batches):
        """Indexed rows (ask = 0) to all blocks of queries of their list, and
        queries (ask = 1) to all blocks of indexed rows."""
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rep = part.column("rep").to_numpy()
                home, row, probe = index.probes(_unit(part.column("v")), slack)
                keys, ats = [], []
                for ask, at, lists in ((0, np.arange(len(home)), home), (1, row, probe)):
                    # Own block among the own kind, every block of the other.
                    own, others = rep[at] % splits[ask, lists], splits[1 - ask, lists]
                    k = np.repeat(np.arange(len(at)), others)
                    other = np.arange(len(k)) - np.repeat(np.cumsum(others) - others, others)
                    first, second = (other, own[k]) if ask else (own[k], other)
                    keys.append(lists[k] << 32 | first << 16 | second)
                    ats.append(at[k])
                key, at, ask = np.concatenate(keys), np.concatenate(ats), np.repeat([0, 1], [len(k) for k in keys]).astype("i1")
                for j in range(0, len(key), DEALT):
                    to = at[j : j + DEALT]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[j : j + DEALT]), pa.array(ask[j : j + DEALT])] + [pa.array(home[to], pa.int32())] + [part.column(c).take(pa.array(to)) for c in ("rep", "copies", "v")],
                        names=["key", "ask", "home", "rep", "copies", "v"],
                    )

    def search(group: pa.Table) -> pa.Table:
        ask = group.column("ask").to_numpy().astype(bool)
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        x = _unit(group.column("v").combine_chunks())
        list_id = int(group.column("key")[0].as_py()) >> 32
        home = group.column("home").to_numpy()[ask]
        rows, own, many, asked = x[~ask], rep[~ask], copies[~ask], copies[ask]
        queries, names = x[ask], rep[ask]
        out: list[tuple[int, int, int | None]] = []
        if len(rows):
            codes, left = index.place(rows, list_id)
            forest, back = Forest(), np.zeros(len(rows), "i8")
            bound = ((radius + left + 1e-5) ** 2).astype("f4")
            for i in range(0, len(queries), 512):
                query, name = queries[i : i + 512], names[i : i + 512]
                r, q = np.nonzero(index.asymmetric(query, list_id, codes) <= bound[:, None])
                keep = name[q] != own[r]
                q, r = q[keep], r[keep]
                hit = np.concatenate([np.einsum("ij,ij->i", query[q[j : j + 65536]], rows[r[j : j + 65536]]) for j in range(0, len(q), 65536)] or [np.empty(0)]) >= threshold
                q, r = q[hit], r[hit]
                n = np.bincount(q, weights=many[r], minlength=len(query)).astype("i8")
                out += [(int(name[k]), int(n[k]), None) for k in np.flatnonzero(n)]
                # Partners that don't ask in the query's home list are counted here.
                pair, at = np.unique(r * len(index.centre) + home[i : i + 512][q], return_inverse=True)
                r_one, h_one = pair // len(index.centre), pair % len(index.centre)
                alone = ((h_one != list_id) & ~index.reaches(rows[r_one], np.full(len(pair), list_id), h_one, slack))[at]
                back += np.bincount(r[alone], weights=asked[i : i + 512][q[alone]], minlength=len(rows)).astype("i8")
                out += [(a, 0, b) for a, b in zip(name[q].tolist(), own[r].tolist()) if forest.join(a, b)]
            out += [(int(own[k]), int(back[k]), None) for k in np.flatnonzero(back)]
        a, n, b = zip(*out) if out else ((), (), ())
        return pa.table({"rep": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()), "other": pa.array(b, pa.int64())})

    dealt = reps.mapInArrow(deal, f"key long, ask byte, home int, rep long, copies long, v {dict(reps.dtypes)['v']}")
    return dealt.groupBy("key").applyInArrow(search, "rep long, n long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding)``: vec_id, n_links,
    component_id, kept. ``threshold`` > 0."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    # NaN exceeds every number in Spark's order, null is kept by forall's rule.
    sound = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ((F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308))))
        & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(sound, F.transform(v, lambda x: x + F.lit(0.0).cast(kind[6:-1]))).alias("v"),
    ).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    # Equal vectors collapse (grouped by the components, the hash only shortens rows).
    reps = stored(
        rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "vectors",
    )
    found = None
    # A row per length of vectors; usually one.
    for dim, n in reps.groupBy(F.size("v")).count().collect():
        one = links(reps.where(F.size("v") == dim).select("rep", "v", "copies"), dim, n, threshold)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "rep long, n long, other long")
    found = stored(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    part = stored(
        reps.join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
            "v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
        ),
        "vector-components",
    )
    named = stored(part.groupBy("component").agg(F.min("least").alias("component_id")), "vector-names")
    by_vector = stored(part.join(named, "component").select("v", F.xxhash64("v").alias("h"), "n_links", "component_id"), "vector-results")
    # Joined by hash and, on equal hashes, by the components.
    same = (rows["h"] == by_vector["h"]) & (rows["v"] == by_vector["v"])
    return rows.join(by_vector, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(by_vector["h"].isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
