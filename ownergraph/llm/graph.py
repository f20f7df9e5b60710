"""Connected components of an undirected link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.llm.common import stored

MAX_ROUNDS = 60


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step on directed pairs ``(a, b)``.

    Large star: every neighbour greater than ``a`` is linked to the least of
    ``a`` and its neighbours. Small star (pairs point downwards, a > b): ``a``
    and its neighbours are linked to the least neighbour. The minimum per node
    is pre-aggregated and written, so that both sides of the join that follows
    are plain scans with an exchange of their own and a hub is split by AQE.
    """
    if small:
        pairs = links
        least = stored(pairs.groupBy("a").agg(F.min("b").alias("m")), "star-min")
        hit = pairs.join(least, "a")
        out = hit.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    else:
        pairs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(
            pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-min"
        )
        out = pairs.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stored(out.where("a <> b").distinct(), "star")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a long, b long)``;
    the component is the least node reachable.

    Alternating large-star and small-star steps until nothing changes; each
    step is written to the shared folder. Self links and nulls are ignored; no
    links give an empty result. Nothing but a count and a checksum comes to
    the driver.
    """
    pairs = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )

    def state(df: DataFrame):
        # The sum is taken in decimal form: it can't overflow.
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(pairs)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        pairs = _star(_star(pairs, small=False), small=True)
        now = state(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


class Forest:
    """Union-find over the values met in one task; ``join`` tells whether the
    link was needed, so that a task emits a spanning forest, not all pairs."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root and p != x:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
