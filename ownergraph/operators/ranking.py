"""Positions and running sums inside groups without sending a big group to one task.

``row_number().over(Window.partitionBy(g))`` puts every row of a group into
one task; a corporate group holding a third of the registry would then sit in
a single task. So rows are range-partitioned on (group, order keys) - a hot group
is cut into many partitions - and each row's position is its global rank
minus the global rank of its group's first row. The only small pieces there
are per-partition counts (one row per partition, broadcast, bounded by the
partition count). Running sums are taken per (partition, group) piece; the sums of
a group's earlier pieces, at most one per partition, are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownergraph.session import materialize


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def ordinal_within_group(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column],
    out_col: str = "ordinal",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out_col`` = 1-based position of each row inside its group when
    ordered by ``order_cols`` (which must make the order total)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = materialize(
        ranged.withColumn("__pid", F.spark_partition_id()).withColumn(
            "__row", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
        )
    )
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    ranked = tagged.join(F.broadcast(offsets), "__pid").withColumn(
        "__global", F.col("__off") + F.col("__row")
    )
    firsts = ranked.groupBy("__pid", *group_cols).agg(F.min("__global").alias("__first"))
    starts = firsts.groupBy(*group_cols).agg(F.min("__first").alias("__start"))
    keyed = firsts.alias("f").join(starts.alias("s"), _null_safe_on(firsts, starts, group_cols)).select(
        F.col("f.__pid").alias("__kpid"), *[F.col(f"f.{c}").alias(f"__k_{c}") for c in group_cols], "__start"
    )
    cond = (ranked["__pid"] == keyed["__kpid"]) & reduce(
        lambda a, b: a & b, [ranked[c].eqNullSafe(keyed[f"__k_{c}"]) for c in group_cols]
    )
    out = ranked.join(keyed, cond).withColumn(
        out_col, (F.col("__global") - F.col("__start") + 1).cast("long")
    )
    return out.drop("__pid", "__row", "__off", "__global", "__kpid", "__start", *[f"__k_{c}" for c in group_cols])


def running_sums_within_group(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column],
    sums: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add, for every name of ``sums``, the sum of its column over the rows of the
    group up to this one, ordered by ``order_cols`` (which must make the order
    total). The sum of a literal 1 is the row's position."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = materialize(
        dealt.select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__row"), *[
            value.cast("long").alias(f"__v_{name}") for name, value in sums.items()
        ])
    )
    piece = ["__pid", *group_cols]
    upto = Window.partitionBy(*piece).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    inside = tagged.select("*", *[F.sum(f"__v_{name}").over(upto).alias(f"__s_{name}") for name in sums])
    totals = tagged.groupBy(*piece).agg(*[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    earlier = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("__pid").alias("__kpid"),
        *[F.col(c).alias(f"__k_{c}") for c in group_cols],
        *[F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__b_{name}") for name in sums],
    )
    same = reduce(lambda a, b: a & b, [inside[c].eqNullSafe(before[f"__k_{c}"]) for c in group_cols])
    joined = inside.join(before, (inside["__pid"] == before["__kpid"]) & same)
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"__s_{name}") + F.col(f"__b_{name}")).alias(name) for name in sums]
    )
