"""Print the physical plans of the main operators over Parquet tables.

The adapter views are first written as Parquet (as the loads would leave
them), so the plans show what a deployment reads: pushed filters, read
schemas, join strategies and exchanges.

usage: python scripts/explain_plans.py [sf_dir] [operator ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from ownergraph.operators import hierarchy, lookup, ranking, relations, search  # noqa: E402
from ownergraph.plans.adapter import adapter_tables  # noqa: E402
from ownergraph.session import build_session, scratch_path  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("local[4]", shuffle_partitions=8)
    t = adapter_tables(spark, sf_dir, cache=False)
    folder = scratch_path(spark, "plans")
    for k in ("lei_records", "relationships", "reporting_exceptions"):
        t[k].write.parquet(f"{folder}/{k}")
    e, r, x = (spark.read.parquet(f"{folder}/{k}") for k in ("lei_records", "relationships", "reporting_exceptions"))
    req = spark.createDataFrame([("CUST0000000000000100",)], "lei string")
    edges = hierarchy._direct_edges(r)
    frontier = e.select(F.col("lei").alias("root_lei"), F.col("lei").alias("node_lei"))
    step = (
        frontier.join(edges, frontier["node_lei"] == edges["__parent"])
        .groupBy("root_lei", F.col("__child").alias("node_lei"))
        .agg(F.min("node_lei").alias("parent_lei"))
        .join(frontier, ["root_lei", "node_lei"], "left_anti")
    )
    plans = {
        "direct_parents": relations.direct_parents(e, r),
        "children_of_request": relations.children(e, r, req),
        "other_relationships": relations.other_relationships(e, r),
        "sibling_counts": relations.sibling_counts(r),
        "search_by_name": lookup.search_by_name(e, "mer#0000001", 25),
        "search_by_name_batch": search.search_by_name_batch(
            e, spark.createDataFrame([("r#00001",), ("",)], "query string"), 10
        ),
        "descendant_level_step": step,
        "ordinal_within_group": ranking.ordinal_within_group(
            edges.select("__parent", "__child"), ["__parent"], [F.col("__child")], "pos"
        ),
    }
    for name, df in plans.items():
        if only and name not in only:
            continue
        print(f"===== {name}")
        df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
