"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces every link (u, v) by a link to the least neighbour of u. Minima are aggregations with a map-side
combine and are written before the join that hands them out, so adaptive execution can split the links of a hub.
Every node of a component ends with one link to the component's least node after a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.store import discard, exchanges_removed, written


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (least node reachable) of all nodes that are not the least of their component.

    ``links`` has two columns of ids; their order, loops, repeats and null ends do not matter. A node that is not in
    the result is the least of its component, or has no link. No links: no rows.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    now = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(a.isNotNull() & b.isNotNull() & (a != b))
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(_least(both).withColumn("m", F.least("u", "m")), "least")
        # Large star: larger neighbours of u are linked to the least one among u and its neighbours.
        large = (
            now.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = written(large, "links")
        # Small star: smaller neighbours of u and u itself are linked to the least of them.
        least2 = written(_least(large), "least")
        small = written(
            large.join(least2, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least2.select("u", F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        # Done when each node has one link and no link leads to a node that has a link itself.
        with exchanges_removed(small.sparkSession):
            rows, nodes = small.agg(F.count("*"), F.countDistinct("u")).first()
            inner = small.select("v").distinct().join(small.select(F.col("u").alias("v")), "v", "left_semi")
            done = rows == nodes and inner.isEmpty()
        for old in (now, least, large, least2):
            discard(old)
        now = small
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
