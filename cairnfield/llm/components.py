"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node that has a link, with the smallest node reachable from it.

    links: two columns a, b of one orderable type, any order, repeats allowed.
    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing
    changes; every round is written to the shared folder. A hub's links are never
    gathered: minima are pre-aggregated and joins can be split.
    """
    a, b = F.col("a"), F.col("b")
    now = materialise(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        size = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if size == mark or size["n"] == 0:
            break
        mark = size
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Broadcasts would pass through the driver in every round; merge joins of large hubs are split at run time.
        large = both.join(least.hint("merge"), "a").where((b > a) & (b != F.col("m"))).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        now = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(a.alias("node"), b.alias("root")).union(now.select(b, b)).distinct()
