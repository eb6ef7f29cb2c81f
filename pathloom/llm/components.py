"""Connected components of a graph of links: alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import discard, durable

#: Keys with more than this part of all rows are joined by broadcast; there are less than HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``small`` (one row a key, n: how many of the ``total`` rows have it), without n: rows of a hot
    key stay where they are, the others meet by shuffle."""
    hot = F.col("n") * HOT > total
    few = F.broadcast(small.where(hot).drop("n"))
    rest = rows.join(few.select(key), key, "left_anti").join(small.where(~hot).drop("n"), key)
    return rows.join(few, key).unionAll(rest)


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that it is linked with, over any number of links) for each node that has a link.

    ``links``: two columns of one orderable type; direction, order and repeats don't matter; nulls and self-links are
    dropped. Each step's result is written to the shared folder, so a lost executor costs one step at most. A node's
    stars are reduced by min() with partial aggregation, and hubs are joined by broadcast: nodes with many links do no
    harm. The number of rounds grows with the logarithm of the longest chain, and has no limit.
    """
    a, b = links.columns
    edges = durable(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    total, state = edges.count(), None
    while True:
        # large star: every neighbour above a node, to the least of the node and its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_hot(both.where(F.col("v") > F.col("u")), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large)
        # small star: every neighbour below a node and the node itself, to the least of them
        low = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_hot(large, low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = durable(small)
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for used in (edges, least, large, low):
            discard(used)
        edges, total = new, now[0]
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
