"""Path searches as loops over DataFrames: a frontier joins the hops, until nothing new is found.

Each step writes what is new, and only that, to the shared folder. What has been settled before is read back without the
paths, and put together into one table every few steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.lang.errors import BindError
from pathloom.plans.durable import counted, discard, durable

#: Written steps that are put together into one table; steps after which reachability begins to take shortcuts; how many
#: times as many as hops these may be.
TOGETHER, PATIENCE, SHORTCUTS = 8, 12, 4


class Settled:
    """What the steps have found so far, of some columns, as few tables; with ``alone`` nothing else reads them later."""

    def __init__(self, columns: list[str], alone: bool):
        self.columns, self.alone, self.parts, self.first_is_own = columns, alone, [], False

    def add(self, step: DataFrame) -> None:
        self.parts.append(step.select(*self.columns))

    def table(self) -> DataFrame:
        if len(self.parts) > TOGETHER:
            *old, last = self.parts  # the last is the next step's frontier
            self.parts = [durable(reduce(DataFrame.unionAll, old)), last]
            for x in old if self.alone else old[: self.first_is_own]:
                discard(x)
            self.first_is_own = True
        return reduce(DataFrame.unionAll, self.parts)


def _onwards(pairs: DataFrame, hops: DataFrame) -> DataFrame:
    return pairs.join(hops, F.col("node") == F.col("from")).select("root", F.col("to").alias("node")).distinct()


def reachable(hops: DataFrame, seeds: DataFrame, low: int, high: int | None) -> DataFrame:
    """(root, node): nodes that a walk of ``low`` to ``high`` hops leads to. ``hops``: (from, to); ``seeds``: (root).

    Where the search goes on for long, walks of two, four, eight, ... hops are added to the hops as shortcuts, so that a
    chain takes steps by the logarithm of its length. Shortcuts end where they become many more than the hops.
    """
    hops, n_hops = counted(hops.select("from", "to").distinct())
    start = seeds.select("root", F.col("root").alias("node")).distinct()
    for _ in range(low):  # exactly so many hops
        start, n = counted(_onwards(start, hops))
        if not n:
            return start
    seen, frontier = Settled(["root", "node"], True), start
    seen.add(start)
    longest, all_hops, step, doubling = hops, hops, 0, high is None
    while high is None or step < high - low:
        step += 1
        if step > PATIENCE and doubling:
            ways_in, ways_out = longest.groupBy("to").agg(F.count(F.lit(1)).alias("i")), longest.groupBy("from").agg(F.count(F.lit(1)).alias("o"))
            ways = ways_in.join(ways_out, F.col("to") == F.col("from")).agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0
            doubling = 0 < ways <= SHORTCUTS * n_hops
            if doubling:
                longest = durable(longest.join(longest.toDF("f", "t"), F.col("to") == F.col("f")).select("from", F.col("t").alias("to")).distinct())
                all_hops = all_hops.unionAll(longest)
                frontier = seen.table()  # earlier ones can go further now
        new, n = counted(_onwards(frontier, all_hops).join(seen.table(), ["root", "node"], "left_anti"))
        if not n:
            break
        seen.add(new)
        frontier = new
    return seen.table()


def _extend(frontier: DataFrame, hops: DataFrame) -> DataFrame:
    return frontier.join(hops, F.col("node") == F.col("from")).select(
        "root", F.col("to").alias("node"), (F.col("n") + 1).alias("n"), (F.col("cost") + F.col("hop_cost")).alias("cost"),
        F.concat("ids", F.array("hop_id")).alias("ids"), F.concat("path", F.array("hop")).alias("path"),
    )


def _start(seeds: DataFrame, hops: DataFrame) -> DataFrame:
    kinds = {c: hops.schema[c].dataType.simpleString() for c in ("hop", "hop_cost", "hop_id")}
    return seeds.select(
        "root", F.col("root").alias("node"), F.lit(0).alias("n"), F.lit(0).cast(kinds["hop_cost"]).alias("cost"),
        F.array().cast(f"array<{kinds['hop_id']}>").alias("ids"), F.array().cast(f"array<{kinds['hop']}>").alias("path"),
    )


def all_walks(hops: DataFrame, seeds: DataFrame, low: int, high: int | None) -> DataFrame:
    """(root, node, n, cost, ids, path): every walk of ``low`` to ``high`` hops; the upper bound must be given."""
    if high is None:
        raise BindError("ALL needs an upper bound of the number of hops")
    at = _start(seeds, hops)
    out = at if low == 0 else None
    for n in range(1, high + 1):
        at = _extend(at, hops)
        if high > 3:
            at, found = counted(at)
            if not found:
                break
        if n >= low:
            out = at if out is None else out.unionAll(at)
    return out if out is not None else at.limit(0)


def best_walks(hops: DataFrame, seeds: DataFrame, low: int, high: int | None, k: int, by_cost: bool) -> DataFrame:
    """(root, node, n, cost, ids, path): for each (root, node) the ``k`` best walks, or with k = 0 all the best ones.

    Best: least cost, then fewest hops, then the ids along the walk; with k = 0 ties in cost (without ``by_cost``: in
    hops) all stay. A walk's prefix to a node is among the best of its state there, so only those are extended: the state
    is the node and the number of hops as far as the bounds make it matter (all of it for costs under an upper bound).
    A step's walks have more hops than all before, so the settled ones' cost and number tell which new ones count.
    """
    if by_cost:
        low_cost = hops.agg(F.min("hop_cost").alias("least"), F.count_if(F.col("hop_cost").isNull()).alias("none")).first()
        if low_cost["least"] is not None and low_cost["least"] < 0:
            raise BindError("the cost of a hop is negative")
        if low_cost["none"]:
            raise BindError("the cost of a hop is null")
    else:
        hops = hops.withColumn("hop_cost", F.lit(1).cast("long"))
    state: Column = F.col("n") if by_cost and high is not None else F.least("n", F.lit(low))
    keys = ["root", "node", "state"]

    def best(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys)
        if k == 0:
            return df.withColumn("_r", F.rank().over(w.orderBy("cost"))).where("_r = 1").drop("_r")
        return df.withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") <= k).drop("_r")

    columns = [*keys, "n", "cost", "ids", "path"]
    frontier = durable(_start(seeds, hops).withColumn("state", state).select(*columns))
    steps, settled = [frontier], Settled([*keys, "n", "cost"], False)
    settled.add(frontier)
    step, nodes = 0, None
    while high is None or step < high:
        step += 1
        if by_cost and k == 0 and high is None and step >= 64 and step & step - 1 == 0:
            # a cheapest walk of more hops than there are nodes holds a cycle, which costs nothing
            nodes = nodes or hops.select("from").unionAll(hops.select("to")).distinct().count()
            if step > nodes + low + 1:
                raise BindError("ALL CHEAPEST: a cycle costs nothing, so there is no end of walks")
        new = _extend(frontier, hops).withColumn("state", state).select(*columns)
        old = settled.table().select("*", *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in ("ids", "path")])
        both = best(new.withColumn("_new", F.lit(True)).unionAll(old.withColumn("_new", F.lit(False))), keys, ["cost", "n", "ids"])
        frontier, found = counted(both.where("_new").drop("_new"))
        if not found:
            break
        steps.append(frontier)
        settled.add(frontier)
    kept = reduce(DataFrame.unionAll, steps).where(F.col("n") >= low)
    return best(kept, ["root", "node"], ["cost", "n", "ids"]).drop("state")
