"""A property graph over the tables of a folder of Parquet files (customers, orders, parts, events, ...)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pathloom.sources.graph import PropertyGraph


def shop_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph ``shop``: its edges' end points all exist, so vertices of which nothing is asked aren't scanned."""

    def read(name: str):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    nation, customer, supplier, orders, lineitem, events = map(read, ("nation", "customer", "supplier", "orders", "lineitem", "events"))
    # a million turns a conversation, or an error
    turn = F.when(F.col("turn").between(0, (1 << 20) - 1), F.col("turn")).otherwise(F.raise_error(F.lit("a turn's number is out of range")).cast("int"))
    turns = read("conversations").withColumn("key", F.col("conv_id") * (1 << 20) + turn)
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    steps = turns.join(last, "conv_id").where(F.col("turn") < F.col("last"))
    k = F.col("n_nationkey")
    routes = nation.select(k.alias("a"), ((k + 1) % 25).alias("b")).unionAll(nation.select(k.alias("a"), ((7 * k + 3) % 25).alias("b")))
    routes = routes.withColumn("cost", (F.pmod(F.col("a") * 5 + F.col("b") * 3, F.lit(11)) + 1).cast("double"))
    g = PropertyGraph("shop", sound=True)
    g.add_vertices("Region", read("region"), "r_regionkey")
    g.add_vertices("Nation", nation, "n_nationkey")
    g.add_vertices("Customer", customer, "c_custkey")
    g.add_vertices("Supplier", supplier, "s_suppkey")
    g.add_vertices("Part", read("part"), "p_partkey")
    g.add_vertices("Purchase", orders, "o_orderkey")
    g.add_vertices("Doc", read("documents"), "doc_id")
    g.add_vertices("Turn", turns, "key", ["conv_id", "turn", "role"])
    g.add_vertices("Visitor", events.select("user_id").distinct(), "user_id")
    g.add_vertices("Event", events, "event_id")
    g.add_edges("in_region", nation, ("Nation", "n_nationkey"), ("Region", "n_regionkey"), key="n_nationkey", props=[])
    g.add_edges("lives_in", customer, ("Customer", "c_custkey"), ("Nation", "c_nationkey"), key="c_custkey", props=[])
    g.add_edges("based_in", supplier, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), key="s_suppkey", props=[])
    g.add_edges("placed", orders, ("Customer", "o_custkey"), ("Purchase", "o_orderkey"), key="o_orderkey", props=[])
    item = {"l_linenumber": "line", "l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_tax": "tax", "l_returnflag": "returnflag", "l_linestatus": "linestatus", "l_shipdate": "shipdate"}
    g.add_edges("contains", lineitem, ("Purchase", "l_orderkey"), ("Part", "l_partkey"), props=item)
    g.add_edges("shipped_by", lineitem, ("Purchase", "l_orderkey"), ("Supplier", "l_suppkey"), props={"l_quantity": "quantity"})
    g.add_edges("did", events, ("Visitor", "user_id"), ("Event", "event_id"), key="event_id", props=[])
    g.add_edges("next_turn", steps, ("Turn", "key"), ("Turn", F.col("key") + 1), key="key", props=[])
    g.add_edges("route", routes, ("Nation", "a"), ("Nation", "b"), key=F.col("a") * 64 + F.col("b"), props=["cost"])
    return g
