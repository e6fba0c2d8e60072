"""Graph views over the sample star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.plans.graph import PropertyGraph
from lattica.plans.ordering import with_ordinal


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(letter: str, column: str) -> Column:
    return F.concat(F.lit(f"{letter}:"), F.col(column).cast("string"))


def foreign_keys(spark: SparkSession, d: str) -> PropertyGraph:
    """Directed forest: region -> nation -> customer -> order, nation -> supplier; weight 1."""
    levels = [("region", "R", "r_regionkey", None, None), ("nation", "N", "n_nationkey", "R", "n_regionkey"), ("customer", "C", "c_custkey", "N", "c_nationkey"), ("supplier", "S", "s_suppkey", "N", "s_nationkey"), ("orders", "O", "o_orderkey", "C", "o_custkey")]
    nodes, edges = None, None
    for table, letter, key, up, ref in levels:
        t = read(spark, d, table)
        n = t.select(tagged(letter, key).alias("id"))
        nodes = n if nodes is None else nodes.union(n)
        if up:
            e = t.select(tagged(up, ref).alias("src"), tagged(letter, key).alias("dst"), F.lit(1.0).alias("weight"))
            edges = e if edges is None else edges.union(e)
    return PropertyGraph.of(nodes, edges)


def shipments(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight): quantity from supplier nation to customer nation, home trade left out."""
    line, orders = read(spark, d, "lineitem"), read(spark, d, "orders")
    flows = line.select("l_orderkey", "l_suppkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    flows = flows.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    flows = flows.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    total = flows.groupBy("s_nationkey", "c_nationkey").agg(F.sum("q").alias("weight")).filter("s_nationkey <> c_nationkey")
    return total.select(tagged("N", "s_nationkey").alias("src"), tagged("N", "c_nationkey").alias("dst"), "weight")


def nations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(tagged("N", "n_nationkey").alias("id"), F.col("n_name").alias("label"))


def trade(spark: SparkSession, d: str, partners: int | None = 3) -> PropertyGraph:
    """Directed: each nation's largest customers by quantity; all of them if partners is None."""
    top = shipments(spark, d)
    if partners is not None:
        w = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
        top = top.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= partners).drop("_r")
    return PropertyGraph.of(nations(spark, d), top).materialize()


def trade_both_ways(spark: SparkSession, d: str) -> PropertyGraph:
    """Undirected: quantity between two nations, both ways summed."""
    pairs = shipments(spark, d).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    return PropertyGraph.of(nations(spark, d), pairs, directed=False).materialize()


def handoff(spark: SparkSession, d: str) -> PropertyGraph:
    """Directed: from each event's user to the next event's user, weight = times."""
    events = with_ordinal(read(spark, d, "events").select("ts", "event_id", tagged("U", "user_id").alias("id")), [F.col("ts"), F.col("event_id")])
    nxt = events.select((F.col("ord") - 1).alias("ord"), F.col("id").alias("dst"))
    edges = events.select("ord", F.col("id").alias("src")).join(nxt, "ord").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return PropertyGraph.of(events.select("id").distinct(), edges)


def buyers(spark: SparkSession, d: str, flag: str | None = None) -> PropertyGraph:
    """Undirected: customers and the suppliers they bought from, weight = quantity."""
    line = read(spark, d, "lineitem")
    line = line.filter(F.col("l_returnflag") == flag) if flag else line
    pairs = line.select("l_orderkey", "l_suppkey", "l_quantity").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = pairs.groupBy(tagged("C", "o_custkey").alias("src"), tagged("S", "l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    c = read(spark, d, "customer")
    meta = F.from_json(F.to_json(F.struct(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))), "map<string,variant>")
    nodes = c.select(tagged("C", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("status"), meta.alias("meta"))
    suppliers = read(spark, d, "supplier").select(tagged("S", "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("").alias("status"), F.expr("CAST(map() AS map<string,variant>)").alias("meta"))
    return PropertyGraph.of(nodes.union(suppliers), edges, directed=False)


def order_chain(spark: SparkSession, d: str) -> PropertyGraph:
    """Directed chains: each customer's orders in time, weight = whole days between them."""
    o = read(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("pending")
    days = F.datediff(F.lead("o_orderdate").over(w), F.col("o_orderdate")).cast("double")
    edges = o.select(tagged("O", "o_orderkey").alias("src"), F.concat(F.lit("O:"), F.lead("o_orderkey").over(w).cast("string")).alias("dst"), days.alias("weight")).filter("dst IS NOT NULL")
    return PropertyGraph.of(o.select(tagged("O", "o_orderkey").alias("id"), status.alias("status")), edges)


def turns(spark: SparkSession, d: str) -> PropertyGraph:
    """Directed chains of conversation turns."""
    t = read(spark, d, "conversations").select("conv_id", "turn").distinct()
    name = F.format_string("T:%d:%d", F.col("conv_id"), F.col("turn"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = t.join(nxt, ["conv_id", "turn"]).select(name.alias("src"), F.format_string("T:%d:%d", F.col("conv_id"), F.col("turn") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    return PropertyGraph.of(t.select(name.alias("id")), edges)
