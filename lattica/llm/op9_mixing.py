"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import park, table, text_of, unique_rows

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3


def running(df: DataFrame, order: list[Column], value: str, out: str, within: list[str]) -> DataFrame:
    """Adds exact running sums of the whole-number column ``value`` over the global order.

    Rows are range-partitioned by ``within`` and ``order``; each range sums its own rows
    and the totals of the ranges before it come from a table of one row per range and
    group, so no task sees more than a range even when one group holds most rows. The
    ranged rows are parked: sampling range bounds twice could give two partitionings.
    """
    keys = [F.col(c) for c in within] + order
    ranged = park(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*within, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    local = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("_local", F.sum(value).over(local)).join(offsets, [*within, "_range"]).withColumn(out, F.col("_offset") + F.col("_local")).drop("_offset", "_local", "_range")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(source, rank, source_size, target): one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating, and share the
    total size; what a source cannot take at ``repeats`` times its size is reshared by
    weight until none is above. That end state is target = min(repeats * size, level *
    weight) for the one level at which the targets sum to the total.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = park(per.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size")), "sources")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    total = per.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    if total.t is None:
        return per.select("source", "rank", "source_size", F.lit(0.0).alias("target"))
    steps = per.select((F.col("cap") / F.col("weight")).alias("ratio"), F.sum("cap").over(by_ratio).alias("capped"), F.sum("weight").over(by_ratio).alias("used"))
    full = steps.filter(F.col("capped") + F.col("ratio") * (total.w - F.col("used")) <= total.t)
    at = full.agg(F.coalesce(F.max("capped"), F.lit(0)).alias("capped"), F.coalesce(F.max("used"), F.lit(0)).alias("used")).first()
    level = (total.t - at.capped) / (total.w - at.used) if total.w > at.used else float("inf")
    return per.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as ``mix`` takes it, with all columns of ``docs``."""
    th = F.xxhash64(text_of().cast("binary"))
    taken = park(mix(docs.withColumn("th", th), carry=("th",)).filter("copies > 0").groupBy("doc_id", "th").agg(F.sum("copies").alias("_n")), "taken")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"))
    wanted = taken.withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t")
    found = unique_rows(docs, ids).withColumn("_th", th).join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")))
    return found.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes: whole documents, up to ``repeats`` times.

    Each source queues its documents in a fixed shuffled order, again and again. A copy's
    virtual time is the source's words up to its middle word divided by the source's
    target, so a source is never off by more than half a document. All copies are sorted
    by virtual time and taken up to the total budget.

    Null texts and texts without words have size 0 and are taken 0 times; a null source is
    a source; repeated rows are separate documents; null doc_ids are kept; an empty table
    gives no rows; extra columns are ignored but for those in ``carry``. Columns: doc_id, size,
    source_size, target, taken, copies.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text_of(), F.lit(WORDS)).cast("long").alias("size"), *carry)
    rows = park(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    targets = source_targets(rows, weights, repeats)
    known = rows.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s", "source")
    known = park(known.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "mix-known")
    shuffled = [F.col("key"), F.col("size"), F.col("row")]
    queue = running(known.filter(F.col("size") > 0), shuffled, "size", "served", ["rank"])
    turns = F.ceil(F.col("target") / F.col("source_size")).cast("int")
    copies = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), F.greatest(F.least(turns, F.lit(repeats)) - 1, F.lit(0)))))
    copies = copies.withColumn("time", (F.col("turn") * F.col("source_size") + F.col("served") - F.col("size") / 2) / F.col("target"))
    lined = running(copies.select("row", "rank", "key", "size", "turn", "time"), [F.col("time"), F.col("rank"), *shuffled, F.col("turn")], "size", "spent", [])
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first().t
    taken = lined.filter(F.col("spent") - F.col("size") / 2 <= budget).groupBy("row").agg(F.count("*").alias("n"))
    out = known.join(taken, "row", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.cast("int").alias("copies"), *carry)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def oracle(documents: str = "documents") -> str:
    """CTEs ending in ``mixed`` (doc_id, row, source, text, size, source_size, target, n)."""
    return f"""
d0 AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS row, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {documents}),
p0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d0 GROUP BY source),
p1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM p0),
p2 AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 AS INTEGER) + 1] AS weight, 3 * source_size AS cap FROM p1),
tot AS (SELECT CAST(sum(source_size) AS BIGINT) AS t, CAST(sum(weight) AS BIGINT) AS w FROM p2),
st AS (SELECT cap / weight AS ratio, sum(cap) OVER o AS capped, sum(weight) OVER o AS used FROM p2 WINDOW o AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT CAST(coalesce(max(capped), 0) AS BIGINT) AS capped, CAST(coalesce(max(used), 0) AS BIGINT) AS used FROM st, tot WHERE capped + ratio * (w - used) <= t),
tg AS (SELECT source, rank, source_size, least(CAST(cap AS DOUBLE), (t - capped) / (w - used) * weight) AS target FROM p2, tot, lv),
kn AS (SELECT d0.*, rank, source_size, target, md5(CAST(doc_id AS VARCHAR)) AS key FROM d0 JOIN tg ON d0.source IS NOT DISTINCT FROM tg.source),
qu AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rank ORDER BY key, size, row ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served FROM kn WHERE size > 0),
cp AS (SELECT *, (turn * source_size + served - size / 2) / target AS time FROM (SELECT *, unnest(range(greatest(least(CAST(ceil(target / source_size) AS BIGINT), 3), 1))) AS turn FROM qu)),
ln AS (SELECT row, size, CAST(sum(size) OVER (ORDER BY time, rank, key, size, row, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM cp),
tk AS (SELECT row, count(*) AS n FROM ln, tot WHERE spent - size / 2 <= t GROUP BY row),
mixed AS (SELECT kn.*, coalesce(n, 0) AS n FROM kn LEFT JOIN tk USING (row))"""


ORACLE = "WITH" + oracle() + "\nSELECT doc_id, size, source_size, target, n * size AS taken FROM mixed"
QUERIES, ORACLE_SQL = {"op9_mixing": op9_mixing}, {"op9_mixing": ORACLE}
