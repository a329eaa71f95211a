"""Projections of plain tables to temporal graphs. A projection is a description of columns; nothing is copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import NODE, NUM, STR
from .graph import Relation, TemporalGraph

DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def node_id(prefix: str, c: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def events(spark: SparkSession, sf_dir: str) -> Relation:
    """ev<i>: eventType, actor (u<i>), value, k; open intervals from ts, in microseconds."""
    df = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", '"k": (-?[0-9]+)', 1).try_cast("double")
    return Relation(df, node_id("ev", "event_id"), {"eventType": (STR, F.col("event_type")), "actor": (NODE, node_id("u", "user_id")), "value": (NUM, F.col("value")), "k": (NUM, k)}, micros("ts"), None, F.col("event_id"))


def orders(spark: SparkSession, sf_dir: str) -> Relation:
    """o<i>: placedBy (c<i>), status, total; from the first to the day after the last date of the order and its lines."""
    ships = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    df = table(spark, sf_dir, "orders").join(ships, "o_orderkey").withColumns({"first": F.least("o_orderdate", "lo"), "last": F.greatest("o_orderdate", "hi")})
    labels = {"placedBy": (NODE, node_id("c", "o_custkey")), "status": (STR, F.col("o_orderstatus")), "total": (NUM, F.col("o_totalprice"))}
    return Relation(df, node_id("o", "o_orderkey"), labels, micros("first"), micros("last") + DAY, F.col("o_orderkey"))


def customers(spark: SparkSession, sf_dir: str) -> Relation:
    """c<i>: segment, balance, nation (n<i>); always."""
    df = table(spark, sf_dir, "customer")
    return Relation(df, node_id("c", "c_custkey"), {"segment": (STR, F.col("c_mktsegment")), "balance": (NUM, F.col("c_acctbal")), "nation": (NODE, node_id("n", "c_nationkey"))}, F.lit(0).cast("bigint"), None, F.col("c_custkey"))


def visits(spark: SparkSession, sf_dir: str) -> Relation:
    """s<i>: kind, visitor (u<i>), k; an interval of one hour and k hours, cut to whole hours, so that intervals meet and coincide."""
    df = table(spark, sf_dir, "events").withColumn("hour", F.floor(micros("ts") / F.lit(3_600_000_000)).cast("bigint"))
    k = F.regexp_extract("props", '"k": (-?[0-9]+)', 1).try_cast("int")
    labels = {"kind": (STR, F.col("event_type")), "visitor": (NODE, node_id("u", "user_id"))}
    return Relation(df, node_id("s", "event_id"), labels, F.col("hour"), F.col("hour") + 1 + F.pmod(k, F.lit(5)), F.col("event_id"))


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev<i> causes ev<j>, the same user's next event, at the time of the first; as edges."""
    e = table(spark, sf_dir, "events")
    after = F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.withColumn("next", after).where("next IS NOT NULL")
    null = lambda t: F.lit(None).cast(t)
    return rows.select(F.col("event_id").alias("edge_seq"), node_id("ev", "event_id").alias("source"), F.lit("causes").alias("label"), F.lit(NODE).alias("rank"), node_id("ev", "next").alias("s"), null("double").alias("n"), null("boolean").alias("b"), micros("ts").alias("start_t"), null("bigint").alias("end_t"))


def branching_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """causes(), and "repeats" from an event to the same user's next one of the same type: an event may have two causes."""
    e = table(spark, sf_dir, "events")
    after = F.lead("event_id").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = e.withColumn("next", after).where("next IS NOT NULL")
    null = lambda t: F.lit(None).cast(t)
    again = rows.select(F.col("event_id").alias("edge_seq"), node_id("ev", "event_id").alias("source"), F.lit("repeats").alias("label"), F.lit(NODE).alias("rank"), node_id("ev", "next").alias("s"), null("double").alias("n"), null("boolean").alias("b"), micros("ts").alias("start_t"), null("bigint").alias("end_t"))
    return causes(spark, sf_dir).unionByName(again)


def event_graph(spark: SparkSession, sf_dir: str, now: int | None = None) -> TemporalGraph:
    return TemporalGraph(spark, now, None, (events(spark, sf_dir),))


def trade_graph(spark: SparkSession, sf_dir: str, now: int | None = None) -> TemporalGraph:
    return TemporalGraph(spark, now, None, (orders(spark, sf_dir), customers(spark, sf_dir)))


def visit_graph(spark: SparkSession, sf_dir: str, now: int | None = None) -> TemporalGraph:
    return TemporalGraph(spark, now, None, (visits(spark, sf_dir),))
