"""Queries of the incremental matcher: the events table is replayed, one machine a user, and its event log is queried.

Timestamps are distinct and in order, so that closed forms in SQL exist for ordinary patterns; those are the oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.projections import events, event_graph
from ..streaming import shards
from .batch_queries import CHAIN_SQL, E, chain, event, one
from .compose import choice, repeat_range
from .pattern import Pattern, PatternBuilder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 86_400_000_000


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The events' type and actor edges, routed to their actor: one row of the table gives both, without a join."""
    r = events(spark, d)
    parts = [replace(r, df=r.df.withColumn("shard", r.labels["actor"][1]), labels={x: r.labels[x]}) for x in ("eventType", "actor")]
    out = [p.df.select(p.labels["actor"][1].alias("shard") if "actor" in p.labels else F.col("shard"), F.struct(*_edge(p, i)).alias("x")).select("shard", "x.*") for i, p in enumerate(parts)]
    return out[0].unionByName(out[1])


def _edge(r, i: int) -> list:
    (label,) = r.labels
    v = r.value(label)
    return [(r.order() * 2 + i).alias("edge_seq"), r.source.alias("source"), F.lit(label).alias("label"), v.rank.cast("int").alias("rank"), v.s.alias("s"), v.n.alias("n"), v.b.alias("b"), r.starts().alias("start_t"), r.ends().alias("end_t")]


def day(t: int) -> int:
    return t // DAY


def log(patterns: list[Pattern], ticks: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: shards.replay(edges(spark, d), patterns, day if ticks else None)


GUARDED = chain("guarded", "signup", "view", "purchase").unless_between("e1", "e3").edge("x", "eventType", "error").bind("x", "actor", "actor").done().build()
AFTER = chain("after", "signup", "purchase").unless_after("e1").edge("x", "eventType", "error").bind("x", "actor", "actor").done().build()
PAIR = chain("pair", "signup", "purchase").build()
NO_ERROR = "NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'error' AND n.t > a.t AND n.t < {}.t)"
THREE = ["e1", "e2", "e3"]


def spans(spark: SparkSession, d: str, patterns: list[Pattern], *anchors: str) -> DataFrame:
    return shards.completed(edges(spark, d), patterns, list(anchors)).select(F.col("shard").alias("actor"), *anchors)


@query("inc_completed", f"WITH {E} SELECT a.u AS actor, a.t AS e1, b.t AS e2, c.t AS e3 {CHAIN_SQL} AND {NO_ERROR.format('c')}")
def _(spark, d):
    return spans(spark, d, [GUARDED], *THREE)


@query("inc_completed_unless_after", f"WITH {E} SELECT a.u AS actor, a.t AS e1, b.t AS e2 FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'purchase' AND a.t < b.t AND {NO_ERROR.format('b')}")
def _(spark, d):
    return spans(spark, d, [AFTER], "e1", "e2")


@query("inc_advanced_counts", f"WITH {E} SELECT stage_index, count(*) AS n FROM (SELECT 0 AS stage_index FROM e WHERE y = 'signup' UNION ALL SELECT 1 FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'view' AND a.t < b.t AND {NO_ERROR.format('b')}) GROUP BY 1")
def _(spark, d):
    return log([GUARDED])(spark, d).where("kind = 'advanced'").groupBy("stage_index").agg(F.count(F.lit(1)).alias("n"))


@query(
    "inc_negated",
    f"""WITH {E}, p AS (SELECT a.u, a.t AS e1, NULL AS e2, a.t AS last FROM e a WHERE y = 'signup' UNION ALL SELECT a.u, a.t, b.t, b.t FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'view' AND a.t < b.t AND {NO_ERROR.format('b')})
SELECT p.u AS actor, e1, coalesce(e2, -1) AS e2, min(n.t) AS at FROM p JOIN e n ON n.u = p.u AND n.y = 'error' AND n.t > p.last GROUP BY p.u, e1, e2""",
)
def _(spark, d):
    return log([GUARDED])(spark, d).where("kind = 'negated'").select(F.col("shard").alias("actor"), F.col("starts")["e1"].alias("e1"), F.coalesce(F.col("starts")["e2"], F.lit(-1)).alias("e2"), "at")


@query(
    "inc_expired",
    f"""WITH {E}, x AS (SELECT *, t // {DAY} AS d FROM e WHERE y = 'signup')
SELECT u AS actor, t AS e1, d + 2 AS tick FROM x WHERE y = 'signup' AND d + 3 <= (SELECT max(t // {DAY}) FROM e)""",
)
def _(spark, d):
    p = replace(PAIR, deadline=2)
    return log([p], True)(spark, d).where("kind = 'expired'").select(F.col("shard").alias("actor"), F.col("starts")["e1"].alias("e1"), "tick")


def _repeat(least: int, most: int | None) -> Pattern:
    return repeat_range("again", one("error"), least, most, ["who"])


@query(
    "inc_repeat_range",
    f"""WITH {E}, r AS (SELECT u, t, row_number() OVER (PARTITION BY u ORDER BY t) AS i FROM e WHERE y = 'error'), p AS (SELECT a.u, a.t AS first_e, b.t AS last_e, b.i - a.i + 1 AS m FROM r a JOIN r b ON a.u = b.u AND a.i < b.i)
SELECT u AS actor, first_e, last_e, k::BIGINT AS reps FROM (SELECT *, unnest(range(3, least(m, 5) + 1)) AS k FROM p WHERE m >= 3)""",
)
def _(spark, d):
    out = shards.completed(edges(spark, d), [_repeat(3, 5)], ["first_e", "last_e"])
    return out.select(F.col("shard").alias("actor"), "first_e", "last_e", F.col("reps").cast("bigint").alias("reps"))


@query("inc_tick_delta", f"WITH {E}, c AS (SELECT b.t // {DAY} AS tick, 'pair' AS p FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'purchase' AND a.t < b.t UNION SELECT t // {DAY}, 'solo' FROM e WHERE y = 'view'), x AS (SELECT DISTINCT t // {DAY} AS tick FROM e WHERE y = 'signup') SELECT tick, coalesce(string_agg(p, ',' ORDER BY p), '') AS completed, bool_or(x.tick IS NOT NULL) AS advanced FROM c FULL JOIN x USING (tick) GROUP BY tick")
def _(spark, d):
    out = shards.tick_deltas(log([PAIR, chain("solo", "view").build()], True)(spark, d))
    return out.select("tick", F.array_join("completed", ",").alias("completed"), F.array_contains("advanced", "pair").alias("advanced"))


@query(
    "inc_metrics",
    f"""WITH {E} SELECT 'guarded' AS pattern, (SELECT count(*) FROM e WHERE y = 'signup') + (SELECT count(*) FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'view' AND a.t < b.t AND {NO_ERROR.format('b')}) AS advanced,
 (SELECT count(*) {CHAIN_SQL} AND {NO_ERROR.format('c')}) AS completed
UNION ALL SELECT 'pair', (SELECT count(*) FROM e WHERE y = 'signup'), (SELECT count(*) FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'purchase' AND a.t < b.t)""",
)
def _(spark, d):
    return shards.metrics(log([GUARDED, PAIR])(spark, d)).select("pattern", "advanced", "completed")


@query("inc_advance_in_place", f"WITH {E} SELECT a.u AS actor, a.t AS e1, min(b.t) AS e2 FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'purchase' AND a.t < b.t GROUP BY a.u, a.t")
def _(spark, d):
    return spans(spark, d, [replace(PAIR, advance_in_place=True)], "e1", "e2")


@query("inc_concurrent_group", f"WITH {E} SELECT a.u AS actor, a.t AS e1, b.t AS e2, c.t AS e3 FROM e a JOIN e b ON a.u = b.u JOIN e c ON a.u = c.u WHERE a.y = 'signup' AND b.y = 'view' AND c.y = 'purchase' AND a.t < c.t AND b.t < c.t")
def _(spark, d):
    p = chain("c", "signup", "view", "purchase").mark_unordered([0, 1]).build()
    return spans(spark, d, [p], *THREE)


@query(
    "inc_exclusive_group",
    f"""WITH RECURSIVE {E}, o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t) AS i FROM e),
w AS (SELECT u, 0::BIGINT AS i, [0]::BIGINT[] AS s, [0]::BIGINT[] AS v, NULL::BIGINT AS t, CAST([] AS BIGINT[]) AS done FROM (SELECT DISTINCT u FROM o)
 UNION ALL SELECT w.u, o.i, CASE o.y WHEN 'signup' THEN list_append(w.s, o.t) WHEN 'purchase' THEN w.s[1:1] WHEN 'click' THEN CASE WHEN len(w.v) > 1 THEN w.s[1:1] ELSE w.s END ELSE w.s END,
  CASE o.y WHEN 'view' THEN list_append(w.v, o.t) WHEN 'click' THEN w.v[1:1] WHEN 'purchase' THEN CASE WHEN len(w.s) > 1 THEN w.v[1:1] ELSE w.v END ELSE w.v END, o.t,
  CASE o.y WHEN 'purchase' THEN w.s[2:] WHEN 'click' THEN w.v[2:] ELSE CAST([] AS BIGINT[]) END
 FROM w JOIN o ON o.u = w.u AND o.i = w.i + 1)
SELECT u AS actor, unnest(done) AS e1, t AS e2 FROM w WHERE len(done) > 0""",
)
def _(spark, d):
    """Pairs of one exclusive group: a completion ends what is open in the group."""
    ps = choice("either", [chain("bought", "signup", "purchase").build(), chain("looked", "view", "click").build()])
    return spans(spark, d, ps, "e1", "e2")


@query("inc_stale", f"WITH {E}, l AS (SELECT max(t // {DAY}) AS last FROM e), x AS (SELECT u, max(t // {DAY}) AS moved FROM e WHERE y = 'signup' GROUP BY u) SELECT u AS actor, 'pair' AS pattern FROM x, l WHERE last - moved >= 2")
def _(spark, d):
    """Patterns with open runs that did not advance for two ticks or more, by the table's last tick."""
    out = shards.report(edges(spark, d), [PAIR], day, "pattern string", lambda m: [(x,) for x in m.stale(2)])
    return out.select(F.col("shard").alias("actor"), "pattern")


@query(
    "inc_stalled_ticks",
    f"""WITH {E}, l AS (SELECT max(t // {DAY}) AS last FROM e), f AS (SELECT u, min(t // {DAY}) AS first FROM e GROUP BY u), k AS (SELECT u, unnest(range(first + 1, last + 1)) AS tick FROM f, l),
z AS (SELECT k.u, tick, max(e.t // {DAY}) AS moved FROM k JOIN e ON e.u = k.u AND e.y = 'signup' AND e.t // {DAY} < tick GROUP BY ALL) SELECT tick, count(*) AS stalled FROM z WHERE tick - moved >= 2 GROUP BY tick""",
)
def _(spark, d):
    """In how many shards a pattern is stalled after each tick."""
    out = shards.ticks(edges(spark, d), [PAIR], day, 2).where(F.array_contains("stalled", "pair"))
    return out.groupBy("tick").agg(F.count(F.lit(1)).alias("stalled"))


@query(
    "inc_plant_status",
    f"""WITH {E}, l AS (SELECT max(t // {DAY}) AS last FROM e), c AS (SELECT u, count(*) AS n FROM e WHERE y = 'purchase' GROUP BY u), p AS (SELECT u, count(*) AS n, max(t // {DAY}) AS moved FROM e WHERE y = 'signup' GROUP BY u),
q AS (SELECT b.u, max(b.t // {DAY}) AS moved FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'click' AND a.t < b.t GROUP BY b.u)
SELECT p.u AS actor, p.n AS plants, coalesce(c.n, 0) AS payoffs, last - greatest(p.moved, coalesce(q.moved, p.moved)) AS idle, last - greatest(p.moved, coalesce(q.moved, p.moved)) >= 2 AS stale FROM p CROSS JOIN l LEFT JOIN c USING (u) LEFT JOIN q USING (u)""",
)
def _(spark, d):
    """A set-up (signup, awaiting a click) and its pay-off (a purchase): what the matcher says of the pair by user."""
    from ..streaming.machine import Machine

    def of(m: Machine) -> list[tuple]:
        m.register_pair("deal", "plant", "payoff")
        return [(x["active_plants"], x["payoffs"], x["ticks_since_advance"], x["stale"]) for x in m.plant_status(2) if x["active_plants"]]

    out = shards.report(edges(spark, d), [chain("plant", "signup", "click").build(), chain("payoff", "purchase").build()], day, "plants long, payoffs long, idle long, stale boolean", of)
    return out.withColumnRenamed("shard", "actor")


@query("inc_equals_batch", f"WITH {E} SELECT count(*) AS batch, count(*) AS incremental, 0 AS apart FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'purchase' AND a.t < b.t")
def _(spark, d):
    """One pattern in both ways."""
    from .batch import find

    batch = find(event_graph(spark, d), PAIR).select(F.col("actor.s").alias("actor"), F.col("e1__start").alias("e1"), F.col("e2__start").alias("e2"))
    inc = spans(spark, d, [PAIR], "e1", "e2")
    both = batch.withColumn("w", F.lit("b")).unionByName(inc.withColumn("w", F.lit("i"))).groupBy("actor", "e1", "e2").agg(F.count(F.when(F.col("w") == "b", 1)).alias("b"), F.count(F.when(F.col("w") == "i", 1)).alias("i"))
    return both.agg(F.sum("b").alias("batch"), F.sum("i").alias("incremental"), F.count(F.when(F.col("b") != F.col("i"), 1)).alias("apart"))


__all__ = ["PatternBuilder", "event"]
