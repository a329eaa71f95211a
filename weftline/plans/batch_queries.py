"""Queries of the batch engine over the projected tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.values import NODE, STR, Node, Parts, compare_literal
from ..sources.graph import Relation, TemporalGraph, end_latest, explode_tags, upsert_history
from ..sources.projections import customers, event_graph, micros, node_id, table, trade_graph, visit_graph
from . import gap
from .batch import evaluate, find, first
from .compose import choice, repeat, repeat_range, sequence
from .pattern import Lit, Op, Pattern, PatternBuilder, Ref

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E = """e AS (SELECT 'ev' || event_id AS id, event_id, 'u' || user_id AS u, event_type AS y, value AS v, epoch_us(ts) AS t,
  TRY_CAST(regexp_extract(props, '"k": (-?[0-9]+)', 1) AS DOUBLE) AS k FROM events)"""
S = """s AS (SELECT 's' || event_id AS id, 'u' || user_id AS u, event_type AS y, epoch_us(ts) // 3600000000 AS a,
  epoch_us(ts) // 3600000000 + 1 + CAST(regexp_extract(props, '"k": (-?[0-9]+)', 1) AS INT) % 5 AS b FROM events)"""
O = """l AS (SELECT l_orderkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1),
o AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS c, o_orderstatus AS st, o_totalprice AS p,
  epoch_us(least(o_orderdate, lo)) AS a, epoch_us(greatest(o_orderdate, hi)) + 86400000000 AS b FROM orders JOIN l ON l_orderkey = o_orderkey)"""


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def event(b: PatternBuilder, anchor: str, kind: str, actor: str | None = "actor", **binds: str) -> PatternBuilder:
    s = b.stage(anchor).edge(anchor, "eventType", kind)
    if actor:
        s = s.bind(anchor, "actor", actor)
    for label, var in binds.items():
        s = s.bind(anchor, label, var)
    return s.done()


def chain(name: str, *kinds: str, actor: str | None = "actor") -> PatternBuilder:
    b = PatternBuilder(name)
    for i, k in enumerate(kinds):
        b = event(b, f"e{i + 1}", k, actor)
    return b


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Node or string variables by their text, numbers as numbers: a name that begins with # is a number."""
    return df.select(*[F.col(n[1:])["n"].alias(n[1:]) if n[0] == "#" else F.col(n)["s"].alias(n) for n in names])


def on_events(p: Pattern, *names: str, **how) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: flat(find(event_graph(spark, d), p, **how), *names)


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# flagship
FLAGSHIP = chain("flagship", "signup", "view", "purchase").unless_between("e1", "e3").edge("x", "eventType", "error").bind("x", "actor", "actor").done().build()
CHAIN_SQL = "FROM e a JOIN e b ON a.u = b.u JOIN e c ON a.u = c.u WHERE a.y = 'signup' AND b.y = 'view' AND c.y = 'purchase' AND a.t < b.t AND b.t < c.t"
IDS3 = "SELECT a.id AS e1, b.id AS e2, c.id AS e3, a.u AS actor"
NO_ERROR = "AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'error' AND n.t > a.t AND n.t < c.t)"
query("flagship", f"WITH {E} {IDS3} {CHAIN_SQL} {NO_ERROR}")(on_events(FLAGSHIP, "e1", "e2", "e3", "actor"))
query("unless_between", f"WITH {E} {IDS3} {CHAIN_SQL} {NO_ERROR}")(on_events(FLAGSHIP, "e1", "e2", "e3", "actor"))
query("three_stage_chain", f"WITH {E} {IDS3} {CHAIN_SQL}")(on_events(chain("c", "signup", "view", "purchase").build(), "e1", "e2", "e3", "actor"))
TWO = "FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND b.y = 'purchase' AND a.t < b.t"
query("two_stage_join", f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.u AS actor {TWO}")(on_events(chain("c", "signup", "purchase").build(), "e1", "e2", "actor"))
query("single_stage", f"WITH {E} SELECT id AS e1, u AS actor FROM e WHERE y = 'purchase'")(on_events(chain("c", "purchase").build(), "e1", "actor"))
query("unless_after", f"WITH {E} {IDS3} {CHAIN_SQL} AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'error' AND n.t > a.t)")(
    on_events(chain("c", "signup", "view", "purchase").unless_after("e1").edge("x", "eventType", "error").bind("x", "actor", "actor").done().build(), "e1", "e2", "e3", "actor")
)
query("unless_global", f"WITH {E} {IDS3} {CHAIN_SQL} {NO_ERROR}")(on_events(chain("c", "signup", "view", "purchase").unless_global().edge("x", "eventType", "error").bind("x", "actor", "actor").done().build(), "e1", "e2", "e3", "actor"))
query("unless_global_single_stage", f"WITH {E} SELECT a.id AS e1, a.u AS actor FROM e a WHERE y = 'purchase' AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'error' AND n.t > a.t)")(
    on_events(chain("c", "purchase").unless_global().edge("x", "eventType", "error").bind("x", "actor", "actor").done().build(), "e1", "actor")
)
query("double_window", f"WITH {E} {IDS3} {CHAIN_SQL} AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'error' AND n.t > a.t AND n.t < b.t) AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'click' AND n.t > b.t AND n.t < c.t)")(
    on_events(chain("c", "signup", "view", "purchase").unless_between("e1", "e2").edge("x", "eventType", "error").bind("x", "actor", "actor").done().unless_between("e2", "e3").edge("x", "eventType", "click").bind("x", "actor", "actor").done().build(), "e1", "e2", "e3", "actor")
)
query("neg_multi_clause", f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.u AS actor {TWO} AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'error' AND n.v > 50 AND n.t > a.t AND n.t < b.t)")(
    on_events(chain("c", "signup", "purchase").unless_between("e1", "e2").edge("x", "eventType", "error").where("x", "value", ">", 50).bind("x", "actor", "actor").done().build(), "e1", "e2", "actor")
)
query("neg_boundary_exclusive", f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.u AS actor {TWO} AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y IN ('signup', 'purchase') AND n.t > a.t AND n.t < b.t)")(
    on_events(chain("c", "signup", "purchase").unless_between("e1", "e2").where("x", "eventType", "in", "signup", "purchase").bind("x", "actor", "actor").done().build(), "e1", "e2", "actor")
)


def _neg_var(spark: SparkSession, d: str) -> DataFrame:
    b = event(PatternBuilder("c"), "e1", "signup", value="v")
    n = event(b, "e2", "purchase").unless_between("e1", "e2").edge("x", "eventType", "view").bind("x", "actor", "actor")
    n._add("x", "value", _var(">", "v"))
    return flat(find(event_graph(spark, d), n.done().build()), "e1", "e2", "actor")


def _var(op: str, var: str):
    from .pattern import Constraint

    return Constraint(op + "?", var=var)


query("neg_var_constraint", f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.u AS actor {TWO} AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'view' AND n.v > a.v AND n.t > a.t AND n.t < b.t)")(_neg_var)

# constraints
for _name, _how, _sql in (
    ("c_eq", ("=", 12.31), "v = 12.31"),
    ("c_lt", ("<", 5), "v < 5"),
    ("c_gt", (">", 200), "v > 200"),
    ("c_lte", ("<=", 5), "v <= 5"),
    ("c_gte", (">=", 200), "v >= 200"),
    ("c_between", ("between", 50, 60), "v BETWEEN 50 AND 60"),
    ("c_any", ("any",), "true"),
    ("c_one_of", ("in", 12.31, 20, 30.5, "x"), "v IN (12.31, 20, 30.5)"),
):
    query(_name, f"WITH {E} SELECT id AS e1, v AS x FROM e WHERE y = 'click' AND {_sql}")(
        on_events(PatternBuilder("c").stage("e1").edge("e1", "eventType", "click").where("e1", "value", *_how).bind("e1", "value", "x").done().build(), "e1", "#x")
    )


@query("c_cross_variant_lt", f"WITH {E} SELECT label, count(*) AS n FROM (SELECT 'actor' AS label FROM e UNION ALL SELECT 'eventType' FROM e UNION ALL SELECT 'value' FROM e WHERE v < 50 UNION ALL SELECT 'k' FROM e WHERE k < 50) GROUP BY label")
def _(spark, d):
    return counted(event_graph(spark, d).edges().where(compare_literal("<", Parts.edge(), 50.0)), "label")


@query("c_nan_guard", f"WITH {E} SELECT y, count(*) AS n FROM e WHERE v < 50 AND v <> 25 AND k <> 7 GROUP BY y")
def _(spark, d):
    """Values with k = 7 are made NaN first: nothing compares with them."""
    df = table(spark, d, "events")
    k = F.regexp_extract("props", '"k": (-?[0-9]+)', 1)
    r = Relation(df, node_id("ev", "event_id"), {"eventType": (STR, F.col("event_type")), "v": (2, F.when(k == "7", F.lit(float("nan"))).otherwise(F.col("value")))}, micros("ts"))
    p = PatternBuilder("c").stage("e").bind("e", "eventType", "y").where("e", "v", "<", 50).where("e", "v", "any").done().build()
    out = find(TemporalGraph(spark, None, None, (r,)), p).select(F.col("y.s").alias("y"), "e")
    same = find(TemporalGraph(spark, None, None, (r,)), PatternBuilder("c").stage("e").bind("e", "eventType", "y").edge("e", "v", 25).done().build()).select("e")
    return counted(out.join(same, "e", "left_anti"), "y")


# cross-stage constraints and lets
for _name, _op in (("x_eq_var", "="), ("x_lt_var", "<"), ("x_gt_var", ">"), ("x_lte_var", "<="), ("x_gte_var", ">=")):
    _p = event(PatternBuilder("c"), "e1", "view", k="x").stage("e2").edge("e2", "eventType", "click").bind("e2", "actor", "actor").where_var("e2", "k", _op, "x").done().build()
    query(_name, f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.k AS x FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'view' AND b.y = 'click' AND a.t < b.t AND b.k {_op} a.k")(on_events(_p, "e1", "e2", "#x"))
_p = event(PatternBuilder("c"), "e1", "view", k="x").stage("e2").edge("e2", "eventType", "click").bind("e2", "actor", "actor").bind("e2", "k", "y").let("z", Op("+", Op("*", Ref("x"), Lit(2)), Ref("y"))).done().build()
query("let_add", f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.k * 2 + b.k AS z FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'view' AND b.y = 'click' AND a.t < b.t")(on_events(_p, "e1", "e2", "#z"))
_p = PatternBuilder("c").stage("e1").edge("e1", "eventType", "view").bind("e1", "value", "x").bind("e1", "k", "y").let("z", Op("/", Ref("x"), Ref("y"))).done().build()
query("let_div_zero_drops", f"WITH {E} SELECT id AS e1, CAST(floor(v / k * 1000000) AS BIGINT) AS z FROM e WHERE y = 'view' AND k <> 0")(lambda spark, d, p=_p: flat(find(event_graph(spark, d), p), "e1", "#z").withColumn("z", F.floor(F.col("z") * 1000000)))


# scans and changes
@query("scan_label", f"WITH {E} SELECT id AS source, t AS start_t FROM e WHERE y = 'purchase'")
def _(spark, d):
    from .pattern import Is

    return event_graph(spark, d).scan("eventType", Is("purchase")).select("source", "start_t")


T0 = 883_612_800_000_000  # 1998-01-01


@query("scan_at_time", f"WITH {O} SELECT id AS source, c AS target, a AS start_t, b AS end_t FROM o WHERE a <= {T0} AND {T0} < b")
def _(spark, d):
    return trade_graph(spark, d).scan("placedBy", at=T0).select("source", F.col("s").alias("target"), "start_t", "end_t")


@query("edges_from_any_time", f"WITH {O} SELECT 'placedBy' AS label, c AS s, a AS start_t FROM o WHERE id = 'o7'")
def _(spark, d):
    return trade_graph(spark, d).edges_from_any_time("o7", "placedBy").select("label", "s", "start_t")


@query("predecessors", f"WITH {E} SELECT id AS source, t AS start_t FROM e WHERE u = 'u7'")
def _(spark, d):
    return event_graph(spark, d).predecessors("u7", "actor").select("source", "start_t")


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Each event sets its user's state."""
    r = Relation(table(spark, d, "events"), node_id("u", "user_id"), {"state": (STR, F.col("event_type"))}, micros("ts"), None, F.col("event_id"))
    return r.edges()


@query("end_edge_latest_open", f"WITH {E}, m AS (SELECT u, max(event_id) AS last FROM e GROUP BY u) SELECT e.u AS source, y AS s, t AS start_t, CASE WHEN event_id = last THEN 4102444800000000 ELSE -1 END AS end_t FROM e JOIN m ON e.u = m.u")
def _(spark, d):
    edges = _states(spark, d)
    closing = edges.select("source", "label", F.lit(4_102_444_800_000_000).alias("at")).distinct()
    return end_latest(edges, closing).select("source", "s", "start_t", F.coalesce("end_t", F.lit(-1)).alias("end_t"))


@query("upsert_history", f"WITH {E} SELECT u AS source, y AS s, t AS start_t, coalesce(lead(t) OVER (PARTITION BY u ORDER BY t, event_id), -1) AS end_t FROM e")
def _(spark, d):
    return upsert_history(_states(spark, d)).select("source", "s", "start_t", F.coalesce("end_t", F.lit(-1)).alias("end_t"))


@query("add_event_tags", f"WITH {E} SELECT label, s, count(*) AS n FROM (SELECT 'eventType' AS label, y AS s FROM e UNION ALL SELECT 'tag', 'k' || (k::INT % 3) FROM e UNION ALL SELECT 'tag', 'all' FROM e) GROUP BY ALL")
def _(spark, d):
    k = F.regexp_extract("props", '"k": (-?[0-9]+)', 1).cast("int")
    df = table(spark, d, "events").select(node_id("ev", "event_id").alias("id"), "event_type", F.array(F.concat(F.lit("k"), (k % 3).cast("string")), F.lit("all")).alias("tags"), micros("ts").alias("t"))
    return counted(explode_tags(df, "id", "event_type", "tags", "t"), "label", "s")


# stages
@query("property_clause_semi", f"WITH {O} SELECT id AS o, c FROM o JOIN customer ON c = 'c' || c_custkey WHERE c_mktsegment = 'BUILDING' AND st = 'F'")
def _(spark, d):
    p = PatternBuilder("c").stage("o").edge("o", "status", "F").bind("o", "placedBy", "c").edge("c", "segment", "BUILDING").done().build()
    return flat(find(trade_graph(spark, d), p), "o", "c")


@query("inline_not_anti", f"WITH {O} SELECT id AS o, c FROM o JOIN customer ON c = 'c' || c_custkey WHERE c_mktsegment <> 'BUILDING' AND st = 'F'")
def _(spark, d):
    p = PatternBuilder("c").stage("o").edge("o", "status", "F").bind("o", "placedBy", "c").not_edge("c", "segment", "BUILDING").done().build()
    return flat(find(trade_graph(spark, d), p), "o", "c")


@query("first_edge_bind", f"WITH {E}, f AS (SELECT u, arg_min(y, event_id) AS y FROM e GROUP BY u) SELECT e.id AS e1, e.u AS actor, f.y AS state FROM e JOIN f ON e.u = f.u WHERE e.y = 'purchase'")
def _(spark, d):
    """A user has many states; the clause takes the first."""
    g = event_graph(spark, d)
    states = _states(spark, d)
    g = TemporalGraph(spark, None, g.edges().unionByName(states))
    p = PatternBuilder("c").stage("e1").edge("e1", "eventType", "purchase").bind("e1", "actor", "actor").bind("actor", "state", "state").done().build()
    return flat(find(g, p), "e1", "actor", "state")


@query("cartesian_no_shared_var", f"WITH {E} SELECT a.id AS e1, b.id AS e2 FROM e a, e b WHERE a.y = 'signup' AND a.v > 250 AND b.y = 'purchase' AND b.v > 250 AND a.t < b.t")
def _(spark, d):
    b = PatternBuilder("c")
    for a, k in (("e1", "signup"), ("e2", "purchase")):
        b = b.stage(a).edge(a, "eventType", k).where(a, "value", ">", 250).done()
    return flat(find(event_graph(spark, d), b.build()), "e1", "e2")


@query("duplicate_edges", f"WITH {E} SELECT id AS e1, u AS actor FROM e WHERE y = 'purchase' UNION ALL SELECT id, u FROM e WHERE y = 'purchase'")
def _(spark, d):
    g = event_graph(spark, d)
    edges = g.edges()
    twice = TemporalGraph(spark, None, edges.unionByName(edges.where("label = 'eventType'")))
    return flat(find(twice, chain("c", "purchase").build()), "e1", "actor")


@query("concurrent_group", f"WITH {E} SELECT a.id AS e1, b.id AS e2, c.id AS e3, a.u AS actor FROM e a JOIN e b ON a.u = b.u JOIN e c ON a.u = c.u WHERE a.y = 'signup' AND b.y = 'view' AND c.y = 'purchase' AND a.t < c.t AND b.t < c.t")
def _(spark, d):
    return flat(find(event_graph(spark, d), chain("c", "signup", "view", "purchase").mark_unordered([0, 1]).build()), "e1", "e2", "e3", "actor")


@query("limit_n", f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.u AS actor {TWO} ORDER BY a.event_id, b.event_id LIMIT 25")
def _(spark, d):
    return flat(first(event_graph(spark, d), chain("c", "signup", "purchase").build(), 25), "e1", "e2", "actor")


@query("first_match", f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.u AS actor {TWO} ORDER BY a.event_id, b.event_id LIMIT 1")
def _(spark, d):
    return flat(first(event_graph(spark, d), chain("c", "signup", "purchase").build()), "e1", "e2", "actor")


# Allen's relations, over visits of one user; both in one group without order, so that any relation can hold
ALLEN_SQL = {
    "before": "p.b < q.a", "after": "q.b < p.a", "meets": "p.b = q.a", "met_by": "q.b = p.a", "equals": "p.a = q.a AND p.b = q.b", "starts": "p.a = q.a AND p.b < q.b", "started_by": "p.a = q.a AND p.b > q.b",
    "finishes": "p.b = q.b AND p.a > q.a", "finished_by": "p.b = q.b AND p.a < q.a", "during": "p.a > q.a AND p.b < q.b", "contains": "p.a < q.a AND p.b > q.b", "overlaps": "p.a < q.a AND q.a < p.b AND p.b < q.b", "overlapped_by": "q.a < p.a AND p.a < q.b AND q.b < p.b",
}
VISITS = "FROM s p JOIN s q ON p.u = q.u WHERE p.y = 'view' AND q.y = 'click'"


def visit_pair(relation: str, least: float | None = None, most: float | None = None) -> Pattern:
    b = PatternBuilder("c")
    for a, k in (("p", "view"), ("q", "click")):
        b = b.stage(a).edge(a, "kind", k).bind(a, "visitor", "u").done()
    return b.mark_unordered([0, 1]).temporal("p", relation, "q", least, most).build()


for _r, _test in ALLEN_SQL.items():
    query(f"allen_{_r}", f"WITH {S} SELECT p.id AS p, q.id AS q {VISITS} AND {_test}")(lambda spark, d, p=visit_pair(_r): flat(find(visit_graph(spark, d), p), "p", "q"))
query("metric_gap_before", f"WITH {S} SELECT p.id AS p, q.id AS q {VISITS} AND p.b < q.a AND q.a - p.b BETWEEN 2 AND 12")(lambda spark, d: flat(find(visit_graph(spark, d), visit_pair("before", 2, 12)), "p", "q"))
query("metric_gap_during", f"WITH {S} SELECT p.id AS p, q.id AS q {VISITS} AND p.a > q.a AND p.b < q.b AND p.a - q.a <= 2")(lambda spark, d: flat(find(visit_graph(spark, d), visit_pair("during", None, 2)), "p", "q"))
query("open_interval_fallback", f"WITH {E} SELECT a.id AS e1, b.id AS e2, a.u AS actor {TWO}")(on_events(chain("c", "signup", "purchase").temporal("e1", "before", "e2", 3, 10).build(), "e1", "e2", "actor"))


def visit_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = PatternBuilder("c")
    for a, k in (("p", "view"), ("q", "click")):
        b = b.stage(a).edge(a, "kind", k).bind(a, "visitor", "u").done()
    return find(visit_graph(spark, d), b.mark_unordered([0, 1]).build())


def _ends() -> list:
    return [F.col(c) for c in ("p__start", "p__end", "q__start", "q__end")]


_CASE = "CASE " + " ".join(f"WHEN {t} THEN '{r}'" for r, t in ALLEN_SQL.items()) + " END"


@query("allen_relation_histogram", f"WITH {S} SELECT r, count(*) AS n, sum(g)::DOUBLE AS gaps FROM (SELECT {_CASE} AS r, CASE {_CASE} WHEN 'before' THEN q.a - p.b WHEN 'after' THEN p.a - q.b WHEN 'overlaps' THEN p.b - q.a WHEN 'overlapped_by' THEN q.b - p.a WHEN 'during' THEN p.a - q.a WHEN 'contains' THEN q.a - p.a WHEN 'starts' THEN q.b - p.b WHEN 'started_by' THEN p.b - q.b WHEN 'finishes' THEN p.a - q.a WHEN 'finished_by' THEN q.a - p.a ELSE 0 END AS g {VISITS}) GROUP BY r")
def _(spark, d):
    df = visit_pairs(spark, d).withColumn("r", intervals.relation(*_ends()))
    return df.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum(intervals.gap_by_relation(F.col("r"), *_ends()).cast("double")).alias("gaps"))


@query("interval_intersects", f"WITH {S} SELECT p.u AS u, count(*) AS n {VISITS} AND p.a < q.b AND q.a < p.b GROUP BY p.u")
def _(spark, d):
    return counted(visit_pairs(spark, d).where(intervals.intersects(*_ends())).select(F.col("u.s").alias("u")), "u")


# composition
def one(kind: str) -> Pattern:
    return event(PatternBuilder(kind), "e", kind, "who").build()


query("seq_shared", f"WITH {E} SELECT a.id AS a_e, b.id AS b_e, a.u AS who {TWO}")(on_events(sequence("s", one("signup"), one("purchase"), ["who"]), "a_e", "b_e", "who"))


def _choice(exclusive: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = evaluate(event_graph(spark, d), choice("c", [one("signup"), one("purchase")], exclusive))
        return out.select("pattern", F.col("bindings")["e"]["s"].alias("e"), F.col("intervals")["e"]["start"].alias("t"))

    return run


_CH = f"WITH {E} SELECT 'c_' || y AS pattern, id AS e, t FROM e WHERE y IN ('signup', 'purchase')"
query("choice_exclusive", _CH)(_choice(True))
query("choice_nonexclusive", _CH)(_choice(False))
query("repeat_exact_3", f"WITH {E} SELECT a.id AS rep0_e, b.id AS rep1_e, c.id AS rep2_e, a.u AS who FROM e a JOIN e b ON a.u = b.u JOIN e c ON a.u = c.u WHERE a.y = 'error' AND b.y = 'error' AND c.y = 'error' AND a.t < b.t AND b.t < c.t")(
    on_events(repeat("r", one("error"), 3, ["who"]), "rep0_e", "rep1_e", "rep2_e", "who")
)
query("repeat_range_batch", f"WITH {E} SELECT a.id AS first_e, b.id AS last_e, a.u AS who FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'error' AND b.y = 'error' AND a.t < b.t")(on_events(repeat_range("r", one("error"), 3, 5, ["who"]), "first_e", "last_e", "who"))


@query("private_hidden", f"WITH {E} SELECT 'purchase' AS pattern, id AS e FROM e WHERE y = 'purchase'")
def _(spark, d):
    from dataclasses import replace

    out = evaluate(event_graph(spark, d), [replace(one("signup"), private=True), one("purchase")])
    return out.select("pattern", F.col("bindings")["e"]["s"].alias("e"))


@query("node_targets", f"WITH {O} SELECT id AS o, c, 'n' || c_nationkey AS n FROM o JOIN customer ON c = 'c' || c_custkey WHERE c_nationkey = 3 AND c_acctbal > 0")
def _(spark, d):
    p = PatternBuilder("c").stage("o").bind("o", "placedBy", "c").edge("c", "nation", Node("n3")).where("c", "balance", ">", 0).bind("c", "nation", "n").done().build()
    return flat(find(trade_graph(spark, d), p), "o", "c", "n")


@query("snapshot_at_time", f"WITH {O} SELECT id AS o, c FROM o WHERE st = 'F' AND a <= {T0} AND {T0} < b")
def _(spark, d):
    p = PatternBuilder("c").stage("o").edge("o", "status", "F").bind("o", "placedBy", "c").done().build()
    return flat(find(trade_graph(spark, d, T0), p), "o", "c")


TEXT = """
private advance_in_place pattern unused { stage e { e.eventType = "view" } }
pattern start { stage e { e.eventType = "signup" e.actor -> ?who e.value > 100 } }
pattern end { stage e { e.eventType in ["purchase", "click"] e.actor -> ?who } unless after e { x.eventType = "error" x.actor -> ?who } }
compose both = start >> end sharing(who)
"""


@query("text_document", f"WITH {E} SELECT a.id AS a_e, b.id AS b_e, a.u AS who FROM e a JOIN e b ON a.u = b.u WHERE a.y = 'signup' AND a.v > 100 AND b.y IN ('purchase', 'click') AND a.t < b.t AND NOT EXISTS (SELECT 1 FROM e n WHERE n.u = a.u AND n.y = 'error' AND n.t > b.t)")
def _(spark, d):
    """A composition in the text form, written out and read again."""
    from ..dsl import parse_document, parse_pattern, pattern_to_dsl

    p = parse_document(TEXT).pattern("both")
    return flat(find(event_graph(spark, d), parse_pattern(pattern_to_dsl(p))), "a_e", "b_e", "who")


# why not
def _gaps(spark: SparkSession, d: str) -> DataFrame:
    b = event(PatternBuilder("w"), "e1", "signup")
    b = b.stage("e2").edge("e2", "eventType", "purchase").bind("e2", "actor", "actor").where("e2", "value", ">", 100000).edge("e2", "refund", "yes").done()
    return gap.clauses(event_graph(spark, d), event(b, "e3", "view").build())


_WHY = f"""WITH {E}, f AS (SELECT count(*) AS n FROM e WHERE y = 'signup'), g AS (SELECT count(*) AS n FROM e a JOIN e b ON a.u = b.u AND a.t < b.t WHERE a.y = 'signup' AND b.y = 'purchase')
SELECT * FROM (VALUES ('e1', 0, 0, 'eventType', true, NULL), ('e1', 0, 1, 'actor', true, NULL), ('e2', 1, 0, 'eventType', true, NULL), ('e2', 1, 1, 'actor', true, NULL),
 ('e2', 1, 2, 'value', false, 'edges exist but none match target constraint'), ('e2', 1, 3, 'refund', false, 'no edges with label refund from ?e2')) AS x(anchor, stage, clause, label, matched, reason), f, g"""
query("why_not_clauses", _WHY.replace("SELECT * FROM (VALUES", "SELECT anchor, stage, clause, label, matched AND (CASE WHEN stage = 0 THEN f.n ELSE g.n END) > 0 AS matched, reason FROM (VALUES"))(_gaps)
query("why_not_status", "SELECT * FROM (VALUES (0, 'e1', 'matched', 2, 2), (1, 'e2', 'partially_matched', 2, 4)) AS x(stage, anchor, status, n_matched, n_clauses)")(lambda spark, d: gap.stages(_gaps(spark, d)))
query("closeness", "SELECT round(4 / 6, 6) AS closeness")(lambda spark, d: gap.closeness(_gaps(spark, d)).withColumn("closeness", F.round("closeness", 6)))

__all__ = ["NODE", "QUERIES", "SQL", "customers"]
