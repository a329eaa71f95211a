"""Scenarios of the fixtures, evaluated in batch."""

import pytest
from pyspark.sql import functions as F

from weftline.functions.values import Node
from weftline.plans.batch import evaluate, find, first
from weftline.plans.compose import choice, repeat, sequence
from weftline.plans.pattern import Lit, Op, PatternBuilder, PatternError, Ref
from weftline.sources.graph import Relation, Source, TemporalGraph

N = Node


def graph(spark, rows, now=10):
    return TemporalGraph.of(spark, rows, now)


def event(name, kind, at, end=None, label="eventType", **others):
    return [(name, label, kind, at, end)] + [(name, k, v, at, end) for k, v in others.items()]


HOSPITALITY = event("ev1", "enterTown", 1, actor=N("alice")) + event("ev2", "showHospitality", 2, actor=N("bob"), target=N("alice")) + event("ev3", "harm", 3, actor=N("bob"), target=N("alice"))


def hospitality():
    p = PatternBuilder("violation").stage("e1").edge("e1", "eventType", "enterTown").bind("e1", "actor", "guest").done()
    p = p.stage("e2").edge("e2", "eventType", "showHospitality").bind("e2", "actor", "host").bind("e2", "target", "guest").done()
    p = p.stage("e3").edge("e3", "eventType", "harm").bind("e3", "actor", "host").bind("e3", "target", "guest").done()
    return p.unless_between("e1", "e3").edge("mid", "eventType", "leaveTown").bind("mid", "actor", "guest").done().build()


@pytest.mark.parametrize(("more", "n"), [([], 1), (event("x", "leaveTown", 2, actor=N("alice")), 0), (event("x", "leaveTown", 2, actor=N("charlie")), 1)])
def test_hospitality(spark, more, n):
    rows = find(graph(spark, HOSPITALITY + more), hospitality()).collect()
    assert len(rows) == n
    assert all((r.guest.s, r.host.s) == ("alice", "bob") for r in rows)


def chain(*kinds, label="eventType"):
    p = PatternBuilder("p")
    for i, k in enumerate(kinds):
        p = p.stage(f"e{i + 1}").edge(f"e{i + 1}", label, k).bind(f"e{i + 1}", "actor", "who").done()
    return p


def test_two_betrayals(spark):
    rows = [("alice", "trait", "impulsive", 0)] + event("ev1", "betray", 1, actor=N("alice")) + event("ev2", "betray", 3, actor=N("alice"))
    p = PatternBuilder("two").stage("e1").edge("e1", "eventType", "betray").bind("e1", "actor", "c").edge("c", "trait", "impulsive").done()
    p = p.stage("e2").edge("e2", "eventType", "betray").bind("e2", "actor", "c").done()
    p = p.unless_global().edge("m", "eventType", "reconcile").bind("m", "actor", "c").done().build()
    assert find(graph(spark, rows), p).count() == 1
    assert find(graph(spark, rows + event("m", "reconcile", 2, actor=N("alice"))), p).count() == 0


def test_romantic_arc(spark):
    def tagged(e, kinds, at):
        return [(e, "tag", k, at) for k in kinds] + [(e, "actor", N("mira"), at)]

    p = PatternBuilder("arc")
    for i, k in enumerate(["negative", "negative", "positive"]):
        p = p.stage(f"e{i}").edge(f"e{i}", "tag", k).edge(f"e{i}", "tag", "romantic").bind(f"e{i}", "actor", "c").done()
    p = p.build()
    rows = tagged("r1", ["negative", "romantic"], 1) + tagged("r2", ["negative", "romantic"], 2) + tagged("r3", ["positive", "romantic"], 3)
    assert find(graph(spark, rows), p).count() == 1
    rows = sum((tagged(f"n{i}", ["negative", "romantic"], i) for i in (1, 2, 3)), []) + tagged("p4", ["positive", "romantic"], 4)
    assert find(graph(spark, rows), p).count() == 3


@pytest.mark.parametrize(("value", "n"), [(0.3, 1), (0.8, 0), (float("nan"), 0), ("low", 1), (True, 0)])
def test_constraint_across_variants(spark, value, n):
    p = PatternBuilder("p").stage("e").edge("e", "eventType", "check").where("e", "loyalty", "<", 0.5).done().build()
    assert find(graph(spark, event("ev1", "check", 1) + [("ev1", "loyalty", value, 1)]), p).count() == n


def test_same_timestamp_and_duplicates(spark):
    p = PatternBuilder("p").stage("a").edge("a", "tag", "x").done().stage("b").edge("b", "tag", "y").done().build()
    assert find(graph(spark, [("ev", "tag", "x", 1), ("ev", "tag", "y", 1)]), p).count() == 0
    one = PatternBuilder("p").stage("a").edge("a", "eventType", "harm").bind("a", "actor", "w").done().build()
    assert find(graph(spark, [("ev1", "eventType", "harm", 1)] * 2 + [("ev1", "actor", N("bob"), 1)]), one).count() == 2


@pytest.mark.parametrize(
    ("a", "b", "relation", "now", "gap", "n"),
    [
        ((1, None), (5, None), "before", 10, (None, None), 1),
        ((3, 5), (1, 100), "during", 4, (None, None), 0),  # the inner one is the earlier stage here
        ((1, 6), (3, 100), "overlaps", 4, (None, None), 1),
        ((1, None), (100, None), "before", 200, (3, 10), 1),
        ((1, 100), (3, 5), "contains", 4, (None, None), 1),
        ((1, 100), (3, 5), "contains", 4, (3, None), 0),
    ],
)
def test_allen(spark, a, b, relation, now, gap, n):
    p = PatternBuilder("p").stage("x").edge("x", "eventType", "a").done().stage("y").edge("y", "eventType", "b").done().temporal("x", relation, "y", *gap).build()
    assert find(graph(spark, event("e1", "a", *a) + event("e2", "b", *b), now), p).count() == n


def test_negation_boundaries(spark):
    rows = event("c1", "crime", 1, actor=N("alice")) + event("p1", "pardon", 1, actor=N("alice")) + event("c2", "crime", 3, actor=N("alice"))
    p = chain("crime", "crime").unless_between("e1", "e2").edge("m", "eventType", "pardon").bind("m", "actor", "who").done().build()
    assert find(graph(spark, rows), p).count() == 1
    assert find(graph(spark, rows + event("p2", "pardon", 2, actor=N("alice"))), p).count() == 0
    after = chain("promise", "break").unless_after("e1").edge("m", "eventType", "apologize").bind("m", "actor", "who").done().build()
    rows = event("a", "promise", 1, actor=N("alice")) + event("b", "break", 2, actor=N("alice"))
    assert find(graph(spark, rows), after).count() == 1
    assert find(graph(spark, rows + event("c", "apologize", 3, actor=N("alice"))), after).count() == 0


def test_let_deadline(spark):
    rows = [("e1", "type", "world", 1), ("e1", "pulse_count", 3.0, 1), ("e2", "type", "world", 5), ("e2", "pulse_count", 8.0, 5)]
    p = PatternBuilder("p").stage("a").edge("a", "type", "world").bind("a", "pulse_count", "ts").let("deadline", Op("+", Ref("ts"), Lit(5))).done()
    p = p.stage("b").edge("b", "type", "world").edge_eq_var("b", "pulse_count", "deadline").done().build()
    assert find(graph(spark, rows), p).count() == 1
    z = PatternBuilder("p").stage("a").edge("a", "type", "world").bind("a", "pulse_count", "ts").let("x", Op("/", Ref("ts"), Lit(0))).done().build()
    assert find(graph(spark, rows), z).count() == 0


@pytest.mark.parametrize("times", [(1, 2), (2, 1)])
def test_concurrent_group(spark, times):
    p = PatternBuilder("p")
    p = p.unordered_group(lambda b: b.stage("a").edge("a", "type", "alpha").done(), lambda b: b.stage("b").edge("b", "type", "beta").done()).build()
    assert find(graph(spark, [("x", "type", "alpha", times[0]), ("y", "type", "beta", times[1])]), p).count() == 1
    with pytest.raises(PatternError):
        PatternBuilder("q").stage("a").edge("a", "type", "x").done().mark_unordered([0])


def test_composition_and_limits(spark):
    one = lambda n, k: PatternBuilder(n).stage("e").edge("e", "type", k).bind("e", "actor", "char").done().build()
    rows = [("a", "type", "promise", 1), ("a", "actor", N("al"), 1), ("b", "type", "fulfill", 5), ("b", "actor", N("al"), 5)]
    both = sequence("promise_kept", one("s", "promise"), one("p", "fulfill"), ["char"])
    g = graph(spark, rows)
    assert find(g, both).count() == 1
    assert [p.name for p in choice("c", [one("s", "promise"), one("p", "fulfill")])] == ["c_s", "c_p"]
    assert evaluate(g, choice("c", [one("s", "promise"), one("p", "fulfill")])).count() == 2
    thrice = [(f"o{i}", k, v, i) for i in range(4) for k, v in (("type", "x"), ("actor", N("al")))]
    assert find(graph(spark, thrice), repeat("r", one("x", "x"), 3, ["char"])).count() == 4
    assert first(graph(spark, thrice), one("x", "x"), 2).count() == 2
    assert first(graph(spark, thrice), one("x", "x"), 0).count() == 0
    assert find(g, PatternBuilder("none").build()).count() == 0


def test_inline_negation_and_first_edge(spark):
    rows = [("e1", "type", "x", 1), ("e1", "tag", "bad", 1), ("e2", "type", "x", 2), ("e2", "tag", "a", 2), ("e2", "tag", "b", 2)]
    p = PatternBuilder("p").stage("e").edge("e", "type", "x").not_edge("e", "tag", "bad").bind("e", "tag", "t").done().build()
    got = find(graph(spark, rows), p).collect()
    assert [(r.e.s, r.t.s) for r in got] == [("e2", "a")]
    with pytest.raises(PatternError):
        PatternBuilder("p").stage("e").not_edge("e", "tag", "bad").done().build()


def test_cross_stage_constraints(spark):
    rows = [("a", "type", "bid", 1), ("a", "price", 5.0, 1), ("b", "type", "bid", 2), ("b", "price", 7.0, 2)]
    for op, n in (("<", 0), (">", 1), ("=", 0), (">=", 1)):
        p = PatternBuilder("p").stage("x").edge("x", "type", "bid").bind("x", "price", "p").done().stage("y").edge("y", "type", "bid").where_var("y", "price", op, "p").done().build()
        assert find(graph(spark, rows), p).count() == n, op
        root = PatternBuilder("p").stage("x").edge("x", "type", "bid").bind("x", "price", "p").done().stage("y").where_var("y", "price", op, "p").done().build()
        assert find(graph(spark, rows), root).count() == n, op


def test_graph_changes(spark):
    g = graph(spark, [("a", "state", "x", 1), ("a", "state", "y", 3)])
    closed, hit = g.end_edge("a", "state", 5)
    assert hit and {(r.s, r.end_t) for r in closed.edges().collect()} == {("x", None), ("y", 5)}
    assert not closed.end_edge("b", "state", 5)[1]
    assert {(r.s, r.end_t) for r in g.upsert("a", "state", "z", 6).edges().collect()} == {("x", None), ("y", 6), ("z", None)}
    assert g.predecessors("y", "state").count() == 0
    assert g.add_ref("c", "knows", "a", 2).predecessors("a", "knows").count() == 1
    assert g.add_event("e", "attack", ["violent", "harm"], 4).edges().count() == 5


class Folders(Source):
    """A store of one table a label."""

    def __init__(self, spark, tables, now):
        self.spark, self.tables, self.now = spark, tables, now

    def edges(self, label=None):
        parts = list(self.tables.values()) if label is None else [self.tables[label]] if label in self.tables else [TemporalGraph(self.spark, None).edges()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def test_own_store(spark):
    rows = event("p1", "order", 1, who=N("ann")) + event("p2", "cancel", 4, who=N("ann")) + event("p3", "order", 5, who=N("ben"), end=7) + event("p4", "refund", 8, who=N("ann"))
    g = graph(spark, rows)
    own = Folders(spark, {x: g.edges(x) for x in ("eventType", "who")}, 10)
    p = PatternBuilder("back").stage("a").edge("a", "eventType", "order").bind("a", "who", "who").done()
    p = p.stage("b").edge("b", "eventType", "refund").bind("b", "who", "who").done()
    seen = lambda graph, p: sorted(map(str, find(graph, p).collect()))
    assert len(seen(own, p.build())) == 1 and seen(own, p.build()) == seen(g, p.build())
    blocked = p.unless_between("a", "b").edge("x", "eventType", "cancel").bind("x", "who", "who").done().build()
    assert seen(own, blocked) == seen(g, blocked) == []
    assert own.scan("who").count() == 3 and own.scan_any_time("who").count() == 4 and own.scan("nothing").isEmpty()
    assert own.predecessors("ann", "who").count() == 3 and own.edges_from("p3", "who", 6).count() == 1


def test_fractional_times(spark):
    rows = event("e1", "a", 1.25, 1.5, who=N("x")) + event("e2", "b", 1.75, 2, who=N("x")) + event("e3", "b", 2.75, 3, who=N("x"))
    p = PatternBuilder("near").stage("a").edge("a", "eventType", "a").bind("a", "who", "w").done().stage("b").edge("b", "eventType", "b").bind("b", "who", "w").done()
    p = p.temporal("a", "before", "b", 0.25, 1.0).build()
    table = TemporalGraph.of(spark, rows, None, "double")
    wide = spark.createDataFrame([(r[0], r[2], "x", float(r[3]), float(r[4]), i) for i, r in enumerate(rows[::2])], "e string, kind string, who string, at double, until double, i int")
    r = Relation(wide, F.col("e"), {"eventType": (1, F.col("kind")), "who": (0, F.col("who"))}, F.col("at"), F.col("until"), F.col("i"), "double")
    for g in (table, TemporalGraph(spark, None, relations=(r,), time="double")):
        got = find(g, p).collect()
        assert [(x["a__start"], x["b__start"], x["b__end"]) for x in got] == [(1.25, 1.75, 2.0)]
        assert find(g, p, at=1.3).isEmpty() and evaluate(g, [p]).count() == 1
        assert dict(find(g, PatternBuilder("none").build()).dtypes) == {}
    with pytest.raises(ValueError, match="seq"):
        Relation(wide, F.col("e"), {}, F.col("at"), time="double")
    closed, hit = TemporalGraph.of(spark, [("n", "l", "v", 0.5)], None, "double").end_edge("n", "l", 2)
    assert hit and closed.edges().first()["end_t"] == 2.0 and closed.add_edge("n", "l", 1, 3).edges().count() == 2


def test_window_without_end_is_decided_by_the_latest(spark):
    p = PatternBuilder("quiet").stage("a").edge("a", "eventType", "in").bind("a", "who", "w").done()
    per = p.unless_after("a").edge("x", "eventType", "out").bind("x", "who", "w").done().build()
    rows = event("a1", "in", 1, who=N("u")) + event("a2", "in", 4, who=N("u")) + event("a3", "in", 2, who=N("v")) + event("x1", "out", 3, who=N("u")) + event("x2", "out", 2, who=N("v")) + event("x3", "out", 2, who=N("u"))
    df = find(graph(spark, rows), per)
    assert sorted(r.a.s for r in df.collect()) == ["a2", "a3"]  # one at the same time is not after
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 1
    p = PatternBuilder("end").stage("a").edge("a", "eventType", "in").done()
    anyone = p.unless_after("a").edge("x", "eventType", "out").done().build()
    assert sorted(r.a.s for r in find(graph(spark, rows), anyone).collect()) == ["a2"]
    assert find(graph(spark, event("a1", "in", 1)), anyone).count() == 1


@pytest.mark.parametrize("wide", [True, False])
def test_negation_that_compares_with_the_match(spark, wide):
    """The compared value is a residual of one anti-join: blocked rows are not made and taken away. Any edge of the body's source may block."""
    from weftline.plans.pattern import Constraint

    rows = [("s1", "a", 3.0, 1), ("s2", "a", 7.0, 2), ("n1", "n", 5.0, 3), ("p1", "b", 0.0, 4), ("n2", "n", 9.0, 9)]
    if wide:
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, source string, kind string, value double, t long")
        g = TemporalGraph(spark, None, None, (Relation(df, F.col("source"), {"kind": (1, F.col("kind")), "value": (2, F.col("value"))}, F.col("t"), None, F.col("id")),))
    else:
        g = TemporalGraph.of(spark, [x for s, k, v, t in rows for x in ((s, "kind", k, t), (s, "value", v, t))] + [("n1", "value", 1, 3)], None)
    b = PatternBuilder("p").stage("x").edge("x", "kind", "a").bind("x", "value", "v").done().stage("y").edge("y", "kind", "b").done()
    n = b.unless_between("x", "y").edge("n", "kind", "n")
    n._add("n", "value", Constraint(">?", var="v"))
    out = find(g, n.done().build())
    assert [r.x.s for r in out.collect()] == ["s2"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "LeftSemi" not in plan
