"""Scorers, causality, discovery and reports on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from weftline.dsl import report
from weftline.functions.values import Node
from weftline.operators import causality, discovery, narrative, scoring
from weftline.plans import gap
from weftline.plans.batch import distinct_matches, evaluate
from weftline.plans.pattern import PatternBuilder
from weftline.sources.graph import TemporalGraph


def test_causal_paths(spark):
    g = TemporalGraph.of(spark, [("a", "causes", Node("b"), 1), ("b", "causes", Node("c"), 2), ("x", "causes", Node("c"), 5), ("c", "causes", Node("a"), 0)], 10)
    effects = spark.createDataFrame([("c",), ("lone",)], "effect string")
    paths = causality.scored(causality.causal_paths(g.edges(), effects, {"causes": 1.0}, 5))
    got = {tuple(r.nodes): (r.divergence, r.total_gap, r.cleanliness) for r in paths.collect()}
    assert got.keys() == {("b", "c"), ("x", "c"), ("a", "b", "c")}
    assert got["b", "c"] == (1, 0, 0.5) and got["a", "b", "c"][:2] == (1, 1)
    s = {r.effect: r.surprise for r in causality.causal_surprise(paths, effects).collect()}
    assert s == {"c": 0.5, "lone": 1.0}


def test_surprise(spark):
    seen = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("q", 1)], "pattern string, round int")
    got = {r.pattern: r.surprise for r in scoring.surprise(seen, 3, {"p": 0.5}).collect()}
    assert got["p"] == pytest.approx(-math.log2((3 / 4) / 0.5)) and got["q"] is None
    with pytest.raises(ValueError):
        scoring.surprise(seen, 3, {"p": 0.0})
    counts = spark.createDataFrame([("a", "b", 3), ("a", "c", 1)], "prev string, current string, n int")
    asked = spark.createDataFrame([("a", "b"), ("a", "z"), ("y", "b")], "prev string, current string")
    got = {(r.prev, r.current): r.surprise for r in scoring.sequential(counts, asked).collect()}
    assert got == {("a", "b"): pytest.approx(-math.log2(4 / 6)), ("a", "z"): pytest.approx(-math.log2(1 / 6)), ("y", "b"): 0.0}


def test_property_scores(spark):
    rows = [("m1", "p", ["a", "b", "a"]), ("m2", "p", ["a"]), ("m3", "p", []), ("m4", "p", ["a", "b"])]
    m = spark.createDataFrame(rows, "match_id string, pattern string, properties array<string>")
    fa, fb = 4 / 6, 3 / 6
    raw = {r.match_id: r.score for r in scoring.stu(m, "mean", attenuated=False).collect()}
    assert raw["m1"] == pytest.approx((fa + fb) / 2) and raw["m2"] == pytest.approx(fa) and raw["m3"] == 1.0
    assert {r.match_id: r.score for r in scoring.stu(m, "min", attenuated=False).collect()}["m1"] == pytest.approx(fb)
    soft = {r.match_id: r.score for r in scoring.stu(m).collect()}
    assert soft["m2"] == pytest.approx(1 - (1 - fa) * (1 - 1 / 5))
    assert scoring.corrected([0.5, 0.2], [10, 4], {(0, 1): 4}, 40) == [1.0, 0.2]
    assert scoring.corrected([0.5, 0.2], [10, 4], {(0, 1): 1}, 40) == [0.5, 0.2]


def test_tension_and_threads(spark):
    def last(values):
        df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "k string, tick long, value double")
        return narrative.tension(df, "k", 5).orderBy(F.desc("tick")).first()

    assert last([1, 2, 3]).trajectory == "rising" and last([1, 2, 3]).slope == pytest.approx(1.0)
    assert last([3, 2, 1]).trajectory == "falling" and last([1, 1, 1]).trajectory == "plateau"
    assert last([0, 0, 1, 0, -1]).trajectory == "peak" and last([1, 2]).trajectory == "unknown"
    t = narrative.Threads()
    t.register("a")
    t.register("b")
    t.observe(["a_open"], [])
    t.observe(["b_open"], [])
    t.observe([], ["a_close"])
    assert t.violations() == [("a", "b")]
    t.close("b")
    assert t.violations() == []
    assert t.status({"a_open": {"active": 1, "completed": 2}, "a_close": {"completed": 1}})[0] == {"name": "a", "open": 1, "closed": 1, "unresolved": True}


def court():
    """Bounded edges: three betrayals after friendship, three departures after arrivals, three exiles of the accused, and noise."""
    out = []
    for i in range(3):
        t = i * 20
        out += [(f"k{i}", "befriend", f"m{i}", t, t + 4), (f"k{i}", "betray", f"m{i}", t + 6, t + 9)]
        out += [(f"v{i}", "arrive", "court", t, t + 2), (f"v{i}", "depart", "court", t + 5, t + 7)]
        out += [(f"q{i}", "accuse", f"l{i}", t, t + 3), (f"l{i}", "exile", "land", t + 4, t + 8)]
    return out + [(f"n{i}", "idle", f"z{i}", i, i + 1) for i in range(12)]


def test_discovery_finds_planted_pairs(spark):
    trace = discovery.Trace.of(spark, court())
    assert trace.size() == 30 and trace.labels().count() == 7
    assert tuple(trace.time_range().first()) == (0, 49)
    a, b = trace.split_at(20)
    assert a.size() + b.size() == 30
    s = discovery.Session(discovery.PairMiner(0.05, 0.3), {"surprise": discovery.surprise_evaluator, "quality": discovery.match_quality_evaluator}, lambda x: x.composite() > 0)
    s.run(trace)
    found = {(x.pattern.stages[0].clauses[0].label, x.pattern.stages[1].clauses[0].label, x.pattern.temporal[0].relation) for x in s.accepted}
    assert {("befriend", "betray", "before"), ("accuse", "exile", "before")} <= found
    assert len(s.scored) >= len(s.accepted) and s.generator.generate(trace, 5) == []
    assert discovery.Scored(None, {"a": 1.0, "b": 2.0}).composite({"b": 3.0}) == 7.0


def test_gap_analysis(spark):
    g = TemporalGraph.of(spark, [("e1", "type", "a", 1), ("e1", "actor", Node("u"), 1), ("e2", "type", "b", 2), ("e2", "actor", Node("w"), 2)], 5)
    b = PatternBuilder("p").stage("x").edge("x", "type", "a").bind("x", "actor", "who").edge("who", "trait", "bold").done()
    rows = gap.clauses(g, b.stage("y").edge("y", "type", "b").done().build()).orderBy("stage", "clause").collect()
    assert [(r.stage, r.matched, r.reason) for r in rows] == [(0, True, None), (0, True, None), (0, False, "no edges with label trait from ?who")]


def test_reports_and_distinct(spark):
    text = 'pattern p { stage a { a.k = "x" a.to -> ?t } } graph { @1 e.k = "x" @1 e.k = "x" @1 e.to -> n now = 3 }'
    out = json.loads(report.batch(spark, text))
    assert out["ok"] and [m["bindings"] for m in out["matches"]] == [{"a": {"node": "e"}, "t": {"node": "n"}}] * 2
    assert [e["kind"] for e in json.loads(report.incremental(text))["events"]] == ["completed"]
    bad = json.loads(report.batch(spark, "pattern p {"))
    assert not bad["ok"] and bad["error"]["line"] == 1
    assert json.loads(report.why_not(spark, text, "p"))["closeness"] == 1.0
    assert json.loads(report.allen((1, 3), (5, 6)))["relation"] == "before"
    from weftline.dsl import parse_document

    d = parse_document(text)
    assert distinct_matches(evaluate(d.graphs[0].build(spark), d.patterns)).count() == 1


def test_ties_like_one_list(spark):
    import random

    r = random.Random(5)
    rows = [(f"m{i}", r.choice("pq"), r.sample("abcdef", r.randint(0, 5))) for i in range(60)]
    rows += [(f"t{i}", "p", ["x", "y"]) for i in range(5)]
    m = spark.createDataFrame(rows, "match_id string, pattern string, properties array<string>")
    got = {x.match_id: x.score for x in scoring.stu_pmi(m).collect()}
    for match, pattern, props in rows:
        lists = [p for _, q, p in rows if q == pattern]
        n, vocab = len(lists), len({x for p in lists for x in p})
        count = [sum(x in p for p in lists) for x in props]
        pairs = {(i, j): sum(props[i] in p and props[j] in p for p in lists) for i in range(len(props)) for j in range(i + 1, len(props))}
        if props:
            raw = scoring.corrected([(c + 1) / (n + vocab) for c in count], count, pairs, n)
            assert got[match] == pytest.approx(1 - (1 - sum(raw) / len(raw)) * (1 - 1 / (n + 1)))


def test_violations_like_threads(spark):
    import random

    r = random.Random(6)
    opened, closed, want = [], [], set()
    for k in range(30):
        t = narrative.Threads()
        for i in range(12):
            name = r.choice("abcde")
            if r.random() < 0.7:
                t.open(name)
                opened.append((f"k{k}", name, i))
            elif name in t.opened:
                t.close(name)
                closed.append((f"k{k}", name))
        want |= {(f"k{k}", a, b) for a, b in t.violations()}
    got = narrative.violations(spark.createDataFrame(opened, "key string, thread string, t int"), spark.createDataFrame(closed, "key string, thread string"), "key").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_significance(spark):
    schema = "advanced array<string>, completed array<string>, stalled array<string>, plants array<struct<name:string,payoff:string,active_plants:long,payoffs:long>>, trajectory string, desired string, pivot_magnitude double, surprise double, sequential_surprise double, violations array<string>"
    df = spark.createDataFrame([(["a"], [], [], [], "rising", "plateau", 0.0, 0.0, 0.0, ["main", "side", "else"]), ([], [], [], [], "rising", "plateau", 0.0, 0.0, 0.0, [])], schema)
    got = narrative.narrative_score(narrative.significant_signals(df, {"a": 2.0}, {"main": 5.0, "side": 0.5})).select("filo_violations", "weighted_filo_violations", "total").collect()
    assert [tuple(x) for x in got] == [(3, 6.5, 2.0 - 3 * 6.5), (0, 0.0, 0.0)]


def test_gap_analysis_makes_no_pairs_by_time_alone(spark):
    """The actor is bound only by a later clause: the stage's rows and the matches before must not be paired before it."""
    rows = [x for i, (kind, who, t) in enumerate([("a", "p", 1), ("a", "q", 4), ("b", "p", 3), ("b", "q", 2), ("b", "r", 9)]) for x in ((f"e{i}", "type", kind, t), (f"e{i}", "who", Node(who), t))]
    g = TemporalGraph.of(spark, [*rows, ("e2", "size", 5, 3), ("e4", "size", 9, 9), ("e4", "who", Node("q"), 9)], None)
    b = PatternBuilder("p").stage("x").edge("x", "type", "a").bind("x", "who", "w").done()
    p = b.stage("y").edge("y", "type", "b").bind("y", "who", "w").where("y", "size", ">", 6).done().stage("z").edge("z", "type", "b").done().build()
    out = gap.clauses(g, p)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if ("NestedLoop" in x or "Cartesian" in x) and "t__x" in x]
    got = {(r.stage, r.clause): r.matched for r in out.collect()}
    assert got == {(0, 0): True, (0, 1): True, (1, 0): True, (1, 1): True, (1, 2): True, (2, 0): False}


def test_a_slope_at_the_threshold_is_rounded_as_in_sql(spark):
    """In decimals the slope is 0.01 exactly; regr_slope makes it 0.010000000000000031, which is rising."""
    from weftline.operators.narrative import tension

    values = [0.9294, 3.7842000000000002, 0.6662, 3.6952, 1.0238999999999998]
    got = tension(spark.createDataFrame([("u", 19747 + i, v) for i, v in enumerate(values)], "key string, tick long, value double"), "key", 5).orderBy("tick").collect()
    assert (got[-1].trajectory, round(got[-1].slope, 12)) == ("rising", 0.01)
    assert [r.trajectory for r in got[:2]] == ["unknown", "unknown"]
