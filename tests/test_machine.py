"""The incremental matcher: scenarios, side effects, and agreement with batch evaluation."""

import random
from dataclasses import replace
from datetime import datetime
from itertools import product

import pytest
from pyspark.sql import functions as F

from weftline.functions.intervals import INVERSE, RELATIONS, relation_of
from weftline.functions.values import Node, compare_python
from weftline.plans.batch import find
from weftline.plans.compose import choice, rename_vars, repeat_range
from weftline.plans.pattern import Lit, Op, PatternBuilder, Ref
from weftline.sources.graph import TemporalGraph
from weftline.streaming import shards
from weftline.streaming.machine import Edge, Machine, evaluate_let, plain_arithmetic

from .test_batch import chain, hospitality

N = Node


def ev(name, kind, at, **others):
    return [Edge(name, "eventType", kind, at)] + [Edge(name, k, v, at) for k, v in others.items()]


def kinds(events):
    return [e.kind for e in events]


def test_replay_of_seven_steps():
    m = Machine([hospitality()], now=100)
    steps = [
        ev("a", "enterTown", 1, actor=N("alice")),
        ev("b", "showHospitality", 2, actor=N("bob"), target=N("alice")),
        ev("c", "showHospitality", 3, actor=N("charlie"), target=N("alice")),
        ev("d", "enterTown", 4, actor=N("dave")),
        ev("e", "leaveTown", 5, actor=N("alice")),
        ev("f", "harm", 6, actor=N("bob"), target=N("alice")),
        ev("g", "harm", 7, actor=N("charlie"), target=N("alice")),
    ]
    assert [kinds(m.feed(s)) for s in steps] == [["advanced"], ["advanced"], ["advanced"], ["advanced"], ["negated"] * 3, [], []]
    assert [dict(r.bindings)["guest"] for r in m.active()] == [N("dave")]


def one(name, kind, **flags):
    return replace(PatternBuilder(name).stage("e").edge("e", "eventType", kind).bind("e", "target", "t").done().build(), **flags)


def test_repeat_range():
    m = Machine([repeat_range("r", one("o", "offense"), 3, 5, ["t"])])
    got = [[(e.kind, e.reps) for e in m.feed(ev(f"o{i}", "offense", i, target=N("alice"))) if e.kind == "completed"] for i in (1, 2, 3)]
    assert got == [[], [], [("completed", 3)]]


@pytest.mark.parametrize(("least", "most", "k"), list(product((1, 2, 3), (None, 3, 4), (2, 4, 6))))
def test_repeat_range_closed_form(least, most, k):
    if most is not None and most < least:
        return
    m = Machine([repeat_range("r", one("o", "x"), least, most, ["t"])])
    got = [(e.spans["first_e"][0], e.spans["last_e"][0], e.reps) for i in range(k) for e in m.feed(ev(f"o{i}", "x", i, target=N("a"))) if e.kind == "completed"]
    want = [(i, j, r) for i in range(k) for j in range(i + 1, k) for r in range(max(2, least), (j - i + 1 if most is None else min(j - i + 1, max(2, most))) + 1)]
    assert sorted(got) == sorted(want)


def test_order_of_arrival():
    p = chain("enter", "harm").build()
    m = Machine([p])
    assert kinds(m.feed(ev("b", "harm", 5, actor=N("alice")))) == [] and kinds(m.feed(ev("a", "enter", 1, actor=N("alice")))) == ["advanced"]


def test_advance_in_place_and_fork():
    p = chain("a", "b").build()
    for flag, left in ((False, 1), (True, 0)):
        m = Machine([replace(p, advance_in_place=flag)])
        m.feed(ev("x", "a", 1, actor=N("u")))
        m.feed(ev("y", "b", 2, actor=N("u")))
        assert len(m.active()) == left
        assert len(m.drain_completed()) == 1 and m.drain_completed() == []


def test_concurrent_group_and_lets():
    p = PatternBuilder("p").stage("a").edge("a", "eventType", "a").bind("a", "v", "x").let("y", Op("*", Ref("x"), Lit(2))).done().stage("b").edge("b", "eventType", "b").edge_eq_var("b", "v", "y").done()
    both = p.build()
    for at in ((1, 2), (2, 1)):
        m = Machine([replace(both, unordered=((0, 1),), stages=tuple(replace(s, lets=(), clauses=s.clauses[:1]) for s in both.stages))])
        out = [x for _, s in sorted(zip(at, (ev("x", "a", at[0]), ev("y", "b", at[1])), strict=True)) for x in kinds(m.feed(s))]
        assert out == ["advanced", "completed"] or out == ["advanced", "advanced", "completed"]
    m = Machine([both])
    assert kinds(m.feed(ev("x", "a", 1, v=3.0)) + m.feed(ev("y", "b", 2, v=5.0)) + m.feed(ev("z", "b", 3, v=6.0))) == ["advanced", "completed"]


def test_ticks_groups_and_switches():
    slow = replace(chain("a", "b").build(), name="slow", deadline=2)
    idle = replace(chain("a", "b").build(), name="idle", inactivity=1)
    m = Machine([slow, idle])
    m.feed(ev("x", "a", 1, actor=N("u")))
    delta, expired = m.end_tick(1)
    assert delta.advanced == ["idle", "slow"] and expired == [] and delta.active == 1
    assert m.end_tick()[1] == [] and kinds(m.end_tick()[1]) == ["expired"] and m.active() == []
    ps = choice("c", [replace(chain("a", "b").build(), name="x"), replace(chain("a", "c").build(), name="y")])
    m = Machine(ps)
    m.feed(ev("x", "a", 1, actor=N("u")))
    assert len(m.active()) == 2
    assert kinds(m.feed(ev("y", "b", 2, actor=N("u")))) == ["completed"] and m.active() == []
    m = Machine([replace(chain("a", "b").build(), private=True)])
    assert m.feed(ev("x", "a", 1, actor=N("u"))) == [] and len(m.active()) == 1 and m.importance() == {}
    twin = m.copy()
    twin.feed(ev("y", "b", 2, actor=N("u")))
    assert len(twin.runs) == 2 and len(m.runs) == 1
    assert m.kill_involving("nobody") == 0 and m.kill_involving("u") == 1
    m.set_enabled(0, False)
    m.feed(ev("z", "a", 5, actor=N("u")))
    assert not m.is_enabled(0) and m.active() == []


def test_pairs_of_plant_and_payoff():
    m = Machine([replace(chain("a", "z").build(), name="plant"), replace(chain("b").build(), name="payoff")])
    m.register_pair("gun", "plant", "payoff")
    m.feed(ev("x", "a", 1, actor=N("u")))
    m.end_tick()
    assert m.plant_status(1) == [{"name": "gun", "active_plants": 1, "payoffs": 0, "ticks_since_advance": 1, "stale": True}]
    m.feed(ev("y", "b", 2, actor=N("u")))
    assert m.plant_status()[0]["payoffs"] == 1


def test_equal_edges_make_one_run():
    m = Machine([chain("a", "b").build()])
    m.feed(ev("x", "a", 1, actor=N("u")))
    assert m.notify(Edge("x", "eventType", "a", 1)) == []


def test_batch_agrees_with_incremental(spark):
    """Random histories in time's order, with negation windows."""
    r = random.Random(4)
    ps = [chain("a", "b").build(), chain("a", "b", "c").unless_between("e1", "e3").edge("m", "eventType", "d").bind("m", "actor", "who").done().build()]
    for _ in range(3):
        rows = [x for i in range(25) for x in ((f"e{i}", "eventType", r.choice("abcd"), i), (f"e{i}", "actor", N(r.choice("uv")), i))]
        m = Machine(ps)
        events = m.feed(Edge(*x) for x in rows)
        g = TemporalGraph.of(spark, rows, None)
        for p in ps:
            got = sorted(tuple(e.spans[s.anchor][0] for s in p.stages) for e in events if e.kind == "completed" and len(e.spans) == len(p.stages))
            want = sorted(tuple(row[f"{s.anchor}__start"] for s in p.stages) for row in find(g, p).collect())
            assert got == want


def test_streaming_query(spark, tmp_path):
    """The same events in two micro-batches: state lasts from one to the next."""
    rows = [("u", i, f"e{i}", *x, i, None) for i, k in enumerate("aabb") for x in (("eventType", 1, k, None, None), ("actor", 0, "u", None, None))]
    schema = "shard string, edge_seq long, source string, label string, rank int, s string, n double, b boolean, start_t long, end_t long"
    p = [chain("a", "b").build()]
    batch = shards.replay(spark.createDataFrame(rows, schema), p)
    want = sorted((r.kind, str(sorted(r.starts.items()))) for r in batch.collect())
    for i, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = shards.stream(src, p).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
        assert sorted((r.kind, str(sorted(r.starts.items()))) for r in spark.table("seen").collect()) == want
    finally:
        q.stop()


def test_ticks_end_for_silent_shards(spark):
    """A run whose shard has no later edge expires by the last tick of all."""
    rows = [("u", 0, "e0", "eventType", 1, "a", None, None, 0, None), ("u", 1, "e0", "actor", 0, "u", None, None, 0, None), ("v", 2, "e1", "eventType", 1, "z", None, None, 50, None)]
    schema = "shard string, edge_seq long, source string, label string, rank int, s string, n double, b boolean, start_t long, end_t long"
    df, p = spark.createDataFrame(rows, schema), replace(chain("a", "b").build(), deadline=2)
    out = shards.replay(df, [p], lambda t: t // 10).where("kind = 'expired'").collect()
    assert [(r.shard, r.tick) for r in out] == [("u", 2)]
    got = {(r.shard, r.tick): (r.expired, r.stalled, r.active) for r in shards.ticks(df, [p], lambda t: t // 10, 2).collect()}
    assert got[("u", 2)] == ([], ["p"], 1) and got[("u", 3)] == (["p"], [], 0) and got[("u", 5)] == ([], [], 0)
    assert shards.replay(spark.createDataFrame([], schema), [p], lambda t: t // 10).collect() == []


def test_streaming_timer(spark, tmp_path):
    """A silent shard's run expires once the watermark has passed its deadline."""
    schema = "shard string, edge_seq long, source string, label string, rank int, s string, n double, b boolean, start_t long, end_t long, at timestamp"
    p = [replace(chain("a", "b").build(), deadline=1)]
    second = 1_000_000

    def rows(shard, at, kind):
        return [(shard, 0, f"{shard}{at}", "eventType", 1, kind, None, None, at * second, None, datetime.fromtimestamp(at)), (shard, 1, f"{shard}{at}", "actor", 0, shard, None, None, at * second, None, datetime.fromtimestamp(at))]

    for i, part in enumerate((rows("u", 5, "a"), rows("v", 95, "z"), rows("v", 96, "z"))):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("at", "1 second")
    out = shards.stream(src, p, lambda t: t // (10 * second), lambda k: k * 10_000, horizon=20 * second)
    q = out.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
        assert [(r.kind, r.shard) for r in spark.table("timed").collect()] == [("advanced", "u"), ("expired", "u")]
    finally:
        q.stop()


def test_state_is_bounded():
    m = Machine([chain("a", "b").build()])
    for i in range(200):
        m.feed([Edge(f"e{i}", "eventType", "c", i, i + 1), Edge(f"e{i}", "actor", N("u"), i)])
    m.feed(ev("x", "a", 200, actor=N("u")))
    assert m.evict(200) == 200 and m.evict(150, idle=True) == 150 and ("x", "actor") in m.store
    assert kinds(m.feed(ev("y", "b", 400, actor=N("u")))) == ["completed"]
    d = shards.Drive(Machine([chain("a", "b").build()]), "u")
    for i in range(200):
        for e in ev(f"e{i}", "a", i, actor=N("u")):
            d.add(e)
    d.flush()
    assert d.machine.log == [] and len(d.out) == 200


def test_evaluators_are_plug_ins():
    p = PatternBuilder("p").stage("a").edge("a", "eventType", "a").bind("a", "v", "x").let("y", Op("+", Ref("x"), Lit("!"))).done().build()
    assert kinds(Machine([p]).feed(ev("x", "a", 1, v="s"))) == []

    def joined(op, a, b):
        return a + b if op == "+" and isinstance(a, str) and isinstance(b, str) else plain_arithmetic(op, a, b)

    m = Machine([p], evaluator=lambda e, held: evaluate_let(e, held, joined))
    assert m.feed(ev("x", "a", 1, v="s"))[0].bindings["y"] == "s!"
    assert m.copy().feed(ev("z", "a", 2, v="t"))[0].bindings["y"] == "t!"


def test_indexed_runs_are_found_as_by_looking_at_all():
    """Any edge's triggers hold all clauses that it satisfies."""
    from weftline.streaming.machine import trigger, triggers

    values = ["a", "b", 1, 1.0, True, False, N("a"), float("nan"), 0]
    for v in values:
        for asked in values:
            for c in PatternBuilder("p").stage("s").edge("s", "l", asked).done().build().stages[0].clauses:
                if compare_python("=", v, asked):
                    assert trigger(c) in triggers(Edge("s", "l", v, 1)), (v, asked)


def test_shard_variables():
    assert "guest" in shards.shard_variables([rename_vars(hospitality(), "x", ["guest"])])


def test_relations_are_exclusive_and_inverse():
    spans = [(a, b) for a in range(5) for b in range(a + 1, 6)]
    for a, b in product(spans, spans):
        name = relation_of(*a, *b)
        assert name in RELATIONS and relation_of(*b, *a) == INVERSE[name]
    assert relation_of(1, None, 2, 3) is None and relation_of(1, 1, 1, 1) == "meets"


def test_order_across_kinds():
    nan = float("nan")
    assert compare_python("<", N("x"), "a") and compare_python("<", "z", 1.0) and compare_python(">", True, 5)
    assert not compare_python("=", nan, nan) and not compare_python("<", nan, 1.0) and not compare_python("=", N("a"), "a")


def test_fractional_times(spark):
    p = chain("a", "b").build()
    rows = [(e, x, v, t) for e, k, t in (("e1", "a", 0.25), ("e2", "b", 0.75), ("e3", "b", 0.5)) for x, v in (("eventType", k), ("actor", Node("u")))]
    edges = TemporalGraph.of(spark, rows, None, "double").edges().withColumn("shard", F.lit("u"))
    log = shards.replay(edges, [replace(p, deadline=None)], lambda t: int(t * 2))
    done = log.where("kind = 'completed'").collect()
    assert sorted((r.starts["e1"], r.starts["e2"], r["at"], r.tick) for r in done) == [(0.25, 0.5, 0.5, 1), (0.25, 0.75, 0.75, 1)]


def test_plants_without_an_open_run_are_not_stale():
    m = Machine([replace(chain("a", "z").build(), name="plant")])
    m.register_pair("gun", "plant", "payoff")
    for label, value in [("eventType", "a"), ("actor", Node("u"))]:
        m.insert(Edge("e1", label, value, 1))
    m.notify(Edge("e1", "eventType", "a", 1))
    for _ in range(5):
        m.end_tick()
    assert [x["stale"] for x in m.plant_status(3)] == [True]
    m.kill_involving("u")
    assert [(x["stale"], x["active_plants"], x["ticks_since_advance"]) for x in m.plant_status(3)] == [(False, 0, 5)]


def test_a_stage_is_asked_once_for_runs_that_hold_the_same():
    """Runs of one actor take an edge by one look; loop runs that differ in the replaced occurrence have one successor."""
    one = PatternBuilder("o").stage("e").edge("e", "type", "x").bind("e", "who", "w").done().build()
    m, looks, who = Machine([repeat_range("r", one, 3, 5, ["w"])]), [], N("p")
    look = m._stage
    m._stage = lambda *a: looks.append(a) or look(*a)
    done = []
    for t in range(20):
        for e in (Edge(f"s{t}", "type", "x", t), Edge(f"s{t}", "who", who, t)):
            m.insert(e)
        done += [x for x in m.notify(Edge(f"s{t}", "type", "x", t)) if x.kind == "completed"]
        m.drain_completed()
    assert len(done) == sum(min(b - a + 1, 5) - 2 for b in range(20) for a in range(b - 1))
    assert len(looks) <= 2 * 20
    assert m.stats["fingerprints"] <= 8 * 20 * 19 / 2


def test_completions_without_events(spark):
    """completed() has the completed events of replay(), with equal starts, double edges, a group and a loop."""
    b = PatternBuilder("g")
    for i, kind in enumerate("aab"):
        b = b.stage(f"e{i}").edge(f"e{i}", "type", kind).bind(f"e{i}", "who", "w").done()
    one = PatternBuilder("o").stage("e").edge("e", "type", "a").bind("e", "who", "w").done().build()
    patterns = [b.mark_unordered([0, 1]).build(), repeat_range("r", one, 2, 3, ["w"])]
    kinds = [("a", 1), ("a", 1), ("b", 1), ("a", 2), ("b", 3), ("b", 3), ("a", 4), ("a", 5), ("b", 6)]
    rows = [(w, 0, f"s{i}", x, r, v, None, None, t, None) for w in "pq" for i, (k, t) in enumerate(kinds) for x, r, v in (("type", 1, k), ("who", 0, w))]
    rows += [r for r in rows if r[2] == "s5"]
    edges = spark.createDataFrame([(w, i, *x) for i, (w, _, *x) in enumerate(rows)], "shard string, edge_seq long, source string, label string, rank int, s string, n double, b boolean, start_t long, end_t long")
    anchors = ["e0", "e1", "e2", "first_e", "last_e"]
    got = sorted(tuple(r) for r in shards.completed(edges, patterns, anchors).fillna(-1).collect())
    log = shards.replay(edges, patterns).where("kind = 'completed'").collect()
    assert got == sorted((r.shard, r.pattern, r.reps, *[r.starts.get(a, -1) for a in anchors]) for r in log) and got
