"""The incremental matcher on Spark: one machine a shard, in a batch replay or in a streaming query.

A shard key is a value that a match's edges share (an actor, say): every edge is routed to its shards before it comes here.
Without one, a constant key gives one machine, as a single process would: exclusive groups and endings of runs hold within
a machine, so that patterns which must end each other belong to shards that both share. State is the machine itself, kept by Spark's
state store; a restarted task continues from the last committed one. Times are whole numbers, or doubles where start_t has
a fractional type."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Literal, Node, Parts
from ..plans.pattern import Bind, Pattern, target_vars
from ..sources.predicates import matches
from .machine import Edge, Event, Machine, Run, TickDelta

EVENTS = "shard string, kind string, pattern string, match_id long, stage_index int, bindings map<string,string>, clause_label string, trigger_source string, stage_reached int, ticks_elapsed int, starts map<string,bigint>, reps int, tick long, at long"
FRACTIONAL = ("float", "double", "decimal")
COLUMNS = ["shard", "edge_seq", "source", "label", "rank", "s", "n", "b", "start_t", "end_t"]


def shard_variables(patterns: list[Pattern]) -> set[str]:
    """Variables by which a set of patterns can be sharded: bound in every stage and in every negation of each."""

    def bound(clauses) -> set[str]:
        return {c.target.var for c in clauses if isinstance(c.target, Bind)} | {c.source for c in clauses}

    own = [set.intersection(*[bound(s.clauses) for s in p.stages], *[bound(n.clauses) for n in p.negations]) for p in patterns if p.stages]
    return set.intersection(*own) if own else set()


def by_node(edges: DataFrame, label: str) -> DataFrame:
    """Each source's edges, routed to the node that its edge of a label refers to."""
    to = edges.where(F.col("label") == label).select("source", F.col("s").alias("shard")).distinct()
    return edges.join(to, "source")


def _value(rank: int, s: Any, n: Any, b: Any) -> Literal:
    return Node(s) if rank == 0 else s if rank == 1 else float(n) if rank == 2 else bool(b)


def edges_of(pdf: pd.DataFrame) -> Iterator[Edge]:
    t = float if pdf["start_t"].dtype.kind == "f" else int
    for x in pdf.itertuples(index=False):
        yield Edge(x.source, x.label, _value(x.rank, x.s, x.n, x.b), t(x.start_t), None if pd.isna(x.end_t) else t(x.end_t))


def timed(edges: DataFrame, columns: list[str] = COLUMNS) -> tuple[DataFrame, str]:
    """The edges' columns with times of one type, and the schema of their events."""
    whole = not edges.schema["start_t"].dataType.typeName().startswith(FRACTIONAL)
    out = edges.select(*[F.col(c).cast("long" if whole else "double").alias(c) if c in ("start_t", "end_t") else F.col(c) for c in columns])
    return out, EVENTS if whole else EVENTS.replace("map<string,bigint>", "map<string,double>").replace("at long", "at double")


def _row(shard: str, e: Event, tick: int, at: float | None) -> tuple:
    show = lambda v: v.id if isinstance(v, Node) else str(v)
    return (shard, e.kind, e.pattern, e.match_id, e.stage_index, {k: show(v) for k, v in e.bindings.items()}, e.clause_label, e.trigger_source, e.stage_reached, e.ticks_elapsed, {k: s[0] for k, s in e.spans.items()}, e.reps, tick, at)


NAMES = [x.split()[0] for x in EVENTS.split(", ")]
TEXTS = pa.map_(pa.string(), pa.string())
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": TEXTS, "double": pa.float64(), "map<string,bigint>": pa.map_(pa.string(), pa.int64()), "map<string,double>": pa.map_(pa.string(), pa.float64()), "array<string>": pa.list_(pa.string())}
#: Event rows, or edges of one shard, that are handed on at once.
ROWS = 5000


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    plain = lambda c, t: [list(v.items()) if isinstance(v, dict) else v for v in c] if pa.types.is_map(t) else c
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(plain(c, TYPES[kind]), TYPES[kind]) for (_, kind), c in zip(fields, columns, strict=True)], names=[n for n, _ in fields])


class Drive:
    """Feeds a machine edges by start time, and ends the ticks that lie before them."""

    def __init__(self, machine: Machine, shard: str, tick_of: Callable[[float], int] | None = None, each_tick: Callable[[TickDelta], tuple] | None = None, stale: int = 10, anchors: list[str] | None = None) -> None:
        self.machine, self.shard, self.tick_of, self.each_tick, self.stale, self.anchors = machine, shard, tick_of, each_tick, stale, anchors
        self.group: list[Edge] = []
        self.out: list[tuple] = []
        self.deltas: list[tuple] = []
        if anchors is not None:
            machine.sink = self.sink

    def sink(self, p: Pattern, runs: list[Run], anchor: str, e: Edge, reps: int) -> None:
        """Completions by the starts of their anchors."""
        n = len(runs)
        starts = [[e.start] * n if a == anchor else [r.spans[a][0] for r in runs] if a in runs[0].spans else [None] * n for a in self.anchors]
        self.out.extend(zip([self.shard] * n, [p.name] * n, [reps] * n, *starts, strict=True))

    def add(self, e: Edge) -> None:
        if self.group and e.start != self.group[0].start:
            self.flush()
        self.group.append(e)

    def to(self, tick: int) -> None:
        """Ends all ticks before this one. Where no run is left to expire and nobody asks for them, they are passed over."""
        m = self.machine
        while m.tick < tick:
            if self.each_tick is None and not m.log and not len(m.runs) - len(m.done):
                m.tick = tick
                break
            at = m.tick
            delta, expired = m.end_tick(self.stale)
            self.out.extend(_row(self.shard, x, at, None) for x in expired)
            if self.each_tick is not None:
                self.deltas.append((self.shard, *self.each_tick(delta)))

    def flush(self) -> None:
        m, group = self.machine, self.group
        if not group:
            return
        if self.tick_of is not None:
            now = self.tick_of(group[0].start)
            if not m.stats["edges"]:
                m.tick = now
            self.to(now)
        told = m.feed(group)
        if self.anchors is None:
            self.out.extend(_row(self.shard, x, m.tick, group[0].start) for x in told)
        else:
            self.out.extend((self.shard, x.pattern, x.reps, *[x.spans[a][0] if a in x.spans else None for a in self.anchors]) for x in told if x.kind == "completed")
        m.drain_completed()
        if self.tick_of is None:
            m.log = []  # only ticks ask for it
        self.group = []


def _edges(batch: pa.RecordBatch) -> Iterator[tuple[str, Edge]]:
    known: dict[tuple, Literal] = {}  # equal values are one object, by which the machine sees that they are equal
    for shard, source, label, rank, s, n, b, start, end in zip(*(batch.column(c).to_pylist() for c in ("shard", "source", "label", "rank", "s", "n", "b", "start_t", "end_t")), strict=True):
        if rank < 2:
            value = known.get((rank, s))
            if value is None:
                value = known[rank, s] = _value(rank, s, n, b)
        else:
            value = _value(rank, s, n, b)
        yield shard, Edge(source, label, value, start, end)


def _replayed(edges: DataFrame, patterns: list[Pattern], tick_of: Callable[[float], int] | None, schema: str, take: Callable[[Drive, bool], list[tuple]], **how: Any) -> DataFrame:
    """Shards are dealt and sorted by Spark and streamed through their machines: a task holds one machine and one batch of
    edges, never a shard's edges. Ticks end for all shards up to the tick of the table's last edge, whose start is the one
    number that goes through the driver."""
    last = None
    if tick_of is not None:
        until = edges.agg(F.max("start_t")).first()[0]
        last = None if until is None else tick_of(until)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d: Drive | None = None
        blank, rows = Machine(patterns), []

        def end() -> list[tuple]:
            if d is None:
                return []
            d.flush()
            if last is not None:
                d.to(last)
            d.machine.sink = None  # else the machine and its drive wait for the collector
            return take(d, True)

        # runs and rows hold no cycles: looking for some after every few thousand of them is a fifth of the time
        least = gc.get_threshold()
        gc.set_threshold(max(100_000, least[0]), *least[1:])
        try:
            for batch in batches:
                for shard, e in _edges(batch):
                    if d is None or shard != d.shard:
                        rows += end()
                        d = Drive(blank.copy(), shard, tick_of, **how)
                    d.add(e)
                    if len(d.out) >= ROWS or len(rows) >= ROWS:
                        rows += take(d, False)
                        yield batch_of(rows, schema)
                        rows = []
            rows += end()
            if rows:
                yield batch_of(rows, schema)
        finally:
            gc.set_threshold(*least)

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return timed(edges)[0].repartition(parts, "shard").sortWithinPartitions("shard", "start_t", "edge_seq").mapInArrow(run, schema)


def replay(edges: DataFrame, patterns: list[Pattern], tick_of: Callable[[float], int] | None = None) -> DataFrame:
    """Events of a bounded table of edges with a shard column, each shard in the order of start and edge_seq."""

    def take(d: Drive, last: bool) -> list[tuple]:
        out, d.out = d.out, []
        return out

    return _replayed(edges, patterns, tick_of, timed(edges)[1], take)


def completed(edges: DataFrame, patterns: list[Pattern], anchors: list[str]) -> DataFrame:
    """The completed events of replay alone: shard, pattern, reps, and the start of each anchor. What they are not asked for
    (bindings, and runs that nothing can follow) isn't made, and edges that no clause can match are left out before they are dealt."""

    def take(d: Drive, last: bool) -> list[tuple]:
        out, d.out = d.out, []
        return out

    asked = F.lit(False)
    for c in {c for p in patterns for s in (*p.stages, *p.negations) for c in s.clauses}:
        asked = asked | ((F.col("label") == c.label) & (F.lit(True) if target_vars(c.target) else matches(c.target, Parts.edge())))
    edges = edges.where(F.coalesce(asked, F.lit(False)))
    kind = "double" if "double" in timed(edges)[1] else "long"
    schema = ", ".join(["shard string", "pattern string", "reps int", *[f"{a} {kind}" for a in anchors]])
    return _replayed(edges, patterns, None, schema, take, anchors=anchors)


DELTAS = "shard string, tick long, advanced array<string>, completed array<string>, negated array<string>, expired array<string>, stalled array<string>, active int"


def ticks(edges: DataFrame, patterns: list[Pattern], tick_of: Callable[[float], int], stale: int = 10) -> DataFrame:
    """What each tick of each shard brought: the machine's tick deltas, stalled patterns included."""

    def take(d: Drive, last: bool) -> list[tuple]:
        out, d.deltas, d.out = d.deltas, [], []
        return out

    return _replayed(edges, patterns, tick_of, DELTAS, take, each_tick=lambda x: (x.tick, x.advanced, x.completed, x.negated, x.expired, x.stalled, x.active), stale=stale)


def report(edges: DataFrame, patterns: list[Pattern], tick_of: Callable[[float], int] | None, schema: str, of: Callable[[Machine], list[tuple]]) -> DataFrame:
    """Rows that a function says of each shard's machine at the end of the table's last tick but one; shard comes first."""

    def take(d: Drive, last: bool) -> list[tuple]:
        d.out = []
        return [(d.shard, *x) for x in of(d.machine)] if last else []

    return _replayed(edges, patterns, tick_of, "shard string, " + schema, take)


def stream(edges: DataFrame, patterns: list[Pattern], tick_of: Callable[[float], int] | None = None, tick_start: Callable[[int], int] | None = None, horizon: float | None = None) -> DataFrame:
    """The same over a streaming DataFrame, append mode: the machine of a shard is its state. In a micro-batch edges are
    sorted by start; what comes later than its time misses matches, as in any incremental evaluation.

    With tick_start (the time, in milliseconds, at which a tick begins) a shard without further edges ends its ticks as well,
    by an event-time timer; edges then need a column at with a watermark. Edges that ended go from the state; with horizon,
    also those of sources that had no edge for so long and that no open run holds."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else Machine(patterns)
        d = Drive(machine, key[0], tick_of)
        if state.hasTimedOut:
            now = machine.tick
            while tick_start(now + 1) <= state.getCurrentWatermarkMs():
                now += 1
            d.to(now)
        else:
            pdf = pd.concat(list(batches)).sort_values(["start_t", "edge_seq"], kind="stable")
            for e in edges_of(pdf):
                d.add(e)
            d.flush()
            if len(pdf):
                end = pdf["start_t"].iloc[-1].item()
                machine.evict(end if horizon is None else end - horizon, horizon is not None)
        state.update((pickle.dumps(machine),))
        if tick_start is not None and any(p.deadline is not None or p.inactivity is not None for p in patterns) and machine.active():
            state.setTimeoutTimestamp(max(tick_start(machine.tick + 1), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(d.out, columns=NAMES)

    columns = [*COLUMNS, "at"] if tick_start is not None else COLUMNS
    dealt, events = timed(edges, columns)
    return dealt.groupBy("shard").applyInPandasWithState(run, events, "machine binary", "append", "EventTimeTimeout" if tick_start is not None else "NoTimeout")


def metrics(events: DataFrame) -> DataFrame:
    """Counts a pattern of an event log, and when it last advanced."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(kind)
    last = F.max(F.when(F.col("kind").isin("advanced", "completed"), F.col("tick"))).alias("last_tick")
    return events.groupBy("pattern").agg(n("advanced"), n("completed"), n("negated"), n("expired"), last)


def tick_deltas(events: DataFrame) -> DataFrame:
    """The names that advanced, completed, were negated or expired in each tick of an event log; ticks() has the stalled ones too."""
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("pattern")))).alias(kind)
    return events.groupBy("tick").agg(*map(names, ("advanced", "completed", "negated", "expired")))
