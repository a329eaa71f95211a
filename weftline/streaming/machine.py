"""The incremental matcher of one shard: edges come one by one, partial matches advance, and events say what happened.

Plain Python without Spark, so that a stateful operator, a batch replay and a test drive the same transitions. A copy of a
machine (copy()) is a speculation: what happens in it stays in it.

Rules: an edge advances a run whose next stage's first clause it satisfies, if it starts later than all the run holds
(stages of one group without order excepted); other clauses are looked up at the edge's start; the run that was advanced
stays, unless the pattern advances in place; equal runs are kept once; an edge in an open window that satisfies a clause of
an "unless", while its other clauses hold now, ends the run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions.intervals import constraint_of
from ..functions.values import Literal, Node
from ..plans.pattern import Bind, Constraint, Expr, Is, Lit, Pattern, Ref, Stage, target_vars
from ..sources.predicates import matches_python

Time = int | float
Span = tuple[Time, Time | None]


@dataclass(frozen=True)
class Edge:
    source: str
    label: str
    value: Literal
    start: Time
    end: Time | None = None

    def covers(self, t: Time) -> bool:
        return self.start <= t and (self.end is None or t < self.end)


@dataclass
class Event:
    kind: str  # advanced completed negated expired
    pattern: str
    match_id: int
    stage_index: int | None = None
    bindings: dict[str, Literal] = field(default_factory=dict)
    clause_label: str | None = None
    trigger_source: str | None = None
    stage_reached: int | None = None
    ticks_elapsed: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    spans: dict[str, Span] = field(default_factory=dict)
    reps: int = 0


@dataclass
class Run:
    """A partial match."""

    pattern: int
    bindings: dict[str, Literal]
    spans: dict[str, Span]
    next: int
    id: int
    created: int
    advanced: int
    reps: int = 0
    mask: int = 0
    state: str = "active"

    known: tuple | None = None
    held: tuple | None = None
    turn: tuple | None = None
    late: Time | None = None
    #: Where its steps are found, by the identity of the values that it holds; not for another process.
    at: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"at": None}

    def base(self, anchor: str) -> tuple:
        """What a run's successors by one edge at one stage differ in; made once, as a run waits for one stage (groups aside)."""
        if self.held is None:
            self.held = (self.pattern, self.next, self.reps, self.mask, self._bound(), frozenset(x for x in self.spans.items() if x[0] != anchor))
        return self.held

    def turned(self, anchor: str, own: frozenset[str]) -> tuple:
        """The same for the next turn of a loop, which forgets the loop's own variables."""
        if self.turn is None:
            base = self.base(anchor)
            self.turn = (*base[:4], frozenset(x for x in base[4] if x[0] not in own), base[5])
        return self.turn

    def latest(self) -> Time:
        """The last start that the run holds."""
        if self.late is None:
            starts = [x[0] for x in self.spans.values()]
            self.late = max(starts) if all(x == x for x in starts) else float("nan")
        return self.late

    def _bound(self) -> frozenset:
        return frozenset((k, v.__class__, v if v == v else "nan") for k, v in self.bindings.items())

    def key(self) -> tuple:
        """What makes two runs equal; made once, as a stored run doesn't change."""
        if self.known is None:
            self.known = (self.pattern, self.next, self.reps, self.mask, self._bound(), frozenset(self.spans.items()))
        return self.known


@dataclass
class Metrics:
    advanced: int = 0
    completed: int = 0
    negated: int = 0
    last_advanced: int | None = None


@dataclass
class TickDelta:
    tick: int
    advanced: list[str]
    completed: list[str]
    negated: list[str]
    expired: list[str]
    stalled: list[str]
    active: int


#: A plug-in for the arithmetic of values: (operator, left, right) to a value, None where it has none.
Arithmetic = Callable[[str, Any, Any], Any]
#: A plug-in for computed bindings: (expression, bindings) to a value, None where it has none.
LetEvaluator = Callable[[Expr, dict[str, Literal]], Any]


def plain_arithmetic(op: str, a: Any, b: Any) -> float | None:
    """Numbers alone; a division by zero has no value."""
    if any(not isinstance(x, (int, float)) or isinstance(x, bool) for x in (a, b)) or (op == "/" and b == 0):
        return None
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[op]()


def evaluate_let(e: Expr, bindings: dict[str, Literal], arithmetic: Arithmetic = plain_arithmetic) -> Literal | None:
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Ref):
        v = bindings.get(e.var)
        return None if isinstance(v, Node) else v
    a, b = (evaluate_let(x, bindings, arithmetic) for x in (e.left, e.right))
    return None if a is None or b is None else arithmetic(e.op, a, b)


def trigger(c: Any) -> tuple:
    """Where a clause is looked for: by its label and the text or truth value that it asks for, if it asks for one."""
    t = c.target
    asked = t.value if isinstance(t, Is) else t.values[0] if isinstance(t, Constraint) and t.op == "=" and not t.var else None
    return (c.label, type(asked), asked) if isinstance(asked, (str, bool)) else (c.label,)


def triggers(e: Edge) -> tuple:
    """The places where clauses that an edge may satisfy are found."""
    return ((e.label,), (e.label, type(e.value), e.value)) if isinstance(e.value, (str, bool)) else ((e.label,),)


def reads(s: Stage) -> tuple[str, ...] | None:
    """The variables of a run that decide what an edge adds to it at a stage; None if an evaluator sees them all."""
    if s.lets:
        return None
    return tuple(sorted({c.source for c in s.clauses}.union(*[target_vars(c.target) for c in s.clauses])))


@dataclass
class Step:
    """What an edge adds to all runs that hold the same of what a stage reads, and two tokens of it: with everything, and
    with what a turn of the loop keeps. Equal steps have equal tokens until completed runs are drained."""

    new: dict[str, Literal]
    whole: int
    kept: int
    #: Whether runs go to the sink together.
    sinks: bool = False


class Machine:
    def __init__(self, patterns: Iterable[Pattern] = (), now: Time | None = None, evaluator: LetEvaluator = evaluate_let) -> None:
        self.evaluator = evaluator
        self.patterns: list[Pattern] = []
        self.enabled: list[bool] = []
        self.metrics: list[Metrics] = []
        self.store: dict[tuple[str, str], list[Edge]] = {}
        self.runs: dict[int, Run] = {}
        self.keys: set[tuple] = set()
        self.now, self.tick, self.next_id = now, 0, 0
        self.stats = {"edges": 0, "fingerprints": 0, "negation_checks": 0, "peak_active": 0}
        self.log: list[Event] = []
        self.done: dict[int, Run] = {}
        self.waiting: dict[tuple, dict[int, Run]] = {}
        self.of_pattern: dict[int, dict[int, Run]] = {}
        self.named: dict[str, tuple[bool, list[Metrics]]] = {}
        self.groups: list[list[tuple[int, ...]]] = []
        self.asks: list[list[tuple]] = []
        self.metadata: list[dict[str, str]] = []
        self.starts: dict[str, set[int]] = {}
        self.ends: dict[str, set[int]] = {}
        self.pairs: list[tuple[str, str, str, str | None]] = []
        self.reads: list[list[tuple[str, ...] | None]] = []
        self.own: list[frozenset[str]] = []
        self.tokens: dict[tuple, int] = {}
        self.next_token = 0
        #: Takes completions in place of events and runs: (pattern, the runs before the last stage, its anchor, its edge, reps).
        self.sink: Callable[[Pattern, list[Run], str, Edge, int], None] | None = None
        self.sent: dict[int, list[int]] = {}
        self.sunk: list[tuple] = []
        for p in patterns:
            self.register(p)

    # patterns
    def register(self, p: Pattern) -> int:
        i = len(self.patterns)
        self.patterns.append(p)
        self.enabled.append(True)
        self.metrics.append(Metrics())
        self.groups.append([tuple(p.group_of(k) or ()) for k in range(len(p.stages))])
        self.asks.append([trigger(x.clauses[0]) if x.clauses else () for x in p.stages])
        self.metadata.append(dict(p.metadata))
        self.reads.append([reads(s) for s in p.stages])
        self.own.append(frozenset(self._loop_names(p)))
        for stage in p.group_of(0) or (0,):
            if p.stages and p.stages[stage].clauses:
                self.starts.setdefault(trigger(p.stages[stage].clauses[0]), set()).add(i)
        for n in p.negations:
            for c in n.clauses:
                self.ends.setdefault(trigger(c), set()).add(i)
        private, own = self.named.get(p.name, (False, []))
        self.named[p.name] = (private or p.private, [*own, self.metrics[-1]])
        return i

    @staticmethod
    def _loop_names(p: Pattern) -> set[str]:
        """The variables that a turn of the loop binds anew."""
        if p.loop is None:
            return set()
        own = p.stages[p.loop.first : p.loop.last + 1]
        names = {s.anchor for s in own} | {n for s in own for n, _ in s.lets} | {c.source for s in own for c in s.clauses} | {v for s in own for c in s.clauses if isinstance(c.target, Bind) for v in target_vars(c.target)}
        return names - set(p.loop.shared)

    def _index(self, r: Run, on: bool) -> None:
        """Puts an active run where the edges that can advance or end it are looked for, or takes it away."""
        asks, groups = self.asks[r.pattern], self.groups[r.pattern]
        places = [self.of_pattern.setdefault(r.pattern, {})]
        if r.next < len(asks):
            for stage in [s for s in groups[r.next] if not r.mask >> s & 1] or (r.next,):
                if asks[stage]:
                    places.append(self.waiting.setdefault(asks[stage], {}))
        for place in places:
            if on:
                place[r.id] = r
            else:
                place.pop(r.id, None)

    def set_enabled(self, pattern: int, on: bool) -> None:
        self.enabled[pattern] = on
        if not on:
            self._remove(r for r in self.active() if r.pattern == pattern)

    def deregister(self, pattern: int) -> None:
        self.set_enabled(pattern, False)

    def is_enabled(self, pattern: int) -> bool:
        return self.enabled[pattern]

    def importance(self) -> dict[str, float]:
        return {p.name: p.importance for p in self.patterns if not p.private}

    # runs
    def active(self, pattern: str | None = None) -> list[Run]:
        return [r for r in self.runs.values() if r.state == "active" and (pattern is None or self.patterns[r.pattern].name == pattern)]

    def _active_of(self, i: int) -> list[Run]:
        return list(self.of_pattern.get(i, {}).values())

    def _remove(self, runs: Iterable[Run]) -> int:
        gone = list(runs)
        for r in gone:
            r.state = "dead"
            if self.runs.pop(r.id, None):
                self._index(r, False)
                self.keys.discard(r.key())
        return len(gone)

    def drain_completed(self) -> list[Run]:
        done = list(self.done.values())
        self.done.clear()
        for r in done:
            self.runs.pop(r.id)
            self.keys.discard(r.key())
        self.keys.difference_update(self.sunk)
        self.sunk.clear()
        self.sent.clear()
        return [r for r in done if not self.patterns[r.pattern].private]

    def evict(self, before: Time, idle: bool = False) -> int:
        """Forgets edges that ended by a time, which no later edge can see; with idle also those of sources without an edge
        since then that no active run holds. A negation over a one-stage match looks at all times: then nothing goes."""
        if any(len(p.stages) == 1 and p.negations for p in self.patterns):
            return 0
        gone = 0
        held = {v.id for r in self.runs.values() for v in r.bindings.values() if isinstance(v, Node)} if idle else set()
        recent = {s for (s, _), own in self.store.items() if any(x.start >= before for x in own)} if idle else set()
        for key, own in list(self.store.items()):
            left = [x for x in own if (x.end is None or x.end > before) and not (idle and key[0] not in held and key[0] not in recent)]
            gone += len(own) - len(left)
            if left:
                self.store[key] = left
            else:
                del self.store[key]
        asked = {k[1] for k in self.keys if len(k) == 2}
        self.tokens = {x: n for x, n in self.tokens.items() if n in asked}
        return gone

    def kill_involving(self, node: str) -> int:
        return self._remove(r for r in self.active() if Node(node) in [v for v in r.bindings.values() if isinstance(v, Node)])

    def copy(self) -> Machine:
        other = Machine.__new__(Machine)
        other.__dict__ = self.__dict__ | {
            "patterns": list(self.patterns), "enabled": list(self.enabled), "metrics": [replace(m) for m in self.metrics], "store": {k: list(v) for k, v in self.store.items()},
            "runs": {i: replace(r, bindings=dict(r.bindings), spans=dict(r.spans)) for i, r in self.runs.items()}, "keys": set(self.keys), "stats": dict(self.stats), "log": [],
            "starts": {k: set(v) for k, v in self.starts.items()}, "ends": {k: set(v) for k, v in self.ends.items()}, "pairs": list(self.pairs), "waiting": {}, "of_pattern": {}, "done": {}, "named": {},
            "reads": list(self.reads), "own": list(self.own), "tokens": dict(self.tokens), "sink": None, "sent": {k: list(v) for k, v in self.sent.items()}, "sunk": list(self.sunk), "groups": list(self.groups), "asks": list(self.asks), "metadata": list(self.metadata),
        }
        for p, m in zip(other.patterns, other.metrics, strict=True):
            private, own = other.named.get(p.name, (False, []))
            other.named[p.name] = (private or p.private, [*own, m])
        for r in other.runs.values():
            if r.state == "active":
                other._index(r, True)
            else:
                other.done[r.id] = r
        return other

    # edges
    def insert(self, e: Edge) -> None:
        self.store.setdefault((e.source, e.label), []).append(e)

    def add(self, e: Edge) -> list[Event]:
        self.insert(e)
        return self.notify(e)

    def feed(self, edges: Iterable[Edge]) -> list[Event]:
        """Edges in time's order: all of one start are inserted before each of them is told."""
        out, group = [], []
        for e in [*edges, None]:
            if e is None or (group and e.start != group[0].start):
                for g in group:
                    self.insert(g)
                for g in group:
                    out += self.notify(g)
                group = []
            if e is not None:
                group.append(e)
        return out

    def _at(self, source: str, label: str, t: Time | None) -> Iterator[Edge]:
        return (e for e in self.store.get((source, label), ()) if t is None or e.covers(t))

    def _clock(self, e: Edge) -> Time:
        return e.start if self.now is None else self.now

    @staticmethod
    def _known(target, of) -> bool:
        """A constraint against a variable needs one that holds a value."""
        if isinstance(target, Constraint) and target.var:
            v = of(target.var)
            return v is not None and not isinstance(v, Node)
        return True

    def _stage(self, s: Stage, e: Edge, held: dict[str, Literal]) -> dict[str, Literal] | None:
        """The bindings that a stage adds to a run's when the edge triggers it; None if it doesn't."""
        first = s.clauses[0] if s.clauses else None
        if first is None or first.label != e.label or (isinstance(b := held.get(first.source), Node) and b.id != e.source):
            return None
        if not self._known(first.target, held.get) or not matches_python(first.target, e.value, held.get):
            return None
        new = {s.anchor: Node(e.source)}
        if first.source not in held:
            new[first.source] = Node(e.source)
        if isinstance(first.target, Bind) and first.target.var not in held:
            new.setdefault(first.target.var, e.value)
        now = held | new
        for c in s.clauses[1:]:
            at = now.get(c.source)
            if at is None and c.bare:
                at = Node(c.source)
            if not isinstance(at, Node) or not self._known(c.target, now.get):
                return None
            hit = next((x for x in self._at(at.id, c.label, e.start) if matches_python(c.target, x.value, now.get)), None)
            if (hit is None) != c.negated:
                return None
            if hit is not None and isinstance(c.target, Bind) and c.target.var not in now:
                new[c.target.var] = now[c.target.var] = hit.value
        for name, x in s.lets:
            v = None if name in now else self.evaluator(x, now)
            if v is None:
                return None
            new[name] = now[name] = v
        return new

    def _killer(self, p: Pattern, r: Run, e: Edge) -> str | None:
        """The label of the clause by which an edge ends a run."""
        for n in p.negations:
            if n.start not in r.spans or (n.end is not None and n.end in r.spans) or e.start <= r.spans[n.start][0]:
                continue
            for i, c in enumerate(n.clauses):
                if c.label != e.label or not self._known(c.target, r.bindings.get) or not matches_python(c.target, e.value, r.bindings.get):
                    continue
                if isinstance(b := r.bindings.get(c.source), Node) and b.id != e.source:
                    continue
                if all(self._holds(o, e, c.source, r) for j, o in enumerate(n.clauses) if j != i):
                    return c.label
        return None

    def _holds(self, c, e: Edge, trigger: str, r: Run) -> bool:
        at = Node(e.source) if c.source == trigger else r.bindings.get(c.source)
        if not isinstance(at, Node) or not self._known(c.target, r.bindings.get):
            return False
        return any(matches_python(c.target, x.value, r.bindings.get) for x in self._at(at.id, c.label, self._clock(e)))

    def _window_blocked(self, p: Pattern, bindings: dict, spans: dict[str, Span], e: Edge) -> bool:
        """Whether a negation's body lies in a window of a finished one-stage match; its first clause at any time."""
        for n in p.negations:
            if not n.clauses or n.start not in spans or (n.end is not None and n.end not in spans):
                continue
            c, low, high = n.clauses[0], spans[n.start][0], None if n.end is None else spans[n.end][0]
            if not self._known(c.target, bindings.get):
                continue
            for (source, label), own in self.store.items():
                if label != c.label or (isinstance(b := bindings.get(c.source), Node) and b.id != source):
                    continue
                for x in own:
                    inside = low < x.start and (high is None or x.start < high)
                    probe = Run(0, bindings, spans, 0, -1, 0, 0)
                    if inside and matches_python(c.target, x.value, bindings.get) and all(self._holds(o, replace(e, source=source), c.source, probe) for o in n.clauses[1:]):
                        return True
        return False

    def _ordered(self, p: Pattern, spans: dict[str, Span], stage: int, e: Edge) -> bool:
        if all(span[0] < e.start for span in spans.values()):
            return True
        place = {s.anchor: i for i, s in enumerate(p.stages)}
        return all(span[0] < e.start or (a in place and p.same_group(place[a], stage)) for a, span in spans.items())

    @staticmethod
    def _relations(p: Pattern, spans: dict[str, Span]) -> bool:
        return all(constraint_of(t.relation, *spans[t.left], *spans[t.right], t.least, t.most) for t in p.temporal if t.left in spans and t.right in spans)

    def notify(self, e: Edge) -> list[Event]:
        """What an edge that is in the store already brings about."""
        self.stats["edges"] += 1
        events: list[Event] = []
        where = triggers(e)
        if not any(x in self.starts or x in self.ends or self.waiting.get(x) for x in where):
            self.stats["peak_active"] = max(self.stats["peak_active"], len(self.runs) - len(self.done))
            return events
        steps: dict[tuple, Any] = {}
        ends = sorted(set().union(*[self.ends.get(x, ()) for x in where])) if self.ends else ()
        killed = []
        for r in sorted((r for i in ends for r in self._active_of(i)), key=lambda r: r.id):
            self.stats["negation_checks"] += 1
            if (label := self._killer(self.patterns[r.pattern], r, e)) is not None:
                r.state = "dead"
                killed.append(r)
                events.append(Event("negated", self.patterns[r.pattern].name, r.id, clause_label=label, trigger_source=e.source, stage_reached=r.next, metadata=dict(self.patterns[r.pattern].metadata), spans=dict(r.spans)))
        fresh: list[Run] = []
        used: set[int] = set()
        places = [own for x in where if (own := self.waiting.get(x))]
        live = list(places[0].values()) if len(places) == 1 else sorted({r.id: r for own in places for r in own.values()}.values(), key=lambda r: r.id)
        for i in sorted(set().union(*[self.starts.get(x, ()) for x in where])):
            p = self.patterns[i]
            if not self.enabled[i]:
                continue
            first = self.groups[i][0] or (0,)
            for stage in first:
                if (new := self._stage(p.stages[stage], e, {})) is not None:
                    events += self._push(p, Run(i, {}, {}, first[0], -1, self.tick, self.tick), stage, new, e, fresh, used)
        tried: set[tuple] = set()
        sent: dict[tuple, list[Run]] = {}
        for r in live:  # oldest first
            i = r.pattern
            if r.state != "active" or not self.enabled[i]:
                continue
            p, group = self.patterns[i], self.groups[i][r.next]
            if not group and self.reads[i][r.next] is not None:
                if not (r.latest() if r.late is None else r.late) < e.start:
                    continue
                at = r.at if r.at is not None else self._place(r, r.next)
                step = steps.get(at, False)
                if step is False:
                    step = steps[at] = self._step(p, r, e)
                if step is None:
                    continue
                if step.sinks:
                    sent.setdefault(at, []).append(r)
                    continue
                if p.loop is not None:
                    # runs that differ in what this stage replaces have the same successors
                    if (base := r.held or r.base(p.stages[r.next].anchor)) in tried:
                        continue
                    tried.add(base)
                events += self._advance(p, r, step, e, fresh, used)
                continue
            for stage in [s for s in group if not r.mask >> s & 1] or (r.next,):
                if not ((r.latest() if r.late is None else r.late) < e.start or self._ordered(p, r.spans, stage, e)):
                    continue
                if self.reads[i][stage] is None:
                    new = self._stage(p.stages[stage], e, r.bindings)
                else:
                    at = r.at if r.at is not None and r.at[1] == stage else self._place(r, stage)
                    new = steps[at] if at in steps else steps.setdefault(at, self._stage(p.stages[stage], e, r.bindings))
                if new is not None:
                    events += self._push(p, r, stage, new, e, fresh, used)
        for at, runs in sent.items():
            self._send(runs, steps[at], e)
        self._remove(self.runs[i] for i in used if i in self.runs)
        for r in fresh:
            self.runs[r.id] = r
            if r.state == "active":
                self._index(r, True)
            else:
                self.done[r.id] = r
        self._remove(killed)
        self._count(events)
        self._exclude(fresh)
        self.stats["peak_active"] = max(self.stats["peak_active"], len(self.runs) - len(self.done))
        shown = [x for x in events if not self._private(x)]
        self.log += shown
        return shown

    def _private(self, x: Event) -> bool:
        return self.named[x.pattern][0]

    def _keep(self, r: Run, fresh: list[Run]) -> bool:
        """Stores a run unless there is an equal one."""
        self.stats["fingerprints"] += 1
        if (key := r.key()) in self.keys:
            return False
        self.keys.add(key)
        r.id, self.next_id = self.next_id, self.next_id + 1
        fresh.append(r)
        return True

    def _token(self, x: tuple) -> int:
        if x not in self.tokens:
            self.tokens[x] = self.next_token
            self.next_token += 1
        return self.tokens[x]

    def _step(self, p: Pattern, r: Run, e: Edge) -> Step | None:
        new = self._stage(p.stages[r.next], e, r.bindings)
        if new is None:
            return None
        bound = lambda names: frozenset((k, v.__class__, v if v == v else "nan") for k, v in names.items())
        kept = {k: v for k, v in new.items() if k not in self.own[r.pattern]} if p.loop else new
        at = (r.pattern, r.next, e.start, e.end)
        anchor = p.stages[r.next].anchor
        sinks = self.sink is not None and r.next + 1 >= len(p.stages) and not p.loop and not p.temporal and not p.advance_in_place and p.group is None and anchor not in r.bindings and anchor not in r.spans
        return Step(new, self._token((True, *at, bound(new))), self._token((False, *at, bound(kept))) if p.loop else -1, sinks)

    def _place(self, r: Run, stage: int) -> tuple:
        r.at = (r.pattern, stage, *[id(r.bindings.get(x)) for x in self.reads[r.pattern][stage]])
        return r.at

    def _send(self, runs: list[Run], step: Step, e: Edge) -> None:
        """Completions of runs by one step. Runs differ, so that equal completions come from one run and equal steps alone."""
        p = self.patterns[runs[0].pattern]
        before = self.sent.setdefault(step.whole, [])
        if before:
            known = set(before)
            runs = [r for r in runs if r.id not in known]
        before += [r.id for r in runs]
        self._sink(p, runs, p.stages[-1].anchor, e, 0)

    def _sink(self, p: Pattern, runs: list[Run], anchor: str, e: Edge, reps: int) -> None:
        if not runs:
            return
        self.next_id += len(runs)
        private, metrics = self.named[p.name]
        metrics[-1].completed += len(runs)
        metrics[-1].last_advanced = self.tick
        if not private:
            self.sink(p, runs, anchor, e, reps)

    def _advance(self, p: Pattern, r: Run, step: Step, e: Edge, fresh: list[Run], used: set[int]) -> list[Event]:
        """_push for a run that was there, at a stage outside of groups: an equal successor is found before it is made, and
        what goes to the sink is not made at all."""
        stage = p.stages[r.next]
        anchor = stage.anchor
        end = r.next + 1 >= len(p.stages)
        if anchor in r.bindings or (anchor in r.spans and not (p.loop and p.loop.first <= r.next)):
            return self._push(p, r, r.next, step.new, e, fresh, used)
        loop = p.loop if end else None
        reps = (r.reps + (1 if r.reps else 2)) if loop else r.reps
        base = r.base(anchor)
        out: list[Event] = []
        spans = None
        if not loop or reps >= loop.least:
            self.stats["fingerprints"] += 1
            key = (base, step.whole)
            if key not in self.keys:
                if p.temporal and end:
                    spans = r.spans | {anchor: (e.start, e.end)}
                if spans is None or self._relations(p, spans):
                    self.keys.add(key)
                    if end and self.sink is not None and p.group is None:
                        self.sunk.append(key)
                        self._sink(p, [r], anchor, e, reps)
                    else:
                        spans = r.spans | {anchor: (e.start, e.end)} if spans is None else spans
                        bindings = r.bindings | step.new
                        done = Run(r.pattern, bindings, spans, r.next + 1, self.next_id, r.created, self.tick, reps, r.mask, "complete" if end else "active", key)
                        self.next_id += 1
                        fresh.append(done)
                        out.append(Event("completed" if end else "advanced", p.name, done.id, r.next, dict(bindings) if end else {}, metadata=self.metadata[r.pattern], spans=dict(spans), reps=reps if loop else 0))
                    if p.advance_in_place:
                        used.add(r.id)
                elif not loop:
                    self.next_id += 1
        if loop and (loop.most is None or reps < loop.most):
            self.stats["fingerprints"] += 1
            key = (r.turned(anchor, self.own[r.pattern]), step.kept)
            if key not in self.keys:
                self.keys.add(key)
                spans = r.spans | {anchor: (e.start, e.end)}
                own = self.own[r.pattern]
                again = Run(r.pattern, {k: v for k, v in (r.bindings | step.new).items() if k not in own}, spans, loop.first, self.next_id, r.created, self.tick, reps, 0, "active", key)
                self.next_id += 1
                fresh.append(again)
                out.append(Event("advanced", p.name, again.id, r.next, metadata=self.metadata[r.pattern], spans=dict(spans), reps=reps))
        return out

    def _push(self, p: Pattern, r: Run, stage: int, new: dict, e: Edge, fresh: list[Run], used: set[int]) -> list[Event]:
        """The run with a stage more: a completion, a partial match, or a turn of the loop."""
        born = r.id < 0
        bindings, spans = r.bindings | new, r.spans | {p.stages[stage].anchor: (e.start, e.end)}
        group, mask, nxt = self.groups[r.pattern][r.next], r.mask, r.next + 1
        if group:
            mask |= 1 << stage
            nxt = group[-1] + 1 if all(mask >> s & 1 for s in group) else group[0]
        end = nxt >= len(p.stages)
        meta, out = self.metadata[r.pattern], []
        grown = Run(r.pattern, bindings, spans, nxt, r.id, r.created, self.tick, r.reps, mask, "complete" if end else "active")
        if end and p.loop and not born:
            reps = r.reps + (1 if r.reps else 2)
            done = replace(grown, reps=reps, known=None)
            if reps >= p.loop.least and self._relations(p, spans) and self._keep(done, fresh):
                out.append(Event("completed", p.name, done.id, stage, dict(bindings), metadata=meta, spans=dict(spans), reps=reps))
                if p.advance_in_place:
                    used.add(r.id)
            if p.loop.most is None or reps < p.loop.most:
                again = replace(grown, bindings={k: v for k, v in bindings.items() if k not in self.own[r.pattern]}, next=p.loop.first, mask=0, reps=reps, state="active", known=None)
                if self._keep(again, fresh):
                    out.append(Event("advanced", p.name, again.id, stage, metadata=meta, spans=dict(spans), reps=reps))
            return out
        if end and born and self._window_blocked(p, bindings, spans, e):
            return out
        if not self._keep(grown, fresh):
            return out
        if end and not born and not self._relations(p, spans):
            fresh.pop()
            self.keys.discard(grown.key())
            return out
        out.append(Event("completed" if end else "advanced", p.name, grown.id, stage, dict(bindings) if end else {}, metadata=meta, spans=dict(spans)))
        if p.advance_in_place and not born and nxt > r.next:
            used.add(r.id)
        return out

    def _count(self, events: list[Event]) -> None:
        for x in events:
            m = self.named[x.pattern][1][-1]
            if x.kind in ("advanced", "completed"):
                m.last_advanced = self.tick
            setattr(m, x.kind, getattr(m, x.kind, 0) + 1)

    def _exclude(self, fresh: list[Run]) -> None:
        """A completed pattern of an exclusive group ends the other active runs of the group, without an event."""
        for r in fresh:
            p = self.patterns[r.pattern]
            if r.state == "complete" and p.group is not None:
                self._remove(x for x in self.active() if x.id != r.id and self.patterns[x.pattern].group == p.group and not (x.pattern == r.pattern and p.loop))

    # ticks
    def end_tick(self, stale: int = 10) -> tuple[TickDelta, list[Event]]:
        """One tick more: deadlines expire, idle runs go silently, and the tick's names are gathered."""
        self.tick += 1
        expired = []
        for r in self.active():
            p = self.patterns[r.pattern]
            if p.deadline is not None and self.tick - r.created > p.deadline:
                expired.append(Event("expired", p.name, r.id, stage_reached=r.next, ticks_elapsed=self.tick - r.created, metadata=dict(p.metadata), spans=dict(r.spans)))
                self._remove([r])
            elif p.inactivity is not None and self.tick - r.advanced >= p.inactivity:
                self._remove([r])
        expired = [x for x in expired if not self._private(x)]
        names = lambda kind: sorted({x.pattern for x in self.log if x.kind == kind})
        delta = TickDelta(self.tick, names("advanced"), names("completed"), names("negated"), sorted({x.pattern for x in expired}), sorted(self.stale(stale)), len(self.active()))
        self.log = []
        return delta, expired

    def stale(self, threshold: int) -> list[str]:
        return [p.name for i, p in enumerate(self.patterns) if self.enabled[i] and (own := self._active_of(i)) and self.tick - max(r.advanced for r in own) >= threshold]

    # set-ups and pay-offs
    def register_pair(self, name: str, plant: str, payoff: str, shared: str | None = None) -> None:
        self.pairs.append((name, plant, payoff, shared))

    def plant_status(self, stale: int = 10) -> list[dict[str, Any]]:
        at = {p.name: i for i, p in enumerate(self.patterns)}
        out = []
        for name, plant, payoff, _ in self.pairs:
            last = self.metrics[at[plant]].last_advanced if plant in at else None
            since = None if last is None else self.tick - last
            out.append({"name": name, "active_plants": len(self.active(plant)), "payoffs": self.metrics[at[payoff]].completed if payoff in at else 0, "ticks_since_advance": since, "stale": since is not None and since >= stale and bool(self.active(plant))})
        return out
