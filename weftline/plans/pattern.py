"""Patterns: what a query asks for, as frozen data. Everything here runs on the driver only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..functions.values import Literal


class PatternError(ValueError):
    """A pattern that can't mean anything."""


@dataclass(frozen=True)
class Lit:
    value: Literal


@dataclass(frozen=True)
class Ref:
    var: str


@dataclass(frozen=True)
class Op:
    op: str  # + - * /
    left: Expr
    right: Expr


Expr = Lit | Ref | Op


def expr_vars(e: Expr) -> set[str]:
    return set() if isinstance(e, Lit) else {e.var} if isinstance(e, Ref) else expr_vars(e.left) | expr_vars(e.right)


def expr_map(e: Expr, var: Callable[[str], str] = lambda v: v, value: Callable[[Literal], Literal] = lambda v: v) -> Expr:
    if isinstance(e, Lit):
        return Lit(value(e.value))
    return Ref(var(e.var)) if isinstance(e, Ref) else Op(e.op, expr_map(e.left, var, value), expr_map(e.right, var, value))


@dataclass(frozen=True)
class Constraint:
    """op: = < > <= >= between any in; or =? <? >? <=? >=? against a variable."""

    op: str
    values: tuple[Literal, ...] = ()
    var: str | None = None


@dataclass(frozen=True)
class Bind:
    var: str


@dataclass(frozen=True)
class Is:
    value: Literal


Target = Bind | Is | Constraint


@dataclass(frozen=True)
class Clause:
    source: str
    label: str
    target: Target
    negated: bool = False
    #: The source is a node's name rather than a variable where nothing binds it.
    bare: bool = False


@dataclass(frozen=True)
class Stage:
    anchor: str
    clauses: tuple[Clause, ...] = ()
    lets: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Temporal:
    left: str
    relation: str
    right: str
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Negation:
    start: str | None
    end: str | None
    clauses: tuple[Clause, ...] = ()
    everywhere: bool = False


@dataclass(frozen=True)
class Loop:
    first: int
    last: int
    least: int
    most: int | None
    shared: tuple[str, ...]


@dataclass(frozen=True)
class Pattern:
    name: str
    stages: tuple[Stage, ...] = ()
    temporal: tuple[Temporal, ...] = ()
    negations: tuple[Negation, ...] = ()
    group: str | None = None
    metadata: tuple[tuple[str, str], ...] = ()
    deadline: int | None = None
    inactivity: int | None = None
    loop: Loop | None = None
    unordered: tuple[tuple[int, ...], ...] = ()
    private: bool = False
    importance: float = 1.0
    advance_in_place: bool = False

    def steps(self) -> list[tuple[int, ...]]:
        """The stages by step: a group without order is one step."""
        out, i = [], 0
        while i < len(self.stages):
            g = self.group_of(i)
            out.append(g or (i,))
            i += len(out[-1])
        return out

    def group_of(self, stage: int) -> tuple[int, ...] | None:
        return next((g for g in self.unordered if stage in g), None)

    def same_group(self, a: int, b: int) -> bool:
        g = self.group_of(a)
        return g is not None and b in g

    def condition_count(self) -> int:
        return sum(len(s.clauses) for s in self.stages) + sum(len(n.clauses) for n in self.negations) + len(self.temporal)

    def all_vars(self) -> set[str]:
        out: set[str] = set()
        for s in self.stages:
            out |= {s.anchor} | {n for n, _ in s.lets} | set().union(*(expr_vars(e) for _, e in s.lets))
        for c in [c for s in self.stages for c in s.clauses] + [c for n in self.negations for c in n.clauses]:
            out |= {c.source} | target_vars(c.target)
        return out

    def map_types(self, label: Callable[[str], str] = lambda x: x, value: Callable[[Literal], Literal] = lambda v: v) -> Pattern:
        """The pattern with every label and every literal converted."""

        def clause(c: Clause) -> Clause:
            t = c.target
            t = Is(value(t.value)) if isinstance(t, Is) else replace(t, values=tuple(map(value, t.values))) if isinstance(t, Constraint) else t
            return replace(c, label=label(c.label), target=t)

        stages = tuple(replace(s, clauses=tuple(map(clause, s.clauses)), lets=tuple((n, expr_map(e, value=value)) for n, e in s.lets)) for s in self.stages)
        return replace(self, stages=stages, negations=tuple(replace(n, clauses=tuple(map(clause, n.clauses))) for n in self.negations))


def target_vars(t: Target) -> set[str]:
    return {t.var} if isinstance(t, Bind) or (isinstance(t, Constraint) and t.var) else set()


@dataclass
class PatternBuilder:
    """PatternBuilder("p").stage("e1").edge("e1", "type", "x").bind("e1", "actor", "who").done().build(); each method returns the builder."""

    name: str
    _stages: list[Stage] = field(default_factory=list)
    _parts: dict = field(default_factory=lambda: {"temporal": [], "negations": [], "metadata": {}, "unordered": []})
    _flags: dict = field(default_factory=dict)

    def stage(self, anchor: str) -> StageBuilder:
        return StageBuilder(self, anchor)

    def unordered_group(self, *stages: StageBuilder | Callable[[PatternBuilder], object]) -> PatternBuilder:
        """Each argument adds one stage to this builder."""
        first = len(self._stages)
        for add in stages:
            add(self)
        return self.mark_unordered(range(first, len(self._stages)))

    def mark_unordered(self, stages) -> PatternBuilder:
        g = tuple(stages)
        if len(g) < 2:
            raise PatternError("a group without order needs two stages")
        if g != tuple(range(g[0], g[0] + len(g))) or g[-1] >= 64:
            raise PatternError("the stages of a group without order are consecutive, and below 64")
        self._parts["unordered"].append(g)
        return self

    def temporal(self, left: str, relation: str, right: str, least: float | None = None, most: float | None = None) -> PatternBuilder:
        self._parts["temporal"].append(Temporal(left, relation, right, least, most))
        return self

    def unless_between(self, start: str, end: str) -> NegationBuilder:
        return NegationBuilder(self, start, end)

    def unless_after(self, start: str) -> NegationBuilder:
        return NegationBuilder(self, start, None)

    def unless_global(self) -> NegationBuilder:
        return NegationBuilder(self, None, None, True)

    def metadata(self, key: str, value: str) -> PatternBuilder:
        self._parts["metadata"][key] = value
        return self

    def flag(self, **flags) -> PatternBuilder:
        """group, deadline, inactivity, private, importance, advance_in_place, loop."""
        self._flags |= flags
        return self

    def deadline(self, ticks: int) -> PatternBuilder:
        return self.flag(deadline=ticks)

    def inactivity_threshold(self, ticks: int) -> PatternBuilder:
        return self.flag(inactivity=ticks)

    def private(self) -> PatternBuilder:
        return self.flag(private=True)

    def importance(self, x: float) -> PatternBuilder:
        return self.flag(importance=x)

    def advance_in_place(self) -> PatternBuilder:
        return self.flag(advance_in_place=True)

    def build(self) -> Pattern:
        anchors = [s.anchor for s in self._stages]

        def window(n: Negation) -> Negation:
            if not n.everywhere:
                return n
            if not anchors:
                raise PatternError("a global negation needs a stage")
            return Negation(anchors[0], anchors[-1] if len(anchors) > 1 else None, n.clauses)

        for s in self._stages:
            if s.clauses and s.clauses[0].negated:
                raise PatternError(f"stage {s.anchor} begins with a negated clause")
        negations = tuple(map(window, self._parts["negations"]))
        if any(c.negated for n in negations for c in n.clauses):
            raise PatternError("a negation's clauses can't be negated")
        return Pattern(self.name, tuple(self._stages), tuple(self._parts["temporal"]), negations, metadata=tuple(self._parts["metadata"].items()), unordered=tuple(self._parts["unordered"]), **self._flags)


class _Clauses:
    def __init__(self) -> None:
        self.clauses: list[Clause] = []

    def edge(self, source: str, label: str, value: Literal):
        return self._add(source, label, Is(value))

    def bind(self, source: str, label: str, var: str):
        return self._add(source, label, Bind(var))

    edge_bind = bind

    def where(self, source: str, label: str, op: str, *values: Literal):
        return self._add(source, label, Constraint(op, values))

    edge_constrained = where

    def _add(self, source: str, label: str, target: Target, negated: bool = False):
        self.clauses.append(Clause(source, label, target, negated))
        return self


class StageBuilder(_Clauses):
    def __init__(self, owner: PatternBuilder, anchor: str) -> None:
        super().__init__()
        self.owner, self.anchor, self.lets = owner, anchor, []

    def where_var(self, source: str, label: str, op: str, var: str):
        return self._add(source, label, Constraint(op + "?", var=var))

    def edge_eq_var(self, source: str, label: str, var: str):
        return self.where_var(source, label, "=", var)

    def edge_lt_var(self, source: str, label: str, var: str):
        return self.where_var(source, label, "<", var)

    def edge_gt_var(self, source: str, label: str, var: str):
        return self.where_var(source, label, ">", var)

    def edge_lte_var(self, source: str, label: str, var: str):
        return self.where_var(source, label, "<=", var)

    def edge_gte_var(self, source: str, label: str, var: str):
        return self.where_var(source, label, ">=", var)

    def edge_one_of(self, source: str, label: str, *values: Literal):
        return self._add(source, label, Constraint("in", values))

    def not_edge(self, source: str, label: str, value: Literal):
        return self._add(source, label, Is(value), True)

    def not_edge_one_of(self, source: str, label: str, *values: Literal):
        return self._add(source, label, Constraint("in", values), True)

    def let(self, name: str, e: Expr):
        self.lets.append((name, e))
        return self

    let_binding = let

    def done(self) -> PatternBuilder:
        self.owner._stages.append(Stage(self.anchor, tuple(self.clauses), tuple(self.lets)))
        return self.owner


class NegationBuilder(_Clauses):
    def __init__(self, owner: PatternBuilder, start: str | None, end: str | None, everywhere: bool = False) -> None:
        super().__init__()
        self.owner, self.start, self.end, self.everywhere = owner, start, end, everywhere

    def done(self) -> PatternBuilder:
        self.owner._parts["negations"].append(Negation(self.start, self.end, tuple(self.clauses), self.everywhere))
        return self.owner
