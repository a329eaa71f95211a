"""Batch evaluation: a pattern becomes joins, semi-joins and anti-joins over a graph's edges, and Catalyst plans them.

A stage is a relation of its variables (structs of rank and payload), its anchor's time and its order. Stages are joined on
the variables they share, with the order of their starts as a residual; constraints, computed bindings and negation windows
apply as soon as what they name is there. Where one wide table has all labels of a stage, the stage is a projection of it.

Settled cases: a clause that binds a variable which is bound already joins on it, wherever that is; a later clause that
binds a new variable takes the first edge; edges are seen at the clock (visibility="now"), or at any time; a pattern without
stages, or with an empty stage, matches nothing; duplicate edges give duplicate matches; repetition counts, deadlines and
groups belong to incremental evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.values import NODE, NUM, STRUCT, Parts, compare, node, number
from ..sources.graph import Relation, Source, TemporalGraph
from ..sources.predicates import matches
from .pattern import Bind, Clause, Constraint, Expr, Is, Lit, Negation, Pattern, PatternError, Ref, Stage, target_vars

V, T, E, Q = "v__", "t__", "e__", "q__"
LetEvaluator = Callable[[Expr, Callable[[str], Column | None]], Column]


def default_let(e: Expr, of_var: Callable[[str], Column | None]) -> Column:
    """The value struct of an expression; null where it has no value: numbers only, no division by zero, no nodes."""

    def number_of(x: Expr) -> Column:
        if isinstance(x, Lit):
            return F.lit(float(x.value)) if isinstance(x.value, (int, float)) and not isinstance(x.value, bool) else F.lit(None).cast("double")
        if isinstance(x, Ref):
            bound = of_var(x.var)
            return F.lit(None).cast("double") if bound is None else F.when(bound["rank"] == NUM, bound["n"])
        a, b = number_of(x.left), number_of(x.right)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[x.op]()

    if isinstance(e, Lit):
        return Parts.literal(e.value).struct()
    if isinstance(e, Ref):
        bound = of_var(e.var)
        return F.lit(None).cast(STRUCT) if bound is None else F.when(bound["rank"] != NODE, bound)
    n = number_of(e)
    return F.when(n.isNotNull(), number(n))


def no_let(e: Expr, of_var: Callable[[str], Column | None]) -> Column:
    return F.lit(None).cast(STRUCT)


@dataclass
class Rows:
    """A DataFrame of v__ variables and t__, e__, q__ anchors, and which there are."""

    df: DataFrame
    vars: set[str] = field(default_factory=set)
    anchors: list[str] = field(default_factory=list)

    def of_var(self, name: str) -> Column | None:
        return self.df[V + name] if name in self.vars else None


@dataclass
class Compiler:
    graph: Source
    at: float | None
    visibility: str = "now"
    let: LetEvaluator = default_let

    def seen(self, start: Column, end: Column, always: bool = False) -> Column:
        if always or self.visibility == "any_time" or self.at is None:
            return F.lit(True)
        return intervals.covers(start, end, self.at)

    def label_edges(self, label: str, target, always: bool = False) -> DataFrame:
        """Edges of a label that satisfy what of the target needs no variable."""
        e = self.graph.edges(label).where(self.seen(F.col("start_t"), F.col("end_t"), always))
        return e if target_vars(target) else e.where(matches(target, Parts.edge()))

    # stages
    def wide(self, stage: Stage, clauses: list[Clause], r: Relation, always: bool = False) -> Rows:
        """A stage whose clauses all read one wide table."""
        df = r.df.where(self.seen(r.starts(), r.ends(), always))
        values: dict[str, Column] = {}
        tests: list[Column] = []
        for c in clauses:
            v, raw = r.value(c.label), r.labels[c.label][1]
            if isinstance(c.target, Bind):
                tests.append(raw.isNotNull())
                if c.target.var in values:
                    tests.append(compare("=", v, Parts.of(values[c.target.var])))
                else:
                    values[c.target.var] = v.struct()
            elif c.negated:
                tests.append(raw.isNull() | ~F.coalesce(matches(c.target, v), F.lit(False)))
            else:
                tests += [raw.isNotNull(), matches(c.target, v)]
        for t in tests:
            df = df.where(t)
        values[clauses[0].source] = node(r.source.cast("string"))
        cols = [c.alias(V + n) for n, c in values.items()]
        df = df.select(*cols, r.starts().alias(T + stage.anchor), r.ends().alias(E + stage.anchor), r.order().alias(Q + stage.anchor))
        return Rows(df, set(values), [stage.anchor])

    def stage(self, stage: Stage, outer: set[str], always: bool = False) -> tuple[Rows, list[Clause], list[Callable[[Rows], Column]]]:
        """The stage's own relation; the clauses and tests that wait for variables of earlier stages."""
        first, rest = stage.clauses[0], list(stage.clauses[1:])
        local = [c for c in rest if c.source == first.source and not (isinstance(c.target, Constraint) and c.target.var)]
        own = {first.source}
        if not (isinstance(first.target, Constraint) and first.target.var) and first.source not in outer:
            r = self.graph.relation_for({c.label for c in [first, *local]})
            if r is not None:
                twice = isinstance(first.target, Bind) and first.target.var == first.source
                if not twice and not any(isinstance(c.target, Bind) and c.target.var == first.source for c in local):
                    rows = self.wide(stage, [first, *local], r, always)
                    return rows, [c for c in rest if c not in local], []
        tests: list[Callable[[Rows], Column]] = []
        df = self.label_edges(first.label, first.target, always)
        cols = {V + first.source: node(F.col("source")), T + stage.anchor: F.col("start_t"), E + stage.anchor: F.col("end_t"), Q + stage.anchor: F.col("edge_seq")}
        if isinstance(first.target, Bind):
            if first.target.var == first.source:
                df = df.where((F.col("rank") == NODE) & (F.col("s") == F.col("source")))
            else:
                cols[V + first.target.var] = Parts.edge().struct()
                own.add(first.target.var)
        elif target_vars(first.target):
            cols["root"] = Parts.edge().struct()
            tests.append(lambda rows: matches(first.target, Parts.of(rows.df["root"]), rows.of_var))
        rows = Rows(df.select(*[c.alias(n) for n, c in cols.items()]), own, [stage.anchor])
        waiting: list[Clause] = []
        for c in rest:
            free = target_vars(c.target) if isinstance(c.target, Constraint) else set()
            # a variable of an earlier stage is met after the join, in the clauses' order
            if waiting or c.source not in rows.vars or not free <= rows.vars or (isinstance(c.target, Bind) and c.target.var in outer and c.target.var not in rows.vars and c.negated):
                waiting.append(c)
            else:
                rows = self.clause(rows, c, always)
        return rows, waiting, tests

    def clause(self, rows: Rows, c: Clause, always: bool = False) -> Rows:
        """A later clause: existence, absence, or the first edge's value."""
        if c.source not in rows.vars and not c.bare:
            return Rows(rows.df.where(F.lit(False)), rows.vars | (target_vars(c.target) if isinstance(c.target, Bind) else set()), rows.anchors) if not c.negated else rows
        from_ = F.lit(c.source) if c.source not in rows.vars else TemporalGraph.value_as_node(rows.df[V + c.source])
        if isinstance(c.target, Bind) and c.target.var not in rows.vars and not c.negated:
            e = self.label_edges(c.label, c.target, always)
            if self.graph.is_single(c.label):
                first = e.select(F.col("source").alias("c__source"), Parts.edge().struct().alias(V + c.target.var))
            else:
                first = e.groupBy(F.col("source").alias("c__source")).agg(F.min_by(Parts.edge().struct(), "edge_seq").alias(V + c.target.var))
            return Rows(rows.df.join(first, from_ == F.col("c__source")).drop("c__source"), rows.vars | {c.target.var}, rows.anchors)
        e = self.label_edges(c.label, c.target, always)
        e = e.select(F.col("source").alias("c__source"), *[F.col(x).alias(f"c__{x}") for x in ("rank", "s", "n", "b")])
        on = from_ == F.col("c__source")
        if target_vars(c.target):
            on = on & matches(c.target, Parts(*[F.col(f"c__{x}") for x in ("rank", "s", "n", "b")]), rows.of_var)
        return Rows(rows.df.join(e, on, "left_anti" if c.negated else "left_semi"), rows.vars, rows.anchors)

    # patterns
    def matches(self, p: Pattern, strict: bool = False) -> Rows | None:
        """All matches, flat; None for a pattern that can't match."""
        if not p.stages or any(not s.clauses for s in p.stages):
            return None
        acc: Rows | None = None
        before: tuple[int, ...] = ()
        pending_t, pending_n = list(p.temporal), [n for n in p.negations if n.clauses]
        for step in p.steps():
            for i in step:
                s = p.stages[i]
                earlier = [p.stages[j].anchor for j in before]
                acc = self.join(acc, s, earlier)
                for name, e in s.lets:
                    if name in acc.vars:
                        acc = Rows(acc.df.where(F.lit(False)), acc.vars, acc.anchors)
                    else:
                        df = acc.df.withColumn(V + name, self.let(e, acc.of_var))
                        acc = Rows(df.where(F.col(V + name).isNotNull()), acc.vars | {name}, acc.anchors)
                acc, pending_t = self.temporal(acc, pending_t)
            before = step
            acc, pending_n = self.negations(acc, pending_n)
        return acc

    def join(self, acc: Rows | None, s: Stage, earlier: list[str]) -> Rows:
        outer = set() if acc is None else acc.vars
        rows, waiting, tests = self.stage(s, outer)
        if acc is not None:
            rows = self.pair(acc, rows, earlier)
        for t in tests:
            rows = Rows(rows.df.where(t(rows)), rows.vars, rows.anchors)
        if "root" in rows.df.columns:
            rows = Rows(rows.df.drop("root"), rows.vars, rows.anchors)
        for c in waiting:
            rows = self.clause(rows, c)
        return rows

    @staticmethod
    def pair(acc: Rows, rows: Rows, earlier: list[str]) -> Rows:
        """Two relations, joined on the variables that both have, the second after some anchors of the first."""
        shared = rows.vars & acc.vars
        right = rows.df.select(*[F.col(c).alias(f"r__{c}") if c[len(V) :] in shared and c.startswith(V) else F.col(c) for c in rows.df.columns])
        on = F.lit(True)
        for name in sorted(shared):
            a, b = acc.df[V + name], right[f"r__{V}{name}"]
            # equal structs give the join its keys; the guard is for NaN
            on = on & (a == b) & F.coalesce(~F.isnan(a["n"]), F.lit(True))
        for x in earlier:
            on = on & (acc.df[T + x] < right[T + rows.anchors[0]])
        df = acc.df.join(right, on).drop(*[f"r__{V}{n}" for n in shared])
        return Rows(df, acc.vars | rows.vars, [*acc.anchors, *rows.anchors])

    def temporal(self, acc: Rows, pending: list) -> tuple[Rows, list]:
        left = []
        for t in pending:
            if {t.left, t.right} <= set(acc.anchors):
                d = acc.df
                acc = Rows(d.where(intervals.constraint(t.relation, d[T + t.left], d[E + t.left], d[T + t.right], d[E + t.right], t.least, t.most)), acc.vars, acc.anchors)
            else:
                left.append(t)
        return acc, left

    def negations(self, acc: Rows, pending: list[Negation]) -> tuple[Rows, list[Negation]]:
        left = []
        for n in pending:
            if n.start in acc.anchors and (n.end is None or n.end in acc.anchors):
                acc = self.negate(acc, n)
            else:
                left.append(n)
        return acc, left

    def body(self, n: Negation, outer: set[str]) -> tuple[Rows, list[Clause], list]:
        """A negation's body as a stage whose first clause is seen at any time."""
        first, rest = n.clauses[0], list(n.clauses[1:])
        if rest and self.visibility == "now" and self.graph.relation_for({c.label for c in n.clauses}) is None:
            rows, waiting, tests = self.stage(Stage("n", (first,)), set(), always=True)
            for c in rest:
                free = target_vars(c.target) if isinstance(c.target, Constraint) else set()
                if waiting or c.source not in rows.vars or not free <= rows.vars:
                    waiting.append(c)
                else:
                    rows = self.clause(rows, c)
            return rows, waiting, tests
        return self.stage(Stage("n", n.clauses), set(), always=True)

    def compared(self, n: Negation, body: Rows, waiting: list[Clause]) -> tuple[Rows, list[tuple[str, Constraint]]]:
        """A negation's body with the values that clauses compare with the match's variables: columns by name, and how."""
        names = [f"c{i}" for i in range(len(waiting))]
        own = [c for c in n.clauses if c not in waiting]
        r = self.graph.relation_for({c.label for c in n.clauses})
        if r is not None and all(c.source == own[0].source for c in n.clauses):
            rows, left, tests = self.stage(Stage("n", (*own, *[Clause(c.source, c.label, Bind(f"?{x}")) for c, x in zip(waiting, names, strict=True)])), set(), always=True)
            if not left and not tests:
                df = rows.df.where(self.seen(F.col(T + "n"), F.col(E + "n")))
                return Rows(df.withColumnsRenamed({f"{V}?{x}": x for x in names}), body.vars, rows.anchors), [(x, c.target) for c, x in zip(waiting, names, strict=True)]
        df = body.df
        for c, x in zip(waiting, names, strict=True):
            e = self.label_edges(c.label, c.target).select(F.col("source").alias("c__source"), Parts.edge().struct().alias(x))
            df = df.join(e, TemporalGraph.value_as_node(df[V + c.source]) == F.col("c__source")).drop("c__source")
        return Rows(df, body.vars, body.anchors), [(x, c.target) for c, x in zip(waiting, names, strict=True)]

    def negate(self, acc: Rows, n: Negation) -> Rows:
        """Without the rows in whose window the body occurs. Variables that both have are the anti-join's keys."""
        body, waiting, tests = self.body(n, acc.vars)
        against: list[tuple[str, Constraint]] = []
        if waiting and all(isinstance(c.target, Constraint) and c.target.var in acc.vars and c.target.var not in body.vars and c.source in body.vars for c in waiting):
            # what the match's variables are compared with is a column of the body, and the comparison a residual of the anti-join
            body, against = self.compared(n, body, waiting)
            waiting = []
        shared = body.vars & acc.vars
        right = body.df.select(*[F.col(c).alias(f"n__{c}") for c in body.df.columns])
        if n.end is None and not waiting and not tests and not against:
            # a window without an end: the latest occurrence of a key decides, and it is found before the shuffle
            right = right.groupBy(*[f"n__{V}{name}" for name in sorted(shared)]).agg(F.max(f"n__{T}n").alias(f"n__{T}n"))

        def condition(left: DataFrame) -> Column:
            on = F.lit(True)
            for name in sorted(shared):
                a = left[V + name]
                on = on & (a == right[f"n__{V}{name}"]) & F.coalesce(~F.isnan(a["n"]), F.lit(True))
            on = on & (left[T + n.start] < right[f"n__{T}n"])
            if n.end is not None:
                on = on & (right[f"n__{T}n"] < left[T + n.end])
            if tests:
                of = lambda name: left[V + name] if name in acc.vars else right[f"n__{V}{name}"] if name in body.vars else None
                on = on & matches(n.clauses[0].target, Parts.of(right["n__root"]), of)
            for name, target in against:
                on = on & matches(target, Parts.of(right[f"n__{name}"]), lambda x: left[V + x])
            return on

        if not waiting:
            return Rows(acc.df.join(right, condition(acc.df), "left_anti"), acc.vars, acc.anchors)
        # a clause that needs the match's own variables: the rows it blocks are found, and taken away
        blocked = acc.df.join(right, condition(acc.df)).select(*acc.df.columns, *[F.col(f"n__{V}{x}").alias(V + x) for x in body.vars - acc.vars])
        rows = Rows(blocked, acc.vars | body.vars, acc.anchors)
        for c in waiting:
            if target_vars(c.target) - rows.vars and isinstance(c.target, Constraint):
                return acc
            rows = self.clause(rows, c)
        gone = rows.df.select(*[F.col(c).alias(f"g__{c}") for c in acc.df.columns]).distinct()
        on = F.lit(True)
        for c in acc.df.columns:
            on = on & acc.df[c].eqNullSafe(gone[f"g__{c}"])
        return Rows(acc.df.join(gone, on, "left_anti"), acc.vars, acc.anchors)


def find(graph: Source, p: Pattern, at: float | None = None, visibility: str = "now", let: LetEvaluator = default_let) -> DataFrame:
    """All matches, one column a variable (its value struct) and <anchor>__start, <anchor>__end, <anchor>__seq."""
    c = Compiler(graph, graph.now if at is None else at, visibility, let)
    rows = c.matches(p)
    names = sorted(p.all_vars() - {n.source for n in ()})
    if rows is None:
        cols = [f"{v} {STRUCT}" for v in names] + [f"{s.anchor}__{x} {t}" for s in p.stages for x, t in (("start", graph.time), ("end", graph.time), ("seq", "bigint"))]
        return graph.spark.createDataFrame([], ", ".join(cols))
    out = [F.col(V + v).alias(v) for v in sorted(rows.vars)]
    for a in rows.anchors:
        out += [F.col(T + a).alias(f"{a}__start"), F.col(E + a).alias(f"{a}__end"), F.col(Q + a).alias(f"{a}__seq")]
    return rows.df.select(*out)


def first(graph: Source, p: Pattern, n: int = 1, **how) -> DataFrame:
    """The first n matches in the order of their edges."""
    df = find(graph, p, **how)
    if n <= 0 or not p.stages:
        return df.limit(0)
    return df.orderBy(*[f"{s.anchor}__seq" for s in p.stages]).limit(n)


def packed(graph: Source, p: Pattern, index: int | None = None, **how) -> DataFrame:
    """Matches as pattern, pattern_idx, bindings, intervals, metadata: one schema for every pattern."""
    df = find(graph, p, **how)
    names = [c for c in df.columns if not c.endswith(("__start", "__end", "__seq"))]
    anchors = [c[: -len("__start")] for c in df.columns if c.endswith("__start")]
    entry = lambda pairs: F.map_from_arrays(F.array(*[F.lit(a) for a, _ in pairs]), F.array(*[b for _, b in pairs])) if pairs else F.create_map()
    meta = entry([(k, F.lit(v)) for k, v in p.metadata]).cast("map<string,string>")
    bindings = entry([(n, F.col(n)) for n in names]).cast(f"map<string,{STRUCT}>")
    spans = entry([(a, F.struct(F.col(f"{a}__start").alias("start"), F.col(f"{a}__end").alias("end"))) for a in anchors]).cast(f"map<string,struct<start:{graph.time},end:{graph.time}>>")
    return df.select(F.lit(p.name).alias("pattern"), F.lit(index).cast("int").alias("pattern_idx"), bindings.alias("bindings"), spans.alias("intervals"), meta.alias("metadata"))


def evaluate(graph: Source, patterns: list[Pattern], **how) -> DataFrame:
    """The matches of all patterns but the private ones."""
    out = None
    for i, p in enumerate(patterns):
        if not p.private:
            part = packed(graph, p, i, **how)
            out = part if out is None else out.unionByName(part)
    return packed(graph, Pattern("none")) if out is None else out


def distinct_matches(df: DataFrame) -> DataFrame:
    """Packed matches without repetition; maps are compared as sorted entries."""
    keys = {f"__{c}": F.array_sort(F.map_entries(c)) for c in ("bindings", "intervals", "metadata")}
    return df.withColumns(keys).dropDuplicates(["pattern", *keys]).drop(*keys)


__all__ = ["Compiler", "Is", "default_let", "distinct_matches", "evaluate", "find", "first", "no_let", "packed", "PatternError"]
