"""Why a pattern does not match: for each clause of the stages up to the first that fails, whether an edge satisfies it.

Bindings are carried from stage to stage: a stage is tried for the matches of the stages before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import Parts
from ..sources.graph import Source, TemporalGraph
from ..sources.predicates import matches
from .batch import E, Q, T, V, Compiler, Rows
from .pattern import Bind, Clause, Constraint, Pattern, Stage, target_vars

SCHEMA = "stage int, anchor string, clause int, label string, matched boolean, reason string"


def clauses(graph: Source, p: Pattern, at: float | None = None, visibility: str = "now") -> DataFrame:
    """One row a clause: stage, anchor, clause, label, matched, reason. A stage without clauses matches and has no rows."""
    c = Compiler(graph, graph.now if at is None else at, visibility)
    acc: Rows | None = None
    before: list[str] = []
    parts: list[DataFrame] = []
    for i, s in enumerate(p.stages):
        if not s.clauses:
            continue
        tried = _Tried(c, acc, before, s)
        parts.append(tried.first(i))
        for k, clause in enumerate(s.clauses[1:], 1):
            parts.append(tried.later(i, k, clause))
            tried.take(clause)
        acc, before = tried.rows(), [s.anchor]
    if not parts:
        return graph.spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    # what comes behind the first stage that fails is not reported
    bad = F.min(F.when(~F.col("matched"), F.col("stage"))).over(W.partitionBy())
    return out.withColumn("__bad", bad).where("__bad IS NULL OR stage <= __bad").drop("__bad")


MISMATCH = "edges exist but none match target constraint"


def _said(found: DataFrame, stage: int, anchor: str, k: int, label: str, matched: Column, reason: Column) -> DataFrame:
    return found.select(F.lit(stage).alias("stage"), F.lit(anchor).alias("anchor"), F.lit(k).alias("clause"), F.lit(label).alias("label"), matched.alias("matched"), F.when(~matched, reason).alias("reason"))


class _Tried:
    """A stage tried for the matches before it.

    Only whether there is a pair is asked, never how many: the matches before (acc) and the stage's own rows (root: its
    first clause; own: with the later clauses that read the stage alone) stay apart. Each is reduced to what a question
    compares: the first time of acc and the last one of the stage, by the variables that both have. So no pairs are made
    that only their order in time links. A variable of acc that a clause binds again becomes a variable of own, which makes
    it a key of their join."""

    def __init__(self, c: Compiler, acc: Rows | None, before: list[str], s: Stage) -> None:
        self.c, self.acc, self.before, self.stage = c, acc, before, s
        self.root, _, self.tests = c.stage(Stage(s.anchor, s.clauses[:1]), set() if acc is None else acc.vars)
        self.own = self.root
        self.late: list[Clause] = []
        self.late_vars: set[str] = set()

    @property
    def outer(self) -> set[str]:
        return set() if self.acc is None else self.acc.vars

    def take(self, clause: Clause) -> None:
        """Restricts the stage by a clause: alone where it can be, or behind the join."""
        free, own = target_vars(clause.target), self.own.vars
        elsewhere = (self.outer | self.late_vars) - own
        binds = isinstance(clause.target, Bind) and not clause.negated
        here = clause.source in own or (clause.bare and clause.source not in elsewhere)
        if here and binds and free <= self.outer - own:
            from_ = TemporalGraph.value_as_node(self.own.df[V + clause.source]) if clause.source in own else F.lit(clause.source)
            (var,) = free
            e = self.c.label_edges(clause.label, clause.target).select(F.col("source").alias("c__source"), Parts.edge().struct().alias(V + var)).distinct()
            self.own = Rows(self.own.df.join(e, from_ == F.col("c__source")).drop("c__source"), own | free, self.own.anchors)
        elif here and not free & elsewhere:
            self.own = self.c.clause(self.own, clause)
        else:
            self.late.append(clause)
            self.late_vars |= free if binds else set()

    def rows(self) -> Rows:
        """The matches up to this stage."""
        rows = self.own if self.acc is None else self.c.pair(self.acc, self.own, self.before)
        for test in self.tests:
            rows = Rows(rows.df.where(test(rows)), rows.vars, rows.anchors)
        for clause in self.late:
            rows = self.c.clause(rows, clause)
        return Rows(rows.df.drop("root"), rows.vars, rows.anchors)

    def pairs(self, left: DataFrame, own: DataFrame, shared: set[str], *on: Column) -> DataFrame:
        """Both sides' reduced rows (l__ and r__ columns), by the variables that both have and by the first clause's test."""
        how = F.lit(True)
        for name in sorted(shared):
            a = left[f"l__{V}{name}"]
            how = how & (a == own[f"r__{V}{name}"]) & F.coalesce(~F.isnan(a["n"]), F.lit(True))
        if self.tests:
            of = lambda name: own[f"r__{V}{name}"] if name in self.root.vars else left[f"l__{V}{name}"] if name in self.outer else None
            how = how & matches(self.stage.clauses[0].target, Parts.of(own["r__root"]), of)
        for x in on:
            how = how & x
        return left.join(own, how)

    def reduced(self, side: DataFrame, names: set[str], prefix: str, **times: Column) -> DataFrame:
        """The first times (l__) or the last ones (r__) of a side, by variables."""
        end = F.min if prefix == "l__" else F.max
        keys = [F.col(V + n).alias(f"{prefix}{V}{n}") for n in sorted(names)]
        if prefix == "r__" and self.tests:
            keys += [F.col("root").alias("r__root")]
            keys += [F.col(V + n).alias(f"r__{V}{n}") for n in sorted((target_vars(self.stage.clauses[0].target) & self.root.vars) - names)]
        return side.groupBy(*keys).agg(*[end(t).alias(f"{prefix}{k}") for k, t in times.items()])

    def asked(self) -> set[str]:
        """The variables of acc that the first clause compares with."""
        return target_vars(self.stage.clauses[0].target) & self.outer - self.root.vars if self.tests else set()

    def first(self, stage: int) -> DataFrame:
        root = self.root.df
        if self.acc is None:
            there = self.rows().df.limit(1)
        else:
            shared = self.root.vars & self.outer
            left = self.reduced(self.acc.df, shared | self.asked(), "l__", t=F.col(T + self.before[0]))
            own = self.reduced(root, shared, "r__", t=F.col(T + self.stage.anchor))
            there = self.pairs(left, own, shared, left["l__t"] < own["r__t"]).select("l__t").limit(1)
        n = there.agg(F.count(F.lit(1)).alias("n"))
        return _said(n, stage, self.stage.anchor, 0, self.stage.clauses[0].label, F.col("n") > 0, F.lit(MISMATCH))

    def later(self, stage: int, k: int, clause: Clause) -> DataFrame:
        asks = {clause.source} | target_vars(clause.target)
        bound = (self.own.vars | self.late_vars) - self.root.vars - self.outer
        side = self.own if asks & bound else self.root
        acc = self.acc
        if acc is None or asks & bound and self.late:
            side, acc = (self.rows() if asks & bound else Rows(_tested(self.root, self.tests).df.drop("root"), self.root.vars, self.root.anchors)), None
        left = set() if acc is None else acc.vars
        if clause.source not in side.vars | left and not clause.bare:
            none = self.c.graph.spark.range(1).select(F.lit(0).alias("n"))
            return _said(none, stage, self.stage.anchor, k, clause.label, F.col("n") > 0, F.lit(f"?{clause.source} is not bound"))
        found = self.alone(side, clause) if acc is None else self.apart(acc, side, clause)
        matched = ~F.col("hits") if clause.negated else F.col("hits")
        reason = F.when(F.lit(clause.negated), f"edge {clause.label} exists but should not").when(~F.col("nodes"), f"?{clause.source} is bound to a value, not a node")
        reason = reason.when(~F.col("there"), f"no edges with label {clause.label} from ?{clause.source}").otherwise(MISMATCH)
        return _said(found, stage, self.stage.anchor, k, clause.label, matched, reason)

    def edged(self, side: Rows, clause: Clause) -> tuple[DataFrame, Column, Column]:
        """A side with the edges of a clause's label from its source; that node; whether there is an edge."""
        e = self.c.label_edges(clause.label, Constraint("any")).select(F.col("source").alias("c__source"), *[F.col(x).alias(f"c__{x}") for x in ("rank", "s", "n", "b")])
        from_ = TemporalGraph.value_as_node(side.df[V + clause.source]) if clause.source in side.vars else F.lit(clause.source)
        return side.df.withColumn("c__from", from_).join(e, F.col("c__from") == F.col("c__source"), "left"), F.col("c__from"), F.col("c__source").isNotNull()

    def alone(self, side: Rows, clause: Clause) -> DataFrame:
        df, from_, there = self.edged(side, clause)
        fits = there & F.coalesce(_fit(clause, lambda name: df[V + name] if name in side.vars else None), F.lit(False))
        any_ = lambda x: F.coalesce(F.max(x), F.lit(False))
        return df.agg(any_(fits).alias("hits"), any_(there).alias("there"), any_(from_.isNotNull()).alias("nodes"))

    def apart(self, acc: Rows, side: Rows, clause: Clause) -> DataFrame:
        shared = side.vars & acc.vars
        mine = clause.source in side.vars or clause.source not in acc.vars
        holder, other = (side, acc) if mine else (acc, side)
        a, b, time = ("r__", "l__", T + self.stage.anchor) if mine else ("l__", "r__", T + self.before[0])
        free = target_vars(clause.target)
        across = free & other.vars - holder.vars
        df, from_, there = self.edged(holder, clause)
        t = F.col(time)
        asked = self.asked()
        keys = {"l__": shared | asked, "r__": shared}
        times = {"nodes": F.when(from_.isNotNull(), t), "there": F.when(there, t)}
        if not across:
            fits = there & F.coalesce(_fit(clause, lambda name: df[V + name] if name in holder.vars else None), F.lit(False))
            times["hits"] = F.when(fits, t)
        held = self.reduced(df, keys[a], a, **times)
        rest = self.reduced(other.df, keys[b], b, t=F.col(T + (self.before[0] if mine else self.stage.anchor)))
        left, own = (rest, held) if mine else (held, rest)
        both = self.pairs(left, own, shared)
        before = (lambda x: F.col("l__t") < F.col(f"r__{x}")) if mine else (lambda x: F.col(f"l__{x}") < F.col("r__t"))
        any_ = lambda x: F.coalesce(F.max(before(x)), F.lit(False)).alias(x)
        found = both.agg(*[any_(x) for x in times])
        if not across:
            return found
        # the target is compared with the other side's variable: both are kept by value
        (var,) = across
        value = F.struct(*[F.col(f"c__{x}").alias(x) for x in ("rank", "s", "n", "b")])
        held = self.reduced(df.where(there).withColumn(f"{V}c__value", value), keys[a] | {"c__value"}, a, t=t)
        rest = self.reduced(other.df, keys[b] | {var}, b, t=F.col(T + (self.before[0] if mine else self.stage.anchor)))
        left, own = (rest, held) if mine else (held, rest)
        v, w = held[f"{a}{V}c__value"], rest[f"{b}{V}{var}"]
        fits = (v == w) & F.coalesce(~F.isnan(v["n"]), F.lit(True)) if isinstance(clause.target, Bind) else F.coalesce(matches(clause.target, Parts.of(v), lambda _: w), F.lit(False))
        hits = self.pairs(left, own, shared, fits, left["l__t"] < own["r__t"]).select("l__t").limit(1)
        return found.crossJoin(hits.agg((F.count(F.lit(1)) > 0).alias("hits")))


def _tested(rows: Rows, tests: list) -> Rows:
    for test in tests:
        rows = Rows(rows.df.where(test(rows)), rows.vars, rows.anchors)
    return rows


def _fit(clause: Clause, of_var) -> Column:
    return matches(clause.target, Parts(*[F.col(f"c__{x}") for x in ("rank", "s", "n", "b")]), of_var)


def stages(rows: DataFrame) -> DataFrame:
    """One row a reported stage: matched, partially_matched or unmatched."""
    out = rows.groupBy("stage", "anchor").agg(F.sum(F.col("matched").cast("int")).cast("int").alias("n_matched"), F.count(F.lit(1)).cast("int").alias("n_clauses"))
    return out.withColumn("status", F.when(F.col("n_matched") == F.col("n_clauses"), "matched").when(F.col("n_matched") > 0, "partially_matched").otherwise("unmatched"))


def closeness(rows: DataFrame) -> DataFrame:
    """The share of reported clauses that matched."""
    return rows.agg(F.avg(F.col("matched").cast("double")).alias("closeness"))


__all__ = ["E", "Q", "T", "clauses", "closeness", "stages"]
