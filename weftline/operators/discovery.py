"""Mining patterns from a trace: pairs of labels whose edges share a node and stand in one relation often."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.values import NODE, Node
from ..plans.batch import find
from ..plans.pattern import Bind, Clause, Pattern, Stage, Temporal
from ..sources.graph import TemporalGraph

TRACE = "source string, label string, target string, start_t bigint, end_t bigint"
#: The ways in which edges a and b share a node, first one counts: (column of a, column of b).
SHARED = (("source", "source"), ("source", "target"), ("target", "source"), ("target", "target"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.1, 0.5


@dataclass
class Trace:
    """A trace: a DataFrame of source, label, target, start_t, end_t."""

    df: DataFrame

    @staticmethod
    def of(spark: SparkSession, rows: Iterable[tuple]) -> Trace:
        return Trace(spark.createDataFrame([(*r, None)[:5] for r in rows], TRACE))

    def size(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def labels(self) -> DataFrame:
        return self.df.select("label").distinct()

    def nodes(self) -> DataFrame:
        return self.df.select(F.col("source").alias("node")).union(self.df.select("target")).distinct()

    def with_label(self, label: str) -> DataFrame:
        return self.df.where(F.col("label") == label)

    def from_node(self, node: str) -> DataFrame:
        return self.df.where(F.col("source") == node)

    def to_node(self, node: str) -> DataFrame:
        return self.df.where(F.col("target") == node)

    def time_range(self) -> DataFrame:
        """lo, hi; 0 and 0 for an empty trace."""
        return self.df.agg(F.coalesce(F.min("start_t"), F.lit(0)).alias("lo"), F.coalesce(F.max(F.coalesce("end_t", "start_t")), F.lit(0)).alias("hi"))

    def split_at(self, t: int) -> tuple[Trace, Trace]:
        return Trace(self.df.where(F.col("start_t") < t)), Trace(self.df.where(F.col("start_t") >= t))

    def label_pairs(self) -> DataFrame:
        """All ordered pairs of different labels; a label list is short."""
        ls = self.labels()
        return ls.select(F.col("label").alias("label_a")).join(ls.select(F.col("label").alias("label_b")), F.col("label_a") != F.col("label_b"))

    def graph(self) -> TemporalGraph:
        """Open edges with node values, and a clock after all of them."""
        hi = self.time_range().first()["hi"]
        edges = self.df.select(
            F.monotonically_increasing_id().alias("edge_seq"), "source", "label", F.lit(NODE).alias("rank"), F.col("target").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), "start_t", F.lit(None).cast("bigint").alias("end_t")
        )
        return TemporalGraph(self.df.sparkSession, hi + 1, edges)


def pairwise_relations(trace: DataFrame) -> DataFrame:
    """label_a, label_b, shared (0 to 3 as SHARED), relation: one row a pair of bounded edges of different labels that share a node.

    Four equi-joins, each without the pairs that an earlier one has; nothing is paired that shares no node."""
    a = trace.select(*[F.col(c).alias(f"a_{c}") for c in trace.columns])
    b = trace.select(*[F.col(c).alias(f"b_{c}") for c in trace.columns])
    out = None
    for i, (x, y) in enumerate(SHARED):
        on = (F.col(f"a_{x}") == F.col(f"b_{y}")) & (F.col("a_label") != F.col("b_label"))
        for p, q in SHARED[:i]:
            on = on & (F.col(f"a_{p}") != F.col(f"b_{q}"))
        part = a.join(b, on).withColumn("shared", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rel = intervals.relation(F.col("a_start_t"), F.col("a_end_t"), F.col("b_start_t"), F.col("b_end_t"))
    return out.select(F.col("a_label").alias("label_a"), F.col("b_label").alias("label_b"), "shared", rel.alias("relation")).where("relation IS NOT NULL")


def candidates(trace: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """label_a, label_b, relation, n, pairs, shared, support, confidence, interest of the frequent relations of frequent pairs."""
    rows = pairwise_relations(trace)
    by = rows.groupBy("label_a", "label_b", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("shared").alias("shared"))
    pairs = by.groupBy("label_a", "label_b").agg(F.sum("n").alias("pairs"))
    total = trace.agg(F.count(F.lit(1)).alias("edges"))
    out = by.join(pairs, ["label_a", "label_b"]).join(total)
    out = out.withColumns({"support": F.col("pairs") / F.col("edges"), "confidence": F.col("n") / F.col("pairs")})
    out = out.where((F.col("support") >= support) & (F.col("confidence") >= confidence))
    return out.withColumn("interest", F.col("n") * F.col("confidence")).drop("edges")


def build(row, i: int, round_: int = 1) -> Pattern:
    """A candidate as a pattern of two stages; the shared node is the variable actor."""
    names = [("actor" if SHARED[row.shared][side] == part else f"{part}_{'ab'[side]}") for side in (0, 1) for part in ("source", "target")]
    stages = tuple(Stage(f"e{k + 1}", (Clause(names[2 * k], label, Bind(names[2 * k + 1])),)) for k, label in enumerate((row.label_a, row.label_b)))
    name = f"discovered_r{round_}_{i}_{row.label_a.replace(' ', '_')}_{row.label_b.replace(' ', '_')}"
    return Pattern(name, stages, (Temporal("e1", row.relation, "e2"),))


class Generator(Protocol):
    name: str

    def generate(self, trace: Trace, budget: int) -> list[Pattern]: ...

    def feedback(self, scored: list[Scored]) -> None: ...


Evaluator = Callable[[Pattern, Trace], float]
Filter = Callable[["Scored"], bool]


@dataclass
class Scored:
    pattern: Pattern
    scores: dict[str, float] = field(default_factory=dict)

    def composite(self, weights: dict[str, float] | None = None) -> float:
        return sum((weights or {}).get(k, 1.0) * v for k, v in self.scores.items())


@dataclass
class PairMiner:
    """Proposes the candidates of most interest, once. The driver gets a budget's rows."""

    support: float = MIN_SUPPORT
    confidence: float = MIN_CONFIDENCE
    name: str = "pairs"
    done: bool = False

    def generate(self, trace: Trace, budget: int) -> list[Pattern]:
        if self.done:
            return []
        self.done = True
        top = candidates(trace.df, self.support, self.confidence).orderBy(F.desc("interest"), "label_a", "label_b", "relation").limit(budget)
        return [build(r, i) for i, r in enumerate(top.collect())]

    def feedback(self, scored: list[Scored]) -> None:
        pass


def label_surprise(trace: DataFrame, labels: list[str]) -> DataFrame:
    """score: how much more often the labels meet at a node than by chance, times how rare they are. One row."""
    total = F.lit(0) + F.count(F.lit(1))
    counts = trace.agg(total.alias("edges"), *[F.count(F.when(F.col("label") == x, 1)).alias(f"n{i}") for i, x in enumerate(labels)])
    first = trace.where(F.col("label") == labels[0]).withColumn("__id", F.monotonically_increasing_id())
    for x in labels[1:]:
        other = trace.where(F.col("label") == x)
        ends = other.select(F.col("source").alias("__n")).union(other.select("target")).distinct()
        by_source = first.join(ends, first["source"] == ends["__n"], "left_semi")
        rest = first.join(ends, first["source"] == ends["__n"], "left_anti")
        first = by_source.unionByName(rest.join(ends, rest["target"] == ends["__n"], "left_semi"))
    seen = first.agg(F.count(F.lit(1)).alias("seen"))
    row = counts.join(seen)
    expected, logs = F.lit(1.0), F.lit(0.0)
    for i in range(len(labels)):
        f = F.col(f"n{i}") / F.col("edges")
        expected, logs = expected * f, logs + F.log(f)
    observed = F.col("seen") / F.col("edges")
    score = observed / F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), expected)) * (-logs / len(labels))
    return row.select(F.coalesce(F.when(observed > 0, score), F.lit(0.0)).alias("score"))


def surprise_evaluator(p: Pattern, trace: Trace) -> float:
    labels = [s.clauses[0].label for s in p.stages if s.clauses]
    return label_surprise(trace.df, labels).first()["score"] if labels and not trace.is_empty() else 0.0


def quality(matches: int, edges: int, p: Pattern) -> float:
    """Specific patterns with a moderate number of matches score best."""
    if not matches:
        return 0.0
    ratio = matches / edges
    return (0.5 / ratio if ratio > 0.5 else max(math.log(matches), 0.0)) * (len(p.stages) + 0.5 * sum(len(s.clauses) for s in p.stages))


def match_quality_evaluator(p: Pattern, trace: Trace) -> float:
    as_nodes = p.map_types(value=lambda v: v if isinstance(v, Node) else Node(str(v)))
    return quality(find(trace.graph(), as_nodes).count(), trace.size(), p)


@dataclass
class Session:
    """Rounds of proposing, scoring and choosing, until a generator has no more."""

    generator: Generator
    evaluators: dict[str, Evaluator]
    keep: Filter = lambda s: True
    rounds: int = 10
    budget: int = 50
    scored: list[Scored] = field(default_factory=list)
    accepted: list[Scored] = field(default_factory=list)

    def run(self, trace: Trace) -> list[Scored]:
        for _ in range(self.rounds):
            found = self.generator.generate(trace, self.budget)
            if not found:
                break
            now = [Scored(p, {k: f(p, trace) for k, f in self.evaluators.items()}) for p in found]
            self.scored += now
            self.accepted += [s for s in now if self.keep(s)]
            self.generator.feedback(now)
        return self.accepted
