"""Temporal graphs: labelled edges with validity intervals, and a clock.

A graph is a DataFrame of edges, or relations: wide tables of which every row is one source whose columns are its labels.
Both read as edges; a stage whose labels all come from one relation is read from the wide table, without any join. Other
stores are subclasses of Source that say how their edges are read.

Times are whole numbers, or of another numeric type that the graph and its relations name (time="double").

Reading (edges_from, scan, predecessors, ...) gives lazy DataFrames whose filters reach the files. Changing (add, end_edge,
upsert) gives a new graph."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import covers
from ..functions.values import BOOL, NODE, NUM, STR, Literal, Node, Parts, payload, rank_of
from ..plans.pattern import Bind, Constraint, Is, Target
from .predicates import matches

SCHEMA = "edge_seq bigint, source string, label string, rank int, s string, n double, b boolean, start_t bigint, end_t bigint"
Time = int | float
TYPES = {NODE: "string", STR: "string", NUM: "double", BOOL: "boolean"}


@dataclass(frozen=True)
class Relation:
    """A wide table: source, start, end and order are columns; labels maps a label to (rank, column). Rows have distinct sources; a null column is no edge."""

    df: DataFrame
    source: Column
    labels: dict[str, tuple[int, Column]]
    start: Column
    end: Column | None = None
    seq: Column | None = None
    time: str = "bigint"

    def __post_init__(self) -> None:
        if self.seq is None and self.time != "bigint":
            raise ValueError("a relation whose times are not whole numbers needs seq, the order of its rows")

    def value(self, label: str) -> Parts:
        rank, c = self.labels[label]
        null = lambda t: F.lit(None).cast(t)
        return Parts(F.lit(rank), c.cast("string") if rank < 2 else null("string"), c.cast("double") if rank == NUM else null("double"), c if rank == BOOL else null("boolean"))

    def starts(self) -> Column:
        return self.start.cast(self.time)

    def ends(self) -> Column:
        return (F.lit(None) if self.end is None else self.end).cast(self.time)

    def order(self) -> Column:
        return (self.start if self.seq is None else self.seq).cast("bigint")

    def edges(self) -> DataFrame:
        """One branch a label: a filter on a literal label leaves only its branch."""
        out = None
        for i, label in enumerate(self.labels):
            v = self.value(label)
            part = self.df.where(self.labels[label][1].isNotNull()).select(
                (self.order() * len(self.labels) + i).alias("edge_seq"), self.source.cast("string").alias("source"), F.lit(label).alias("label"), v.rank.cast("int").alias("rank"), v.s.alias("s"), v.n.alias("n"), v.b.alias("b"), self.starts().alias("start_t"), self.ends().alias("end_t")
            )
            out = part if out is None else out.unionByName(part)
        return out


def edge_schema(time: str = "bigint") -> str:
    return SCHEMA.replace("_t bigint", f"_t {time}")


def edge_row(seq: int, source: str, label: str, value: Literal, start: Time, end: Time | None = None, time: str = "bigint") -> tuple:
    r, p = rank_of(value), payload(value)
    if time == "double":
        start, end = float(start), None if end is None else float(end)
    return (seq, source, label, r, p if r < 2 else None, p if r == NUM else None, p if r == BOOL else None, start, end)


class Source:
    """What patterns read. A subclass for another store gives spark, now and edges(); the scans, and every query, follow.

    edges(label) returns the columns of SCHEMA, with start_t and end_t of the type time, and must leave out other labels; a
    lazy DataFrame lets filters reach the store. The two methods after it may say what saves joins, and need not."""

    spark: SparkSession
    now: Time | None = None
    time: str = "bigint"

    def edges(self, label: str | None = None) -> DataFrame:
        raise NotImplementedError

    def is_single(self, label: str) -> bool:
        """Whether a source has one edge of a label at most."""
        return False

    def relation_for(self, labels: set[str]) -> Relation | None:
        """The relation that alone has all of these labels."""
        return None

    def edges_from(self, node: str, label: str, at: Time | None = None) -> DataFrame:
        return self.edges_from_any_time(node, label).where(self._at(at))

    def edges_from_any_time(self, node: str, label: str) -> DataFrame:
        return self.edges(label).where(F.col("source") == node)

    def scan(self, label: str, target: Target | None = None, at: Time | None = None) -> DataFrame:
        return self.scan_any_time(label, target).where(self._at(at))

    def scan_any_time(self, label: str, target: Target | None = None) -> DataFrame:
        return self.edges(label).where(matches(Constraint("any") if target is None else target, Parts.edge()))

    def predecessors(self, node: str, label: str) -> DataFrame:
        return self.edges(label).where((F.col("rank") == NODE) & (F.col("s") == node))

    def _at(self, at: Time | None) -> Column:
        t = self.now if at is None else at
        return F.lit(True) if t is None else covers(F.col("start_t"), F.col("end_t"), t)

    @staticmethod
    def value_as_node(value: Column) -> Column:
        return F.when(value["rank"] == NODE, value["s"])


@dataclass(frozen=True)
class TemporalGraph(Source):
    spark: SparkSession
    now: Time | None
    table: DataFrame | None = None
    relations: tuple[Relation, ...] = ()
    #: Labels with one edge a source at most: a later clause that binds one needs no search for the first edge.
    single: frozenset[str] = field(default_factory=frozenset)
    time: str = "bigint"

    @property
    def schema(self) -> str:
        return edge_schema(self.time)

    @staticmethod
    def of(spark: SparkSession, rows: Iterable[tuple], now: Time | None, time: str = "bigint") -> TemporalGraph:
        """From (source, label, value, start[, end]) rows, in order."""
        return TemporalGraph(spark, now, spark.createDataFrame([edge_row(i, *(*r, None)[:5], time) for i, r in enumerate(rows)], edge_schema(time)), time=time)

    def edges(self, label: str | None = None) -> DataFrame:
        """All edges, or those of a label, which relations give from their own columns only."""
        parts = [] if self.table is None else [self.table if label is None else self.table.where(F.col("label") == label)]
        for r in self.relations:
            if label is None:
                parts.append(r.edges())
            elif label in r.labels:
                parts.append(replace(r, labels={label: r.labels[label]}).edges())
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def is_single(self, label: str) -> bool:
        return label in self.single or (self.table is None and sum(label in r.labels for r in self.relations) == 1)

    def relation_for(self, labels: set[str]) -> Relation | None:
        """The relation that alone has all of these labels."""
        if self.table is not None:
            return None
        having = [r for r in self.relations if labels & r.labels.keys()]
        return having[0] if len(having) == 1 and labels <= having[0].labels.keys() else None

    # changes
    def add(self, rows: DataFrame | Iterable[tuple]) -> TemporalGraph:
        """With more edges: a table, or (source, label, value, start[, end]) rows, which come after those that are there."""
        if not isinstance(rows, DataFrame):
            last = 0 if self.table is None else self.table.agg(F.max("edge_seq")).first()[0]
            rows = self.spark.createDataFrame([edge_row((last or 0) + 1 + i, *(*r, None)[:5], self.time) for i, r in enumerate(rows)], self.schema)
        return replace(self, table=rows if self.table is None else self.table.unionByName(rows))

    def add_edge(self, source: str, label: str, value: Literal, start: Time, end: Time | None = None) -> TemporalGraph:
        return self.add([(source, label, value, start, end)])

    def add_ref(self, source: str, label: str, node: str, start: Time) -> TemporalGraph:
        return self.add_edge(source, label, Node(node), start)

    def add_event(self, event: str, kind: str, tags: Iterable[str], start: Time) -> TemporalGraph:
        return self.add([(event, "eventType", kind, start), *[(event, "tag", t, start) for t in tags]])

    def end_edge(self, source: str, label: str, at: Time) -> tuple[TemporalGraph, bool]:
        """Closes the most recent open edge of a source and label; says whether there was one."""
        done = end_latest(self.edges(), self.spark.createDataFrame([(source, label, float(at) if self.time == "double" else at)], f"source string, label string, at {self.time}"))
        hit = not self.edges_from_any_time(source, label).where("end_t IS NULL").isEmpty()
        return replace(self, table=done, relations=()), hit

    def upsert(self, source: str, label: str, value: Literal, at: Time) -> TemporalGraph:
        return self.end_edge(source, label, at)[0].add_edge(source, label, value, at)

    def with_now(self, now: Time | None) -> TemporalGraph:
        return replace(self, now=now)


def end_latest(edges: DataFrame, closings: DataFrame) -> DataFrame:
    """edges with, for each (source, label, at) of closings, the most recent open edge ended at that time.

    Which edge that is comes from a maximum by source and label, not from sorting their edges."""
    latest = edges.where("end_t IS NULL").groupBy("source", "label").agg(F.max("edge_seq").alias("edge_seq"))
    at = closings.groupBy("source", "label").agg(F.min("at").alias("__at"))
    hit = latest.join(at, ["source", "label"]).select("source", "label", "edge_seq", "__at")
    out = edges.join(hit, ["source", "label", "edge_seq"], "left")
    return out.select(*[F.coalesce("end_t", "__at").alias("end_t") if c == "end_t" else c for c in edges.columns])


def upsert_history(edges: DataFrame) -> DataFrame:
    """Bulk upsert: each open edge ends where the next one of its source and label starts."""
    w = W.partitionBy("source", "label").orderBy("start_t", "edge_seq")
    return edges.withColumn("end_t", F.coalesce("end_t", F.lead("start_t").over(w)))


def explode_tags(events: DataFrame, event: str, kind: str, tags: str, start: str) -> DataFrame:
    """Event rows with an array of tags as one eventType edge and one tag edge each, in one pass."""
    both = F.concat(F.array(F.struct(F.lit("eventType").alias("label"), F.col(kind).alias("s"))), F.transform(F.col(tags), lambda t: F.struct(F.lit("tag").alias("label"), t.alias("s"))))
    rows = events.select(F.col(event).alias("source"), F.col(start).alias("start_t"), F.posexplode(both).alias("i", "e"))
    return rows.select("source", "e.label", F.lit(STR).alias("rank"), "e.s", F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), "start_t", F.lit(None).cast("bigint").alias("end_t"), "i")


__all__ = ["Bind", "Is", "Relation", "Source", "TemporalGraph", "edge_row", "edge_schema", "end_latest", "explode_tags", "upsert_history"]
