"""Edge values as columns: a rank (0 node, 1 string, 2 number, 3 boolean) and one payload column a rank.

Values of different ranks compare by rank; NaN compares false with everything, itself included. A value is either four
columns of an edge (rank, s, n, b) or one struct of them, which is what a variable holds."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE, STR, NUM, BOOL = range(4)
STRUCT = "struct<rank:int,s:string,n:double,b:boolean>"


@dataclass(frozen=True)
class Node:
    """A reference to a node, as opposed to a string of the same text."""

    id: str


Literal = Node | str | float | int | bool


def rank_of(v: Literal) -> int:
    return BOOL if isinstance(v, bool) else NUM if isinstance(v, (int, float)) else NODE if isinstance(v, Node) else STR


def payload(v: Literal) -> Any:
    return v.id if isinstance(v, Node) else float(v) if rank_of(v) == NUM else v


@dataclass(frozen=True)
class Parts:
    """The four columns of a value."""

    rank: Column
    s: Column
    n: Column
    b: Column

    @staticmethod
    def edge() -> Parts:
        return Parts(F.col("rank"), F.col("s"), F.col("n"), F.col("b"))

    @staticmethod
    def of(struct: Column) -> Parts:
        return Parts(struct["rank"], struct["s"], struct["n"], struct["b"])

    @staticmethod
    def literal(v: Literal) -> Parts:
        r, p = rank_of(v), payload(v)
        null = lambda t: F.lit(None).cast(t)
        return Parts(F.lit(r), F.lit(p) if r < 2 else null("string"), F.lit(p) if r == NUM else null("double"), F.lit(p) if r == BOOL else null("boolean"))

    def struct(self) -> Column:
        return F.struct(self.rank.cast("int").alias("rank"), self.s.alias("s"), self.n.alias("n"), self.b.alias("b"))


def node(source: Column) -> Column:
    return Parts(F.lit(NODE), source, F.lit(None).cast("double"), F.lit(None).cast("boolean")).struct()


def number(n: Column) -> Column:
    return Parts(F.lit(NUM), F.lit(None).cast("string"), n, F.lit(None).cast("boolean")).struct()


def text(s: Column) -> Column:
    return Parts(F.lit(STR), s, F.lit(None).cast("double"), F.lit(None).cast("boolean")).struct()


def boolean(b: Column) -> Column:
    return Parts(F.lit(BOOL), F.lit(None).cast("string"), F.lit(None).cast("double"), b).struct()


COMPARISONS = ("=", "<", ">", "<=", ">=")


def compare_literal(op: str, a: Parts, v: Literal) -> Column:
    """a op literal. Only the literal's own payload column is read, so that equality reaches the scan as two plain filters."""
    r, p = rank_of(v), payload(v)
    if r == NUM and math.isnan(p):
        return F.lit(False)
    own = (a.s, a.s, a.n, a.b)[r]
    guard = (lambda c: c & ~F.isnan(own)) if r == NUM else (lambda c: c)
    same = lambda test: (a.rank == r) & guard(test)
    if op == "=":
        return same(own == F.lit(p))
    if op in ("<", "<="):
        return (a.rank < r) | same(own < F.lit(p) if op == "<" else own <= F.lit(p))
    return (a.rank > r) | same(own > F.lit(p) if op == ">" else own >= F.lit(p))


def compare(op: str, a: Parts, b: Parts) -> Column:
    """a op b, both columns."""
    sane = ~F.coalesce(F.isnan(a.n), F.lit(False)) & ~F.coalesce(F.isnan(b.n), F.lit(False))
    by = lambda f: F.when(a.rank < 2, f(a.s, b.s)).when(a.rank == NUM, f(a.n, b.n)).otherwise(f(a.b, b.b))
    tests = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    same = (a.rank == b.rank) & sane & F.coalesce(by(tests[op]), F.lit(False))
    if op == "=":
        return same
    return same | (a.rank < b.rank if op in ("<", "<=") else a.rank > b.rank)


def compare_python(op: str, a: Literal, b: Literal) -> bool:
    """The same rule on Python values, for the incremental machine."""
    if op == "=" and a.__class__ is b.__class__:
        return a == b
    ra, rb = rank_of(a), rank_of(b)
    pa, pb = payload(a), payload(b)
    if (ra == NUM and math.isnan(pa)) or (rb == NUM and math.isnan(pb)):
        return ra != rb and op != "=" and ((ra < rb) == (op in ("<", "<=")))
    if ra != rb:
        return op != "=" and ((ra < rb) == (op in ("<", "<=")))
    return {"=": pa == pb, "<": pa < pb, ">": pa > pb, "<=": pa <= pb, ">=": pa >= pb}[op]
