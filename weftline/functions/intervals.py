"""Allen's interval algebra over half-open intervals [start, end), as column expressions. A null end is an open interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The relations in the order in which they are tested, and what each is from the other side.
INVERSE = {
    "before": "after",
    "after": "before",
    "meets": "met_by",
    "met_by": "meets",
    "equals": "equals",
    "starts": "started_by",
    "started_by": "starts",
    "finishes": "finished_by",
    "finished_by": "finishes",
    "during": "contains",
    "contains": "during",
    "overlaps": "overlapped_by",
    "overlapped_by": "overlaps",
}
RELATIONS = tuple(INVERSE)
BEFORE_OR_MEETS = ("before", "meets")


def _tests(a, ae, b, be) -> dict:
    """Works on columns and on numbers alike (& on booleans)."""
    return {
        "before": ae < b,
        "after": be < a,
        "meets": ae == b,
        "met_by": be == a,
        "equals": (a == b) & (ae == be),
        "starts": (a == b) & (ae < be),
        "started_by": (a == b) & (ae > be),
        "finishes": (ae == be) & (a > b),
        "finished_by": (ae == be) & (a < b),
        "during": (a > b) & (ae < be),
        "contains": (a < b) & (ae > be),
        "overlaps": (a < b) & (b < ae) & (ae < be),
        "overlapped_by": (b < a) & (a < be) & (be < ae),
    }


def _gaps(a, ae, b, be) -> dict:
    zero = a - a
    return {
        "before": b - ae, "after": a - be, "meets": zero, "met_by": zero, "equals": zero, "overlaps": ae - b, "overlapped_by": be - a,
        "during": a - b, "contains": b - a, "starts": be - ae, "started_by": ae - be, "finishes": a - b, "finished_by": b - a,
    }


def relation(a: Column, ae: Column, b: Column, be: Column) -> Column:
    """The relation's name; null if an end is open."""
    out = None
    for name, test in _tests(a, ae, b, be).items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(ae.isNotNull() & be.isNotNull(), out)


def relation_of(a: int, ae: int | None, b: int, be: int | None) -> str | None:
    if ae is None or be is None:
        return None
    return next((name for name, test in _tests(a, ae, b, be).items() if test), None)


def gap(name: str, a: Column, ae: Column, b: Column, be: Column) -> Column:
    """The distance that belongs to a relation; null where it needs an open end."""
    return _gaps(a, ae, b, be)[name]


def gap_of(name: str, a: int, ae: int | None, b: int, be: int | None) -> float | None:
    needs = {"before": (ae,), "after": (be,), "overlaps": (ae,), "overlapped_by": (be,), "starts": (ae, be), "started_by": (ae, be)}.get(name, ())
    if any(x is None for x in needs):
        return None
    return _gaps(a, ae if ae is not None else 0, b, be if be is not None else 0)[name]


def gap_by_relation(rel: Column, a: Column, ae: Column, b: Column, be: Column) -> Column:
    """The gap of whatever relation a column names."""
    out = None
    for name, g in _gaps(a, ae, b, be).items():
        out = F.when(rel == name, g) if out is None else out.when(rel == name, g)
    return out


def covers(start: Column, end: Column, t) -> Column:
    return (start <= t) & (end.isNull() | (F.lit(t) < end if not isinstance(t, Column) else t < end))


def ends_by_start(ae: Column, b: Column) -> Column:
    """a is over when b begins (it may meet it)."""
    return F.coalesce(ae <= b, F.lit(False))


def meets(ae: Column, b: Column) -> Column:
    return F.coalesce(ae == b, F.lit(False))


def intersects(a: Column, ae: Column, b: Column, be: Column) -> Column:
    return (ae.isNull() | (b < ae)) & (be.isNull() | (a < be))


def is_bounded(ae: Column) -> Column:
    return ae.isNotNull()


def constraint(name: str, a: Column, ae: Column, b: Column, be: Column, least: float | None = None, most: float | None = None) -> Column:
    """Whether a pair satisfies a relation with an optional gap. With an open interval only before and meets can hold, by the
    order of the starts, and a gap that can't be computed isn't tested."""
    rel = relation(a, ae, b, be)
    fallback = (a < b) if name in BEFORE_OR_MEETS else F.lit(False)
    ok = F.when(rel.isNull(), fallback).otherwise(rel == name)
    g = gap(name, a, ae, b, be)
    if least is not None:
        ok = ok & F.coalesce(g >= F.lit(least), F.lit(True))
    if most is not None:
        ok = ok & F.coalesce(g <= F.lit(most), F.lit(True))
    return ok


def constraint_of(name: str, a: int, ae: int | None, b: int, be: int | None, least: float | None = None, most: float | None = None) -> bool:
    rel = relation_of(a, ae, b, be)
    if not (a < b and name in BEFORE_OR_MEETS if rel is None else rel == name):
        return False
    g = gap_of(name, a, ae, b, be)
    return g is None or ((least is None or g >= least) and (most is None or g <= most))
