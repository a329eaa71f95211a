"""What a clause asks of an edge's target, as a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import NODE, NUM, Literal, Parts, compare, compare_literal, compare_python, payload, rank_of
from ..plans.pattern import Bind, Constraint, Is, PatternError, Target


def matches(target: Target, v: Parts, of_var: Callable[[str], Column | None] = lambda _: None) -> Column:
    """Whether a value satisfies a target. of_var gives the struct that a variable holds, None while it is unbound.

    A constraint against a variable holds for values only: an unbound one, or one bound to a node, matches nothing."""
    if isinstance(target, Is):
        return compare_literal("=", v, target.value)
    if isinstance(target, Bind):
        bound = of_var(target.var)
        return F.lit(True) if bound is None else compare("=", v, Parts.of(bound))
    if target.var:
        bound = of_var(target.var)
        if bound is None:
            return F.lit(False)
        return (bound["rank"] != NODE) & compare(target.op[:-1], v, Parts.of(bound))
    if target.op == "any":
        return F.lit(True)
    if target.op == "between":
        return compare_literal(">=", v, target.values[0]) & compare_literal("<=", v, target.values[1])
    if target.op == "in":
        return _one_of(v, target.values)
    return compare_literal(target.op, v, target.values[0])


def _one_of(v: Parts, values: tuple[Literal, ...]) -> Column:
    """One IN a rank."""
    out = F.lit(False)
    for r, column in enumerate((v.s, v.s, v.n, v.b)):
        own = [payload(x) for x in values if rank_of(x) == r and not (r == NUM and payload(x) != payload(x))]
        if own:
            out = out | ((v.rank == r) & column.isin(*own))
    return out


def matches_python(target: Target, value: Literal, of_var: Callable[[str], Literal | None]) -> bool:
    """The same for one Python value."""
    if isinstance(target, Is):
        return compare_python("=", value, target.value)
    if isinstance(target, Bind):
        bound = of_var(target.var)
        return bound is None or compare_python("=", value, bound)
    if target.var:
        bound = of_var(target.var)
        return bound is not None and rank_of(bound) != NODE and compare_python(target.op[:-1], value, bound)
    if target.op == "any":
        return True
    if target.op == "between":
        return compare_python(">=", value, target.values[0]) and compare_python("<=", value, target.values[1])
    if target.op == "in":
        return any(compare_python("=", value, x) for x in target.values)
    if target.op not in ("=", "<", ">", "<=", ">="):
        raise PatternError(f"unknown operator {target.op}")
    return compare_python(target.op, value, target.values[0])


def constraint(op: str, *values: Literal) -> Constraint:
    return Constraint(op, values)
