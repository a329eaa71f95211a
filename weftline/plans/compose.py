"""Patterns made of patterns: sequence, choice, exact and open repetition."""

from __future__ import annotations

from dataclasses import replace

from .pattern import Bind, Clause, Constraint, Loop, Pattern, PatternError, expr_map


def rename_vars(p: Pattern, prefix: str, keep=()) -> Pattern:
    """Every variable and anchor outside of keep gets the prefix and an underscore."""
    kept = set(keep)
    new = lambda v: v if v is None or v in kept else f"{prefix}_{v}"

    def clause(c: Clause) -> Clause:
        t = c.target
        t = Bind(new(t.var)) if isinstance(t, Bind) else replace(t, var=new(t.var)) if isinstance(t, Constraint) else t
        return replace(c, source=new(c.source), target=t)

    return replace(
        p,
        stages=tuple(replace(s, anchor=new(s.anchor), clauses=tuple(map(clause, s.clauses)), lets=tuple((new(n), expr_map(e, var=new)) for n, e in s.lets)) for s in p.stages),
        temporal=tuple(replace(t, left=new(t.left), right=new(t.right)) for t in p.temporal),
        negations=tuple(replace(n, start=new(n.start), end=new(n.end), clauses=tuple(map(clause, n.clauses))) for n in p.negations),
    )


def _chain(name: str, parts: list[Pattern], loop: Loop | None = None) -> Pattern:
    """Parts one after the other. What belongs to a whole pattern (group, deadline, privacy, importance) starts afresh."""
    shifts = [sum(len(q.stages) for q in parts[:i]) for i in range(len(parts))]
    meta: dict[str, str] = {}
    for p in parts:
        meta |= dict(p.metadata)
    return Pattern(
        name,
        sum((p.stages for p in parts), ()),
        sum((p.temporal for p in parts), ()),
        sum((p.negations for p in parts), ()),
        metadata=tuple(meta.items()),
        unordered=tuple(tuple(i + by for i in g) for p, by in zip(parts, shifts, strict=True) for g in p.unordered),
        advance_in_place=any(p.advance_in_place for p in parts),
        loop=loop,
    )


def sequence(name: str, a: Pattern, b: Pattern, shared=()) -> Pattern:
    return _chain(name, [rename_vars(a, "a", shared), rename_vars(b, "b", shared)])


def choice(name: str, alternatives: list[Pattern], exclusive: bool = True) -> list[Pattern]:
    """One pattern an alternative; exclusive ones share a group."""
    return [replace(p, name=f"{name}_{p.name}", group=name if exclusive else None) for p in alternatives]


def repeat(name: str, p: Pattern, n: int, shared=()) -> Pattern:
    if n < 1:
        raise PatternError("a repetition needs a count of 1 or more")
    return _chain(name, [rename_vars(p, f"rep{i}", shared) for i in range(n)])


def repeat_range(name: str, p: Pattern, least: int, most: int | None = None, shared=()) -> Pattern:
    """A first occurrence, then one that loops. In batch this is its first and last occurrence; the counting is incremental."""
    if least < 1 or (most is not None and most < least):
        raise PatternError("a repetition's bounds are 1 <= least <= most")
    n = len(p.stages)
    return _chain(name, [rename_vars(p, "first", shared), rename_vars(p, "last", shared)], Loop(n, 2 * n - 1, least, most, tuple(shared)))
