"""Patterns to text. What the text form can't say raises: a range of two bounds, inactivity, exclusive groups, loops."""

from __future__ import annotations

from ..functions.values import Literal, Node
from ..plans.pattern import Bind, Clause, Constraint, Expr, Is, Lit, Pattern, PatternError, Ref


def _literal(v: Literal) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return f"{v:g}" if float(f"{v:g}") == v else repr(float(v))
    if '"' in v or "\n" in v:
        return f'"""{v}"""'
    return f'"{v}"'


def _target(t) -> str:
    if isinstance(t, Bind):
        return f"-> ?{t.var}"
    if isinstance(t, Is):
        return f"-> {t.value.id}" if isinstance(t.value, Node) else f"= {_literal(t.value)}"
    assert isinstance(t, Constraint)
    if t.var:
        return f"{t.op[:-1]} ?{t.var}"
    if t.op == "in":
        return f"in [{', '.join(map(_literal, t.values))}]"
    if t.op in ("between", "any"):
        raise PatternError(f"{t.op} has no text form")
    return f"{t.op} {_literal(t.values[0])}"


def _expr(e: Expr) -> str:
    return _literal(e.value) if isinstance(e, Lit) else f"?{e.var}" if isinstance(e, Ref) else f"({_expr(e.left)} {e.op} {_expr(e.right)})"


def pattern_to_dsl(p: Pattern) -> str:
    if p.inactivity is not None or p.loop is not None:
        raise PatternError("inactivity and loops have no text form in a pattern")
    bound: set[str] = set()

    def clause(c: Clause, pad: str, own: str | None) -> str:
        mark = "?" if c.source in bound and c.source != own else ""
        if isinstance(c.target, Bind):
            bound.add(c.target.var)
        return f"{pad}{'! ' if c.negated else ''}{mark}{c.source}.{c.label} {_target(c.target)}"

    out = [f"{'private ' * p.private}{'advance_in_place ' * p.advance_in_place}pattern {p.name}{f' importance {p.importance:g}' if p.importance != 1 else ''} {{"]
    for step in p.steps():
        pad = "  "
        if len(step) > 1:
            out.append("  concurrent {")
            pad = "    "
        for i in step:
            s = p.stages[i]
            out.append(f"{pad}stage {s.anchor} {{")
            out += [clause(c, pad + "  ", s.anchor) for c in s.clauses]
            out.append(f"{pad}}}")
            bound.add(s.anchor)
            if len(step) == 1:
                out += [f"  let {n} = {_expr(e)}" for n, e in s.lets]
                bound.update(n for n, _ in s.lets)
        if len(step) > 1:
            out.append("  }")
    for n in p.negations:
        out.append(f"  unless {f'between {n.start} {n.end}' if n.end else f'after {n.start}'} {{")
        out += [clause(c, "    ", None) for c in n.clauses]
        out.append("  }")
    for t in p.temporal:
        least, most = ("" if x is None else f"{x:g}" for x in (t.least, t.most))
        out.append(f"  temporal {t.left} {t.relation} {t.right}{f' gap {least}..{most}' if least or most else ''}")
    if p.deadline is not None:
        out.append(f"  deadline {p.deadline}")
    out += [f'  meta({_literal(k)}, {_literal(v)})' for k, v in p.metadata]
    return "\n".join([*out, "}"]) + "\n"
