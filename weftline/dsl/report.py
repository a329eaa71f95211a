"""Results as JSON: {"ok": true, ...} or {"ok": false, "error": {...}}. For small graphs written in the text form."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.intervals import RELATIONS, gap_of, relation_of
from ..functions.values import BOOL, NODE, NUM, Node
from ..plans import gap
from ..plans.batch import evaluate
from ..plans.pattern import PatternError
from ..streaming.machine import Edge, Machine
from .parser import ParseError, parse_document


def _enveloped(f: Callable[[], dict[str, Any]]) -> str:
    try:
        return json.dumps({"ok": True} | f(), sort_keys=True)
    except ParseError as e:
        return json.dumps({"ok": False, "error": {"message": e.message, "line": e.line, "column": e.column}}, sort_keys=True)
    except PatternError as e:
        return json.dumps({"ok": False, "error": {"message": str(e), "line": 0, "column": 0}}, sort_keys=True)


def _value(v) -> Any:
    if isinstance(v, Node):
        return {"node": v.id}
    if not hasattr(v, "rank"):
        return v
    return {"node": v.s} if v.rank == NODE else v.n if v.rank == NUM else v.b if v.rank == BOOL else v.s


def matches_to_dicts(df: DataFrame) -> list[dict[str, Any]]:
    """Packed matches as plain dictionaries."""
    return [
        {"pattern": r.pattern, "bindings": {k: _value(v) for k, v in r.bindings.items()}, "intervals": {k: [s.start, s.end] for k, s in r.intervals.items()}, "metadata": r.metadata}
        for r in df.collect()
    ]


def batch(spark: SparkSession, text: str) -> str:
    """All matches of a document's patterns in its first graph."""

    def run() -> dict[str, Any]:
        d = parse_document(text)
        if not d.graphs:
            raise ParseError("the document has no graph")
        return {"matches": matches_to_dicts(evaluate(d.graphs[0].build(spark), d.patterns))}

    return _enveloped(run)


def incremental(text: str) -> str:
    """The events of a document's patterns as its first graph's edges come in, by start time."""

    def run() -> dict[str, Any]:
        d = parse_document(text)
        if not d.graphs:
            raise ParseError("the document has no graph")
        m = Machine(d.patterns, d.graphs[0].now)
        rows = sorted(d.graphs[0].rows, key=lambda r: r[3])
        events = m.feed(Edge(*r) for r in rows)
        return {"events": [{"kind": e.kind, "pattern": e.pattern, "match_id": e.match_id, "stage": e.stage_index, "bindings": {k: _value(v) for k, v in e.bindings.items()}, "clause": e.clause_label, "trigger": e.trigger_source} for e in events]}

    return _enveloped(run)


def why_not(spark: SparkSession, text: str, pattern: str) -> str:
    def run() -> dict[str, Any]:
        d = parse_document(text)
        rows = gap.clauses(d.graphs[0].build(spark), d.pattern(pattern))
        own = [r.asDict() for r in rows.orderBy("stage", "clause").collect()]
        return {"clauses": own, "closeness": sum(r["matched"] for r in own) / len(own) if own else 1.0}

    return _enveloped(run)


def allen(a: tuple[int, int | None], b: tuple[int, int | None]) -> str:
    name = relation_of(*a, *b)
    return json.dumps({"ok": True, "relation": name, "gap": None if name is None else gap_of(name, *a, *b), "relations": list(RELATIONS)}, sort_keys=True)
