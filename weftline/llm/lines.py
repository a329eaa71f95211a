"""Substring deduplication by hashing lines and the sentences in them.

A text's units are its lines, and the sentences of lines that have several. A unit is normalised (lower case, white space
runs to one space, trimmed) and hashed. Over the whole corpus the occurrence of the lowest rank (doc_id, then row, then
place) is kept, and every later one goes with the separator behind it; units of fewer than a least number of words are
left alone. Spans keep the original offsets. The first occurrence of a sentence survives: a line is removed only for an
earlier equal line, which holds the sentence earlier.

Defined results: a null or empty text has no units; a null doc_id ranks last; a repeated row's units are later occurrences
of the first's and go; an empty table gives no rows; other columns are not read. Counts are summed before they are
shuffled, and only units that occur again meet.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, BLANKS_SQL, cut, cutter, let, plain_columns, prefix_sums, running_max, table

#: A unit of fewer words is never removed.
LEAST_WORDS = 8
LINE = "\n"
SENTENCE = "[.!?][ \\t]+"
#: What ends a sentence where whole passages are asked for: closing punctuation of scripts without spaces has no blank behind it.
STOP = re.compile(r"[.!?][ \t]+|[。！？]")
#: Characters of scripts without spaces; each counts as a word.
DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
CLOSING = ".!?。！？… "
SPAN = "array<struct<start:bigint,end:bigint>>"


def _pieces(text: Column, separator: str, base: Column) -> Column:
    """(start, end, body) of the pieces between separators; end includes the separator behind the piece."""
    gaps = F.regexp_extract_all(text, F.lit(separator), F.lit(0))

    def of(ps: Column, gs: Column) -> Column:
        sized = F.transform(ps, lambda p, i: F.struct(p.alias("body"), (F.length(p) + F.coalesce(F.length(F.get(gs, i)), F.lit(0))).cast("long").alias("n")))
        return let(sized, lambda xs: F.zip_with(xs, prefix_sums(F.transform(xs, lambda x: x["n"]), base), lambda x, at: F.struct(at.alias("start"), (at + x["n"]).alias("end"), x["body"].alias("body"))))

    return let(F.split(text, separator), lambda ps: let(gaps, lambda gs: of(ps, gs)))


def units(text: Column, least: int = LEAST_WORDS) -> Column:
    """An array of (start, end, a, b) of the units that count; a and b are a 96-bit digest."""
    lines = _pieces(F.coalesce(text, F.lit("")), LINE, F.lit(0))
    parts = F.flatten(F.transform(lines, lambda x: let(_pieces(x["body"], SENTENCE, x["start"]), lambda s: F.when(F.size(s) > 1, F.concat(F.array(x), s)).otherwise(F.array(x)))))
    norm = lambda p: F.trim(F.regexp_replace(F.lower(p), BLANKS, " "))
    hashed = F.transform(
        parts,
        lambda s: let(norm(s["body"]), lambda n: F.when(F.size(F.split(n, " ")) >= least, F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(n).alias("a"), F.hash(n).alias("b")))),
    )
    return F.filter(hashed, lambda s: s.isNotNull())


def passages(text: str | None, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
    """Like units, of whole passages: closing punctuation does not count, a character of a script without spaces counts as
    a word, and pieces of fewer words than least stand in runs: from each the shortest run of consecutive pieces, forwards
    and backwards, that has least words. A run is removed if the same run stands earlier, so each of its pieces survives."""
    text, at, leaves, found = text or "", 0, [], set()
    norm = lambda x: re.sub(BLANKS, " ", x.lower()).strip(" ").rstrip(CLOSING)
    size = lambda n: sum(max(1, len(DENSE.findall(w))) for w in n.split(" ")) if n else 0

    def add(start: int, end: int, key: str) -> None:
        d = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))
        found.add((start, end, *(int.from_bytes(d[i : i + 8], "big", signed=True) for i in (0, 8))))

    for line in text.split(LINE):
        end = min(at + len(line) + 1, len(text))
        n = norm(line)
        if size(n) >= least:
            add(at, end, n)
        ends = [m.end() for m in STOP.finditer(line)]
        for a, b in zip([0, *ends], [*ends, len(line)], strict=True):
            n = norm(line[a:b])
            if n:
                leaves.append((at + a, at + b, end if b == len(line) else at + b, a == 0, n, size(n)))
        at = end
    for i, leaf in enumerate(leaves):
        for step in (1, -1):
            j, total = i, leaf[5]
            while total < least and 0 <= j + step < len(leaves):
                j += step
                total += leaves[j][5]
            if total >= least:
                first, last = leaves[min(i, j)], leaves[max(i, j)]
                # the line feed behind a run goes only with a whole line, so that no two lines become one
                add(first[0], last[2] if first[3] else last[1], " ".join(x[4] for x in leaves[min(i, j) : max(i, j) + 1]))
    return sorted(found)


def repeated(df: DataFrame, least: int = LEAST_WORDS, whole: bool = False) -> DataFrame:
    """One row a document: doc_id, n_units, and removed, the merged spans (start, end) of units that an earlier one equals.
    With whole, the units are passages(), in which short pieces count too; the query and its SQL are without."""
    docs = plain_columns(df, ["doc_id", "text"])
    of = F.udf(lambda t: passages(t, least), "array<struct<start:bigint,end:bigint,a:bigint,b:bigint>>", useArrow=True)(F.col("text")) if whole else units(F.col("text"), least)
    held = cut(docs.select("doc_id", of.alias("units"), F.monotonically_increasing_id().alias("row")), "units")
    each = held.select("doc_id", "row", F.explode("units").alias("u")).select("doc_id", "row", "u.*")
    twice = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    again = cut(each.join(twice, ["a", "b"], "left_semi").withColumn("r", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "start")), "again")
    # the first ones go by their own place, so that a unit of very many occurrences is no key of a join
    first = again.groupBy("a", "b").agg(F.min("r").alias("first")).select("a", "b", "first.row", "first.start")
    later = again.join(first, ["a", "b", "row", "start"], "left_anti")
    spans = later.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    out = held.select("row", "doc_id", F.size("units").cast("long").alias("n_units")).join(spans, "row", "left")
    return out.withColumn("removed", merged(F.coalesce("removed", F.array().cast(SPAN))))


def merged(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap joined: a run begins where a span starts behind all ends before it, and ends
    with the largest end in it. Linear but for the running maximum, which goes by blocks."""
    none = F.array().cast(SPAN)

    def of(ss: Column) -> Column:
        reach = running_max(F.transform(ss, lambda s: s["end"]))

        def cut(ends: Column) -> Column:
            n = F.size(ss)
            heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ss, i)["start"] > F.get(ends, i - 1)))
            tails = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get(ss, i + 1)["start"] > F.get(ends, i)))
            return F.zip_with(heads, tails, lambda h, t: F.struct(F.get(ss, h)["start"].alias("start"), F.get(ends, t).alias("end")))

        return let(reach, cut)

    return let(spans, lambda ss: F.when(F.size(ss) > 0, of(ss)).otherwise(none))


def strip(text: Column, removed: Column) -> Column:
    """The text without the merged spans."""

    def of(spans: Column) -> Column:
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
        return cutter(text, lambda cut: F.array_join(F.zip_with(starts, ends, lambda a, b: cut(a, b - a)), ""))

    return let(removed, of)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its units, the maximal runs that go, their characters, and the runs as start:end, joined by commas."""
    out = repeated(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("removed_spans"),
    )


def sql(source: str = "documents") -> str:
    def pieces(frm: str, split: str, gaps: str, base: str, key: str) -> str:
        return f"""SELECT *, {base} + coalesce(sum(n) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
  SELECT *, length(p[i]) + coalesce(length(g[i]), 0) AS n, p[i] AS body FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, {split} AS p, {gaps} AS g FROM {frm})))"""

    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
l AS (SELECT rid, doc_id, i AS line, a, a + n AS b, body FROM ({pieces('d', 'string_split(t, chr(10))', "list_resize(CAST([] AS VARCHAR[]), len(string_split(t, chr(10))) - 1, chr(10))", '0', 'rid')})),
s AS (SELECT rid, doc_id, a2 AS a, b2 AS b, body2 AS body FROM (SELECT rid, doc_id, line, count(*) OVER (PARTITION BY rid, line) AS k, a AS a2, a + n AS b2, body AS body2
  FROM ({pieces('(SELECT rid, doc_id, line, a AS base, body AS whole FROM l)', f"regexp_split_to_array(whole, '{SENTENCE}')", f"regexp_extract_all(whole, '{SENTENCE}')", 'base', 'rid, line')})) WHERE k > 1),
u AS (SELECT rid, doc_id, a::BIGINT AS a, b::BIGINT AS b, trim(regexp_replace(lower(body), '{BLANKS_SQL}', ' ', 'g')) AS k FROM (SELECT rid, doc_id, a, b, body FROM l UNION ALL SELECT * FROM s)),
c AS (SELECT * FROM u WHERE len(string_split(k, ' ')) >= {LEAST_WORDS}),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, rid, a) AS pos FROM c),
x AS (SELECT rid, a, max(b) AS b FROM r WHERE pos > 1 GROUP BY rid, a),
m AS (SELECT *, max(b) OVER (PARTITION BY rid ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
y AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY a) AS run FROM m),
z AS (SELECT rid, run, min(a) AS a, max(b) AS b FROM y GROUP BY rid, run),
g AS (SELECT rid, count(*) AS n, sum(b - a) AS chars, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM z GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM c GROUP BY rid)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_units, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(chars, 0)::BIGINT AS removed_chars, coalesce(spans, '') AS removed_spans
FROM d LEFT JOIN g USING (rid) LEFT JOIN n USING (rid)"""
