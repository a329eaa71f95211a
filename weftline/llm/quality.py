"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A table with a text column lang has the stop words asked for only of languages that the list covers (and of unknown ones).

Defined results: null or empty text has no words and fails the base; ties and repeated rows are judged row by row; an
empty table gives an empty result; columns besides the text are carried through unread, and the metric columns take
the place of columns of the same name. A text is read whole, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS_SQL, let, plain_columns, spare, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of English, German, French and Spanish, with and without a capital.
STOP_WORDS = tuple(
    w
    for x in (
        "the of and to in is that it for on with as was at by be this are from or an a not "
        "der die das und ist nicht ein eine von mit zu den auf für sich "
        "le la les des et un une que qui dans pour par sur est en du de au pas avec "
        "el los las y por con para del se no una como"
    ).split()
    for w in (x, x[0].upper() + x[1:])
)


@dataclass(frozen=True)
class Rule:
    """A document passes if low * per <= 100 * metric <= high * per; whole numbers, so that every engine decides alike. low, high: percent."""

    name: str
    metric: str
    per: str
    low: int | None = None
    high: int | None = None
    langs: tuple[str, ...] = ()  # only texts of these languages, and of unknown ones, are judged; none: all


#: The production thresholds.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1600),
    Rule("symbol_ratio", "n_symbols", "n_words", high=10),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=4, langs=("en", "de", "fr", "es")),
    Rule("exclamation_ratio", "n_exclamations", "n_words", high=30),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=40),
)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    """How many characters of a set a text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that stand twice or more in the text. Only texts with a repeated window are sorted."""
    n = F.size(w)
    windows = F.when(n < WINDOW, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]))
    )

    def covered(ws: Column) -> Column:
        by_text = F.array_sort(F.transform(ws, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))

        def marked(s: Column) -> Column:
            keys = F.transform(s, lambda e: e["k"])
            before = F.concat(F.array(F.lit(None).cast("string")), keys)
            after = F.slice(keys, F.lit(2), F.size(keys))
            near = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            hits = F.zip_with(s, near, lambda e, q: F.when(e["k"].eqNullSafe(q["a"]) | e["k"].eqNullSafe(q["b"]), e["p"]))
            return F.array_sort(F.filter(hits, lambda p: p.isNotNull()))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(let(by_text, marked), start, step, lambda acc: acc["n"])

    return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(covered(ws)))


def measures(text: Column) -> Column:
    """All metrics of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)

    def of(w: Column) -> Column:
        return let(
            lines,
            lambda rows: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                _without(text, SYMBOLS).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(rows).cast("long").alias("n_lines"),
                _without(text, "!").cast("long").alias("n_exclamations"),
            ),
        )

    return let(words(text), of)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES, lang: Column | None = None) -> tuple[Column, Column]:
    """The base's verdict, and the names of the rules that fail, in the table's order. lang: the text's language, if known."""
    base_failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    failed = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (100 * m[r.metric] < r.low * m[r.per])
        if r.high is not None:
            bad = bad | (100 * m[r.metric] > r.high * m[r.per])
        if r.langs and lang is not None:
            bad = bad & F.coalesce(lang.isin(*r.langs), F.lit(True))
        failed.append(F.when(bad, F.lit(r.name)))
    return base_failed, F.concat_ws(",", *failed)


def lang_of(df: DataFrame) -> Column | None:
    return F.col("lang") if dict(df.dtypes).get("lang") == "string" else None


def quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the metrics, base_failed, failed_rules and kept."""
    name = spare(df, "measures")
    held = df.withColumn(name, measures(F.col(f"`{text}`")))
    base_failed, failed = verdict(F.col(name), rules, lang_of(df))
    new = {n: F.col(name)[n] for n in (*BASE_COLUMNS, "n_stop_words", "n_lines", "n_exclamations")} | {"base_failed": base_failed, "failed_rules": failed}
    out = held.select(*[F.col(f"`{c}`") for c in df.columns if c not in {*new, "kept"}], *[v.alias(k) for k, v in new.items()])
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])
    return quality(docs).select("doc_id", *BASE_COLUMNS, "base_failed", "kept", "failed_rules")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    name = spare(docs, "measures")
    base_failed, failed = verdict(F.col(name), lang=lang_of(docs))
    return docs.withColumn(name, measures(F.col("text"))).where(~base_failed & (failed == "")).select(*[F.col(f"`{c}`") for c in docs.columns])


def sql(source: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    stops = ", ".join("'" + w + "'" for w in STOP_WORDS)
    chars = lambda s: f"(length(t) - length(translate(t, '{s}', '')))"
    blank = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    tests = []
    for r in RULES:
        bad = [f"100 * {r.metric} < {r.low} * {r.per}"] * (r.low is not None) + [f"100 * {r.metric} > {r.high} * {r.per}"] * (r.high is not None)
        if r.langs:
            bad = [f"({' OR '.join(bad)}) AND coalesce(lang IN ({', '.join(repr(x) for x in r.langs)}), true)"]
        tests.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM {source}),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{BLANKS_SQL}'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {blank}, '')) > 0) AS ls FROM d),
wins AS (SELECT rid, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS k
         FROM (SELECT rid, w, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM w WHERE len(w) >= {WINDOW})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM wins) WHERE n > 1),
rep AS (SELECT rid, sum(least({WINDOW}, i - last))::BIGINT AS n
        FROM (SELECT rid, i, lag(i, 1, -{WINDOW}) OVER (PARTITION BY rid ORDER BY i) AS last FROM twice) GROUP BY rid),
m AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(translate(t, {blank}, ''))::BIGINT AS word_chars,
        {chars(SYMBOLS)}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
        len(ls)::BIGINT AS n_lines, {chars('!')}::BIGINT AS n_exclamations
      FROM w LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {', '.join(tests)}) AS failed_rules FROM m)
SELECT doc_id, {', '.join(BASE_COLUMNS)}, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""
