"""Secret scans with corpus-wide ownership frequency.

Patterns give candidate spans; each candidate's value is hashed, and hashes are counted over the whole corpus by distinct
owners (here: sources) and by distinct repositories (documents, of which equal texts are one). A value that many owners or
very many repositories have is a copied example; any other that looks random is taken for live. Opaque tokens, which no
pattern names, are reported only when they are live. Offsets are prefix sums in blocks: time is linear in a text.

Defined results: null or empty text has no spans; a null owner counts as one of its own; repeated rows are
reported row by row and count once in the frequencies; an empty table gives none; other columns are carried through and
clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, cutter, let, plain_columns, prefix_sums, running_max, spare, table

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
#: kind, pattern, group of the value. The first three are the base. Patterns mean the same to Java and to DuckDB.
KINDS = (
    ("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", "AKIA[A-Z0-9]{16,}", 0),
    ("hex", "[0-9a-f]{24,}", 0),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0),
    ("vendor", "gh[oprsu]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}", 0),
    ("opaque", "[A-Za-z0-9+/_-]{24,}", 0),
)
#: Strings of which one stands in every match: a cheap test before the pattern.
NEEDS = {"access": ("AKIA",), "key": ("PRIVATE KEY-----",), "jwt": ("eyJ",), "vendor": ("gh", "glpat-", "xox", "sk_live_", "AIza")}
BASE = 3
NAMES = tuple(k for k, _, _ in KINDS)
OPAQUE = NAMES.index("opaque")
#: A value of so many distinct owners is a copied example.
WIDE_OWNERS = 4
#: Or of so many distinct repositories, whoever owns them.
WIDE_REPOS = 100
#: Live-looking: so many different characters at least, and a digit.
LEAST_KINDS_OF_CHARACTERS = 8
MARK = "[SECRET]"


def _spans(text: Column, k: int) -> Column:
    """All matches of a kind: (start, end, kind, hash, looks_live, value_start), by start. Offsets are prefix sums over the text split at the matches."""
    name, pattern, group = KINDS[k]
    pieces = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))
    # a match begins behind all pieces up to it and all matches before it
    sized_of = lambda ps: F.transform(ps, lambda x: F.length(x["m"]) + x["gap"])

    def span(x: Column, at: Column) -> Column:
        m = x["m"]
        value = F.regexp_extract(m, pattern, group) if group else m
        end = at + F.length(m)
        looks = (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_KINDS_OF_CHARACTERS) & value.rlike("[0-9]")
        if name == "opaque":
            looks = looks & value.rlike("[A-Z]") & value.rlike("[a-z]")
        return F.struct(
            at.alias("start"), end.cast("long").alias("end"), F.lit(k).alias("kind"), F.md5(value.cast("binary")).alias("hash"), looks.alias("live"), (end - F.length(value)).cast("long").alias("value_start"), F.length(value).alias("n")
        )

    starts = lambda ps: F.zip_with(prefix_sums(sized_of(ps)), ps, lambda at, x: at + x["gap"])
    all_ = let(pairs, lambda ps: F.zip_with(ps, starts(ps), span))
    if name == "assign":
        all_ = F.filter(all_, lambda s: s["n"] >= 6)
    if name == "opaque":
        all_ = F.filter(all_, lambda s: s["live"])
    test = F.lit(True)
    for i, s in enumerate(NEEDS.get(name, ())):
        test = F.contains(text, F.lit(s)) if i == 0 else test | F.contains(text, F.lit(s))
    return F.when(test & text.rlike(pattern), all_)


def candidates(text: Column) -> Column:
    """Every candidate span of a text by start, then kind; opaque ones only where no other span overlaps them."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,hash:string,live:boolean,value_start:bigint,n:int>>")
    named = F.array_sort(F.concat(*[F.coalesce(_spans(text, k), none) for k in range(len(KINDS))]))
    return F.when(text.rlike("|".join(p for _, p, _ in KINDS)), named).otherwise(none)


def examples(held: DataFrame, owner: str, repo: str, wide_owners: int, wide_repos: int) -> DataFrame:
    """hash of the values that are widely copied: by distinct owners or by distinct repositories. Pairs are made distinct, and
    counted by owner, before hashes meet."""
    each = held.select(F.explode("__spans").alias("s"), F.struct(F.col(owner)).alias("o"), F.struct(F.col(repo)).alias("r"))
    pairs = each.select(F.col("s.hash").alias("hash"), "o", "r").distinct()
    by_owner = pairs.groupBy("hash", "o").agg(F.count(F.lit(1)).alias("n"))
    counts = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))
    return counts.where((F.col("n_owners") >= wide_owners) | (F.col("n_repos") >= wide_repos)).select("hash")


def overlapping(values: Column) -> Column:
    """Sorted spans, those that overlap joined; spans that only touch stay apart."""

    def of(ss: Column) -> Column:
        def cut(ends: Column) -> Column:
            n = F.size(ss)
            heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ss, i)["start"] >= F.get(ends, i - 1)))
            tails = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get(ss, i + 1)["start"] >= F.get(ends, i)))
            return F.zip_with(heads, tails, lambda h, t: F.struct(F.get(ss, h)["start"].alias("start"), F.get(ends, t).alias("end")))

        return let(running_max(F.transform(ss, lambda s: s["end"])), cut)

    return let(values, lambda ss: F.when(F.size(ss) > 0, of(ss)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")))


SHOWN = "array<struct<start:bigint,end:bigint,kind:int,value_start:bigint,status:string>>"


def scan(df: DataFrame, carry: list[str], text: str = "text", owner: str = "source", wide: int = WIDE_OWNERS, out: str = "spans", wide_repos: int = WIDE_REPOS) -> DataFrame:
    """The carried columns and, named by out, spans: (start, end, kind, value_start, status), of every row. status: example,
    live or weak. A repository is a document; documents of equal text are one, so that copies of a leak are no example."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__carried"), F.col(f"`{owner}`").alias("__owner"), F.col(f"`{text}`").alias("__text"), candidates(F.col(f"`{text}`")).alias("__spans"))
    some = F.size("__spans") > 0
    held = held.withColumn("__repo", F.when(some, F.md5(F.coalesce("__text", F.lit("")).cast("binary")))).drop("__text")
    held = cut(held.withColumn("__row", F.monotonically_increasing_id()), "candidates")
    some = held.where(some)
    each = some.select("__row", F.explode("__spans").alias("s")).withColumn("hash", F.col("s.hash"))
    wide_ = examples(some, "__owner", "__repo", wide, wide_repos).withColumn("example", F.lit(True))
    status = F.when(F.col("example"), "example").when(F.col("s.live"), "live").otherwise("weak")
    each = each.join(wide_, "hash", "left").withColumn("status", status)
    shown = each.where((F.col("s.kind") != OPAQUE) | (F.col("status") == "live")).select("__row", "s.start", "s.end", "s.kind", "s.value_start", "status")
    # opaque spans that another span overlaps say nothing new: one that ends behind their start, or starts before their end
    # (two orders, since a frame to the end is made anew for every row)
    places, so_far = ("start", "end", "kind"), (W.unboundedPreceding, W.currentRow)
    named, own = F.col("kind") != OPAQUE, W.partitionBy("__row")
    before = F.max(F.when(named, F.col("end"))).over(own.orderBy(*places).rowsBetween(*so_far))
    after = F.min(F.when(named, F.col("start"))).over(own.orderBy(*[F.desc(c) for c in places]).rowsBetween(*so_far))
    shown = shown.withColumns({"before": before, "after": after})
    alone = named | ~(F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False)))
    rows = shown.where(alone).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "value_start", "status"))).alias("__found"))
    both = held.drop("__spans").join(rows, "__row", "left")
    return both.select(*[F.col("__carried")[c].alias(c) for c in carry], F.coalesce("__found", F.array().cast(SHOWN)).alias(out))


def redact(text: Column, spans: Column) -> Column:
    """The text with the values of all spans but examples replaced by a mark, those that look weak too; overlapping values become one mark. spans by start."""
    values = F.array_sort(F.transform(F.filter(spans, lambda s: s["status"] != "example"), lambda s: F.struct(s["value_start"].alias("start"), s["end"].alias("end"))))

    def of(gone: Column) -> Column:
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda s: s["end"]))
        ends = F.concat(F.transform(gone, lambda s: s["start"]), F.array(F.length(text).cast("long")))
        return cutter(text, lambda cut: F.array_join(F.zip_with(starts, ends, lambda a, b: cut(a, b - a)), MARK))

    # values that touch stay two: only those that overlap become one mark
    return let(overlapping(values), of)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "source"])
    out = scan(docs, ["doc_id"])
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1), s["start"], s["end"])
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] < BASE), name), ",")
    return out.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{NAMES[k]}") for k in range(BASE)],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
        count(lambda s: s["status"] == "live").alias("n_live"),
        count(lambda s: s["status"] == "example").alias("n_example"),
    )


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: values of few owners give way to a mark, examples stay; every document stays. n_chars follows the text."""
    some = F.coalesce(F.col("text"), F.lit("")).rlike("|".join(p for _, p, _ in KINDS))
    spans, changed = spare(docs, "__found"), spare(docs, "__new")
    found = scan(docs.where(some), docs.columns, out=spans)
    found = found.withColumn(changed, redact(F.col("text"), F.col(spans)))
    new = {"text": F.col(changed), "n_chars": F.when(F.col(changed) == F.col("text"), F.col("n_chars")).otherwise(F.length(changed).cast("long"))}
    changed = found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
    return docs.where(~some).unionByName(changed)


def sql(source: str = "documents") -> str:
    quote = lambda s: s.replace("'", "''")
    parts = []
    for k, (name, pattern, group) in enumerate(KINDS):
        p = quote(pattern)
        value = f"regexp_extract(m, '{p}', {group})" if group else "m"
        looks = f"len(list_distinct(string_split(v, ''))) >= {LEAST_KINDS_OF_CHARACTERS} AND regexp_matches(v, '[0-9]')"
        if name == "opaque":
            looks += " AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"
        keep = {"assign": "length(v) >= 6", "opaque": looks}.get(name, "true")
        parts.append(f"""SELECT rid, doc_id, source, {k} AS kind, a, a + length(m) AS b, md5(v) AS h, {looks} AS live FROM (
  SELECT *, {value} AS v FROM (SELECT rid, doc_id, source, ms[i] AS m, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)::BIGINT
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a FROM (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, doc_id, source, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}'))))) WHERE {keep}""")
    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    label = f"{names}[kind + 1] || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM {source}),
c AS ({' UNION ALL '.join(parts)}),
o AS (SELECT h, count(DISTINCT coalesce('s' || c.source, '')) AS owners, count(DISTINCT (coalesce('s' || c.source, ''), md5(t))) AS repos FROM c JOIN d USING (rid) GROUP BY h),
s AS (SELECT c.*, CASE WHEN owners >= {WIDE_OWNERS} OR repos >= {WIDE_REPOS} THEN 'example' WHEN live THEN 'live' ELSE 'weak' END AS status FROM c JOIN o USING (h)),
k AS (SELECT * FROM s WHERE kind <> {OPAQUE} OR (status = 'live' AND NOT EXISTS (SELECT 1 FROM s n WHERE n.rid = s.rid AND n.kind <> {OPAQUE} AND n.a < s.b AND s.a < n.b))),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({label}, ',' ORDER BY a, kind) FILTER (kind < {BASE}) AS base, string_agg({label}, ',' ORDER BY a, kind) AS spans,
  count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'example') AS n_example FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN g USING (rid)"""
