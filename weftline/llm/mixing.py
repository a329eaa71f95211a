"""Mixing sources to target weights.

Words are summed by source; weights give targets; target / size is a source's repetition rate. Each document is emitted
floor(rate) times, plus one hash-seeded Bernoulli copy whose probability is the fraction. The draws of a source are those of
systematic sampling: its documents in order of size and hash, a start drawn from the source's hash. Every document has the
fraction as its probability, as with independent draws, but a source's words miss its target by one document's at most.
Documents of one size are exchangeable, so that a (source, size) needs only how many of it are drawn: those of the smallest
hashes, up to a threshold. Counts are summed before they are shuffled; hashes are ranked within 256 parts of each group.

Defined results: a null or empty text has size 0 and no words to take; null is a source, the last one; documents with
equal id and text share their draw; sources without words have target 0 and rate 0; an empty table gives no rows; other
columns are carried through, and those of mix_plan take the place of columns of the same name. One row a source goes
through windows in one task, which sort and sum with spill; so do the sizes of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS_SQL, cut, spare, table, words

WEIGHTS = (5, 2, 1)
MOST = 3
#: Most groups of a source and a size whose thresholds are broadcast; more are joined.
MOST_BROADCAST = 200_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target from rows of (source, size).

    A source is held at most * its size where the common level (words per weight) would exceed that. The level follows from
    sources in order of most * size / weight: it is the first at which the sources before it are held and it is not. One row
    a source goes through the windows here, after the sums."""
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank + 1).cast("int")))
    whole = W.partitionBy()
    held = W.orderBy((most * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = held.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # whole numbers decide which sources are held: left * weight <= most * size * open_weight
    free = left * F.col("weight") <= most * F.col("source_size") * open_weight
    by = by.withColumns({"left": left, "open": open_weight, "free": free, "at": F.row_number().over(held)})
    first = F.min(F.when(F.col("free"), F.struct("at", "left", "open"))).over(whole)
    by = by.withColumn("first", first)
    level = F.when(F.col("at") >= F.col("first.at"), F.col("first.left").cast("double") * F.col("weight") / F.col("first.open"))
    return by.select("source", "source_size", "weight", F.coalesce(level, (most * F.col("source_size")).cast("double")).alias("target"))


def uniform(x: Column) -> Column:
    """A number in [0, 1) of a string's hash."""
    return F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 8), 16, 10).cast("double") / float(2**32)


def start_of(source: Column) -> Column:
    return uniform(F.concat(F.lit("mix:"), F.coalesce(F.concat(F.lit("s"), source), F.lit(""))))


def _draw(doc_id: Column, text_md5: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_md5).cast("binary"), 256)


def thresholds(facts: DataFrame, rates: DataFrame) -> DataFrame:
    """source, size, upto: of the documents of a source and size those are drawn whose draw is at most upto; from rows of
    (source, size, draw) and of (source, rate)."""
    units = facts.distinct().withColumn("bucket", F.substring("draw", 1, 2))
    counts = cut(units.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0))).withColumnRenamed("source", "__of").join(rates.select("source", "rate"), F.col("__of").eqNullSafe(F.col("source")))
    part, at = F.col("rate") - F.floor("rate"), start_of(F.col("source"))
    reached = lambda k: F.floor(k * part + at)
    drawn = sizes.select("source", "size", (reached(F.col("before") + F.col("n")) - reached(F.col("before"))).alias("m")).where("m > 0")
    # the bucket of the m-th smallest draw, and its place there
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    order = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    spot = counts.join(drawn, same(counts, drawn)).where((F.col("before") < F.col("m")) & (F.col("m") <= F.col("before") + F.col("n")))
    spot = cut(spot.select(counts["source"], counts["size"], "bucket", (F.col("m") - F.col("before")).alias("place")), "spots")
    ranked = units.join(spot, same(units, spot) & (units["bucket"] == spot["bucket"])).select(units["source"], units["size"], units["bucket"], "draw", "place")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("draw")))
    return ranked.where("rank = place").select("source", "size", F.col("draw").alias("upto"))


def _planned(df: DataFrame, weights: tuple[int, ...], most: int, name: str) -> DataFrame:
    """df with one more column, a struct of size, source_size, target, rate and copies, under a name that df doesn't have."""
    size = F.size(words(F.col("text"))).cast("long").alias("size")
    draw = _draw(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("draw")
    of = F.col("source").alias("source")
    facts = cut(df.select(of, size, draw), "sizes")
    size_of = F.col("source_size").cast("double")
    rates = source_targets(facts, weights, most)
    rates = cut(rates.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / size_of)).otherwise(0.0)), "rates")
    upto = cut(thresholds(facts, rates), "thresholds")
    plan = upto.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("size", "upto"))).alias("upto")) if upto.count() <= MOST_BROADCAST else None
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), of, size, draw)
    if plan is not None:  # so few sizes a source that all thresholds go along with its rate
        both = rates.withColumnRenamed("source", "__of").join(plan, F.col("__of").eqNullSafe(F.col("source")), "left").drop("source")
        held = held.join(F.broadcast(both), F.col("source").eqNullSafe(F.col("__of"))).withColumn("upto", F.col("upto")[F.col("size")])
    else:
        upto = upto.withColumnsRenamed({"source": "__of", "size": "__size"})
        held = held.join(upto, F.col("source").eqNullSafe(F.col("__of")) & (F.col("size") == F.col("__size")), "left").drop("__of", "__size")
        held = held.join(rates.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of")))
    more = F.when(F.col("draw") <= F.col("upto"), 1).otherwise(0)
    mix = F.struct("size", "source_size", "target", "rate", (F.floor("rate").cast("long") + more).alias("copies"))
    return held.select(*[F.col("row")[c].alias(c) for c in df.columns], mix.alias(name))


def mix_plan(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """df with size, source_size, target, rate and copies."""
    new = ["size", "source_size", "target", "rate", "copies"]
    name = spare(df, "mix")
    out = _planned(df, weights, most, name)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[F.col(name)[c].alias(c) for c in new])


def emit(planned: DataFrame) -> DataFrame:
    """Every document as often as its copies say."""
    return planned.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix_plan(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents, repeated or left out as the mix says."""
    name = spare(docs, "mix")
    out = _planned(docs, WEIGHTS, MOST, name).where(F.col(name)["copies"] > 0)
    out = out.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def sql(source: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, sha256(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS h,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS_SQL}'), lambda x: x <> ''))::BIGINT AS size FROM {source}),
s0 AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
s1 AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::BIGINT AS w FROM s0),
s2 AS (SELECT *, row_number() OVER o AS pos,
  ((sum(n) OVER ()) - {MOST} * coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
  ((sum(w) OVER ()) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS opn
  FROM s1 WINDOW o AS (ORDER BY {MOST} * n / w, source NULLS LAST)),
f AS (SELECT pos, lft, opn FROM s2 WHERE lft * w <= {MOST} * n * opn ORDER BY pos LIMIT 1),
s3 AS (SELECT source, n, CASE WHEN s2.pos >= f.pos THEN f.lft::DOUBLE * w / f.opn ELSE ({MOST} * n)::DOUBLE END AS target FROM s2, f),
s4 AS (SELECT *, CASE WHEN n > 0 THEN least({MOST}.0::DOUBLE, target / n::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM s3),
s5 AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part, ('0x' || substr(sha256('mix:' || coalesce('s' || source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS st FROM s4),
u AS (SELECT DISTINCT source, size, h FROM d),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b4 FROM (SELECT source, size, count(*) AS n FROM u GROUP BY ALL)),
m AS (SELECT c.source, size, floor((b4 + c.n)::DOUBLE * part + st) - floor(b4::DOUBLE * part + st) AS m FROM c JOIN s5 ON c.source IS NOT DISTINCT FROM s5.source),
r AS (SELECT u.*, row_number() OVER (PARTITION BY source, size ORDER BY h) AS pos FROM u),
k AS (SELECT r.source, r.size, r.h, CASE WHEN pos <= m THEN 1 ELSE 0 END AS more FROM r JOIN m ON r.source IS NOT DISTINCT FROM m.source AND r.size = m.size),
x AS (SELECT d.doc_id, d.size, s5.n, s5.target, whole + more AS copies FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.size = k.size AND d.h = k.h)
SELECT doc_id, size, n AS source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM x"""
