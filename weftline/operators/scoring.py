"""How surprising matches are: by frequency, by sequence, and by their properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of mutual information over which two properties count as one.
PMI_BITS = 1.0


def surprise(seen: DataFrame, rounds: int | Column, baselines: dict[str, float], each_round_once: bool = True) -> DataFrame:
    """pattern, surprise: -log2 of the smoothed rate over the baseline; seen has rows of pattern and round."""
    for name, b in baselines.items():
        if not 0 < b <= 1:
            raise ValueError(f"the baseline of {name} is not within (0, 1]")
    count = F.count_distinct("round") if each_round_once else F.count(F.lit(1))
    base = F.create_map(*[x for k, v in baselines.items() for x in (F.lit(k), F.lit(float(v)))])
    by = seen.groupBy("pattern").agg(count.alias("n")).withColumn("baseline", base[F.col("pattern")])
    n = rounds if isinstance(rounds, Column) else F.lit(rounds)
    return by.select("pattern", "n", F.when(F.col("baseline").isNotNull(), -F.log2((F.col("n") + 1) / (n + 1) / F.col("baseline"))).alias("surprise"))


def transitions(ordered: DataFrame, key: str, time: str) -> DataFrame:
    """prev, current counts of consecutive patterns of each key."""
    prev = F.lag("pattern").over(W.partitionBy(key).orderBy(time))
    return ordered.withColumn("prev", prev).where("prev IS NOT NULL").groupBy("prev", F.col("pattern").alias("current")).agg(F.count(F.lit(1)).alias("n"))


def sequential(counts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """prev, current, surprise: -log2((n + 1) / (total + successors)); 0 where prev was never followed."""
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("successors"))
    asked = counts.select("prev", "current") if asked is None else asked.select("prev", "current")
    rows = asked.join(counts, ["prev", "current"], "left").join(totals, "prev", "left")
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("successors"))
    return rows.select("prev", "current", F.when(F.col("total").isNull(), 0.0).otherwise(-F.log2(p)).alias("surprise"))


def property_table(matches: DataFrame, keys: tuple[str, ...] = ("pattern",)) -> DataFrame:
    """Per key and property: count, matches, vocabulary, freq = (count + 1) / (matches + vocabulary). A match's repeated property counts once."""
    total = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    counts = matches.select(*keys, F.explode(F.array_distinct("properties")).alias("property")).groupBy(*keys, "property").agg(F.count(F.lit(1)).alias("count"))
    vocabulary = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("vocabulary"))
    return counts.join(total, list(keys)).join(vocabulary, list(keys)).withColumn("freq", (F.col("count") + 1) / (F.col("matches") + F.col("vocabulary")))


MODES = {
    "mean": lambda f: F.avg(f),
    "tfidf": lambda f: F.sum(-F.log2(f)),
    "geometric": lambda f: F.exp(F.avg(F.log(f))),
    "min": lambda f: F.min(f),
}


def attenuate(score: Column, matches: Column, mode: str) -> Column:
    """Towards "not surprising" while matches are few."""
    confidence = 1 - 1 / (matches + 1)
    return score * confidence if mode == "tfidf" else 1 - (1 - score) * confidence


def stu(matches: DataFrame, mode: str = "mean", keys: tuple[str, ...] = ("pattern",), attenuated: bool = True, table: DataFrame | None = None) -> DataFrame:
    """match_id, keys, score of each match by the frequencies of its properties; 1 without properties or without a table."""
    table = property_table(matches, keys) if table is None else table
    sizes = table.select(*keys, "matches", "vocabulary").distinct()
    each = matches.select("match_id", *keys, F.explode_outer(F.array_distinct("properties")).alias("property"))
    rows = each.join(sizes, list(keys), "left").join(table.select(*keys, "property", "count"), [*keys, "property"], "left")
    freq = F.when(F.col("property").isNotNull(), (F.coalesce("count", F.lit(0)) + 1) / (F.col("matches") + F.col("vocabulary")))
    out = rows.groupBy("match_id", *keys).agg(MODES[mode](freq).alias("raw"), F.max("matches").alias("matches"))
    score = attenuate(F.col("raw"), F.col("matches"), mode) if attenuated else F.col("raw")
    return out.select("match_id", *keys, F.coalesce(score, F.lit(1.0)).alias("score"))


def pair_table(matches: DataFrame) -> DataFrame:
    """pattern, a, b, pairs: how often two properties (a < b) stand in one match; pairs are made within a match's own list."""
    p = F.array_sort(F.array_distinct("properties"))
    pairs = F.flatten(F.transform(p, lambda a, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return matches.select("pattern", F.explode(pairs).alias("x")).groupBy("pattern", "x.a", "x.b").agg(F.count(F.lit(1)).alias("pairs"))


def pmi(matches: DataFrame) -> DataFrame:
    """pattern, a, b, pmi in bits."""
    t = property_table(matches).select("pattern", "property", "count", "matches")
    a = t.select("pattern", F.col("property").alias("a"), F.col("count").alias("na"), "matches")
    b = t.select("pattern", F.col("property").alias("b"), F.col("count").alias("nb"))
    rows = pair_table(matches).join(a, ["pattern", "a"]).join(b, ["pattern", "b"])
    n = F.col("matches").cast("double")
    return rows.select("pattern", "a", "b", "pairs", F.log2((F.col("pairs") / n) / ((F.col("na") / n) * (F.col("nb") / n))).alias("pmi"))


def corrected(freqs: list[float], counts: list[int], pairs: dict[tuple[int, int], int], n: int) -> list[float]:
    """Frequencies, in order, where of two closely tied properties the commoner one takes its frequency given the other."""
    import math

    out = list(freqs)
    for i in range(len(out)):
        for j in range(i + 1, len(out)):
            both = pairs.get((i, j), 0)
            if not both or not counts[i] or not counts[j] or math.log2((both / n) / ((counts[i] / n) * (counts[j] / n))) <= PMI_BITS:
                continue
            high, low = (i, j) if out[i] > out[j] else (j, i)
            out[high] = min(1.0, both / counts[low])
    return out


def correct_ties(freqs: Column, ties: Column, n: Column) -> Column:
    """Frequencies (i, freq) after the correction: of two closely tied properties the commoner one takes its frequency given
    the other. ties: (i, j, pairs, ni, nj) in the order of i and j; each step sees the last one's result."""

    def step(now: Column, t: Column) -> Column:
        of = lambda i: F.filter(now, lambda x: x["i"] == i)[0]["freq"]
        bound = F.log2((t["pairs"] / n) / ((t["ni"] / n) * (t["nj"] / n))) > PMI_BITS
        first = of(t["i"]) > of(t["j"])
        high = F.when(first, t["i"]).otherwise(t["j"])
        given = F.least(F.lit(1.0), t["pairs"] / F.when(first, t["nj"]).otherwise(t["ni"]))
        return F.transform(now, lambda x: F.struct(x["i"].alias("i"), F.when(bound & (x["i"] == high), given).otherwise(x["freq"]).alias("freq")))

    return F.aggregate(ties, freqs, step)


def stu_pmi(matches: DataFrame) -> DataFrame:
    """match_id, pattern, score: mean frequency after the correction of tied properties, in the order of a match's list."""
    t = property_table(matches)
    each = matches.select("match_id", "pattern", F.posexplode(F.array_distinct("properties")).alias("i", "property"))
    known = each.join(t.select("pattern", "property", "count", "matches", "freq"), ["pattern", "property"])
    x = known.select("match_id", "pattern", "i", F.col("property").alias("p"), F.col("count").alias("ni"))
    y = known.select("match_id", "pattern", F.col("i").alias("j"), F.col("property").alias("q"), F.col("count").alias("nj"))
    tied = x.join(y, ["match_id", "pattern"]).where("i < j").withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q")}).join(pair_table(matches), ["pattern", "a", "b"])
    ties = tied.groupBy("match_id", "pattern").agg(F.array_sort(F.collect_list(F.struct("i", "j", "pairs", "ni", "nj"))).alias("t"))
    lists = known.groupBy("match_id", "pattern").agg(F.array_sort(F.collect_list(F.struct("i", "freq"))).alias("f"), F.max("matches").alias("n")).join(ties, ["match_id", "pattern"], "left")
    got = F.when(F.col("t").isNull(), F.col("f")).otherwise(correct_ties(F.col("f"), F.col("t"), F.col("n").cast("double")))
    raw = F.aggregate(got, F.lit(0.0), lambda a, v: a + v["freq"]) / F.size("f")
    return lists.select("match_id", "pattern", attenuate(raw, F.col("n"), "mean").alias("score"))
