"""Queries of the scorers, of causality and of discovery, and the same in SQL. Real numbers are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import causality, discovery, narrative, scoring
from ..sources.projections import branching_causes, causes, events, micros, node_id, table
from .batch_queries import _CASE, E
from .flow_queries import DAY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MINUTE = 60_000_000


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Millionths, cut off after a shift that keeps equal numbers on one side."""
    return df.withColumns({n: F.floor(F.col(n) * 1_000_000 + 0.5001).cast("bigint") for n in names})


def R(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000 + 0.5001) AS BIGINT)"


def seen(spark: SparkSession, d: str) -> DataFrame:
    """Events as matches: pattern is the type, match_id the event, properties two classes of its numbers, role its k mod 2."""
    r = events(spark, d)
    k = r.labels["k"][1].cast("int")
    props = F.array(F.concat(F.lit("k"), (k % 5).cast("string")), F.when(F.col("value") < 20, "low").when(F.col("value") < 100, "mid").otherwise("high"), F.concat(F.lit("h"), (F.hour(F.col("ts").cast("timestamp")) >= 12).cast("string")))
    return r.df.select(r.source.alias("match_id"), F.col("event_type").alias("pattern"), props.alias("properties"), F.concat(F.lit("r"), (k % 2).cast("string")).alias("role"), node_id("u", "user_id").alias("actor"), micros("ts").alias("t"), F.floor(micros("ts") / DAY).alias("round"))


M = f"""{E}, m AS (SELECT id, y, u, t, t // {DAY} AS d, 'r' || (k::INT % 2) AS role, unnest(['k' || (k::INT % 5), CASE WHEN v < 20 THEN 'low' WHEN v < 100 THEN 'mid' ELSE 'high' END, 'h' || (t // 43200000000 % 2 = 1)]) AS p FROM e),
c AS (SELECT y, p, count(*) AS n FROM m GROUP BY ALL), g AS (SELECT y, count(DISTINCT id) AS n, count(DISTINCT p) AS vocab FROM m GROUP BY y),
f AS (SELECT m.id, m.y, m.p, (c.n + 1) / (g.n + g.vocab) AS f, c.n AS c, g.n AS n FROM m JOIN c ON m.y = c.y AND m.p = c.p JOIN g ON m.y = g.y)"""
BASE = {"signup": 0.5, "view": 0.25, "purchase": 1.0}


@query("shannon_surprise", f"WITH {E}, r AS (SELECT count(DISTINCT t // {DAY}) AS n FROM e) SELECT y AS pattern, count(DISTINCT t // {DAY}) AS n, {R('-log2((count(DISTINCT t // ' + str(DAY) + ') + 1) / (any_value(r.n) + 1) / CASE y WHEN ' + repr('signup') + ' THEN 0.5 WHEN ' + repr('view') + ' THEN 0.25 ELSE 1.0 END::DOUBLE)')} AS surprise FROM e, r WHERE y IN ('signup', 'view', 'purchase') GROUP BY y")
def _(spark, d):
    rounds = seen(spark, d).select("round").distinct().count()
    some = seen(spark, d).where(F.col("pattern").isin(*BASE))
    return rounded(scoring.surprise(some, rounds, BASE), "surprise")


@query("seq_surprise", f"WITH {E}, x AS (SELECT lag(y) OVER (PARTITION BY u ORDER BY t) AS prev, y AS current FROM e), n AS (SELECT prev, current, count(*) AS n FROM x WHERE prev IS NOT NULL GROUP BY ALL) SELECT prev, current, {R('-log2((n + 1) / (sum(n) OVER (PARTITION BY prev) + count(*) OVER (PARTITION BY prev)))')} AS surprise FROM n")
def _(spark, d):
    return rounded(scoring.sequential(scoring.transitions(seen(spark, d), "actor", "t")), "surprise")


for _name, _mode, _agg in (("stu_mean", "mean", "avg(f)"), ("stu_tfidf", "tfidf", "sum(-log2(f))"), ("stu_geo", "geometric", "exp(avg(ln(f)))"), ("stu_min", "min", "min(f)")):
    query(_name, f"WITH {M} SELECT id AS match_id, y AS pattern, {R(_agg)} AS score FROM f GROUP BY id, y")(lambda spark, d, mode=_mode: rounded(scoring.stu(seen(spark, d), mode, attenuated=False), "score"))
query("stu_attenuated", f"WITH {M} SELECT id AS match_id, y AS pattern, {R('1 - (1 - avg(f)) * (1 - 1 / (any_value(n) + 1))')} AS score FROM f GROUP BY id, y")(lambda spark, d: rounded(scoring.stu(seen(spark, d)), "score"))
query("stu_property_frequency", f"WITH {M} SELECT c.y AS pattern, c.p AS property, {R('(c.n + 1) / (g.n + g.vocab)')} AS freq FROM c JOIN g ON c.y = g.y")(lambda spark, d: rounded(scoring.property_table(seen(spark, d)).select("pattern", "property", "freq"), "freq"))
query("stu_pmi_pairs", f"WITH {M}, q AS (SELECT a.y, a.p AS a, b.p AS b, count(*) AS n FROM m a JOIN m b ON a.id = b.id AND a.p < b.p GROUP BY ALL) SELECT q.y AS pattern, q.a, q.b, q.n AS pairs, {R('log2((q.n / g.n) / ((x.n / g.n) * (z.n / g.n)))')} AS pmi FROM q JOIN g ON q.y = g.y JOIN c x ON x.y = q.y AND x.p = q.a JOIN c z ON z.y = q.y AND z.p = q.b")(
    lambda spark, d: rounded(scoring.pmi(seen(spark, d)), "pmi")
)


def tied(spark: SparkSession, d: str) -> DataFrame:
    """seen(), with a finer class of the value, which a level always goes with, in place of k."""
    value = events(spark, d).df.select(node_id("ev", "event_id").alias("match_id"), F.concat(F.lit("b"), F.coalesce(F.floor(F.col("value") / 25), F.lit(0)).cast("string")).alias("fine"))
    return seen(spark, d).join(value, "match_id").withColumn("properties", F.array(F.col("properties")[1], "fine", F.col("properties")[2]))


def _tie(i: int, j: int) -> str:
    """One step of the correction over f1, f2, f3."""
    bound = f"log2((q{i}{j} / n) / ((n{i} / n) * (n{j} / n))) > 1"
    return f"* REPLACE (CASE WHEN {bound} AND f{i} > f{j} THEN least(1, q{i}{j} / n{j}) ELSE f{i} END AS f{i}, CASE WHEN {bound} AND f{i} <= f{j} THEN least(1, q{i}{j} / n{i}) ELSE f{j} END AS f{j})"


T = f"""{E}, w AS (SELECT id, y, CASE WHEN v < 20 THEN 'low' WHEN v < 100 THEN 'mid' ELSE 'high' END AS p1, 'b' || coalesce(floor(v / 25), 0)::BIGINT AS p2, 'h' || (t // 43200000000 % 2 = 1) AS p3 FROM e),
m AS (SELECT id, y, unnest([p1, p2, p3]) AS p FROM w), c AS (SELECT y, p, count(*) AS n FROM m GROUP BY ALL), g AS (SELECT y, count(DISTINCT id) AS n, count(DISTINCT p) AS vocab FROM m GROUP BY y),
q AS (SELECT a.y, a.p AS a, b.p AS b, count(*) AS n FROM m a JOIN m b ON a.id = b.id AND a.p <> b.p GROUP BY ALL),
z AS (SELECT w.id, w.y, g.n, {', '.join(f'c{i}.n AS n{i}, ((c{i}.n + 1) / (g.n + g.vocab))::DOUBLE AS f{i}' for i in (1, 2, 3))}, {', '.join(f'q{i}{j}.n AS q{i}{j}' for i, j in ((1, 2), (1, 3), (2, 3)))} FROM w JOIN g ON g.y = w.y {' '.join(f'JOIN c c{i} ON c{i}.y = w.y AND c{i}.p = w.p{i}' for i in (1, 2, 3))} {' '.join(f'JOIN q q{i}{j} ON q{i}{j}.y = w.y AND q{i}{j}.a = w.p{i} AND q{i}{j}.b = w.p{j}' for i, j in ((1, 2), (1, 3), (2, 3)))}),
z1 AS (SELECT {_tie(1, 2)} FROM z), z2 AS (SELECT {_tie(1, 3)} FROM z1), z3 AS (SELECT {_tie(2, 3)} FROM z2)"""
query("stu_pmi", f"WITH {T} SELECT id AS match_id, y AS pattern, {R('1 - (1 - (f1 + f2 + f3) / 3) * (1 - 1 / (n + 1))')} AS score FROM z3")(lambda spark, d: rounded(scoring.stu_pmi(tied(spark, d)), "score"))
query(
    "stu_role",
    f"WITH {M}, rc AS (SELECT y, role, p, count(*) AS n FROM m GROUP BY ALL), rg AS (SELECT y, role, count(DISTINCT id) AS n, count(DISTINCT p) AS vocab FROM m GROUP BY ALL) SELECT m.id AS match_id, m.y AS pattern, m.role, {R('avg((rc.n + 1) / (rg.n + rg.vocab))')} AS score FROM m JOIN rc ON m.y = rc.y AND m.role = rc.role AND m.p = rc.p JOIN rg ON m.y = rg.y AND m.role = rg.role GROUP BY m.id, m.y, m.role",
)(lambda spark, d: rounded(scoring.stu(seen(spark, d), "mean", ("pattern", "role"), attenuated=False), "score"))


# narrative
P = f"""{E}, n AS (SELECT u, t // {DAY} AS tick, y, count(*) AS n FROM e GROUP BY ALL), tt AS (SELECT u, tick, sum(n) AS total, lag(tick) OVER (PARTITION BY u ORDER BY tick) AS prev FROM n GROUP BY u, tick),
s AS (SELECT n.u, n.tick, n.y, n.n / total AS p, prev FROM n JOIN tt ON n.u = tt.u AND n.tick = tt.tick),
k AS (SELECT u, tick, y, sum(p) AS p, sum(q) AS q FROM (SELECT u, tick, y, 0 AS p, p AS q FROM s UNION ALL SELECT tt.u, tt.tick, s.y, s.p, 0 FROM tt JOIN s ON s.u = tt.u AND s.tick = tt.prev) GROUP BY u, tick, y)"""
for _name, _how, _agg in (
    ("pivot_jsd", "jensen_shannon", "greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END))"),
    ("pivot_kl", "kullback_leibler", "CASE WHEN max(CASE WHEN p > 0 AND q <= 0 THEN 1 ELSE 0 END) = 1 THEN 1000 ELSE greatest(0, sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END)) END"),
    ("pivot_hellinger", "hellinger", "least(1, sqrt(sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q))) / 2))"),
):
    query(_name, f"WITH {P} SELECT k.u AS actor, k.tick, {R('CASE WHEN any_value(tt.prev) IS NULL THEN 0 ELSE ' + _agg + ' END')} AS pivot FROM k JOIN tt ON tt.u = k.u AND tt.tick = k.tick GROUP BY k.u, k.tick")(
        lambda spark, d, how=_how: rounded(narrative.pivots(seen(spark, d).select("actor", F.col("round").alias("tick"), F.col("pattern").alias("kind")), "actor", how).withColumn("pivot", F.least("pivot", F.lit(1000.0))), "pivot")
    )


def samples(spark: SparkSession, d: str) -> DataFrame:
    r = events(spark, d)
    return r.df.select(node_id("u", "user_id").alias("actor"), F.floor(micros("ts") / DAY).alias("tick"), "value").groupBy("actor", "tick").agg((F.sum("value") / 100).alias("value"))


V = f"""{E}, v AS (SELECT u, t // {DAY} AS tick, sum(v) / 100 AS value FROM e GROUP BY ALL), w AS (SELECT u, tick, value, list(value) OVER z AS vs, regr_slope(value, tick) OVER z AS m FROM v WINDOW z AS (PARTITION BY u ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, len(vs) AS n, len(vs) // 2 AS half, CASE WHEN len(vs) < 2 THEN 0 ELSE m END AS slope FROM w), x AS (SELECT *, list_avg(vs[1:half]) AS a, list_avg(vs[half + 1:]) AS b, vs[half + 1] AS mid FROM h),
y AS (SELECT u, tick, value, slope, CASE WHEN n < 3 THEN 'unknown' WHEN mid > a AND mid > b AND abs(a - b) < 0.1 THEN 'peak' WHEN mid < a AND mid < b AND abs(a - b) < 0.1 THEN 'valley' WHEN slope > 0.01 THEN 'rising' WHEN slope < -0.01 THEN 'falling' ELSE 'plateau' END AS trajectory FROM x)"""
query("tension_slope", f"WITH {V} SELECT u AS actor, tick, {R('slope')} AS slope FROM y")(lambda spark, d: rounded(narrative.tension(samples(spark, d), "actor", 5).select("actor", "tick", "slope"), "slope"))
query("tension_trajectory", f"WITH {V} SELECT u AS actor, trajectory, count(*) AS n FROM y GROUP BY ALL")(lambda spark, d: narrative.tension(samples(spark, d), "actor", 5).groupBy("actor", "trajectory").agg(F.count(F.lit(1)).alias("n")))


def day_rows(spark: SparkSession, d: str) -> DataFrame:
    """A tick a user and day: clicks advance, purchases complete, errors stall; a signup without a purchase is an open plant."""
    names = lambda kind, pre: F.collect_list(F.when(F.col("pattern") == kind, F.concat(F.lit(pre), F.col("role"))))
    n = lambda kind: F.count(F.when(F.col("pattern") == kind, 1))
    rows = seen(spark, d).groupBy("actor", F.col("round").alias("tick")).agg(
        names("click", "a_").alias("advanced"), names("purchase", "c_").alias("completed"), names("error", "s_").alias("stalled"), n("signup").alias("signups"), n("purchase").alias("bought")
    )
    plants = F.array(F.struct(F.lit("p").alias("name"), F.lit("c_r1").alias("payoff"), F.col("signups").alias("active_plants"), F.col("bought").alias("payoffs")))
    return rows.withColumns({"plants": plants, "filo_violations": F.lit(0), "trajectory": F.lit("rising"), "desired": F.when(F.col("signups") > 0, "rising").otherwise("falling"), "pivot_magnitude": F.lit(0.25), "surprise": F.col("signups") * 0.5, "sequential_surprise": F.lit(0.0)})


N = f"""{E}, z AS (SELECT u, t // {DAY} AS tick, count(*) FILTER (y = 'click') AS adv, count(*) FILTER (y = 'click' AND k::INT % 2 = 1) AS adv1, count(*) FILTER (y = 'purchase') AS comp, count(*) FILTER (y = 'purchase' AND k::INT % 2 = 1) AS res, count(*) FILTER (y = 'error') AS st, count(*) FILTER (y = 'signup') AS su FROM e GROUP BY ALL)"""
REST = "- 2 * st - 0.5 * (CASE WHEN su > 0 AND comp = 0 THEN 1 ELSE 0 END) + 2 * (CASE WHEN su > 0 THEN 1 ELSE -1 END) + 1.5 * 0.25 + 0.5 * su"
query("narrative_score", f"WITH {N} SELECT u AS actor, tick, {R('adv + 3 * comp + 5 * res ' + REST)} AS total FROM z")(lambda spark, d: rounded(narrative.narrative_score(narrative.signals(day_rows(spark, d))).select("actor", "tick", "total"), "total"))
query("narrative_score_weighted", f"WITH {N} SELECT u AS actor, tick, {R('2 * ((adv - adv1) + 3.0 * adv1 + 3 * ((comp - res) + 0.5 * res) + 5 * (0.5 * res) ' + REST + ')')} AS total FROM z")(
    lambda spark, d: rounded(narrative.narrative_score(narrative.weighted_signals(day_rows(spark, d), {"a_r1": 3.0, "c_r1": 0.5}), time_scale=2.0).select("actor", "tick", "total"), "total")
)


def thread_violations(spark: SparkSession, d: str) -> DataFrame:
    """Threads of a user's kinds: opened by the first event of a kind, closed by an error after it."""
    rows = seen(spark, d).select("actor", "pattern", "t")
    last = F.last(F.when(F.col("pattern") != "error", F.col("pattern")), True).over(W.partitionBy("actor").orderBy("t"))
    closed = rows.withColumn("thread", last).where("pattern = 'error' AND thread IS NOT NULL")
    return narrative.violations(rows.where("pattern <> 'error'").withColumnRenamed("pattern", "thread"), closed, "actor")


F_ = f"""{N}, o AS (SELECT u, y, min(t) AS t FROM e WHERE y <> 'error' GROUP BY ALL), l AS (SELECT u, y, last_value(CASE WHEN y <> 'error' THEN y END IGNORE NULLS) OVER (PARTITION BY u ORDER BY t) AS x FROM e),
cl AS (SELECT DISTINCT u, x AS y FROM l WHERE y = 'error' AND x IS NOT NULL), vi AS (SELECT a.u, a.y AS closed, b.y AS blocking FROM o a JOIN cl ON cl.u = a.u AND cl.y = a.y JOIN o b ON b.u = a.u AND b.t > a.t WHERE NOT EXISTS (SELECT 1 FROM cl k WHERE k.u = b.u AND k.y = b.y))"""
query("filo_violations", f"WITH {F_} SELECT u AS actor, closed, blocking FROM vi")(thread_violations)


@query(
    "narrative_significance",
    f"WITH {F_}, vs AS (SELECT u, sum(CASE WHEN closed = 'view' THEN 4 WHEN closed = 'click' THEN 0.25 ELSE 1 END) AS w FROM vi GROUP BY u) SELECT z.u AS actor, tick, {R('(adv - adv1) + 3.0 * adv1 + 3 * comp + 5 * res - 3 * coalesce(vs.w, 0) ' + REST)} AS total FROM z LEFT JOIN vs ON vs.u = z.u",
)
def _(spark, d):
    of = thread_violations(spark, d).groupBy("actor").agg(F.collect_list("closed").alias("violations"))
    rows = day_rows(spark, d).drop("filo_violations").join(of, "actor", "left").withColumn("violations", F.coalesce("violations", F.array().cast("array<string>")))
    return rounded(narrative.narrative_score(narrative.significant_signals(rows, {"a_r1": 3.0}, {"view": 4.0, "click": 0.25})).select("actor", "tick", "total"), "total")


query("pivot_average", f"WITH {P}, pv AS (SELECT k.u, k.tick, CASE WHEN any_value(tt.prev) IS NULL THEN 0 ELSE least(1, sqrt(sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q))) / 2)) END AS x FROM k JOIN tt ON tt.u = k.u AND tt.tick = k.tick GROUP BY k.u, k.tick) SELECT u AS actor, tick, {R('avg(x) OVER (PARTITION BY u ORDER BY tick ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS average FROM pv")(
    lambda spark, d: rounded(narrative.average_pivot(narrative.pivots(seen(spark, d).select("actor", F.col("round").alias("tick"), F.col("pattern").alias("kind")), "actor", "hellinger"), "actor", 4).select("actor", "tick", "average"), "average")
)


# causality: the effects are purchases over 100
def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    effects = table(spark, d, "events").where("event_type = 'purchase' AND value > 100").select(node_id("ev", "event_id").alias("effect"))
    return causality.scored(causality.causal_paths(causes(spark, d), effects, {"causes": 0.9}, 3), MINUTE), effects


K = f"""{E}, x AS (SELECT *, lag(id, 1) OVER w AS i1, lag(id, 2) OVER w AS i2, lag(id, 3) OVER w AS i3, lag(t, 1) OVER w AS t1, lag(t, 2) OVER w AS t2, lag(t, 3) OVER w AS t3 FROM e WINDOW w AS (PARTITION BY u ORDER BY t)),
h AS (SELECT id AS effect, 1 AS hops, i1 || '>' || id AS path, 0 AS gap FROM x WHERE y = 'purchase' AND v > 100 AND i1 IS NOT NULL UNION ALL SELECT id, 2, i2 || '>' || i1 || '>' || id, t1 - t2 FROM x WHERE y = 'purchase' AND v > 100 AND i2 IS NOT NULL
 UNION ALL SELECT id, 3, i3 || '>' || i2 || '>' || i1 || '>' || id, t1 - t3 FROM x WHERE y = 'purchase' AND v > 100 AND i3 IS NOT NULL), c AS (SELECT *, 0.9 * (1 - 0.5 * (1 - exp(-(gap / {MINUTE}) / 50))) AS clean FROM h)"""


@query("causal_paths", f"WITH {K} SELECT effect, path, gap::BIGINT AS total_gap FROM c")
def _(spark, d):
    return _paths(spark, d)[0].select("effect", F.array_join("nodes", ">").alias("path"), "total_gap")


@query("cleanliness", f"WITH {K} SELECT effect, hops::INT AS hops, {R('clean')} AS cleanliness FROM c")
def _(spark, d):
    return rounded(_paths(spark, d)[0].select("effect", F.size("times").alias("hops"), "cleanliness"), "cleanliness")


@query("causal_best", f"WITH {K} SELECT path, {R('clean')} AS cleanliness FROM c ORDER BY clean DESC, string_split(path, '>') LIMIT 20")
def _(spark, d):
    return rounded(causality.ranked(_paths(spark, d)[0]).limit(20).select(F.array_join("nodes", ">").alias("path"), "cleanliness"), "cleanliness")


@query("causal_surprise", f"WITH {K} SELECT e.id AS effect, {R('1 - coalesce(max(clean), 0)')} AS surprise FROM e LEFT JOIN c ON c.effect = e.id WHERE e.y = 'purchase' AND e.v > 100 GROUP BY e.id")
def _(spark, d):
    return rounded(causality.causal_surprise(*_paths(spark, d)), "surprise")


# two causes: the user's last event, and the user's last one of the same type
B = f"""{E}, b AS (SELECT id AS node, lag(id) OVER z AS cause, lag(t) OVER z AS t, 0.9 AS w FROM e WINDOW z AS (PARTITION BY u ORDER BY t, event_id) UNION ALL SELECT id, lag(id) OVER z, lag(t) OVER z, 0.6 FROM e WINDOW z AS (PARTITION BY u, y ORDER BY t, event_id)),
cs AS (SELECT * FROM b WHERE cause IS NOT NULL), br AS (SELECT node, count(*) AS n FROM cs GROUP BY node),
h1 AS (SELECT e.id AS effect, cs.cause, cs.t, cs.w, br.n - 1 AS dv FROM e JOIN cs ON cs.node = e.id JOIN br ON br.node = e.id WHERE e.y = 'purchase' AND e.v > 100),
bp AS (SELECT effect, cause || '>' || effect AS path, dv, w AS conf, w AS mean, 0 AS gap FROM h1 UNION ALL SELECT h1.effect, cs.cause || '>' || h1.cause || '>' || h1.effect, dv + br.n - 1, least(h1.w, cs.w), (h1.w + cs.w) / 2, h1.t - cs.t FROM h1 JOIN cs ON cs.node = h1.cause AND cs.t < h1.t JOIN br ON br.node = h1.cause)"""


@query("causal_branches", f"WITH {B} SELECT effect, path, dv::BIGINT AS divergence, {R('conf')} AS confidence, {R(f'mean * (1 - 0.5 * (1 - exp(-(gap / {MINUTE}) / 50))) / (1 + dv)')} AS cleanliness FROM bp")
def _(spark, d):
    effects = table(spark, d, "events").where("event_type = 'purchase' AND value > 100").select(node_id("ev", "event_id").alias("effect"))
    paths = causality.scored(causality.causal_paths(branching_causes(spark, d), effects, {"causes": 0.9, "repeats": 0.6}, 2), MINUTE)
    return rounded(paths.select("effect", F.array_join("nodes", ">").alias("path"), "divergence", "confidence", "cleanliness"), "confidence", "cleanliness")


# discovery: a trace of visits, actor to a page, over whole hours
def trace(spark: SparkSession, d: str) -> discovery.Trace:
    r = events(spark, d)
    k = r.labels["k"][1].cast("int")
    hour = F.floor(micros("ts") / 3_600_000_000)
    return discovery.Trace(r.df.select(node_id("u", "user_id").alias("source"), F.col("event_type").alias("label"), F.concat(F.lit("g"), F.col("user_id").cast("string"), F.lit("_"), (k % 50).cast("string")).alias("target"), hour.alias("start_t"), (hour + 1 + k % 5).alias("end_t")))


X = f"""{E}, t AS (SELECT u AS source, y AS label, 'g' || substr(u, 2) || '_' || (k::INT % 50) AS target, t // 3600000000 AS a, t // 3600000000 + 1 + k::INT % 5 AS b FROM e)"""
HIT = f"h AS (SELECT p.label AS label_a, q.label AS label_b, {_CASE} AS relation, CASE WHEN p.source = q.source THEN 0 ELSE 3 END AS shared FROM t p JOIN t q ON p.label <> q.label AND p.source = q.source)"


@query("label_pairs", f"WITH {X} SELECT a.label AS label_a, b.label AS label_b FROM (SELECT DISTINCT label FROM t) a, (SELECT DISTINCT label FROM t) b WHERE a.label <> b.label")
def _(spark, d):
    return trace(spark, d).label_pairs()


@query("pairwise_relations", f"WITH {X}, {HIT} SELECT label_a, label_b, relation, shared, count(*) AS n FROM h WHERE relation IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return discovery.pairwise_relations(trace(spark, d).df).groupBy("label_a", "label_b", "relation", "shared").agg(F.count(F.lit(1)).alias("n"))


@query("pair_candidates", f"WITH {X}, {HIT}, r AS (SELECT label_a, label_b, relation, count(*) AS n FROM h WHERE relation IS NOT NULL GROUP BY ALL), z AS (SELECT *, sum(n) OVER (PARTITION BY label_a, label_b) AS pairs FROM r) SELECT label_a, label_b, relation, n, pairs::BIGINT AS pairs, {R('n * n / pairs')} AS interest FROM z WHERE pairs / (SELECT count(*) FROM t) >= 0.1 AND n / pairs >= 0.4")
def _(spark, d):
    return rounded(discovery.candidates(trace(spark, d).df, confidence=0.4).select("label_a", "label_b", "relation", "n", "pairs", "interest"), "interest")


@query("surprise_eval", f"WITH {X}, c AS (SELECT count(*) AS n, count(*) FILTER (label = 'signup') AS a, count(*) FILTER (label = 'purchase') AS b FROM t), s AS (SELECT count(*) AS k FROM t p WHERE label = 'signup' AND EXISTS (SELECT 1 FROM t q WHERE q.label = 'purchase' AND q.source = p.source)) SELECT {R('(k / n) / ((a / n) * (b / n)) * -(ln(a / n) + ln(b / n)) / 2')} AS score FROM c, s")
def _(spark, d):
    return rounded(discovery.label_surprise(trace(spark, d).df, ["signup", "purchase"]), "score")


@query("match_quality_eval", f"WITH {X}, m AS (SELECT count(*) AS k FROM t p JOIN t q ON p.source = q.source WHERE p.label = 'signup' AND q.label = 'purchase' AND p.a < q.a), c AS (SELECT count(*) AS n FROM t) SELECT k AS matches, {R('(CASE WHEN k / n > 0.5 THEN 0.5 / (k / n) ELSE greatest(ln(k), 0) END) * 3')} AS score FROM m, c")
def _(spark, d):
    from types import SimpleNamespace

    from .batch import find

    tr = trace(spark, d)
    p = discovery.build(SimpleNamespace(shared=0, label_a="signup", label_b="purchase", relation="before"), 0)
    found = find(tr.graph(), p).count()
    return rounded(spark.createDataFrame([(found, float(discovery.quality(found, tr.size(), p)))], "matches long, score double"), "score")


@query("corpus_time_range", f"WITH {X} SELECT min(a) AS lo, max(b) AS hi FROM t")
def _(spark, d):
    return trace(spark, d).time_range()


@query("corpus_split", f"WITH {X} SELECT count(*) FILTER (a < 473700) AS before, count(*) FILTER (a >= 473700) AS after FROM t")
def _(spark, d):
    a, b = trace(spark, d).split_at(473_700)
    n = lambda t, name: t.df.agg(F.count(F.lit(1)).alias(name))
    return n(a, "before").join(n(b, "after"))
