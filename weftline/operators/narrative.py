"""Narrative measures over ticks: tension, turns, threads, and one score of them all."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_WINDOW = 3
THRESHOLD = 0.01


def tension(samples: DataFrame, key: str, window: int, threshold: float = THRESHOLD) -> DataFrame:
    """key, tick, value, slope, trajectory over the last samples of each key (rows of key, tick, value).

    The slope is that of least squares. A peak or a valley is a middle sample above or below the means of both halves, which
    differ by less than ten thresholds; else the slope decides between rising, falling and plateau; unknown under three."""
    window = max(LEAST_WINDOW, window)
    w = W.partitionBy(key).orderBy("tick").rowsBetween(-(window - 1), 0)
    rows = samples.withColumn("s", F.collect_list(F.struct("tick", "value")).over(w))
    values = F.transform("s", lambda x: x["value"])
    n = F.size("s")
    half = F.floor(n / 2).cast("int")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    mean = lambda xs: F.try_divide(total(xs), F.size(xs))
    rows = rows.withColumns({"slope": F.coalesce(_slope(F.col("s")), F.lit(0.0)), "a": mean(F.slice(values, F.lit(1), half)), "b": mean(F.slice(values, half + 1, n)), "mid": F.get(values, half)})
    near = F.abs(F.col("a") - F.col("b")) < threshold * 10
    kind = (
        F.when(n < LEAST_WINDOW, "unknown")
        .when((F.col("mid") > F.col("a")) & (F.col("mid") > F.col("b")) & near, "peak")
        .when((F.col("mid") < F.col("a")) & (F.col("mid") < F.col("b")) & near, "valley")
        .when(F.col("slope") > threshold, "rising")
        .when(F.col("slope") < -threshold, "falling")
        .otherwise("plateau")
    )
    return rows.select(key, "tick", "value", "slope", kind.alias("trajectory"))


def _slope(s: Column) -> Column:
    """The least-squares slope of value by tick, by running means and moments in the order and with the roundings of SQL's
    regr_slope: a slope at a threshold falls on the same side of it."""

    def step(a: Column, e: Column) -> Column:
        x, y = e["tick"].cast("double"), e["value"].cast("double")
        n = a["n"] + 1
        dx = x - a["x"]
        my = a["y"] + (y - a["y"]) / n
        mx = a["x"] + dx / n
        return F.struct(n.alias("n"), mx.alias("x"), my.alias("y"), (a["xy"] + dx * (y - my)).alias("xy"), (a["xx"] + (x - mx) * dx).alias("xx"))

    start = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xy", "xx")])
    return F.aggregate(s, start, step, lambda a: F.try_divide(a["xy"] / a["n"], a["xx"] / a["n"]))


def _jensen_shannon(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.sum(part(p) + part(q)))


def _kullback_leibler(p: Column, q: Column) -> Column:
    return F.greatest(F.lit(0.0), F.sum(F.when(p <= 0, 0.0).when(q <= 0, float("inf")).otherwise(p * F.log2(p / q))))


def _hellinger(p: Column, q: Column) -> Column:
    d = F.sqrt(p) - F.sqrt(q)
    return F.least(F.lit(1.0), F.sqrt(F.sum(d * d) / 2))


#: Aggregates over the rows of two distributions, p the earlier one.
DISTANCES = {"jensen_shannon": _jensen_shannon, "kullback_leibler": _kullback_leibler, "hellinger": _hellinger}


def pivots(events: DataFrame, key: str, distance="jensen_shannon") -> DataFrame:
    """key, tick, pivot: how far a tick's mix of kinds (rows of key, tick, kind) is from the last tick's that had any; 0 for the first."""
    measure = DISTANCES[distance] if isinstance(distance, str) else distance
    counts = events.groupBy(key, "tick", "kind").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key, "tick").agg(F.sum("n").alias("total")).withColumn("prev", F.lag("tick").over(W.partitionBy(key).orderBy("tick")))
    share = counts.join(totals, [key, "tick"]).withColumn("p", F.col("n") / F.col("total"))
    now = share.select(key, "tick", "kind", F.col("p").alias("q"), F.lit(0.0).alias("p"))
    before = totals.where("prev IS NOT NULL").select(key, "tick", F.col("prev").alias("at")).join(share.select(key, F.col("tick").alias("at"), "kind", "p"), [key, "at"]).select(key, "tick", "kind", F.lit(0.0).alias("q"), "p")
    both = now.unionByName(before).groupBy(key, "tick", "kind").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    out = both.groupBy(key, "tick").agg(measure(F.col("p"), F.col("q")).alias("d"))
    return out.join(totals.select(key, "tick", "prev"), [key, "tick"]).select(key, "tick", F.when(F.col("prev").isNull(), 0.0).otherwise(F.col("d")).alias("pivot"))


def average_pivot(pivot: DataFrame, key: str, window: int) -> DataFrame:
    return pivot.withColumn("average", F.avg("pivot").over(W.partitionBy(key).orderBy("tick").rowsBetween(-(window - 1), 0)))


@dataclass
class Threads:
    """Openings and closings of named threads; the first opened is to be closed last."""

    names: dict[str, tuple[str, str]] = field(default_factory=dict)
    opened: list[str] = field(default_factory=list)
    closed: list[str] = field(default_factory=list)

    def register(self, name: str, open_: str | None = None, close: str | None = None) -> None:
        self.names[name] = (open_ or f"{name}_open", close or f"{name}_close")

    def open(self, name: str) -> None:
        if name not in self.opened:
            self.opened.append(name)

    def close(self, name: str) -> None:
        self.closed.append(name)

    def observe(self, advanced: list[str], completed: list[str]) -> None:
        for name in self.names:
            if f"{name}_open" in advanced:
                self.open(name)
        for name in self.names:
            if f"{name}_close" in completed:
                self.close(name)

    def status(self, counts: dict[str, dict[str, int]]) -> list[dict]:
        """counts: by pattern, its active and completed numbers."""
        of = lambda p, k: counts.get(p, {}).get(k, 0)
        return [{"name": n, "open": of(a, "active"), "closed": of(z, "completed"), "unresolved": of(a, "completed") > of(z, "completed")} for n, (a, z) in self.names.items()]

    def violations(self) -> list[tuple[str, str]]:
        """(closed, still open): threads closed while a later one, which is never closed, is open."""
        out, live = [], list(self.opened)
        for name in self.closed:
            if name in live:
                at = live.index(name)
                out += [(name, later) for later in live[at + 1 :] if later not in self.closed]
                live.pop(at)
        return out

    def reset(self) -> None:
        self.opened.clear()
        self.closed.clear()


def violations(opened: DataFrame, closed: DataFrame, key: str) -> DataFrame:
    """key, closed, blocking of every key's threads, as Threads.violations gives them.

    opened: key, thread, t, of which the first time counts; closed: key, thread. Both are aggregated before they are paired, so
    a key is paired over its different threads and not over its events."""
    first = opened.groupBy(key, "thread").agg(F.min("t").alias("t"))
    ends = closed.select(key, "thread").distinct().withColumn("ended", F.lit(True))
    rows = first.join(ends, [key, "thread"], "left")
    done = rows.where("ended").select(key, F.col("thread").alias("closed"), F.col("t").alias("since"))
    live = rows.where("ended IS NULL").select(key, F.col("thread").alias("blocking"), "t")
    return done.join(live, key).where("t > since").select(key, "closed", "blocking")


#: The default weight of each signal.
WEIGHTS = {"advancements": 1.0, "completions": 3.0, "stalled": -2.0, "unresolved_plants": -0.5, "resolutions": 5.0, "filo_violations": -3.0, "tension_fit": 2.0, "pivot_magnitude": 1.5, "surprise": 1.0, "sequential_surprise": 1.0}
WEIGHTED = ("advancements", "completions", "filo_violations", "resolutions")
OPPOSITE = (("rising", "falling"), ("peak", "valley"))


def tension_fit(actual: Column, desired: Column) -> Column:
    """1 for the same trajectory, -1 for the opposite one, 0 otherwise and for unknown ones."""
    against = F.lit(False)
    for a, b in OPPOSITE:
        against = against | ((actual == a) & (desired == b)) | ((actual == b) & (desired == a))
    return F.when((actual == "unknown") | (desired == "unknown"), 0.0).when(actual == desired, 1.0).when(against, -1.0).otherwise(0.0)


def signals(ticks: DataFrame) -> DataFrame:
    """Signals of rows with advanced, completed, stalled (name lists), plants (name, payoff, active_plants, payoffs), filo_violations, trajectory, desired, pivot_magnitude, surprise, sequential_surprise."""
    paid = F.transform("plants", lambda p: p["payoff"])
    n = lambda xs: F.size(xs).cast("double")
    return ticks.withColumns(
        {
            "advancements": n("advanced"),
            "completions": n("completed"),
            "stalled": n("stalled"),
            "unresolved_plants": n(F.filter("plants", lambda p: (p["active_plants"] > 0) & (p["payoffs"] == 0))),
            "resolutions": n(F.filter("completed", lambda c: F.array_contains(paid, c))),
            "tension_fit": tension_fit(F.col("trajectory"), F.col("desired")),
        }
    )


def weighted_signals(ticks: DataFrame, importance: dict[str, float]) -> DataFrame:
    """signals, and weighted_<signal> with each pattern's importance (1 by default) in place of a count."""
    w = F.create_map(*[x for k, v in importance.items() for x in (F.lit(k), F.lit(float(v)))]) if importance else F.create_map().cast("map<string,double>")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(w[x], F.lit(1.0)))
    paid = F.transform("plants", lambda p: p["payoff"])
    rows = ticks.withColumns({"weighted_advancements": total(F.col("advanced")), "weighted_completions": total(F.col("completed")), "weighted_resolutions": total(F.filter("completed", lambda c: F.array_contains(paid, c)))})
    return signals(rows)


def significant_signals(ticks: DataFrame, importance: dict[str, float], threads: dict[str, float]) -> DataFrame:
    """weighted_signals of rows that also have violations, a list of the closed threads' names, one a violation; each weighs as
    its thread (1 by default). filo_violations becomes their number."""
    w = F.create_map(*[x for k, v in threads.items() for x in (F.lit(k), F.lit(float(v)))]) if threads else F.create_map().cast("map<string,double>")
    total = F.aggregate("violations", F.lit(0.0), lambda a, x: a + F.coalesce(w[x], F.lit(1.0)))
    return weighted_signals(ticks.withColumns({"filo_violations": F.size("violations"), "weighted_filo_violations": total}), importance)


def narrative_score(df: DataFrame, weights: dict[str, float] | None = None, time_scale: float | Column = 1.0) -> DataFrame:
    """With part_<signal> of each of the ten signals and their total. A weighted form is used where it is above 0."""
    weights = WEIGHTS | (weights or {})
    scale = time_scale if isinstance(time_scale, Column) else F.lit(float(time_scale))
    parts = {}
    for name, w in weights.items():
        x = F.col(name).cast("double")
        if name in WEIGHTED and f"weighted_{name}" in df.columns:
            x = F.when(F.col(f"weighted_{name}") > 0, F.col(f"weighted_{name}")).otherwise(x)
        parts[f"part_{name}"] = x * w * scale
    out = df.withColumns(parts)
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(p)
    return out.withColumn("total", total)
