"""Reports over served requests: percentiles, summaries, counters, histograms, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the first-token histogram, in milliseconds.
TTFT_BOUNDS = (5, 10, 25, 50, 100, 150, 250, 400, 600, 1000, 1500, 2500, 5000, 10000)


#: Stretches of a group's values that are counted before any is sorted.
BINS = 1024


def percentiles(rows: DataFrame, value: str, percents: tuple[int, ...], *, by: tuple[str, ...] = ()) -> DataFrame:
    """``p<q>`` columns: the element at ``min(n * q div 100, n - 1)`` of the sorted values, without collecting a group.

    Equal values are counted first, then the counts of ``BINS`` equal stretches between
    a group's least and greatest value; only the stretches that a wanted index falls
    into are sorted.  The element is the least value whose running count passes the
    index.  An empty input gives zeros.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    span = counts.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    told = counts.join(span, list(by)) if by else counts.join(F.broadcast(span), F.lit(True))  # one row
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))).otherwise(0)
    binned = told.select(*by, "v", "n", "total", bin_.cast("int").alias("bin"))
    at = lambda q: F.least(F.expr(f"total * {q} div 100"), F.col("total") - 1)
    per_bin = binned.groupBy(*by, "bin").agg(F.sum("n").alias("inside"), F.first("total").alias("total"))
    upto = F.sum("inside").over(Window.partitionBy(*by).orderBy("bin"))
    wanted = per_bin.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("inside"))
    asked = F.lit(False)
    for q in percents:
        asked |= (F.col("before") <= at(q)) & (at(q) < F.col("upto"))
    wanted = wanted.filter(asked).select(*by, "bin", "before")
    near = binned.join(wanted, [*by, "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "bin").orderBy("v")))
    picks = [F.coalesce(F.min(F.when(F.col("upto") > at(q), F.col("v"))), F.lit(0)).alias(f"p{q}") for q in percents]
    return near.groupBy(*by).agg(*picks) if by else near.agg(*picks)


def summary(results: DataFrame, elapsed_s: float, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors, rates over the rest, hedges and throughput."""
    ok = F.col("error").isNull()
    n = F.count_if(ok)
    share = lambda c: F.when(n > 0, F.count_if(ok & F.col(c)) / n).otherwise(0.0)
    columns = [
        F.count_if(~ok).alias("errors"), n.alias("served"), share("prefix_hit").alias("prefix_hit_rate"), F.coalesce(F.avg(F.when(ok, F.col("prefill_ms"))), F.lit(0.0)).alias("prefill_mean_ms"),
        F.count_if(ok & F.col("hedged")).alias("hedges_launched"), F.count_if(ok & F.col("hedge_won")).alias("hedges_won"), F.count_if(ok & F.col("cached")).alias("cached"),
        (n / elapsed_s).alias("throughput"), (F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)) / elapsed_s).alias("tokens_per_s"),
    ]
    return results.groupBy(*by).agg(*columns) if by else results.agg(*columns)


def error_kinds(results: DataFrame) -> DataFrame:
    return results.filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def prefix_spread(results: DataFrame, prefix: str = "item_id") -> DataFrame:
    """Mean number of distinct workers of a prefix over served requests."""
    per = results.filter("error is null").groupBy(prefix).agg(F.count_distinct("worker").alias("workers"))
    return per.agg(F.coalesce(F.avg("workers"), F.lit(0.0)).alias("spread"), F.count("*").alias("prefixes"))


def stats_delta(before: DataFrame, after: DataFrame, key: str, counters: list[str], gauges: list[str]) -> DataFrame:
    """Counters of ``after`` less those of ``before``, gauges as after; keys that ``before`` lacks count from 0."""
    both = after.alias("a").join(before.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    return both.select(F.col(f"a.{key}"), *((F.col(f"a.{c}") - F.coalesce(F.col(f"b.{c}"), F.lit(0))).alias(c) for c in counters), *(F.col(f"a.{g}") for g in gauges))


def trials(per_trial: DataFrame, value: str, by: str) -> DataFrame:
    """Mean and sample deviation over trials; a single trial deviates by 0."""
    return per_trial.groupBy(by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.count("*").alias("trials"))


def counters(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, bounds: tuple[int, ...] = TTFT_BOUNDS, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative counts of values up to each bound, and of all as ``+Inf``; one pass, one row a bound."""
    cells = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds), F.struct(F.lit("+Inf").alias("le"), F.count(value).alias("n")))
    got = rows.groupBy(*by).agg(cells.alias("cells")) if by else rows.agg(cells.alias("cells"))
    return got.select(*by, F.explode("cells").alias("c")).select(*by, "c.le", "c.n")


def histogram_quantile(buckets: DataFrame, q: float, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Value at ``q`` by linear interpolation in the first bucket that reaches it; the last bound beyond all bounds."""
    upper = F.when(F.col("le") == "+Inf", F.lit(None)).otherwise(F.col("le").cast("double"))
    rows = buckets.withColumn("upper", upper).withColumn("order", F.coalesce("upper", F.lit(float("inf"))))
    w = Window.partitionBy(*by).orderBy("order")
    rows = rows.withColumn("lower", F.coalesce(F.lag("upper").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    total = F.max("n").over(Window.partitionBy(*by))
    rows = rows.withColumn("want", F.lit(q) * total)
    value = F.when(F.col("upper").isNull(), F.col("lower")).otherwise(F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("want") - F.col("below")) / (F.col("n") - F.col("below")))
    reached = rows.filter("n >= want and n > below").withColumn("value", value)
    pick = F.min_by("value", "order").alias("value")
    return reached.groupBy(*by).agg(pick) if by else reached.agg(pick)


def running_ratio(rows: DataFrame, hit: Column, *, by: str, order: list[str]) -> DataFrame:
    """Hits over requests so far, within ``by``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ratio", F.sum(F.when(hit, 1).otherwise(0)).over(w) / F.count("*").over(w))


def rate(rows: DataFrame, label: str, *, window_ms: int, step_ms: int) -> DataFrame:
    """Events a second over sliding windows that end at multiples of ``step_ms``; a window holds its start, not its end."""
    first = F.floor(F.col("ts_ms") / step_ms) + 1
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(window_ms // step_ms - 1)), lambda i: (first + i) * step_ms))
    return rows.select(label, ends.alias("end_ms")).groupBy(label, "end_ms").agg((F.count("*") / (window_ms / 1000.0)).alias("rate"))


def gates(phases: DataFrame) -> DataFrame:
    """End-to-end checks over the summaries of phases A (least loaded), B (affinity) and C (hedged)."""
    f = lambda p, c: F.max(F.when(F.col("phase") == p, F.col(c)))
    checks = phases.agg(
        (f("B", "prefix_hit_rate") > f("A", "prefix_hit_rate")).alias("affinity_hits_more"), (f("B", "prefill_mean_ms") < f("A", "prefill_mean_ms")).alias("affinity_prefills_less"),
        ((f("C", "hedges_launched") > 0) & (2 * f("C", "hedges_launched") < f("C", "served"))).alias("hedges_some"), (f("C", "errors") == 0).alias("no_errors"))
    return checks.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in checks.columns)), F.array(*checks.columns))).alias("gate", "passed"))


def thresholds(results: DataFrame) -> DataFrame:
    """Load-test checks: 95th percentiles of first token and request, and the share of answered requests."""
    p = percentiles(results.filter("error is null"), "ttft_ms", (95,)).withColumnRenamed("p95", "ttft_p95")
    r = percentiles(results.filter("error is null"), "total_ms", (95,)).withColumnRenamed("p95", "total_p95")
    s = results.agg((F.count_if(F.col("error").isNull()) / F.count("*")).alias("answered"))
    one = p.join(r, F.lit(True)).join(s, F.lit(True))  # one row each
    return one.select("ttft_p95", "total_p95", (F.col("ttft_p95") < 3000).alias("ttft_ok"), (F.col("total_p95") < 5000).alias("total_ok"), (F.col("answered") > 0.95).alias("answered_ok"))
