"""Scores, slopes, splits, resampling and bands. Events or clusters, not rows, are the units."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import order_statistics, quantiles


def unit_series(df: DataFrame, unit: str, event: str, time: str) -> DataFrame:
    return df.groupBy(unit).agg(F.min(time).alias("first_time"), F.count_distinct(event).alias("events"), F.count("*").alias("rows"))


def forecast_scores(df: DataFrame, actual: str, predicted: str, by: list[str], tolerance: float = 0.0) -> DataFrame:
    """n, absolute and squared errors, bias, exact median, maximum, and the share of right signs where both lie beyond tolerance."""
    e, a, p = F.col(predicted) - F.col(actual), F.col(actual), F.col(predicted)
    sided = (F.abs(a) > tolerance) & (F.abs(p) > tolerance)
    known = df.where(a.isNotNull() & p.isNotNull())
    scores = known.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_ae"),
        F.try_divide(F.count_if(sided & (F.signum(a) == F.signum(p))), F.count_if(sided)).alias("directional"),
    )
    middle = quantiles(known.select(*by, F.abs(e).alias("_e")), "_e", [0.5], by).withColumnRenamed("q0", "median_ae")
    return scores.join(middle, by).select(*by, "n", "mae", "mse", "rmse", "bias", "median_ae", "max_ae", "directional")


def mean_by_event(df: DataFrame, actual: str, predicted: str, event: str) -> DataFrame:
    """Mean and population deviation over events of each event's absolute error."""
    each = df.groupBy(event).agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("m"))
    return each.agg(F.avg("m").alias("event_mae"), F.stddev_pop("m").alias("event_mae_sd"), F.count("m").alias("events"))


def clipped(p: Column, epsilon: float) -> Column:
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))


def resolution_scores(df: DataFrame, actual: str, predicted: str, cluster: str, epsilon: float = 1e-6) -> DataFrame:
    """Brier score and log loss of clipped probabilities: within a cluster, then over clusters. Unknown outcomes stay out."""
    p, y = clipped(F.col(predicted), epsilon), F.col(actual)
    each = df.where(y.isNotNull() & F.col(predicted).isNotNull()).groupBy(cluster).agg(F.avg((p - y) * (p - y)).alias("b"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("l"), F.count("*").alias("n"))
    return each.agg(F.avg("b").alias("brier"), F.avg("l").alias("log_loss"), F.count("*").alias("clusters"), F.sum("n").alias("rows"))


def reliability(df: DataFrame, actual: str, predicted: str, bins: int = 10) -> DataFrame:
    """Bins (i/n, (i+1)/n], the first one with 0."""
    at = F.greatest(F.ceil(F.col(predicted) * bins) - 1, F.lit(0)).cast("int")
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("observed"))


def event_means(df: DataFrame, event: str, response: str, shock: str) -> DataFrame:
    return df.where(F.col(response).isNotNull() & F.col(shock).isNotNull()).groupBy(event).agg(F.avg(response).alias("y"), F.avg(shock).alias("x"), F.count("*").cast("double").alias("w"))


def weighted_slope(units: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weighted least squares of y on the shock, standardised by its unweighted population deviation; null where that is nil."""
    s = units.groupBy(*by).agg(
        F.count("*").alias("events"), F.avg("x").alias("mx"), F.stddev_pop("x").alias("sd"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("swx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("swxx"),
        F.sum(F.col("w") * F.col("y")).alias("swy"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("swxy"),
    )
    det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    raw = F.when((F.col("sd") > 1e-12) & (det > 0), (F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy")) / det)
    return s.select(*by, "events", (raw * F.col("sd")).alias("slope"), raw.alias("raw_slope"), ((F.col("swy") - raw * F.col("swx")) / F.col("sw")).alias("raw_intercept"))


def leave_one_out(units: DataFrame) -> DataFrame:
    """The raw slope without each unit, from total sums minus its own: one aggregate and one pass."""
    t = units.agg(*[F.sum(e).alias(n) for n, e in _sums().items()])
    j = units.crossJoin(F.broadcast(t))  # t is one row
    o = {n: F.col(n) - e for n, e in _sums().items()}
    det = o["sw"] * o["swxx"] - o["swx"] * o["swx"]
    return j.select(*[c for c in units.columns if c not in "xyw"], F.when(det > 1e-12, (o["sw"] * o["swxy"] - o["swx"] * o["swy"]) / det).alias("slope_without"), F.try_divide(F.col("swy") - F.col("w") * F.col("y"), F.col("sw") - F.col("w")).alias("mean_without"))


def _sums() -> dict[str, Column]:
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    return {"sw": w, "swx": w * x, "swxx": w * x * x, "swy": w * y, "swxy": w * x * y}


def chronological_split(df: DataFrame, unit: str, time: str, span: str, train: float = 0.6, validation: float = 0.2, embargo: float | None = None) -> DataFrame:
    """Adds fold (train, validation, test), purged and training_cutoff. Units go by (first time, id); rows whose time + span + embargo passes
    the next fold's start are purged. The embargo is the spans' 95th percentile unless given; fewer than 3 units raise."""
    kept = df.where(F.col(time).isNotNull())
    units = kept.groupBy(unit).agg(F.min(time).alias("_start"))
    n = units.count()
    if n < 3:
        raise ValueError("a split needs three units")
    n_train = min(max(int(n * train), 1), n - 2)
    n_val = min(max(int(n * validation), 1), n - n_train - 1)
    edges = _nth_units(units, unit, [n_train, n_train + n_val])
    before = lambda e: (F.col("_start") < e[0]) | ((F.col("_start") == e[0]) & (F.col(unit) <= F.lit(e[1])))
    folds = units.withColumn("fold", F.when(before(edges[0]), "train").when(before(edges[1]), "validation").otherwise("test"))
    starts = {r["fold"]: (r["a"], r["z"]) for r in folds.groupBy("fold").agg(F.min("_start").alias("a"), F.max("_start").alias("z")).collect()}
    reach = F.greatest(F.col(span), F.lit(0))
    wait = embargo if embargo is not None else quantiles(kept.select(reach.alias("_span")), "_span", [0.95]).first()[0]
    ends = F.col(time) + reach + F.lit(wait)
    purged = F.when(F.col("fold") == "train", ends > starts["validation"][0]).when(F.col("fold") == "validation", ends > starts["test"][0]).otherwise(F.lit(False))
    cutoff = F.when(F.col("fold") == "test", starts["validation"][1]).otherwise(starts["train"][1])
    return kept.join(folds.select(unit, "fold"), unit).withColumn("purged", purged).withColumn("training_cutoff", cutoff)


def _nth_units(units: DataFrame, unit: str, counts: list[int]) -> list[tuple]:
    """(start, id) of the n-th unit by (start, id), for each n of counts: the start by an order statistic, the id among those of that start alone."""
    spark = units.sparkSession
    ranks = spark.createDataFrame([(i, n - 1) for i, n in enumerate(counts)], "i int, k long")
    found = {r["i"]: r["value"] for r in order_statistics(units, "_start", ranks, []).collect()}
    out = []
    for i, n in enumerate(counts):
        earlier = units.where(F.col("_start") < found[i]).count()
        tied = units.where(F.col("_start") == found[i])
        row = tied.withColumn("_at", F.row_number().over(W.partitionBy("_start").orderBy(unit))).where(F.col("_at") == n - earlier).first()
        out.append((row["_start"], row[unit]))
    return out


def stable_seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def draws_table(spark: SparkSession, clusters: list, samples: int, seed: int = 0) -> DataFrame:
    """(replicate, cluster, times): clusters drawn with replacement, the same for the same seed, labels and count on any cluster."""
    labels = sorted(clusters)
    rng = np.random.default_rng(stable_seed(seed, samples, *labels))
    rows = []
    for r in range(samples):
        picked, times = np.unique(rng.integers(0, len(labels), len(labels)), return_counts=True)
        rows += [(r, labels[i], int(t)) for i, t in zip(picked, times, strict=True)]
    kind = "string" if isinstance(labels[0], str) else "long"
    return spark.createDataFrame(rows, f"replicate int, cluster {kind}, times int")


def bootstrap_mean(units: DataFrame, draws: DataFrame, cluster: str, value: str, by: list[str] = ()) -> DataFrame:
    """(by, replicate, estimate): the mean over drawn units, each as often as its cluster was drawn. Units are pre-aggregated, so what is
    joined is clusters times replicates."""
    sums = units.groupBy(*by, F.col(cluster).alias("cluster")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return sums.join(draws, "cluster").groupBy(*by, "replicate").agg(F.try_divide(F.sum(F.col("s") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("estimate"))


def percentile_interval(replicates: DataFrame, by: list[str] = (), coverage: float = 0.95) -> DataFrame:
    """Percentile interval of the estimates; degenerate if it has no width, inconclusive with under two replicates."""
    tail = (1 - coverage) / 2
    got = replicates.groupBy(*by).agg(F.count("estimate").alias("replicates"), F.percentile("estimate", tail).alias("lower"), F.percentile("estimate", 1 - tail).alias("upper"))
    status = F.when(F.col("replicates") < 2, "inconclusive").when(F.col("upper") - F.col("lower") < 1e-15, "degenerate").otherwise("estimated")
    return got.withColumn("status", status).withColumns({c: F.when(F.col("replicates") >= 2, F.col(c)) for c in ("lower", "upper")})


def curve_band(replicates: DataFrame, points: DataFrame, by: str, coverage: float = 0.95) -> DataFrame:
    """A band over all points of a curve at once: the coverage quantile of each replicate's largest standardised distance."""
    whole = replicates.groupBy("replicate").agg(F.count_if(F.col("estimate").isNull()).alias("_bad")).where("_bad = 0").select("replicate")
    used = replicates.join(whole, "replicate", "left_semi")
    sd = used.groupBy(by).agg(F.stddev_pop("estimate").alias("sd"))
    curve = points.join(sd, by)
    far = used.join(F.broadcast(curve), by).withColumn("d", F.when(F.col("sd") > 0, F.abs(F.col("estimate") - F.col("point")) / F.col("sd")).otherwise(0.0)).groupBy("replicate").agg(F.max("d").alias("d"))
    c = far.agg(F.percentile("d", coverage).alias("c"))
    return curve.crossJoin(F.broadcast(c)).select(by, "point", (F.col("point") - F.col("c") * F.col("sd")).alias("lower"), (F.col("point") + F.col("c") * F.col("sd")).alias("upper"))


def permutation_p(observed: float, null: list[float]) -> float:
    return (1 + sum(abs(x) >= abs(observed) for x in null)) / (len(null) + 1)


def permutations_table(spark: SparkSession, units: list[tuple], repetitions: int, seed: int = 0) -> DataFrame:
    """(repetition, event, donor): within each regime, which event's response an event gets. units: (event, regime)."""
    rng, groups, rows = np.random.default_rng(stable_seed(seed, repetitions, *sorted(units))), {}, []
    for event, regime in sorted(units):
        groups.setdefault(regime, []).append(event)
    for r in range(repetitions):
        for members in groups.values():
            rows += [(r, e, members[int(i)]) for e, i in zip(members, rng.permutation(len(members)), strict=True)]
    return spark.createDataFrame(rows, "repetition int, event long, donor long")


def quantile_strata(df: DataFrame, value: str, parts: int = 4) -> DataFrame:
    """Adds stratum: right-closed quantile bins, equal limits merged, so ties share a bin."""
    found = quantiles(df, value, [i / parts for i in range(1, parts)]).first()
    at = list(found) if found else []
    limits = sorted(set(at))
    bin_of = F.lit(0)
    for x in limits:
        bin_of = bin_of + F.when(F.col(value) > x, 1).otherwise(0)
    return df.withColumn("stratum", F.when(F.col(value).isNotNull(), bin_of))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = successes / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale


def bootstrap_slope(units: DataFrame, draws: DataFrame, cluster: str, by: list[str] = ()) -> DataFrame:
    """(by, replicate, estimate): the slope of y on the shock, standardised within each replicate. Sums by cluster are joined, not units."""
    x, y, t = F.col("x"), F.col("y"), F.col("times")
    parts = {"n": F.lit(1.0), "sx": x, "sxx": x * x, "sy": y, "sxy": x * y}
    sums = units.groupBy(*by, F.col(cluster).alias("cluster")).agg(*[F.sum(e).alias(n) for n, e in parts.items()])
    s = sums.join(draws, "cluster").groupBy(*by, "replicate").agg(*[F.sum(F.col(n) * t).alias(n) for n in parts])
    sd = F.sqrt(F.greatest(F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2), F.lit(0.0)))
    return s.select(*by, "replicate", F.when(sd > 1e-12, (F.col("sxy") / F.col("n") - F.col("sx") * F.col("sy") / F.col("n") / F.col("n")) / sd).alias("estimate"))


def paired_gains(df: DataFrame, actual: str, one: str, other: str, release: str) -> DataFrame:
    """(release, rows, gain): how much smaller the mean absolute error of ``other`` is, on the rows where both forecasts exist."""
    whole = df.where(F.col(actual).isNotNull() & F.col(one).isNotNull() & F.col(other).isNotNull())
    gain = F.abs(F.col(one) - F.col(actual)) - F.abs(F.col(other) - F.col(actual))
    return whole.groupBy(release).agg(F.count("*").alias("rows"), F.avg(gain).alias("gain"))


def one_sided_bounds(successes: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact binomial lower and upper bounds, each at the given confidence: the rates at which a tail has the rest of the probability."""

    def tail(p: float, least: int) -> float:
        if p in (0.0, 1.0):
            return float(p == 1.0 or least <= 0)
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(max(least, 0), n + 1)]
        return sum(map(math.exp, logs))

    def root(least: int, wanted: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if tail(mid, least) < wanted else (low, mid)
        return (low + high) / 2

    return 0.0 if successes == 0 else root(successes, 1 - confidence), 1.0 if successes == n else root(successes + 1, confidence)


def promoted(gain: float | None, null_upper: float | None, least_gain: float, ceiling: float) -> str:
    """A richer model is promoted only with a sufficient gain and a null audit whose bound stays under the ceiling."""
    if gain is None or null_upper is None:
        return "inconclusive"
    return "promoted" if gain >= least_gain and null_upper <= ceiling else "not_promoted"


MOST_UNITS = 200_000


def statistic_bootstrap(units: DataFrame, cluster: str, statistic: Callable[[pd.DataFrame], dict[str, float]], samples: int, seed: int = 0, coverage: float = 0.95) -> DataFrame:
    """(metric, point, lower, upper, effective, status) of a caller's own statistic: units (a frame) -> metrics, evaluated on all units and on each replicate.

    A replicate draws as many clusters as there are, with replacement, and keeps all units of a drawn cluster as often as it was drawn. Units are releases, at most
    MOST_UNITS, and are sent to every executor; replicates are what is distributed. Under two clusters or two usable replicates the interval is inconclusive,
    one without width degenerate.
    """
    spark = units.sparkSession
    held = units.limit(MOST_UNITS + 1).toPandas()
    if len(held) > MOST_UNITS:
        raise ValueError(f"at most {MOST_UNITS} units")
    groups = {c: g for c, g in held.groupby(cluster, sort=True)}
    labels, point = list(groups), statistic(held)
    sent = spark.sparkContext.broadcast(groups)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for pdf in it:
            rows = []
            for r in pdf["id"]:
                drawn = np.random.default_rng([stable_seed(seed, samples, *labels) % (1 << 32), int(r)]).integers(0, len(labels), len(labels))
                rows += [(int(r), m, float(v)) for m, v in statistic(pd.concat([own[labels[i]] for i in drawn], ignore_index=True)).items() if v is not None and math.isfinite(v)]
            yield pd.DataFrame(rows, columns=["replicate", "metric", "estimate"])

    points = spark.createDataFrame([(m, float(v)) for m, v in point.items()], "metric string, point double")
    if len(labels) < 2:
        return points.select("*", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.lit(0).cast("long").alias("effective"), F.lit("inconclusive").alias("status"))
    replicates = spark.range(samples).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "replicate long, metric string, estimate double")
    found = percentile_interval(replicates, ["metric"], coverage).withColumnRenamed("replicates", "effective")
    joined = points.join(found, "metric", "left").withColumn("effective", F.coalesce("effective", F.lit(0).cast("long"))).withColumn("status", F.coalesce("status", F.lit("inconclusive")))
    return joined.select("metric", "point", "lower", "upper", "effective", "status")
