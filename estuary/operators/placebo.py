"""Falsifiers of an event slope, and what the slope test can resolve at a given number of events."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stats


@dataclass(frozen=True)
class Frame:
    """Names of a panel's columns; a placebo whose column is None is left out."""

    response: str
    shock: str
    event: str
    cluster: str
    time: str
    regime: str
    before: str | None = None
    age: str | None = None
    horizon: str | None = None
    cohort: str | None = None
    control: str | None = None


def shifted_shocks(df: DataFrame, f: Frame, shift: int = 1) -> DataFrame:
    """(event, shifted): the shock of the event ``shift`` earlier in the same regime. One row an event enters the window, not the panel's rows."""
    events = df.groupBy(F.col(f.event).alias("event"), F.col(f.regime).alias("regime")).agg(F.min(f.time).alias("at"), F.avg(f.shock).alias("x"))
    lagged = events.withColumn("shifted", F.lag("x", shift).over(W.partitionBy("regime").orderBy("at", "event")))
    return lagged.where(F.col("shifted").isNotNull()).groupBy("event").agg(F.max_by("shifted", "regime").alias("shifted"))


def placebo_units(df: DataFrame, f: Frame, shift: int = 1) -> DataFrame:
    """(placebo, stratum, event, cluster, y, x, w): event means for every variant, from one aggregate.

    baseline; pre_release_lead: the change before the release; shifted_release_time: an earlier shock of the same regime;
    reversed_direction: the negated shock; quote_age: by quantile of age; endpoint: by horizon; negative_control: the control cohort only.
    A row without a variant's response or shock takes no part in that variant. Every event weighs one.
    """
    df = df.join(shifted_shocks(df, f, shift).withColumnRenamed("event", f.event), f.event, "left")
    if f.age:
        df = stats.quantile_strata(df, f.age)

    def variant(name: str, y: str, x: Column, stratum: Column | None = None, only: Column | None = None) -> Column:
        made = F.struct(F.lit(name).alias("placebo"), (F.lit("all") if stratum is None else stratum.cast("string")).alias("stratum"), F.col(y).cast("double").alias("y"), x.cast("double").alias("x"))
        return made if only is None else F.when(only, made)

    shock = F.col(f.shock)
    made = [variant("baseline", f.response, shock), variant("shifted_release_time", f.response, F.col("shifted")), variant("reversed_direction", f.response, -shock)]
    if f.before:
        made.append(variant("pre_release_lead", f.before, shock))
    if f.age:
        made.append(variant("quote_age", f.response, shock, F.col("stratum")))
    if f.horizon:
        made.append(variant("endpoint", f.response, shock, F.col(f.horizon)))
    if f.cohort:
        made.append(variant("negative_control", f.response, shock, None, F.col(f.cohort) == f.control))
    rows = df.select(F.col(f.event).alias("event"), F.col(f.cluster).alias("cluster"), F.explode(F.array(*made)).alias("v")).select("event", "cluster", "v.*")
    kept = rows.where(F.col("stratum").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull())
    return kept.groupBy("placebo", "stratum", "event").agg(F.min("cluster").alias("cluster"), F.avg("y").alias("y"), F.avg("x").alias("x"), F.lit(1.0).alias("w"))


def placebo_suite(df: DataFrame, f: Frame, draws: DataFrame | None = None, shift: int = 1, least_events: int = 3) -> DataFrame:
    """One row a placebo and stratum: events, slope, status, and the cluster interval if draws (replicate, cluster, times) are given.
    Under ``least_events`` events, or a shock that does not vary, is inconclusive and has no slope."""
    units, by = placebo_units(df, f, shift), ["placebo", "stratum"]
    s = stats.weighted_slope(units, by)
    enough = (F.col("events") >= least_events) & F.col("slope").isNotNull()
    out = s.select(*by, "events", F.when(enough, F.col("slope")).alias("slope"), F.when(enough, "ok").otherwise("inconclusive").alias("status"))
    if draws is None:
        return out
    interval = stats.percentile_interval(stats.bootstrap_slope(units, draws, "cluster", by), by)
    return out.join(interval.select(*by, "lower", "upper", F.col("status").alias("interval_status")), by, "left")


def label_permutation(units: DataFrame, regime: str, repetitions: int, seed: int = 0) -> DataFrame:
    """One row: events, slope, repetitions, p. Within each regime shocks are dealt anew among events, never across regimes.

    units: event, y, x and the regime. In each repetition an event takes the shock of the event that stands at its own place when the
    regime is ordered by a seeded hash, so a repetition is two ranks and a join on (repetition, regime, place).
    """
    base = units.select("event", F.col(regime).alias("regime"), "y", "x")
    every = base.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    w = W.partitionBy("repetition", "regime")
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repetition").cast("string"), F.col("event").cast("string")).cast("binary"))
    receivers = every.withColumn("place", F.row_number().over(w.orderBy("event"))).select("repetition", "regime", "place", "y")
    donors = every.withColumn("place", F.row_number().over(w.orderBy(mixed, "event"))).select("repetition", "regime", "place", "x")
    null = stats.weighted_slope(receivers.join(donors, ["repetition", "regime", "place"]).withColumn("w", F.lit(1.0)), ["repetition"])
    seen = stats.weighted_slope(base.withColumn("w", F.lit(1.0))).select("events", "slope")
    j = null.select(F.col("slope").alias("dealt")).crossJoin(F.broadcast(seen))  # one row
    return j.groupBy("events", "slope").agg(F.count("dealt").alias("repetitions"), ((1 + F.count_if(F.abs("dealt") >= F.abs("slope"))) / (F.count("dealt") + 1)).alias("p"))


def _interval(seed: int, n: int, slope: float, sigma: float, shock_sigma: float, cluster_size: int, samples: int, coverage: float) -> tuple[float, float]:
    """Cluster-bootstrap interval of the standardised slope on one simulated set of events."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(n) * shock_sigma
    y = slope * x + rng.standard_normal(n) * sigma
    at = np.arange(n) // cluster_size
    k = at[-1] + 1
    sums = np.stack([np.bincount(at, v, k) for v in (np.ones(n), x, x * x, y, x * y)], axis=1)
    drawn = rng.multinomial(k, np.full(k, 1 / k), size=samples) @ sums
    c, sx, sxx, sy, sxy = drawn.T
    with np.errstate(invalid="ignore", divide="ignore"):
        sd = np.sqrt(np.maximum(sxx / c - (sx / c) ** 2, 0))
        found = np.where(sd > 1e-12, (sxy / c - sx * sy / c / c) / sd, np.nan)
    found = found[np.isfinite(found)]
    if len(found) < 2:
        return float("nan"), float("nan")
    low, high = np.quantile(found, [(1 - coverage) / 2, (1 + coverage) / 2])
    return float(low), float(high)


def power(
    spark: SparkSession, n_events: int = 24, relevant: float = 0.02, sigma: float = 0.03, repetitions: int = 200, grid: tuple[int, ...] = (12, 24, 36, 60, 120), seed: int = 20260913, samples: int = 100,
    coverage: float = 0.95, cluster_size: int = 2, shock_sigma: float = 1.0,
) -> DataFrame:
    """Rates at which the interval leaves out zero: hypothesis null (slope zero), relevant (the smallest slope of interest) and grid (the
    same at other event counts), each with its usable repetitions, median width and Wilson bounds. Repetitions are independent tasks, each
    with its own seed, so the result does not depend on the partitioning."""
    if repetitions < 20 or n_events < 3 or sigma <= 0:
        raise ValueError("power needs 20 repetitions, 3 events and a positive residual scale")
    settings = [("null", 0.0, n_events, repetitions), ("relevant", relevant, n_events, repetitions), *[("grid", relevant, n, max(40, repetitions // 4)) for n in grid if n >= 3]]
    tasks = spark.createDataFrame(settings, "hypothesis string, slope double, n_events int, repetitions int").withColumn("repetition", F.explode(F.sequence(F.lit(0), F.col("repetitions") - 1))).drop("repetitions")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [_interval(stats.stable_seed("power", seed, r.hypothesis, r.n_events, r.repetition), r.n_events, r.slope, sigma, shock_sigma, cluster_size, samples, coverage) for r in b.itertuples()]
            yield b[["hypothesis", "slope", "n_events"]].assign(lower=[a for a, _ in ends], upper=[z for _, z in ends])

    got = tasks.repartition("hypothesis", "n_events", "repetition").mapInPandas(draw, "hypothesis string, slope double, n_events int, lower double, upper double")
    usable = ~F.isnan("lower")
    r = got.groupBy("hypothesis", "slope", "n_events").agg(
        F.count_if(usable).alias("usable"), F.count_if(usable & ((F.col("lower") > 0) | (F.col("upper") < 0))).alias("excludes_zero"), F.percentile(F.when(usable, F.col("upper") - F.col("lower")), 0.5).alias("median_width"),
    )
    low, high = stats.wilson(F.col("excludes_zero"), F.col("usable"))
    seen = F.col("usable") > 0
    return r.withColumns({"rate": F.when(seen, F.col("excludes_zero") / F.col("usable")), "rate_low": F.when(seen, low), "rate_high": F.when(seen, high)}).drop("excludes_zero")


def events_for_power(rates: DataFrame, target: float = 0.8) -> int | None:
    """The least event count of the grid whose rate reaches the target."""
    return rates.where((F.col("hypothesis") == "grid") & (F.col("rate") >= target)).agg(F.min("n_events")).first()[0]
