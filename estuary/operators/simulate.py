"""Simulated releases on two venues, and Monte Carlo checks of the decision rules; every draw is seeded by its own event, so partitions do not matter.

A release moves a latent price that two venues observe: a fast one with a short delay and frequent updates, and the target with a long delay and rare ones. What else
happens is the scenario's: a private repricing of the fast venue that the target learns later or never, a second shock that no column shows, a halt, lost messages.
All scenarios take their random numbers in one order, so that two scenarios differ by what they declare and by nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import one_sided_bounds, wilson


@dataclass(frozen=True)
class Process:
    """Seconds and probability points. gap: mean time between a venue's updates; drop: the share of them that is lost."""

    communication: bool = False
    gain: float = 0.0
    private_sigma: float = 0.0
    delay_alpha: float = 0.5
    delay_beta: float = 4.0
    gap_alpha: float = 2.0
    gap_beta: float = 20.0
    drop_beta: float = 0.0
    tick: float = 0.01
    step: float = 1.0
    sensitivity_spread: float = 0.12
    omitted_sigma: float = 0.0
    news: bool = True
    complement: float = 1.0
    reversal: float = 0.0
    spread_multiplier: float = 1.0
    pause: tuple[float, float] | None = None
    pause_jump: float = 0.0
    rules_differ: bool = False


# The declared scenarios, and what all of them share.
SCENARIOS = {
    "shared_news_delay": Process(private_sigma=0.15),
    "communication": Process(communication=True, gain=0.9, private_sigma=0.15),
    "heterogeneous_sensitivity": Process(sensitivity_spread=0.45),
    "omitted_shock": Process(omitted_sigma=0.06),
    "opposing_sign": Process(sensitivity_spread=0.18, complement=-1.0),
    "spread_only": Process(news=False, spread_multiplier=3.0),
    "later_reversal": Process(reversal=1.6),
    "rule_mismatch": Process(delay_beta=1.0, gap_beta=8.0, drop_beta=0.3, rules_differ=True),
    "resolution_pause": Process(pause=(700.0, 1000.0), pause_jump=0.03),
    "coarse_sampling": Process(step=30.0, tick=0.05, gap_alpha=30.0, gap_beta=60.0),
    "dropped_messages": Process(drop_beta=0.6, gap_beta=10.0),
}
PRE, POST, HORIZONS, DELAY, LAG = 150.0, 1200.0, (60, 300, 900), 30.0, 60.0
SENSITIVITY, ABSORBED, INNOVATION, PRIVATE_LIFE, PRIVATE_MOST, CARRIED_AFTER, CARRIED_TAU = 0.08, 45.0, 0.0004, 1500.0, 0.25, 300.0, 45.0
OMITTED_SHARE, NOISE, CONTROL_NOISE, HALF_SPREAD, STALE, REVERSAL_AT, REVERSAL_TAU, WIDE = 0.008, 0.002, 0.004, 0.01, 300.0, 420.0, 180.0, (-30.0, 120.0)
CONTRACTS = ("C0", "C1", "G0")


def _rise(t: np.ndarray, tau: float) -> np.ndarray:
    return 1 - np.exp(-np.maximum(t, 0.0) / tau)


def _relaxing(draws: np.ndarray, t: np.ndarray, step: float, sigma: float) -> np.ndarray:
    """A path that is nil before the release and from then on follows its own shocks, relaxing slowly: the sum of the shocks, each shrunk by its age."""
    phi = math.exp(-step / PRIVATE_LIFE)
    after = t >= 0
    shocks = np.where(after, sigma * math.sqrt(1 - phi * phi) * draws, 0.0)
    age = np.cumsum(after)
    return np.clip(np.where(after, phi**age * np.cumsum(shocks * phi ** (-age.astype(float))), 0.0), -PRIVATE_MOST, PRIVATE_MOST)


class Event:
    """One release: its grid, latents and what each venue's updates show."""

    def __init__(self, name: str, seed: int, index: int) -> None:
        p = self.process = SCENARIOS[name]
        rng = np.random.default_rng([seed, index])
        t = self.t = np.arange(round((PRE + POST) / p.step) + 1) * p.step - PRE
        n = len(t)
        tau, self.shock = 40 + 20 * rng.random(), float(rng.standard_normal())
        omitted = np.cumsum(rng.standard_normal(n)) * p.omitted_sigma * OMITTED_SHARE * math.sqrt(p.step)
        innovation = np.cumsum(rng.standard_normal(n)) * INNOVATION * math.sqrt(p.step)
        response = _rise(t, tau)
        if p.reversal:
            response = response * np.where(t < REVERSAL_AT, 1.0, 1 - p.reversal * _rise(t - REVERSAL_AT, REVERSAL_TAU))
        carried = _rise(t - CARRIED_AFTER, CARRIED_TAU) * p.gain * p.communication
        lag = max(1, round(CARRIED_AFTER / p.step))
        self.fast, self.slow, self.news = {}, {}, {}
        for c in CONTRACTS:
            level, spread, draws = 0.3 + 0.4 * rng.random(), float(rng.standard_normal()), rng.standard_normal(n)
            sign = 0.0 if c == "G0" or not p.news else p.complement if c == "C1" else 1.0
            self.news[c] = sign * SENSITIVITY * (1 + p.sensitivity_spread * spread) * self.shock
            common = level + self.news[c] * response + (omitted - omitted[0]) + (innovation - innovation[0])
            private = _relaxing(draws, t, p.step, p.private_sigma if sign else 0.0)
            late = np.concatenate([np.zeros(min(lag, n)), private[: max(0, n - lag)]])
            jump = np.where(t >= p.pause[1], p.pause_jump, 0.0) if p.pause and c == "C0" else 0.0
            self.fast[c], self.slow[c] = np.clip(common + private, 0.02, 0.98), np.clip(common + carried * late + jump, 0.02, 0.98)
        self.updates = {"alpha": self._updates(rng, p.gap_alpha, 0.0), "beta": self._updates(rng, p.gap_beta, p.drop_beta), "gamma": self._updates(rng, p.gap_alpha, 0.0)}
        if p.pause:
            at = self.updates["beta"]
            open_then = at[(t[at] < p.pause[0]) | (t[at] > p.pause[1])]
            self.updates["beta"] = np.union1d(open_then, [round((p.pause[1] + PRE) / p.step)])
        self.seen = {}
        for venue, latent, delay, noise in (("alpha", self.fast, p.delay_alpha, NOISE), ("beta", self.slow, p.delay_beta, NOISE), ("gamma", self.slow, p.delay_beta, CONTROL_NOISE)):
            at = self.updates[venue]
            source = np.clip(np.searchsorted(t, t[at] - delay, side="right") - 1, 0, n - 1)
            for c in CONTRACTS:
                shown = latent[c][source] + noise * rng.standard_normal(len(at))
                self.seen[venue, c] = np.round(np.clip(np.rint(shown / p.tick) * p.tick, 0, 1), 8)

    def _updates(self, rng: np.random.Generator, gap: float, drop: float) -> np.ndarray:
        """Grid points at which a venue updates; what is drawn does not depend on how much of it is lost."""
        step, n = self.process.step, len(self.t)
        count = int((PRE + POST) / max(min(gap, step), step / 2)) + 32
        times = np.cumsum(-gap * np.log(np.maximum(rng.random(count), 1e-12)))
        times = times[rng.random(count) >= drop]
        at = np.unique(np.rint(times / step).astype(int))
        return at[at < n]

    def asof(self, venue: str, contract: str, at: int) -> tuple[float | None, int | None]:
        """The latest value shown at or before a grid point, and its own point."""
        k = int(np.searchsorted(self.updates[venue], at, side="right")) - 1
        return (None, None) if k < 0 else (float(self.seen[venue, contract][k]), int(self.updates[venue][k]))

    def rows(self, delay: float = DELAY, horizons: tuple[int, ...] = HORIZONS, contracts: tuple[str, ...] = CONTRACTS) -> list[tuple]:
        """(contract, horizon, price, own_lag, neighbor_lag, control_lag, shock, delayed_shock, target, exclusion_reason) with all reasons of a row."""
        p, out = self.process, []
        now = round((delay + PRE) / p.step)
        then = now - max(1, round(LAG / p.step))
        move = lambda a, b: None if a is None or b is None else round(a - b, 8)
        control = move(self.asof("gamma", "G0", now)[0], self.asof("gamma", "G0", then)[0])
        for c in contracts:
            venue = "gamma" if c == "G0" else "beta"
            (price, seen), before = self.asof(venue, c, now), self.asof(venue, c, then)[0]
            lent = move(self.asof("alpha", c, now)[0], self.asof("alpha", c, then)[0])
            age = math.inf if seen is None else (now - seen) * p.step
            late = 0.0 if seen is None else self.shock * (1 - math.exp(-age / ABSORBED))
            common = [(price is None, "no_baseline_quote"), (before is None, "no_own_lag_quote"), (lent is None, "no_neighbor_lag_quote"), (age > max(STALE, 4 * p.gap_beta * (1 + p.drop_beta)), "stale_baseline")]
            for h in horizons:
                end = self.asof(venue, c, now + round(h / p.step))[0]
                halted = p.pause is not None and delay < p.pause[1] and delay + h > p.pause[0]
                why = [r for hit, r in (*common, (end is None, "no_endpoint_quote"), (delay + h > POST, "beyond_simulation_window"), (halted, "halted_during_window")) if hit]
                out.append((c, h, price, move(price, before), lent, control, round(self.shock, 8), round(late, 8), move(end, price), ";".join(why) or None))
        return out

    def quotes(self) -> list[tuple]:
        """(venue, contract, at, mid, bid, ask, valid, reason, dropped_before): every update of every contract on its venues."""
        p, out = self.process, []
        for (venue, c), values in self.seen.items():
            if (c == "G0") != (venue == "gamma"):
                continue
            at = self.updates[venue]
            wide = (self.t[at] >= WIDE[0]) & (self.t[at] <= WIDE[1]) & (venue != "gamma")
            half = HALF_SPREAD * np.where(wide, p.spread_multiplier, 1.0)
            gaps = np.concatenate([[False], np.diff(at) > 1]) if len(at) else np.zeros(0, bool)
            for k, i in enumerate(at):
                halted = p.pause is not None and venue != "gamma" and p.pause[0] < self.t[i] < p.pause[1]
                out.append((venue, c, float(self.t[i]), float(values[k]), round(float(values[k] - half[k]), 8), round(float(values[k] + half[k]), 8), not halted, "halted" if halted else None, bool(gaps[k]) and venue != "gamma"))
        return out


EVENT = "event_id long, contract string, horizon int, price double, own_lag double, neighbor_lag double, control_lag double, shock double, delayed_shock double, target double, exclusion_reason string"
QUOTE = "event_id long, venue string, contract string, at double, mid double, bid double, ask double, valid boolean, exclusion_reason string, dropped_before boolean"


def _spread(spark: SparkSession, n: int, each: object, schema: str) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in pdf["id"]:
                yield pd.DataFrame([(int(i), *r) for r in each(int(i))], columns=[c.split()[0] for c in schema.split(", ")])

    return spark.range(n).mapInPandas(run, schema)


def simulated(spark: SparkSession, scenario: str, n_events: int, seed: int, delay: float = DELAY) -> DataFrame:
    """Forecast rows (EVENT) of a scenario: three contracts at each horizon."""
    return _spread(spark, n_events, lambda i: Event(scenario, seed, i).rows(delay), EVENT).withColumn("valid", F.col("exclusion_reason").isNull())


def simulated_quotes(spark: SparkSession, scenario: str, n_events: int, seed: int) -> DataFrame:
    return _spread(spark, n_events, lambda i: Event(scenario, seed, i).quotes(), QUOTE)


def tapes(spark: SparkSession, scenario: str, n_events: int, seed: int, spacing: int = 30 * 86_400_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints, contracts, releases) on the shape of an archive: each valid update is a print at its midpoint, on the event's axis; contracts state their rules, which in the
    scenario of differing rules agree in title alone; releases lie ``spacing`` microseconds apart."""
    rules = SCENARIOS[scenario].rules_differ
    releases = spark.range(n_events).select(F.col("id").alias("event_id"), (F.col("id") * spacing).alias("release"))
    quotes = simulated_quotes(spark, scenario, n_events, seed).where("valid")
    named = lambda venue, contract: F.concat_ws("-", venue, contract, F.lpad(F.col("event_id").cast("string"), 4, "0"))
    at = (F.col("event_id") * spacing + F.col("at") * 1_000_000).cast("long")
    prints = quotes.select(F.xxhash64("event_id", "venue", "contract", "at").alias("trade_id"), named(F.col("venue"), F.col("contract")).alias("contract"), at.alias("time"), F.col("mid").alias("price"), F.lit("yes").alias("axis"))
    held = quotes.select("event_id", "venue", "contract").distinct()
    threshold = F.when(F.col("contract") == "C1", 0.3).otherwise(0.5)
    differs = (F.col("venue") == "beta") & F.lit(rules) & (F.col("contract") == "C1")
    contracts = held.select(
        named(F.col("venue"), F.col("contract")).alias("contract"), "event_id", "venue", F.concat(F.lit("Release above "), threshold.cast("string")).alias("title"), F.when(differs, "at_least").otherwise("above").alias("operator"), threshold.alias("threshold")
    )
    return prints, contracts, releases


def _gain(scenario: str, seed: int, n: int, delay: float = 60.0, horizon: int = 300) -> float:
    """How much a neighbour's lag lowers the held-out mean absolute error beyond one's own lag and the news, on complete rows of one contract; nan with too few."""
    rows = [r for i in range(n) for r in Event(scenario, seed, i).rows(delay, (horizon,), ("C0",)) if r[-1] is None]
    if len(rows) < 20:
        return math.nan
    x, y = np.array([[1.0, r[3], r[6], r[7], r[4]] for r in rows]), np.array([r[8] for r in rows])
    cut = int(len(rows) * 0.6)
    errors = []
    for k in (4, 5):
        a = x[:cut, :k]
        w = np.linalg.solve(a.T @ a + 1e-6 * np.eye(k), a.T @ y[:cut])
        errors.append(np.abs(x[cut:, :k] @ w - y[cut:]).mean())
    return float(errors[0] - errors[1])


def detections(spark: SparkSession, scenarios: list[str], repetitions: int, n_events: int, seed: int, least_gain: float = 0.002, parallel: int | None = None) -> DataFrame:
    """(scenario, repetitions, detected, rate, lower, upper): how often the gain passes, with a Wilson interval. Repetitions without a complete comparison do not count."""
    tasks = spark.createDataFrame([(s, seed * 1_000_003 + r) for s in scenarios for r in range(repetitions)], "scenario string, seed long")
    tasks = tasks.repartition(parallel or spark.sparkContext.defaultParallelism)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"scenario": pdf["scenario"], "gain": [_gain(s, int(r), n_events) for s, r in zip(pdf["scenario"], pdf["seed"], strict=True)]})

    made = tasks.mapInPandas(run, "scenario string, gain double").where(F.col("gain").isNotNull() & ~F.isnan("gain"))
    out = made.groupBy("scenario").agg(F.count("*").alias("repetitions"), F.count_if(F.col("gain") >= least_gain).alias("detected"))
    lower, upper = wilson(F.col("detected"), F.col("repetitions"))
    return out.withColumn("rate", F.col("detected") / F.col("repetitions")).withColumn("lower", lower).withColumn("upper", upper)


def calibrated(spark: SparkSession, nulls: list[str], recoveries: list[str], repetitions: int, n_events: int, seed: int, least_gain: float = 0.002, ceiling: float = 0.05, target_power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """The decision rule held to its declared error rates: (scenario, kind, repetitions, detected, bound, meets, verdict).

    The level is divided among the null scenarios that can be estimated, so that all of their upper bounds hold at once; one without a complete draw is not estimable and
    keeps the verdict from being a pass. The verdict is pass if all meet, fail if a rate itself is beyond its limit, else inconclusive: the repetitions are too few to tell.
    """
    rates = {r["scenario"]: (r["detected"], r["repetitions"]) for r in detections(spark, [*nulls, *recoveries], repetitions, n_events, seed, least_gain).collect()}  # one row a scenario
    estimable = [s for s in nulls if s in rates]
    rows, wrong = [], False
    for kind, names in (("null", nulls), ("recovery", recoveries)):
        for name in names:
            if name not in rates:
                rows.append((name, kind, 0, 0, None, False))
                continue
            hits, n = rates[name]
            lower, upper = one_sided_bounds(hits, n, 1 - alpha / len(estimable) if kind == "null" else 1 - alpha)
            rows.append((name, kind, n, hits, upper if kind == "null" else lower, upper <= ceiling if kind == "null" else lower >= target_power))
            wrong |= hits / n > ceiling if kind == "null" else hits / n < target_power
    verdict = "pass" if all(r[-1] for r in rows) else "fail" if wrong else "inconclusive"
    return spark.createDataFrame([(*r, verdict) for r in rows], "scenario string, kind string, repetitions long, detected long, bound double, meets boolean, verdict string")
