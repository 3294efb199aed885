"""Masked panels over a dense declared grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.masking import masked
from . import asof
from .asof import last_group, tie_groups, window_join


@dataclass(frozen=True)
class PanelSettings:
    """Microseconds throughout."""

    before: int
    after: int
    baseline_cap: int
    endpoint_cap: int
    horizons: tuple[int, ...]


def dense_grid(events: DataFrame, candidates: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Every declared (event, contract) at every horizon, traded or not."""
    return events.join(candidates, "event_id").withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])))


def undeclared(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Events without a declared candidate: the grid may not be built while there are any."""
    return events.join(candidates, "event_id", "left_anti").select("event_id")


# Why a row of the trade panel is masked, in order.
TRADE_REASONS = ("rule_evidence_missing", "closed_before_release", "missing_baseline", "stale_baseline", "no_post_release_trade", "endpoint_beyond_cap", "mixed_axis")


def trade_panel(trades: DataFrame, events: DataFrame, candidates: DataFrame, settings: PanelSettings) -> DataFrame:
    """One row for each declared event, contract and horizon.

    trades (trade_id, contract, time, price, axis), events (event_id, at, rule_known, closed_before), candidates
    (event_id, contract). Baseline: the mean of the last tie group in [at - before, at); endpoint: of the last
    in (at, at + horizon]. A print at the event itself is in neither. Only these two groups decide about the axis: a member without one, or two
    axes among them, mask the row, and what is printed later does not. Legs stay visible on masked rows, the response does not. An event
    without a declared candidate raises.
    """
    if missing := undeclared(events, candidates).limit(3).collect():
        raise ValueError(f"events without a declared candidate, such as {[r[0] for r in missing]}")
    declared = events.join(candidates, "event_id").select("event_id", "contract", "at")
    near = window_join(trades, declared, "time", "at", settings.before, settings.after, ["contract"])
    keys = ["event_id", "contract"]
    pre = near.where(F.col("time") < F.col("at"))
    base = last_group(tie_groups(pre, keys, "time", "price", "trade_id", "axis"), keys, "time").select(
        *keys, F.col("time").alias("baseline_time"), F.col("mean").alias("baseline"), F.col("ids").alias("baseline_ids"), F.col("axes").alias("baseline_axes"), F.col("members").alias("n_pre")
    )
    groups = tie_groups(near.where(F.col("time") > F.col("at")).withColumn("wait", F.col("time") - F.col("at")), [*keys, "wait"], "time", "price", axis="axis")
    reached = groups.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in settings.horizons]))).where(F.col("wait") <= F.col("horizon"))
    ends = last_group(reached.drop("wait"), [*keys, "horizon"], "time").select(
        *keys, "horizon", F.col("time").alias("endpoint_time"), F.col("mean").alias("endpoint"), F.col("low").alias("endpoint_low"), F.col("high").alias("endpoint_high"), F.col("axes").alias("endpoint_axes"), F.col("members").alias("n_post")
    )
    rows = dense_grid(events, candidates, settings.horizons).join(base, keys, "left").join(ends, [*keys, "horizon"], "left").na.fill(0, ["n_pre", "n_post"])
    rows = rows.withColumn("baseline_age", F.col("at") - F.col("baseline_time")).withColumn("endpoint_age", F.col("at") + F.col("horizon") - F.col("endpoint_time")).withColumn("response", F.col("endpoint") - F.col("baseline"))
    unset = F.coalesce(F.col("baseline_axes.unset"), F.lit(0)) + F.coalesce(F.col("endpoint_axes.unset"), F.lit(0)) > 0
    several = F.least("baseline_axes.low", "endpoint_axes.low") < F.greatest("baseline_axes.high", "endpoint_axes.high")
    conditions = (
        ~F.col("rule_known"), F.col("closed_before"), F.col("baseline_time").isNull(), F.col("baseline_age") > settings.baseline_cap, F.col("endpoint_time").isNull(),
        (F.col("endpoint_age") > settings.endpoint_cap) | (F.col("horizon") > settings.after), unset | several,
    )
    return masked(rows, list(zip(conditions, TRADE_REASONS, strict=True)), ["response"]).drop("baseline_axes", "endpoint_axes")


def panel_counts(panel: DataFrame) -> DataFrame:
    """Overall (event_id null) and by event: candidates, legs seen, valid rows, and the valid share (null of nothing)."""
    return panel.rollup("event_id").agg(
        F.count("*").alias("rows"),
        F.count_distinct("contract").alias("contracts"),
        F.count_if(F.col("baseline").isNotNull()).alias("with_baseline"),
        F.count_if(F.col("endpoint").isNotNull()).alias("with_endpoint"),
        F.count_if("valid").alias("valid_rows"),
        F.try_divide(F.count_if("valid"), F.count_if(F.col("baseline").isNotNull())).alias("valid_share"),
    )


def event_equal_mean(panel: DataFrame, by: list[str], value: str = "response", event: str = "event_id") -> DataFrame:
    """The mean within each event, then over events."""
    inner = panel.where("valid").groupBy(*by, event).agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    return inner.groupBy(*by).agg(F.avg("_m").alias("mean"), F.count("*").alias("events"), F.sum("_n").alias("rows"))


def forecast_rows(trades: DataFrame, events: DataFrame, receivers: DataFrame, donors: DataFrame, delay: int, lag: int, horizon: int, scan_before: int, signal_cap: int) -> DataFrame:
    """Receiver anchors, own lags and targets beside what a donor showed by then; one row for each event and receiver.

    trades (trade_id, contract, time, price); events (event_id, release); receivers (event_id, contract); donors (contract,
    donor). tau = release + delay; anchor: last at or before tau; prior: last at or before tau - horizon; target: last in
    (tau, tau + horizon]; donor baseline: last before the release; donor signal: last by tau - lag, not before the
    release and at most signal_cap old. Only the receiver's own gaps mask a row; the target stays visible.
    """
    base = events.join(receivers, "event_id").withColumn("tau", F.col("release") + delay)
    reach = dict(before=scan_before, after=delay + horizon)

    def leg(near: DataFrame, keep: object, name: str) -> DataFrame:
        groups = tie_groups(near.where(keep), ["event_id", "contract"], "time", "price")
        return last_group(groups, ["event_id", "contract"], "time").select("event_id", "contract", F.col("time").alias(f"{name}_time"), F.col("mean").alias(name))

    t, tau = F.col("time"), F.col("tau")
    own = window_join(trades, base.select("event_id", "contract", "release", "tau"), "time", "release", keys=["contract"], **reach)
    given = base.join(donors, "contract").select("event_id", F.col("donor").alias("contract"), "release", "tau").distinct()
    lent = window_join(trades, given, "time", "release", keys=["contract"], **reach)
    cutoff = tau - lag
    seen = leg(lent, (t <= cutoff) & (t >= F.col("release")) & (t >= cutoff - signal_cap), "donor_signal").withColumnRenamed("contract", "donor")
    first = leg(lent, t < F.col("release"), "donor_baseline").withColumnRenamed("contract", "donor")
    rows = base.join(donors, "contract", "left")
    for name, keep in (("anchor", t <= tau), ("prior", t <= tau - horizon), ("target_level", (t > tau) & (t <= tau + horizon))):
        rows = rows.join(leg(own, keep, name), ["event_id", "contract"], "left")
    rows = rows.join(first, ["event_id", "donor"], "left").join(seen, ["event_id", "donor"], "left")
    rows = rows.withColumn("own_lag", F.col("anchor") - F.col("prior")).withColumn("target", F.col("target_level") - F.col("anchor")).withColumn("neighbor_lag", F.col("donor_signal") - F.col("donor_baseline"))
    return masked(rows, [(F.col("anchor").isNull(), "no_anchor"), (F.col("target_level").isNull(), "no_target")])


# Why a row of the quote panel is masked, in order, and then why either leg's quote is not admitted.
QUOTE_REASONS = ("ineligible_contract", "unknown_rule_semantics", "rule_unavailable", "contract_not_open", "missing_baseline", "missing_endpoint", "closed_in_window", "contaminated")
LEG_REASONS = ("quote_invalid", "last_verified_unknown", "quote_stale", "side_missing")


def quote_panel(quotes: DataFrame, releases: DataFrame, pairs: DataFrame, contracts: DataFrame, horizons: tuple[int, ...], max_age: int) -> DataFrame:
    """Declared (release, contract) pairs by horizon with the midpoints of the latest quotes before the release and up to its endpoint.

    quotes: contract, record_id, time (of the fold's own axis), state (valid, or why not), last_verified, bid, ask. releases: event_id, at,
    contaminated (array of struct(start, end), null: none). pairs: event_id, contract. contracts: contract, opened, closed, rule_from (when
    its rule was known, null: never published). Rows are masked, never dropped, with reasons in order; a pair without a contract stays.
    Both quotes must hold: a latest quote that is invalid, unverified, older than max_age or one-sided is never passed over for an older one.
    """
    c = F.col
    carry = ["state", "last_verified", "bid", "ask"]
    grid = pairs.select("event_id", "contract").distinct().join(releases.select("event_id", "at", "contaminated"), "event_id")
    base = asof.asof_last(grid, quotes, ["contract"], "at", "time", "record_id", carry, strict=True).withColumnsRenamed({f"matched_{x}": f"b_{x}" for x in ("time", "id", *carry)})
    closings = asof.window_join(quotes.where(c("state") == "closed").select("contract", "time"), grid.select("event_id", "contract", "at"), "time", "at", 0, max(horizons), ["contract"])
    base = base.join(closings.groupBy("event_id", "contract").agg(F.min("time").alias("closing")), ["event_id", "contract"], "left")
    spread = base.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons]))).withColumn("until", c("at") + c("horizon"))
    both = asof.asof_last(spread, quotes, ["contract"], "until", "time", "record_id", carry).withColumnsRenamed({f"matched_{x}": f"e_{x}" for x in ("time", "id", *carry)})
    j = both.join(contracts.select("contract", "opened", "closed", "rule_from", F.lit(True).alias("listed")), "contract", "left")

    def unfit(side: str, at: Column) -> list[tuple[Column, str]]:
        held, ok, seen = c(f"{side}_time").isNotNull(), c(f"{side}_state").eqNullSafe(F.lit("valid")), c(f"{side}_last_verified")
        name = {"b": "baseline", "e": "endpoint"}[side]
        fit = held & ok & seen.isNotNull()
        conditions = (held & ~ok, held & ok & seen.isNull(), fit & (at - seen > max_age), fit & (c(f"{side}_bid").isNull() | c(f"{side}_ask").isNull()))
        return [(x, f"{name}_{why}") for x, why in zip(conditions, LEG_REASONS, strict=True)]

    conditions = (
        c("listed").isNull(), c("listed") & c("rule_from").isNull(), c("rule_from") > c("at"), ~asof.open_during(c("opened"), c("closed"), c("at"), c("until")), c("b_time").isNull(), c("e_time").isNull(), c("closing") <= c("until"),
        asof.overlaps_any(c("contaminated"), c("at"), c("until")),
    )
    ladder = [*zip(conditions, QUOTE_REASONS, strict=True), *unfit("b", c("at")), *unfit("e", c("until"))]
    mid = {s: (c(f"{s}_bid") + c(f"{s}_ask")) / 2 for s in "be"}
    shown = j.withColumns({"baseline": mid["b"], "endpoint": mid["e"], "response": mid["e"] - mid["b"], "spread_before": c("b_ask") - c("b_bid"), "spread_after": c("e_ask") - c("e_bid")})
    shown = shown.withColumns({"baseline_age": c("at") - c("b_last_verified"), "endpoint_age": c("until") - c("e_last_verified")})
    out = masking.masked(shown, ladder, ["baseline", "endpoint", "response", "spread_before", "spread_after", "baseline_age", "endpoint_age"])
    return out.select(
        "event_id", "contract", "horizon", c("b_id").alias("baseline_id"), c("e_id").alias("endpoint_id"), "baseline", "endpoint", "response", "spread_before", "spread_after", "baseline_age", "endpoint_age", "exclusion_reasons", "exclusion_reason", "valid",
    )
