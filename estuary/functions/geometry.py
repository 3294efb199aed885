"""Arithmetic on bounded prices, funding intervals, payoffs and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid_and_spread(bid: Column, ask: Column, valid: Column) -> tuple[Column, Column]:
    both = valid & bid.isNotNull() & ask.isNotNull()
    return F.when(both, (bid + ask) / 2), F.when(both, ask - bid)


def bounded_level(price: Column, delta: Column) -> Column:
    """price + 100 tanh(delta / 100), kept off 0 and 1."""
    return F.least(F.greatest(price + 100 * F.tanh(delta / 100), F.lit(1e-6)), F.lit(1 - 1e-6))


def price_variance(p: Column) -> Column:
    return p * (1 - p)


def edge_distance(p: Column) -> Column:
    return F.least(p, 1 - p)


def snapped_hours(hours: Column) -> Column:
    """The nearest of 1, 4 and 8 hours by relative error, if within 15 %."""
    each = F.transform(F.array(F.lit(1.0), F.lit(4.0), F.lit(8.0)), lambda h: F.struct((F.abs(hours - h) / h).alias("error"), h.alias("hours")))
    best = F.array_min(each)
    return F.when(hours.isNotNull() & (best["error"] <= 0.15), best["hours"])


def funding_interval(rate: Column, apr: Column, window_days: Column, settlements: Column) -> Column:
    """struct(hours, refusal): from the rate and its yearly figure, and from a count of settlements; both must agree."""
    by_rate = snapped_hours(F.when((apr != 0) & (rate != 0), rate * 8760 / apr))
    by_count = snapped_hours(F.when(settlements > 0, window_days * 24 / settlements))
    clash = by_rate.isNotNull() & by_count.isNotNull() & (by_rate != by_count)
    hours = F.when(~F.coalesce(clash, F.lit(False)), F.coalesce(by_rate, by_count))
    return F.struct(hours.alias("hours"), F.when(clash, "interval_disagrees").when(hours.isNull(), "interval_underivable").alias("refusal"))


def orientation(operator: Column) -> Column:
    return F.when(operator.isin("above", "at_least"), 1).when(operator.isin("below", "at_most"), -1).otherwise(0)


def stated_places(threshold: Column) -> Column:
    """How many decimal places a threshold states, as text: 4.250 states three."""
    return F.char_length(F.regexp_extract(threshold, r"\.([0-9]+)$", 1))


def payoff(threshold: Column, operator: Column, atom: Column, rounding: str | None = "nearest") -> Column:
    """0 or 1: whether an outcome satisfies the operator, for a threshold in text. The outcome is first brought to the threshold's own places: to the nearest (half
    away from zero), up or down; without a rounding it is taken as it is. An operator that compares with no threshold is null."""
    level, x = threshold.try_cast("decimal(38,12)"), atom.cast("decimal(38,12)")
    unit = F.element_at(F.array(*[F.lit(f"1e-{p}").cast("decimal(12,12)") if p else F.lit("1").cast("decimal(13,12)") for p in range(13)]).cast("array<decimal(13,12)>"), F.least(stated_places(threshold), F.lit(12)) + 1)
    steps = (x / unit).cast("decimal(38,6)")
    whole = {"nearest": lambda: F.signum(steps) * F.floor(F.abs(steps) + F.lit(0.5).cast("decimal(2,1)")), "up": lambda: F.ceil(steps), "down": lambda: F.floor(steps)}
    seen = x if rounding is None else (whole[rounding]().cast("decimal(26,0)") * unit).cast("decimal(38,12)")
    hit = F.when(operator == "above", seen > level).when(operator == "at_least", seen >= level).when(operator == "below", seen < level).when(operator == "at_most", seen <= level).when(operator == "equal", seen == level)
    return hit.cast("int")


def bounded_features(price: Column, families: list[str], family: Column) -> Column:
    """struct(variance, edge, one of each family, refusal): p(1-p), min(p,1-p) and indicators; a price outside [0, 1] is refused and leaves them null."""
    refusal = F.when(price.isNull() | (price < 0) | (price > 1), "price_outside_unit_interval")
    ok = refusal.isNull()
    return F.struct(F.when(ok, price_variance(price)).alias("variance"), F.when(ok, edge_distance(price)).alias("edge"), *[F.when(ok, (family == f).cast("int")).alias(f"is_{f}") for f in families], refusal.alias("refusal"))


def depth(bid_size: Column, ask_size: Column) -> Column:
    """Size at the top of a book: the sum of the known sides, null where neither is."""
    return F.when(bid_size.isNotNull() | ask_size.isNotNull(), F.coalesce(bid_size, F.lit(0)) + F.coalesce(ask_size, F.lit(0)))


def fill_cost(levels: Column, quantity: Column) -> Column:
    """Cost of taking quantity from array<struct<price, size>>, best first; null where the depth does not suffice."""
    start = F.struct(quantity.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def step(acc: Column, x: Column) -> Column:
        take = F.least(acc["left"], x["size"].cast("double"))
        return F.struct((acc["left"] - take).alias("left"), (acc["cost"] + take * x["price"].cast("double")).alias("cost"))

    return F.aggregate(levels, start, step, lambda acc: F.when(acc["left"] <= 1e-12, acc["cost"]))


def outcome_class(lower: Column, upper: Column, relevant: float, null_value: float = 0.0) -> Column:
    """What an interval says: evidence for an effect, a bound that excludes a relevant one, or nothing."""
    return F.when(lower.isNull() | upper.isNull(), "inconclusive").when((lower > null_value) | (upper < null_value), "evidence_for").when((lower > null_value - relevant) & (upper < null_value + relevant), "informative_bound").otherwise("inconclusive")
