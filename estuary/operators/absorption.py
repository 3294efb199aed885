"""Absorption paths: how soon a response reaches its final level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def crossing(points: Column, fraction: float) -> Column:
    """Struct(at, bound): first horizon where the share reaches fraction, linear between horizons. points: ordered array<struct<h, a>>.

    Beyond it at the first horizon already, at is null and bound that horizon."""
    first = points[0]
    pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda x, y: F.struct(x["h"].alias("h0"), x["a"].alias("a0"), y["h"].alias("h1"), y["a"].alias("a1")))
    hits = F.filter(pairs, lambda p: p["a1"] >= fraction - TOLERANCE)
    hit = F.try_element_at(hits, F.lit(1))
    exact = F.abs(hit["a1"] - fraction) <= TOLERANCE
    between = hit["h0"] + (fraction - hit["a0"]) / (hit["a1"] - hit["a0"]) * (hit["h1"] - hit["h0"])
    at = F.when(F.abs(first["a"] - fraction) <= TOLERANCE, first["h"].cast("double")).when(first["a"] > fraction, F.lit(None).cast("double")).when(exact, hit["h1"].cast("double")).otherwise(between)
    return F.struct(at.alias("at"), F.when(first["a"] > fraction + TOLERANCE, first["h"]).alias("bound"))


def absorption(panel: DataFrame, keys: list[str], horizon: str, response: str, terminal: int) -> DataFrame:
    """One row for each pair: half and ninety per cent times, drawdown, steps back and overshoot of response(h) / response(terminal).

    Refusals in order: no terminal horizon declared, terminal unobserved, no final response. A horizon that repeats refuses its pair."""
    path = F.array_sort(F.collect_list(F.struct(F.col(horizon).alias("h"), F.col(response).alias("r"))))
    rows = panel.where(F.col(horizon) <= terminal).groupBy(*keys).agg(path.alias("path"), F.count("*").alias("n"), F.count_distinct(horizon).alias("hs"), F.max(F.when(F.col(horizon) == terminal, F.col(response))).alias("final"), F.count_if(F.col(horizon) == terminal).alias("declared"))
    refusal = F.when(F.col("n") != F.col("hs"), "duplicate_horizon").when(F.col("declared") == 0, "terminal_undeclared").when(F.col("final").isNull(), "terminal_unobserved").when(F.col("final") == 0, "no_terminal_response")
    seen = F.transform(F.filter("path", lambda x: x["r"].isNotNull()), lambda x: F.struct(x["h"].alias("h"), (x["r"] / F.col("final")).alias("a")))
    rows = rows.withColumn("refusal", refusal).withColumn("points", F.when(F.col("refusal").isNull(), seen))
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("draw"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("back"))

    def step(acc: Column, x: Column) -> Column:
        top = F.greatest(acc["top"], x["a"])
        return F.struct(top.alias("top"), F.greatest(acc["draw"], top - x["a"]).alias("draw"), x["a"].alias("last"), (acc["back"] + F.when(x["a"] < acc["last"] - TOLERANCE, 1).otherwise(0)).alias("back"))

    walk = F.aggregate("points", start, step)
    rows = rows.withColumn("_w", walk).withColumn("_50", F.when(F.size("points") > 0, crossing(F.col("points"), 0.5))).withColumn("_90", F.when(F.size("points") > 0, crossing(F.col("points"), 0.9)))
    return rows.select(*keys, "refusal", F.col("_50.at").alias("h50"), F.col("_50.bound").alias("h50_bound"), F.col("_90.at").alias("h90"), F.col("_w.draw").alias("drawdown"), F.col("_w.back").alias("steps_back"), (F.col("_w.top") > 1 + TOLERANCE).alias("overshoot"))


def median_of_medians(paths: DataFrame, cluster: str, value: str) -> DataFrame:
    each = paths.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.median(value).alias("m"), F.count("*").alias("n"))
    return each.agg(F.median("m").alias("median"), F.count("*").alias("clusters"), F.sum("n").alias("paths"))
