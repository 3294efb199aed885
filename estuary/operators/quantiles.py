"""Exact order statistics and quantiles in bounded memory, by refining histograms: no task holds or sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS, FEW, MOST_GROUPS = 1024, 4096, 100_000


def _joined(df: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """df beside the state of its group; groups are sent to every executor if they are at most MOST_GROUPS, else shuffled."""
    if not by:
        return df.crossJoin(F.broadcast(state))  # a row for each target, of which there are a few
    return df.join(F.broadcast(state) if state.count() <= MOST_GROUPS else state, by)


def order_statistics(df: DataFrame, value: str, targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, value): the k-th smallest value (from 0) of each group, for targets (by, i, k). Nulls and NaN do not count; a k beyond the group gives no row.

    Each pass counts a target's interval in BINS equal parts, map-side first, and keeps the part that holds its rank, until few values or a
    single one are left; those are ranked.
    """
    x = F.col("_x")
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).where(x.isNotNull() & ~F.isnan("_x"))
    ends = rows.groupBy(*by).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("n"))
    state = (targets.join(ends, by) if by else targets.crossJoin(F.broadcast(ends))).where("k < n and k >= 0").withColumn("skip", F.lit(0).cast("long"))
    return _refined(rows, state, by)


def _refined(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Rounds of refinement; the state is one row a target and is rebuilt from plain values, so no lineage grows."""
    spark, keys = rows.sparkSession, [*by, "i"]
    names = [*keys, "k", "lo", "hi", "n", "skip"]
    schema = state.select(*names).schema
    held = state.select(*names)
    small = held.count() <= MOST_GROUPS
    for _ in range(64):
        if small:
            held = spark.createDataFrame(held.collect(), schema)  # at most MOST_GROUPS targets
        wide = held.where((F.col("n") > FEW) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        width = (F.col("hi") - F.col("lo")) / BINS
        inside = _joined(rows, wide, by).where((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi")))
        bin_of = F.least(F.floor((F.col("_x") - F.col("lo")) / width), F.lit(BINS - 1)).cast("long")
        counted = inside.groupBy(*keys, "k", "skip", bin_of.alias("bin")).agg(F.count("*").alias("c"), F.min("_x").alias("l"), F.max("_x").alias("h"))
        order = W.partitionBy(*keys).orderBy("bin")
        running = counted.withColumn("upto", F.col("skip") + F.sum("c").over(order))
        chosen = running.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k")))
        narrowed = chosen.select(*keys, "k", F.col("l").alias("lo"), F.col("h").alias("hi"), F.col("c").alias("n"), (F.col("upto") - F.col("c")).alias("skip"))
        held = held.where(~((F.col("n") > FEW) & (F.col("lo") < F.col("hi")))).unionByName(narrowed)
    done = held.where("lo = hi").select(*keys, F.col("lo").alias("value"))
    few = _joined(rows, held.where("lo < hi"), by).where((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi")))
    placed = few.withColumn("at", F.col("skip") + F.row_number().over(W.partitionBy(*keys).orderBy("_x")) - 1).where("at = k")
    return done.unionByName(placed.select(*keys, F.col("_x").alias("value")))


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] = ()) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles, linear between the two values beside the rank; a group without a value has no row."""
    by = list(by)
    x = F.col(value).cast("double")
    n = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 0")
    at = [F.lit(p) * (F.col("_n") - 1) for p in probabilities]
    ranks = F.array(*[F.struct(F.lit(2 * j + side).alias("i"), F.least(F.floor(a) + side, F.col("_n") - 1).cast("long").alias("k")) for j, a in enumerate(at) for side in (0, 1)])
    found = order_statistics(df, value, n.select(*by, F.explode(ranks).alias("r")).select(*by, "r.i", "r.k"), by)
    sides = found.groupBy(*by).agg(*[F.max(F.when(F.col("i") == 2 * j + side, F.col("value"))).alias(f"_{j}_{side}") for j in range(len(probabilities)) for side in (0, 1)])
    joined = n.join(sides, by) if by else n.crossJoin(F.broadcast(sides))  # one row each
    out = [(F.col(f"_{j}_0") + (a - F.floor(a)) * (F.col(f"_{j}_1") - F.col(f"_{j}_0"))).alias(f"q{j}") for j, a in enumerate(at)]
    return joined.select(*by, *out)
