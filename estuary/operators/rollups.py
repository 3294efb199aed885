"""Counts and summaries of what was built: cards, coverage, receipts, spreads, overlaps, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles


def forecast_counts(rows: DataFrame, receiver: str = "contract") -> DataFrame:
    """One row: rows, valid ones, those with a target and with a neighbour's lag, and distinct receivers and events."""
    return rows.agg(
        F.count("*").alias("rows"), F.count_if("valid").alias("valid_rows"), F.count("target").alias("rows_with_target"), F.count("neighbor_lag").alias("rows_with_neighbor_lag"), F.count_distinct(receiver).alias("receivers"),
        F.count_distinct("event_id").alias("events"),
    )


def event_cards(panel: DataFrame, declared: tuple[int, ...]) -> DataFrame:
    """By event and horizon: whether the horizon is declared, rows, valid rows, and how many valid rows have a response, with its mean, least and largest."""
    shown = F.when(F.col("valid"), F.col("response"))
    cards = panel.groupBy("event_id", "horizon").agg(F.count("*").alias("rows"), F.count_if("valid").alias("valid_rows"), F.count(shown).alias("responses"), F.avg(shown).alias("mean"), F.min(shown).alias("low"), F.max(shown).alias("high"))
    return cards.withColumn("declared", F.col("horizon").isin(*declared))


def categorical_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows) for each value of each named column, in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(each).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("rows"))


def missing_cells(present: DataFrame, units: DataFrame, horizons: DataFrame, keys: list[str]) -> DataFrame:
    """Declared cells (every unit at every horizon) that present (keys) lacks. Horizons are a handful of declared rows."""
    return units.crossJoin(F.broadcast(horizons)).select(*keys).join(present.select(*keys), keys, "left_anti")


def receipt_quality(receipts: DataFrame, blobs: DataFrame) -> DataFrame:
    """(source, status, receipts, failed, bytes, schema_missing) of receipts (source, raw_hash, status, schema_version), held against blobs (raw_hash, bytes, intact). A
    receipt without a usable hash, without a blob, or with one whose bytes changed, fails; only verified ones count bytes."""
    held = receipts.join(blobs.select(F.col("raw_hash").alias("_h"), "bytes", "intact"), F.col("raw_hash") == F.col("_h"), "left")
    fine = F.coalesce(F.col("raw_hash").rlike("^[0-9a-f]{64}$") & F.col("intact"), F.lit(False))
    return held.groupBy("source", F.coalesce(F.col("status").cast("string"), F.lit("unrecorded")).alias("status")).agg(
        F.count("*").alias("receipts"), F.count_if(~fine).alias("failed"), F.coalesce(F.sum(F.when(fine, F.col("bytes"))), F.lit(0)).alias("bytes"), F.count_if(F.col("schema_version").isNull()).alias("schema_missing")
    )


def orphans(blobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Blobs that no receipt names."""
    return blobs.join(receipts.select("raw_hash"), "raw_hash", "left_anti")


def spacing_summary(moments: DataFrame, at: str, by: list[str] = (), bucket: int = 86_400_000_000) -> DataFrame:
    """(by, intervals, least, middle, most): spacing of consecutive instants; a single instant has none. Neighbours are found within time buckets and, between
    them, from one row a bucket."""
    known = moments.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_t")).withColumn("_slot", F.floor(F.col("_t") / bucket))
    near = known.withColumn("_near", F.lag("_t").over(W.partitionBy(*by, "_slot").orderBy("_t")))
    ends = known.groupBy(*by, "_slot").agg(F.max("_t").alias("_last"))
    earlier = W.partitionBy(*by).orderBy("_slot") if by else W.orderBy("_slot")  # one row a bucket
    far = ends.withColumn("_far", F.lag("_last").over(earlier)).drop("_last")
    deltas = near.join(far, [*by, "_slot"]).withColumn("delta", F.col("_t") - F.coalesce("_near", "_far")).where("delta is not null")
    middle = quantiles(deltas, "delta", [0.5], by).withColumnRenamed("q0", "middle")
    sums = deltas.groupBy(*by).agg(F.count("*").alias("intervals"), F.min("delta").alias("least"), F.max("delta").alias("most"))
    return sums.join(middle, list(by)) if by else sums.crossJoin(F.broadcast(middle))  # one row each


def fidelity(spaced: DataFrame, requested: int, by: list[str]) -> DataFrame:
    """(by, deltas, finer, equal, coarser) of sets.spacing() rows against a requested spacing."""
    d = F.col("delta")
    return spaced.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("deltas"), F.count_if(d < requested).alias("finer"), F.count_if(d == requested).alias("equal"), F.count_if(d > requested).alias("coarser"))


def trailing_spread(quotes: DataFrame, at: str, spread: str, window: int, by: list[str]) -> DataFrame:
    """(by, n, low, middle, high, mean) of known spreads in the window that ends at the latest instant of all."""
    last = quotes.agg(F.max(at).alias("_z"))
    near = quotes.crossJoin(F.broadcast(last)).where((F.col(at) > F.col("_z") - window) & F.col(spread).isNotNull())  # last is one row
    ends = near.groupBy(*by).agg(F.count("*").alias("n"), F.min(spread).alias("low"), F.max(spread).alias("high"), F.avg(spread).alias("mean"))
    return ends.join(quantiles(near, spread, [0.5], by).withColumnRenamed("q0", "middle"), by)


def box_overlap(quotes: DataFrame, bid: str, ask: str, by: list[str]) -> DataFrame:
    """(by, best_bid, best_ask, feasible, crossed): whether some price lies in all boxes [bid, ask], and how many boxes are crossed themselves."""
    return quotes.groupBy(*by).agg(F.max(bid).alias("best_bid"), F.min(ask).alias("best_ask"), (F.max(bid) <= F.min(ask)).alias("feasible"), F.count_if(F.col(bid) > F.col(ask)).alias("crossed"))


def spread_stability(differentials: DataFrame, spread: str, build: str, by: list[str]) -> DataFrame:
    """(by, rows, builds, low, middle, high, sign_stable): spreads over builds, and whether they never change their sign (zero has none)."""
    sign = F.when(F.col(spread) != 0, F.signum(spread))
    ends = differentials.where(F.col(spread).isNotNull()).groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(build).alias("builds"), F.min(spread).alias("low"), F.max(spread).alias("high"), (F.coalesce(F.min(sign) == F.max(sign), F.lit(True))).alias("sign_stable"))
    return ends.join(quantiles(differentials, spread, [0.5], by).withColumnRenamed("q0", "middle"), by)


def origin_counts(union: DataFrame, origin: str = "origin") -> DataFrame:
    """Rows by origin; counts that do not add up to the union raise, as a row then has no origin."""
    counts = union.groupBy(origin).agg(F.count("*").alias("rows"))
    if counts.where(F.col(origin).isNull()).count():
        raise ValueError("rows without an origin")
    return counts


def multiplicity(rows: DataFrame, cluster: str) -> DataFrame:
    """rows with cluster_rows and weight, one divided by the rows of the row's cluster; counted map-side and joined, so that a hot cluster is no window."""
    counts = rows.groupBy(F.col(cluster).alias("_c")).agg(F.count("*").alias("cluster_rows"))
    return rows.join(counts, F.col(cluster).eqNullSafe(F.col("_c"))).drop("_c").withColumn("weight", 1.0 / F.col("cluster_rows"))


def settled_from(curve: DataFrame, by: list[str], at: str, value: str, band: float) -> DataFrame:
    """(by, settled, overshoot): the first point after which the curve stays within band of its end, and whether it ever goes beyond its end, seen from its start, by
    more than band. A curve is a handful of horizons."""
    w = W.partitionBy(*by).orderBy(at)
    rest, whole = w.rowsBetween(W.currentRow, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    end, start = F.last(value).over(whole), F.first(value).over(whole)
    r = curve.withColumns({"_end": end, "_start": start}).withColumn("_far", F.abs(F.col(value) - F.col("_end")))
    r = r.withColumn("_rest", F.max("_far").over(rest)).withColumn("_beyond", (F.col(value) - F.col("_end")) * F.signum(F.col("_end") - F.col("_start")) > band)
    return r.groupBy(*by).agg(F.min(F.when(F.col("_rest") <= band, F.col(at))).alias("settled"), F.coalesce(F.bool_or("_beyond"), F.lit(False)).alias("overshoot"))


def shared_by_all(layers: list[DataFrame], key: str) -> DataFrame:
    """Keys that every layer holds."""
    out = layers[0].select(key)
    for other in layers[1:]:
        out = out.intersect(other.select(key))
    return out


def absorption_summary(paths: DataFrame, cluster: str, columns: tuple[str, ...] = ("h50", "h90")) -> DataFrame:
    """One row: paths, refused ones, and for each column the median of clusters' medians with the number of clusters and paths behind it."""
    out = paths.agg(F.count("*").alias("paths"), F.count_if(F.col("refusal").isNotNull()).alias("refused"))
    for c in columns:
        each = quantiles(paths, c, [0.5], [cluster])
        known = paths.agg(F.count(c).alias(f"{c}_paths"))
        middle = quantiles(each, "q0", [0.5]).withColumnRenamed("q0", c)
        out = out.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(each.agg(F.count("*").alias(f"{c}_clusters")))).join(F.broadcast(middle), F.lit(True), "left")  # one row each
    return out


def refusal_counts(paths: DataFrame, refusal: str = "refusal") -> DataFrame:
    return paths.where(F.col(refusal).isNotNull()).groupBy(refusal).agg(F.count("*").alias("paths"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null of nothing."""
    return F.try_divide(part, whole)
