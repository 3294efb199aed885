"""As-of and event-window joins that shuffle on bounded keys and sort nothing globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_join(records: DataFrame, events: DataFrame, time: str, at: str, before: int, after: int, keys: list[str], bucket: int | None = None) -> DataFrame:
    """records joined to events of equal keys with time in [at - before, at + after]; times are microseconds.

    Each event is listed under the time buckets its window covers, so the join is an equi join on (keys, bucket) and a
    busy key is spread over its buckets.
    """
    size = bucket or max(1, before + after)
    slots = F.sequence(F.floor((F.col(at) - before) / size).cast("long"), F.floor((F.col(at) + after) / size).cast("long"))
    spread = events.withColumn("_bucket", F.explode(slots))
    left = records.withColumn("_bucket", F.floor(F.col(time) / size).cast("long"))
    return left.join(spread, [*keys, "_bucket"]).where((F.col(time) >= F.col(at) - before) & (F.col(time) <= F.col(at) + after)).drop("_bucket")


def asof_last(probes: DataFrame, records: DataFrame, keys: list[str], at: str, time: str, tie: str, carry: list[str], strict: bool = False, bucket: int = 86_400_000_000) -> DataFrame:
    """Each probe with the latest record of its keys at or before (strictly before) its time; ties to the largest tie.

    Probes and records of a (keys, time bucket) are merged in one sort and the last record is carried forward; what reaches a bucket from
    earlier ones is carried over a summary with one row a bucket. So a key that holds a third of all rows is sorted in as many tasks as it
    has buckets. Records without a time never match; probes without a match, or without a time, keep nulls.
    """
    held = F.struct(F.col(time).alias("time"), F.col(tie).alias("tie"), *[F.col(c).alias(c) for c in carry])
    slot = F.floor(F.col("_at") / bucket).cast("long").alias("_slot")
    a = records.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"), held.alias("_held")).select("*", slot)
    b = probes.select(*keys, F.col(at).alias("_at"), F.lit(0 if strict else 2).alias("_kind"), F.lit(None).cast(records.schema[tie].dataType).alias("_tie"), F.struct(*[F.col(c) for c in probes.columns]).alias("_probe")).select("*", slot)
    both = a.unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(*keys, "_slot").orderBy("_at", "_kind", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("_near", F.last("_held", ignorenulls=True).over(order)).where(F.col("_probe").isNotNull()).select(*keys, "_slot", "_probe", "_near")
    ends = both.groupBy(*keys, "_slot").agg(F.max_by("_held", F.when(F.col("_held").isNotNull(), F.struct("_at", "_tie"))).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    far = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slot").alias("_s"), F.when(F.col("_slot").isNotNull(), F.last("_end", ignorenulls=True).over(before)).alias("_far"))
    same = F.col("_slot").eqNullSafe(F.col("_s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    last = near.join(far, same, "left").select("_probe", F.coalesce("_near", "_far").alias("_last"))
    return last.select("_probe.*", F.col("_last.time").alias("matched_time"), F.col("_last.tie").alias("matched_id"), *[F.col(f"_last.{c}").alias(f"matched_{c}") for c in carry])


def latest_by_key(records: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The record of the largest (time, tie) of each key; unknown times lose to all others. Summed map-side, so a hot key is no burden."""
    rank = F.struct(F.col(time).isNotNull().alias("known"), F.col(time), F.col(tie))
    return records.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in records.columns if c not in keys]), rank).alias("_r")).select(*keys, "_r.*")


def tie_groups(records: DataFrame, keys: list[str], time: str, value: str, tie: str | None = None, axis: str | None = None) -> DataFrame:
    """One row for each keys and time: records at one instant are one observation. mean is null if any value is.

    ids (if tie is named) are the members' ids, ordered. axes (if axis is named) is struct(low, high, unset): the least and greatest axis among the
    members and how many have none, which tells whether they share one without a set of them."""
    known = F.count(value) == F.count("*")
    more = [F.array_sort(F.collect_set(tie)).alias("ids")] if tie else []
    if axis:
        more.append(F.struct(F.min(axis).alias("low"), F.max(axis).alias("high"), F.count_if(F.col(axis).isNull()).alias("unset")).alias("axes"))
    return records.groupBy(*keys, time).agg(F.when(known, F.avg(value)).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("members"), *more)


def last_group(groups: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The latest tie group of keys, and the members of all of them."""
    kept = F.struct(F.col(time).alias("time"), *[c for c in groups.columns if c not in keys and c not in (time, "members")])
    return groups.groupBy(*keys).agg(F.max_by(kept, F.col(time)).alias("g"), F.sum("members").alias("members")).select(*keys, "g.*", "members")


def open_during(opened: Column, closed: Column, start: Column, end: Column) -> Column:
    """Whether a contract is open from start to end: opened by start, and not closed by end. An unknown opening fails, an unknown close does not."""
    return F.coalesce(opened <= start, F.lit(False)) & F.coalesce(closed > end, F.lit(True))


def overlaps_any(windows: Column, start: Column, end: Column) -> Column:
    """Whether any struct(start, end) of an array meets [start, end]."""
    return F.exists(windows, lambda w: (w["start"] <= end) & (w["end"] >= start))


# Why a record is not admitted as a feature, in order.
FEATURE_REASONS = ("no_record", "usable_time_unknown", "not_yet_available", "last_verified_unknown", "last_verified_after_asof_time", "stale_last_verified", "invalid_record")


def features_asof(records: DataFrame, probes: DataFrame, keys: list[str], at: str, max_age: int) -> DataFrame:
    """The latest record by time of each key at each probe, admissible or not: an invalid latest is never passed over for an older valid one.

    records (keys, record_id, time, usable_time, last_verified, valid, value). Reasons in order.
    """
    from ..functions.masking import masked

    found = asof_last(probes, records, keys, at, "time", "record_id", ["usable_time", "last_verified", "valid", "value"])
    t = F.col(at)
    held = F.col("matched_time").isNotNull()
    conditions = (
        ~held, held & F.col("matched_usable_time").isNull(), F.col("matched_usable_time") > t, held & F.col("matched_last_verified").isNull(), F.col("matched_last_verified") > t, F.col("matched_last_verified") <= t - max_age,
        ~F.col("matched_valid"),
    )
    return masked(found, list(zip(conditions, FEATURE_REASONS, strict=True)), ["matched_value"])
