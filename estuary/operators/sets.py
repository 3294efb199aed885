"""Unions with precedence, occurrences, gaps and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry


def union_by_precedence(layers: list[tuple[str, DataFrame]], key: str, columns: list[str]) -> DataFrame:
    """One row for each key over ordered layers: an earlier layer's value stands, later ones fill nulls only; seen_<layer> and origin tell
    where it occurs. Within a layer, repeated keys merge alike, in the order of their values."""
    tagged = None
    for i, (name, df) in enumerate(layers):
        rows = df.select(F.lit(i).alias("_layer"), key, *columns).where(F.col(key).isNotNull())
        tagged = rows if tagged is None else tagged.unionByName(rows)
    merged = tagged.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_layer", F.col(c)))).alias(c) for c in columns], *[F.bool_or(F.col("_layer") == i).alias(f"seen_{name}") for i, (name, _) in enumerate(layers)])
    names = F.filter(F.array(*[F.when(F.col(f"seen_{n}"), F.lit(n)) for n, _ in layers]), lambda x: x.isNotNull())
    return merged.withColumn("origin", F.when(F.size(names) == 1, F.concat(names[0], F.lit("_only"))).otherwise(F.array_join(names, "_and_")))


def first_occurrences(records: DataFrame, identity: list[str], order: list[str], content: list[str]) -> DataFrame:
    """The first record (by order) of each occurrence, with how often it came and whether its content conflicts. Position or
    provenance is the identity; equal content is no reason to merge. A hot identity is merged map-side."""
    rest = [c for c in records.columns if c not in identity]
    digest = F.xxhash64(*content)
    return records.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("times"), (F.min(digest) != F.max(digest)).alias("conflict")).select(*identity, "_r.*", "times", "conflict")


def spacing(records: DataFrame, keys: list[str], at: str, step: int, bucket: int = 86_400_000_000) -> DataFrame:
    """Gaps of a grid: each record's distance (delta) to the one before, whether it is off the grid, and how many stamps are missing between.

    Records are sorted within (keys, bucket of time); a bucket's first record finds the one before it in a summary of one row a bucket, so that a key is
    spread over its buckets. missing_stamps() lists the stamps."""
    slot = records.select(*keys, at).withColumn("_slot", F.floor(F.col(at) / bucket).cast("long"))
    near = slot.withColumn("_near", F.lag(at).over(W.partitionBy(*keys, "_slot").orderBy(at)))
    ends = slot.groupBy(*keys, "_slot").agg(F.max(at).alias("_last"))
    far = ends.withColumn("_far", F.lag("_last").over(W.partitionBy(*keys).orderBy("_slot"))).drop("_last")
    rows = near.join(far, [*keys, "_slot"], "left").withColumn("before", F.coalesce("_near", "_far")).withColumn("delta", F.col(at) - F.col("before"))
    off = F.col("delta").isNotNull() & ((F.col("delta") <= 0) | (F.col("delta") % step != 0))
    missing = F.when(~off & (F.col("delta") > step), F.floor(F.col("delta") / step) - 1).otherwise(0).cast("long")
    return rows.select(*keys, at, "before", "delta", off.alias("off_grid"), missing.alias("missing"))


def missing_stamps(spaced: DataFrame, keys: list[str], at: str, step: int) -> DataFrame:
    """(keys, stamp): every stamp that spacing() counts as missing, a row each."""
    gaps = spaced.where("missing > 0")
    return gaps.select(*keys, F.explode(F.sequence(F.col("before") + step, F.col(at) - step, F.lit(step).cast("long"))).alias("stamp"))


def window_ends(spaced: DataFrame, keys: list[str], at: str, step: int, start: int, end: int) -> DataFrame:
    """(keys, prefix, suffix, usable): stamps missing before the first and after the last record of a requested window, and whether the series
    has no hole, no stamp off the grid and reaches both ends."""
    ends = spaced.groupBy(*keys).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.sum("missing").alias("holes"), F.count_if("off_grid").alias("off"))
    prefix, suffix = (F.floor(F.greatest(x, F.lit(0)) / step).cast("long") for x in (F.col("lo") - start, F.lit(end) - F.col("hi")))
    return ends.select(*keys, prefix.alias("prefix"), suffix.alias("suffix"), ((prefix == 0) & (suffix == 0) & (F.col("holes") == 0) & (F.col("off") == 0)).alias("usable"))


def unordered_pairs(rows: DataFrame, group: list[str], order: Column, prefix: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """All pairs a before b of each group. Groups are quotes of one asset at one time and hence small; the shuffle is on the group."""
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(order)))
    own = [c for c in rows.columns if c not in group]
    a = ranked.select(*group, F.col("_rn").alias("_a"), *[F.col(c).alias(prefix[0] + c) for c in own])
    b = ranked.select(*group, F.col("_rn").alias("_b"), *[F.col(c).alias(prefix[1] + c) for c in own])
    return a.join(b, group).where("_a < _b").drop("_a", "_b")


def funding_differentials(quotes: DataFrame, group: list[str]) -> DataFrame:
    """quotes (group, venue, symbol, rate, apr, hours, paid_30d, order): pairs of quotes with a known yearly figure, long the lower one.

    apr_spread >= 0; per_hour only where both intervals are known; settled_30d only where both were paid. Ties keep the order."""
    known = quotes.where(F.col("apr").isNotNull())
    pairs = unordered_pairs(known, group, F.struct("apr", "order"), ("long_", "short_")).where((F.col("long_venue") != F.col("short_venue")) | (F.col("long_symbol") != F.col("short_symbol")))
    return pairs.withColumn("apr_spread", F.col("short_apr") - F.col("long_apr")).withColumn("per_hour", F.col("short_rate") / F.col("short_hours") - F.col("long_rate") / F.col("long_hours")).withColumn("settled_30d", F.col("short_paid_30d") - F.col("long_paid_30d"))


def cross_venue_basis(quotes: DataFrame, group: list[str]) -> DataFrame:
    """ln(high) - ln(low) of each pair of positive prices."""
    pairs = unordered_pairs(quotes.where("price > 0"), group, F.struct("price", "order"), ("low_", "high_"))
    return pairs.withColumn("basis", F.log("high_price") - F.log("low_price"))


MOST_MEETINGS = 10_000


def neighbor_edges(contracts: DataFrame, calendar: DataFrame, match: list[str]) -> DataFrame:
    """receiver -> donor across the immediately preceding meeting, one row and one reason for each receiver.

    contracts (contract, date, *match, opened, closed, verified_from, verified_to), calendar (date, origin, window_end). First hit wins: the
    receiver not open at the origin, or not to the window's end, or its rule not verified for it; no earlier meeting; no contract
    there; none that matches; none open at both instants; none verified. Of those left the smallest id lends.
    """
    # The calendar has one row for each meeting; the meeting before is the largest earlier date, found by its neighbours alone.
    meetings = sorted(r["date"] for r in calendar.select("date").distinct().limit(MOST_MEETINGS + 1).collect())
    if len(meetings) > MOST_MEETINGS:
        raise ValueError(f"a calendar holds at most {MOST_MEETINGS} meetings")
    kind = calendar.schema["date"].dataType
    pairs = calendar.sparkSession.createDataFrame(list(zip(meetings, [None, *meetings[:-1]], strict=True)), f"date {kind.simpleString()}, previous {kind.simpleString()}")
    dates = calendar.join(pairs, "date")
    live = lambda: F.coalesce(F.col("opened") <= F.col("origin"), F.lit(False)) & F.coalesce(F.col("closed") > F.col("origin"), F.lit(True))
    through = lambda: F.coalesce(F.col("closed") > F.col("window_end"), F.lit(True))
    ruled = lambda: F.coalesce(F.col("verified_from") <= F.col("origin"), F.lit(False)) & F.coalesce(F.col("window_end") < F.col("verified_to"), F.lit(True))
    receivers = contracts.join(F.broadcast(dates), "date")
    # What a donor must be depends on the receiver's meeting only, so donors are summed by that meeting before receivers join, one to one.
    later = dates.where("previous is not null").select(F.col("date").alias("to"), F.col("previous").alias("date"), "origin", "window_end")
    lent = contracts.join(F.broadcast(later), "date")
    ok = live() & through()
    offers = lent.groupBy("to", *match).agg(F.count("*").alias("_same"), F.count_if(ok).alias("_live"), F.min(F.when(ok & ruled(), F.col("contract"))).alias("donor")).withColumnRenamed("to", "date")
    there = lent.groupBy(F.col("to").alias("date")).agg(F.count("*").alias("_there"))
    found = receivers.join(offers, ["date", *match], "left").join(F.broadcast(there), "date", "left")
    reason = (
        F.when(~live(), "receiver_not_open").when(~through(), "receiver_not_open_through_window").when(~ruled(), "receiver_rule_not_verified").when(F.col("previous").isNull(), "no_earlier_meeting")
        .when(F.col("_there").isNull(), "no_contract_at_previous_meeting").when(F.col("_same").isNull(), "no_matching_contract").when(F.col("_live") == 0, "donor_not_open").when(F.col("donor").isNull(), "donor_rule_not_verified")
    )
    return found.select("contract", "date", reason.alias("reason"), F.when(reason.isNull(), F.col("donor")).alias("donor"))


# Grades, the best first; components of a predicate, and those that must agree.
GRADES = ("EXACT", "ECONOMICALLY_EQUIVALENT", "APPROXIMATE", "REJECT")
COMPONENTS = ("underlying_event", "reference_period", "threshold", "operator", "settlement_criterion", "reference_horizon")
REQUIRED_COMPONENTS = ("underlying_event", "reference_period", "threshold", "operator")


def predicate_classes(predicates: DataFrame, components: list[str]) -> DataFrame:
    """(readable, unit, components, members, least): predicates that state the same, counted."""
    return predicates.groupBy("readable", "unit", *components).agg(F.count("*").alias("members"), F.min("id").alias("least"))


def graded_classes(left: DataFrame, right: DataFrame, components: list[str], required: list[str], tolerant: str, unit_scale: dict[str, float], join_on: str) -> DataFrame:
    """Grades of all pairs of two venues' predicates (id, readable, unit, *components) that agree in join_on, by classes of equal predicates.

    Returns grade, reasons and pairs, one row for each pair of classes, with the classes' least ids (left_id, right_id). An unreadable side rejects.
    Unobserved components and differing required ones reject; a ``tolerant`` number that is equal after its unit's scale makes the pair
    ECONOMICALLY_EQUIVALENT, other differences APPROXIMATE, none EXACT. Pairs that differ in join_on are rejected wholesale (rejected_wholesale counts
    them), so the join is an equi join of classes, and no pair of predicates is built.
    """
    scale = F.create_map(*[x for u, s in unit_scale.items() for x in (F.lit(u), F.lit(float(s)))])
    names = ["least", "members", "readable", "unit", *components]
    a, b = (predicate_classes(side, components).where(F.col(join_on).isNotNull()).select(*[F.col(c).alias(p + c) for c in names]) for side, p in ((left, "a_"), (right, "b_")))
    both = a.join(b, F.col("a_" + join_on) == F.col("b_" + join_on))

    def verdict(c: str) -> Column:
        x, y = F.col("a_" + c), F.col("b_" + c)
        same = (x == y) & (F.col("a_unit") == F.col("b_unit")) if c == tolerant else x == y
        out = F.when(x.isNull() | y.isNull(), "unobserved").when(same, "equal")
        if c == tolerant:
            out = out.when(F.abs(x * F.try_element_at(scale, F.col("a_unit")) - y * F.try_element_at(scale, F.col("b_unit"))) < 1e-9, "equivalent")
        return out.otherwise("differs")

    both = both.withColumns({"v_" + c: verdict(c) for c in components})
    bad = F.filter(F.array(F.when(~(F.col("a_readable") & F.col("b_readable")), "unreadable"), *[F.when(F.col("v_" + c) == "unobserved", F.lit(c + "_unobserved")) for c in components], *[F.when(F.col("v_" + c) == "differs", F.lit(c + "_differs")) for c in required]), lambda r: r.isNotNull())
    differs = F.lit(False)
    for c in components:
        differs = differs | (F.col("v_" + c) == "differs")
    grade = F.when(F.size(bad) > 0, "REJECT").when(F.col("v_" + tolerant) == "equivalent", "ECONOMICALLY_EQUIVALENT").when(differs, "APPROXIMATE").otherwise("EXACT")
    return both.select(F.col("a_least").alias("left_id"), F.col("b_least").alias("right_id"), grade.alias("grade"), F.array_join(bad, ",").alias("reasons"), (F.col("a_members") * F.col("b_members")).alias("pairs"))


def registry_counts(graded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs by grade, pairs by reason) of graded_classes()."""
    by_reason = graded.where("reasons != ''").select(F.explode(F.split("reasons", ",")).alias("reason"), "pairs")
    return graded.groupBy("grade").agg(F.sum("pairs").alias("pairs")), by_reason.groupBy("reason").agg(F.sum("pairs").alias("pairs"))


def rejected_wholesale(left: DataFrame, right: DataFrame, graded: DataFrame) -> int:
    """Pairs that differ in what graded_classes() joins on: all pairs less those that it graded."""
    return left.count() * right.count() - (graded.agg(F.sum("pairs")).first()[0] or 0)


def distinct_names(df: DataFrame, name: str, key: str, pattern: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (name, key) whose name matches, sorted, at most limit; and the names with several keys, of which there must be none."""
    pairs = df.select(name, key).where(F.col(name).isNotNull() & F.col(key).isNotNull() & F.col(name).rlike(pattern)).distinct()
    clashes = pairs.groupBy(name).agg(F.count_distinct(key).alias("keys")).where("keys > 1")
    return pairs.orderBy(name, key).limit(limit), clashes


def implied_interval(df: DataFrame) -> DataFrame:
    """Adds interval_hours and interval_refusal to quotes with rate, apr, window_days and settlements."""
    x = geometry.funding_interval(F.col("rate"), F.col("apr"), F.col("window_days"), F.col("settlements"))
    return df.withColumn("_i", x).withColumn("interval_hours", F.col("_i.hours")).withColumn("interval_refusal", F.col("_i.refusal")).drop("_i")
