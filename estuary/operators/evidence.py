"""What admits a record as evidence: expectations, rule intervals, readiness of releases, series of one policy rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masking

# Units by the ending of a statistic's name, the first that fits; routes of expectations; refusals in order.
UNIT_OF_ENDING = {
    "_index_level": "index_level", "_thousands": "thousands_of_count", "_jobs": "count", "_hours": "hours", "_usd": "usd",
    "_mom_pct": "percent_change", "_yoy_pct": "percent_change", "_rate_pct": "percent", "_pct": "percent_change",
}
EXPECTATION_REFUSALS = (
    "recorded_evidence_bytes_could_not_be_read",
    "evidence_bytes_do_not_match_the_recorded_digest",
    "source_kind_is_not_an_admissible_route",
    "market_implied_expectation_cannot_validate_the_market",
    "consensus_identity_is_not_named",
    "verification_method_is_not_named",
    "expectation_published_at_or_after_the_release",
    "expectation_targets_a_revised_actual_not_the_first_print",
    "statistic_is_not_declared_by_the_release",
    "reference_period_does_not_match_the_release",
    "release_declares_no_unit_for_the_statistic",
    "unit_does_not_match_the_release_statistic",
)
ROUTES = ("licensed_consensus", "archived_forecast", "market_implied")
# What marks a series of the policy rate, and what excludes one.
POLICY_HOST = "federalreserve.gov"
POLICY_CATEGORY = "economics"
POLICY_TITLE = "fomc|fed funds|federal funds|policy interest rate|interest rate decision|rate decision|fed meeting|fed rate|rate cut|rate hike"
POLICY_EXCLUSIONS = {
    "fed_personnel_or_nomination": r"fed chair|fed board|fed governor|fed vice|fed nominee|fed nom|senate.*vote for.*fed|confirmed as fed|to chair the .*fomc",
    "fed_communication_or_mention": r"fed tweet|fed mention|fed dissent|dot plot|fedwatch",
    "foreign_or_non_us_inflation": r"brazil|argentina|china|cpi in china|canada|euro|eu |france|italy|japan|uk |britain|iran|hungary|sweden|poland|czech|swiss|norway|turkey|india|indonesia|korea|australia|mexico|israel|zealand|south africa",
}


def declared_unit(statistic: Column) -> Column:
    """The unit that a statistic's own name states, or null."""
    return F.coalesce(*[F.when(statistic.endswith(end), F.lit(unit)) for end, unit in UNIT_OF_ENDING.items()])


def validated_expectations(records: DataFrame, releases: DataFrame, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """Records with refusals, refusal (the first) and valid; a refused record's value is null.

    records: event_id, statistic, value, unit, source_kind, consensus_id, verified_by, published_at, revision_status, reference_period,
    evidence_sha256 (as recorded) and evidence (the bytes held, or null). releases, one row an event: event_id, release_time,
    release_period, statistics and revised_statistics (arrays). A record of no known release names a statistic nobody declares.
    """
    facts = releases.select("event_id", "release_time", "release_period", "statistics", "revised_statistics")
    j, c = records.join(facts, "event_id", "left"), F.col

    def missing(x: Column) -> Column:
        return F.coalesce(F.trim(x) == "", F.lit(True))

    unit = declared_unit(c("statistic"))
    declared = F.coalesce(F.array_contains("statistics", c("statistic")), F.lit(False))
    revised_only = ~declared & F.coalesce(F.array_contains("revised_statistics", c("statistic")), F.lit(False))
    conditions = (
        c("evidence").isNull(),
        ~F.sha2("evidence", 256).eqNullSafe(c("evidence_sha256")),
        ~F.coalesce(c("source_kind").isin(*routes), F.lit(False)),
        c("source_kind") == "market_implied",
        missing(c("consensus_id")),
        missing(c("verified_by")),
        ~F.coalesce(c("published_at") < c("release_time"), c("release_time").isNull()),
        ~c("revision_status").eqNullSafe(F.lit("initial")) | revised_only,
        ~declared & ~revised_only,
        ~c("reference_period").eqNullSafe(c("release_period")),
        unit.isNull(),
        ~c("unit").eqNullSafe(unit),
    )
    ladder = list(zip(conditions, EXPECTATION_REFUSALS, strict=True))
    out = masking.masked(j, ladder, ["value"]).drop("release_time", "release_period", "statistics", "revised_statistics")
    return out.withColumnsRenamed({"exclusion_reasons": "refusals", "exclusion_reason": "refusal"})


def attested_rules(captures: DataFrame, wanted: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row a contract: in_force_from, in_force_to (null: open), rule_digest, basis and refusal.

    captures: contract_id, capture_id, body (bytes held), raw_hash (as recorded), source_kind, rule_text, settlement, captured_at,
    stated_from, stated_to (an interval that the document itself states) and observed_at (an instant that its source dates). A capture is
    admissible if its bytes hash to what was recorded, its kind is among ``kinds`` (if any are given), and text and settlement are not
    empty. Stated intervals win over observations; two different ones are ambiguous, one that ends where it starts is empty. Observed
    ones run from the first sight of the wanted text (``wanted``: contract_id, rule_digest; else the earliest) to the first later sight
    of another. All of it is two aggregates by contract, so a contract of many captures is never gathered.
    """
    c = F.col
    fit = (F.sha2("body", 256) == c("raw_hash")) & (F.trim("rule_text") != "") & (F.trim("settlement") != "")
    if kinds:
        fit = fit & c("source_kind").isin(*kinds)
    at = F.coalesce("stated_from", "observed_at")
    seen = captures.select(
        "contract_id", "capture_id", "captured_at", "stated_from", "stated_to", "observed_at", F.coalesce(fit, F.lit(False)).alias("fit"), F.sha2(c("rule_text").cast("binary"), 256).alias("digest"), at.alias("at"),
    )
    bounds, stated = c("fit") & c("at").isNotNull(), c("fit") & c("stated_from").isNotNull()
    span = F.struct("stated_from", "stated_to")
    first = seen.groupBy("contract_id").agg(
        F.count("*").alias("captures"), F.count_if(c("fit")).alias("admissible"), F.count_if(bounds).alias("bounding"), F.count_if(stated).alias("stated"),
        F.min(F.when(stated, span)).alias("low"), F.max(F.when(stated, span)).alias("high"), F.max_by("digest", F.when(stated, F.struct("captured_at", "capture_id"))).alias("stated_digest"), F.min_by("digest", F.when(bounds, F.struct("at", "capture_id"))).alias("earliest"),
    )
    if wanted is not None:
        first = first.join(wanted.select("contract_id", c("rule_digest").alias("wanted")), "contract_id", "left").withColumn("target", F.coalesce("wanted", "earliest")).drop("wanted")
    else:
        first = first.withColumn("target", c("earliest"))
    marks = seen.where(bounds).join(first.select("contract_id", "target"), "contract_id")
    opened = marks.where(c("digest") == c("target")).groupBy("contract_id").agg(F.min("at").alias("opened"))
    closed = marks.where(c("digest") != c("target")).join(opened, "contract_id").where(c("at") > c("opened")).groupBy("contract_id").agg(F.min("at").alias("closed"))
    j = first.join(opened, "contract_id", "left").join(closed, "contract_id", "left")
    by_stated = c("stated") > 0
    refusal = (
        F.when(c("bounding") == 0, "no_dated_source_bounds_the_rule").when(by_stated & ~c("low").eqNullSafe(c("high")), "stated_intervals_disagree")
        .when(by_stated & (c("low.stated_to") <= c("low.stated_from")), "stated_interval_is_empty").when(~by_stated & c("opened").isNull(), "wanted_rule_was_never_seen")
    )
    holds = refusal.isNull()
    return j.select(
        "contract_id", "captures", "admissible", refusal.alias("refusal"), F.when(holds, F.when(by_stated, "stated_interval").otherwise("observed_live")).alias("basis"),
        F.when(holds, F.when(by_stated, c("low.stated_from")).otherwise(c("opened"))).alias("in_force_from"), F.when(holds, F.when(by_stated, c("low.stated_to")).otherwise(c("closed"))).alias("in_force_to"),
        F.when(holds, F.when(by_stated, c("stated_digest")).otherwise(c("target"))).alias("rule_digest"),
    )


def release_readiness(releases: DataFrame, contracts: DataFrame, captures: DataFrame, before: int, after: int, bucket: int) -> DataFrame:
    """The ledger of declared releases: candidates, covered, earliest and state.

    releases: event_id, at. contracts: contract_id, opened, closed; a candidate's listing covers the release, [opened, closed). captures:
    contract_id, instant, ends (null: open). A candidate is covered by a capture no later than at - before which has not ended before
    at + after. States: met, not_met, no_candidates. Listings meet releases under the time buckets that they cover and captures by
    contract, so both are equi joins; ``bucket`` should be near the length of a listing. A capture that another of the same contract and
    instant outlasts is dropped before the join.
    """
    c, slot = F.col, lambda x: F.floor(x / bucket).cast("long")
    listed = contracts.where(c("closed") > c("opened")).select("contract_id", "opened", "closed").distinct()
    listed = listed.withColumn("slot", F.explode(F.sequence(slot(c("opened")), slot(c("closed") - 1))))
    pairs = listed.join(releases.select("event_id", "at", slot(c("at")).alias("slot")), "slot").where((c("opened") <= c("at")) & (c("at") < c("closed"))).select("event_id", "at", "contract_id").distinct()
    reach = captures.where(c("instant").isNotNull()).groupBy("contract_id", "instant").agg(F.max(F.coalesce("ends", F.lit(2**62))).alias("ends"))
    covers = (c("instant") <= c("at") - before) & (c("ends") >= c("at") + after)
    each = pairs.join(reach, "contract_id", "left").groupBy("event_id", "contract_id").agg(F.min(F.when(covers, c("instant"))).alias("since"))
    totals = each.groupBy("event_id").agg(F.count("*").alias("candidates"), F.count("since").alias("covered"), F.min("since").alias("earliest"))
    out = releases.select("event_id").join(totals, "event_id", "left").fillna(0, ["candidates", "covered"])
    return out.withColumn("state", F.when(c("candidates") == 0, "no_candidates").when(c("covered") > 0, "met").otherwise("not_met"))


def policy_series(ticker: Column, title: Column, category: Column, hosts: Column) -> Column:
    """struct(admitted, reason, exclusion): the first settlement source decides, not any in the list; exclusions come before evidence."""
    text = F.lower(F.concat_ws(" ", F.coalesce(ticker, F.lit("")), F.coalesce(title, F.lit(""))))
    named = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(ticker, F.lit(""))))
    excluded = F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in POLICY_EXCLUSIONS.items()])
    fed = F.coalesce(F.contains(F.try_element_at(hosts, F.lit(1)), F.lit(POLICY_HOST)), F.lit(False))
    economics = F.coalesce(F.lower(F.trim(category)) == POLICY_CATEGORY, F.lit(False))
    reason = (
        F.when(excluded.isNotNull(), "excluded_by_pattern").when(~fed, "no_us_federal_reserve_settlement_source").when(~economics, "category_is_not_economics")
        .when(~named.rlike(POLICY_TITLE), "title_names_no_policy_rate_or_meeting").otherwise("fed_settlement_source_with_policy_rate_title")
    )
    why = F.when(excluded.isNotNull(), excluded).when(~fed, "not_us_policy_source").when(~economics, "category_not_economics").when(~named.rlike(POLICY_TITLE), "title_not_policy_rate")
    return F.struct(why.isNull().alias("admitted"), reason.alias("reason"), why.alias("exclusion"))
