"""Look-ups that decide what a row may know: labels by a cutoff, surprises, placebo lags, settlements, archived origins, rule evidence and rule audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.masking import reasons

# What rule evidence must bind, under any of these names, and may bind; the refusals; clock qualities, the worst first.
EVIDENCE_NAMES = {
    "contract_id": ("contract_id", "ticker"), "rule_hash": ("rule_hash", "raw_rule_hash", "document_hash"), "source_url": ("source_url", "source", "url", "rule_source"), "verified_by": ("verified_by", "verifier", "verified_by_method"),
    "in_force_from": ("in_force_from", "effective_from", "rule_effective_from"), "observed_at": ("observed_at", "rule_available_at", "observed_at_utc"), "settlement_semantics": ("settlement_semantics", "settlement", "payout_rule"),
}
OPTIONAL_EVIDENCE = {"in_force_to": ("in_force_to", "effective_to", "rule_effective_to")}
OTHER_CONTRACT, NO_DIGEST, EVIDENCE_MISSING = "rule_evidence_names_a_different_contract", "rule_hash_is_not_a_digest_of_rule_text", "rule_evidence_missing"
CLOCK_QUALITIES = ("unknown", "clock_unsynced", "clock_synced")
# The fields of a rule audit, those that both records must state, and those that block within one venue only.
AUDIT_FIELDS = (
    "event_id", "family", "reference_period", "source", "units", "vintage", "operator", "threshold", "lower", "upper", "rounding", "timezone", "deadline", "settlement", "currency", "exceptional_policy", "contract_id", "rule_hash", "open_time",
    "close_time", "resolve_time",
)
AUDIT_REQUIRED = ("reference_period", "source", "units", "vintage", "rounding", "timezone", "deadline", "settlement", "currency", "exceptional_policy", "operator")
SAME_VENUE = ("contract_id", "rule_hash", "open_time", "close_time", "resolve_time")
SCALAR_OPERATORS, BOUNDED_OPERATORS = ("above", "at_least", "below", "at_most", "equal"), ("range", "binary")


def available_labels(resolutions: DataFrame, cutoff: Column) -> DataFrame:
    """Resolutions whose outcome was known by the cutoff. known_at alone decides, whenever the venue settled; an unknown known_at is never by any cutoff."""
    return resolutions.where(F.col("known_at") <= cutoff)


def label_join(rows: DataFrame, resolutions: DataFrame, keys: list[str], cutoff: str) -> DataFrame:
    """rows with payout and known_at of the label known by each row's own cutoff: the latest of several, ties by the rule's hash; null where none was known."""
    known = rows.select(*keys, cutoff).distinct().join(resolutions, keys).where(F.col("known_at") <= F.col(cutoff))
    latest = known.groupBy(*keys, cutoff).agg(F.max_by(F.struct("payout", "known_at"), F.struct("known_at", "rule_hash")).alias("_l"))
    return rows.join(latest, [*keys, cutoff], "left").select(*rows.columns, "_l.payout", "_l.known_at")


def surprises(expectations: DataFrame, facts: DataFrame) -> DataFrame:
    """expectations (event_id, statistic, value) with actual and surprise = first print - expectation; facts (event_id, statistic, first_print). Without a
    first print there is no surprise, not one of zero."""
    found = facts.select("event_id", "statistic", F.col("first_print").alias("actual"))
    return expectations.join(found, ["event_id", "statistic"], "left").withColumn("surprise", F.col("actual") - F.col("value"))


def shocks(rows: DataFrame, surprised: DataFrame, statistic_of: dict[str, str]) -> DataFrame:
    """rows (event_id, family, release_time, ...) with shock, the surprise of the family's declared statistic, and delayed_shock, that of the release before in
    the family. Releases, not rows, are ordered, so rows of one release share both."""
    names = F.create_map(*[F.lit(x) for pair in statistic_of.items() for x in pair])
    named = rows.select("event_id", "family", "release_time").distinct().withColumn("statistic", F.try_element_at(names, F.col("family")))
    own = named.join(surprised.select("event_id", "statistic", F.col("surprise").alias("shock")), ["event_id", "statistic"], "left")
    order = W.partitionBy("family").orderBy("release_time", "event_id")
    lagged = own.withColumn("delayed_shock", F.lag("shock").over(order)).select("event_id", "family", "shock", "delayed_shock")
    return rows.join(lagged, ["event_id", "family"], "left")


def placebo_lags(rows: DataFrame, placebo: DataFrame) -> DataFrame:
    """rows (event_id, receiver, ...) with placebo_neighbor_lag, the lag that the declared placebo donor lends the receiver; null where it lends none."""
    return rows.join(placebo.select("event_id", "receiver", F.col("neighbor_lag").alias("placebo_neighbor_lag")), ["event_id", "receiver"], "left")


def settlement_counts(quotes: DataFrame, funding: DataFrame, keys: list[str]) -> DataFrame:
    """quotes with settlements, how often their venue settled; a venue that the funding page does not hold stays unknown."""
    return quotes.join(funding.select(*keys, "settlements"), keys, "left")


def verified_origins(records: DataFrame, pages: DataFrame, pointed: Column, digest: Column) -> DataFrame:
    """records (page_hash, pointer, ...) with refusal: null where the archived page of that hash holds, at the pointer, a record of the cited digest.

    pages (page_hash, body); pointed: the JSON that the pointer names in body (see functions.text.json_pointer); digest: the cited record's. First hit wins: no
    origin, no such page, a pointer that names nothing, a thing that is no record, another record.
    """
    from ..functions.text import text_digest

    held = pages.select(F.col("page_hash").alias("_hash"), F.col("body").alias("body"), F.lit(True).alias("_held"))
    both = records.join(held, F.col("page_hash") == F.col("_hash"), "left").withColumn("_found", pointed)
    refusal = (
        F.when(F.col("page_hash").isNull() | F.col("pointer").isNull(), "no_page_origin").when(F.col("_held").isNull(), "page_not_stored").when(F.col("_found").isNull(), "pointer_names_nothing")
        .when(~F.col("_found").startswith("{"), "pointer_names_no_record").when(text_digest(F.col("_found")) != digest, "another_record")
    )
    return both.select(*records.columns, refusal.alias("refusal"))


def rule_evidence(records: DataFrame, evidence: str, ticker: str) -> DataFrame:
    """records with bound (map of what the evidence, map<string,string>, binds), missing (in order), verified and refusal.

    Evidence that names another contract, or whose hash is no sha256 digest, establishes nothing; else every required binding must be present under
    one of its names, the first of which counts.
    """
    given = F.coalesce(F.col(evidence), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    of = lambda names: F.coalesce(*[F.try_element_at(given, F.lit(n)) for n in names])
    found = {n: of(names) for n, names in (EVIDENCE_NAMES | OPTIONAL_EVIDENCE).items()}
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), x.alias("value")) for n, x in found.items()]), lambda e: e["value"].isNotNull())
    absent = reasons(*[(found[n].isNull(), n) for n in EVIDENCE_NAMES])
    other = found["contract_id"].isNotNull() & (F.trim(found["contract_id"]) != F.trim(F.col(ticker)))
    loose = found["rule_hash"].isNotNull() & ~F.trim(found["rule_hash"]).rlike("^[0-9a-f]{64}$")
    missing = F.when(other, F.array(F.lit("contract_id"))).when(loose, F.array(F.lit("rule_hash"))).otherwise(absent)
    refusal = F.when(other, OTHER_CONTRACT).when(loose, NO_DIGEST).when(F.size(absent) > 0, EVIDENCE_MISSING)
    return records.withColumns({"bound": F.map_from_entries(entries), "missing": missing, "refusal": refusal, "verified": refusal.isNull()})


def rule_audit(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with matches, blocking (fields whose difference blocks), differing and missing, for structs left and right of text fields.

    A field that both state must be equal, and one that only one states differs. Fields of a venue's own block within one venue only. Required fields that neither
    states leave the match unproven, and so does a threshold for a scalar operator or a bound for a bounded one.
    """
    have = {f.name for f in pairs.schema[left].dataType.fields}
    a, b = (lambda f, side=side: F.col(f"{side}.{f}") for side in (left, right))
    across = ~a("venue").eqNullSafe(b("venue"))
    fields = [f for f in AUDIT_FIELDS if f in have]
    differs = {f: ~a(f).eqNullSafe(b(f)) for f in fields}
    both_absent = lambda f: a(f).isNull() & b(f).isNull() if f in have else F.lit(True)
    operator = F.coalesce(a("operator"), F.lit(""))
    missing = reasons(
        *[(both_absent(f), f) for f in AUDIT_REQUIRED], (both_absent("threshold") & operator.isin(*SCALAR_OPERATORS), "threshold"),
        *[(both_absent(f) & operator.isin(*BOUNDED_OPERATORS), f) for f in ("lower", "upper")],
    )
    blocking = reasons(*[(differs[f] & (~across if f in SAME_VENUE else F.lit(True)), f) for f in fields])
    out = pairs.withColumns({"differing": reasons(*[(differs[f], f) for f in fields]), "blocking": blocking, "missing": missing})
    return out.withColumn("matches", (F.size("blocking") == 0) & (F.size("missing") == 0))


def worst_quality(*qualities: Column) -> Column:
    """The least trustworthy of several clock qualities; one that is not among the declared ones is worse than all. Null only where none is given."""
    ranked = F.filter(F.array(*[F.struct((F.array_position(F.array(*map(F.lit, CLOCK_QUALITIES)), q) - 1).alias("rank"), q.alias("quality")) for q in qualities]), lambda x: x["quality"].isNotNull())
    return F.array_min(ranked)["quality"]


def largest_uncertainty(*seconds: Column) -> Column:
    """The largest of the known uncertainties; null where all are unknown."""
    return F.array_max(F.array(*seconds)) if len(seconds) > 1 else seconds[0]


def cohort_rows(rows: DataFrame, contract: str, declared: list[str]) -> DataFrame:
    """Rows of the declared contracts; a declared contract without a row raises."""
    kept = rows.where(F.col(contract).isin(declared))
    if absent := sorted(set(declared) - {r[0] for r in kept.select(contract).distinct().collect()}):  # at most the declared ones
        raise ValueError(f"no rows of {absent}")
    return kept


def admissible_covariates(df: DataFrame, event_time: str, times: dict[str, str], covariates: dict[str, str]) -> DataFrame:
    """(column, kind, rows, unknown, late, admissible): by column, how often its time is unknown or too late.

    times: conventional columns, whose time must lie before the event; covariates: declared ones, whose time may be the event's own. A column is
    admissible if none of its times is late; unknown times are counted, and their rows are to be left out.
    """
    at, out = F.col(event_time), []
    for kind, named in (("conventional", times), ("declared", covariates)):
        for column, time in named.items():
            t = F.col(time)
            late = t >= at if kind == "conventional" else t > at
            out.append(F.struct(F.lit(column).alias("column"), F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count_if(F.col(column).isNotNull() & (t.isNull() | at.isNull())).alias("unknown"), F.count_if(F.col(column).isNotNull() & late).alias("late")))
    if not out:
        raise ValueError("no covariate is named")
    return df.agg(F.array(*out).alias("c")).select(F.explode("c").alias("c")).select("c.*").withColumn("admissible", F.col("late") == 0)
