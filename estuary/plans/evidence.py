"""Evidence, placebos, power and the weighted ladder over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.times import SECOND, micros
from ..operators import evidence, models, placebo
from .registry import query, read

DAY = 86400 * SECOND


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey, epoch_us(o_orderdate) AS t FROM orders), x AS (SELECT *, CASE k % 5 WHEN 0 THEN 'headline_mom_pct' WHEN 1 THEN 'payrolls_jobs' WHEN 2 THEN 'core_level' WHEN 3 THEN 'revised_usd' ELSE 'other_usd' END AS st FROM r),
v AS (SELECT k, st, CASE WHEN k % 23 = 0 THEN 'recorded_evidence_bytes_could_not_be_read' WHEN k % 19 = 0 THEN 'evidence_bytes_do_not_match_the_recorded_digest' WHEN k % 17 = 0 THEN 'source_kind_is_not_an_admissible_route' WHEN k % 13 = 0 THEN 'market_implied_expectation_cannot_validate_the_market'
 WHEN k % 11 = 0 THEN 'consensus_identity_is_not_named' WHEN k % 29 = 0 THEN 'verification_method_is_not_named' WHEN o_custkey % 4 = 0 THEN 'expectation_published_at_or_after_the_release' WHEN o_custkey % 9 = 0 OR st = 'revised_usd' THEN 'expectation_targets_a_revised_actual_not_the_first_print'
 WHEN st = 'other_usd' THEN 'statistic_is_not_declared_by_the_release' WHEN o_custkey % 7 = 0 THEN 'reference_period_does_not_match_the_release' WHEN st = 'core_level' THEN 'release_declares_no_unit_for_the_statistic' WHEN st = 'payrolls_jobs' AND o_custkey % 2 = 0 THEN 'unit_does_not_match_the_release_statistic' END AS refusal FROM x)
SELECT st AS statistic, refusal, count(*) AS n, CAST(sum(CASE WHEN refusal IS NULL THEN k END) AS DOUBLE) AS total FROM v GROUP BY ALL""")
def expectation_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order's release, with a planted fault of every kind."""
    o, k, u = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    at, body = micros(F.col("o_orderdate")), F.col("o_orderkey").cast("string").cast("binary")
    names = [F.when(k % 5 == i, n) for i, n in enumerate(("headline_mom_pct", "payrolls_jobs", "core_level", "revised_usd"))]
    releases = o.select(
        k.alias("event_id"), at.alias("release_time"), F.lit("2026-01").alias("release_period"), F.array(F.lit("headline_mom_pct"), F.lit("payrolls_jobs"), F.lit("core_level")).alias("statistics"),
        F.array(F.lit("revised_usd")).alias("revised_statistics"),
    )
    records = o.select(
        k.alias("event_id"), F.coalesce(*names, F.lit("other_usd")).alias("statistic"), k.cast("double").alias("value"), F.when(k % 5 == 0, "percent_change").when(u % 2 == 0, "thousands_of_count").otherwise("count").alias("unit"),
        F.when(k % 17 == 0, "rumour").when(k % 13 == 0, "market_implied").otherwise("licensed_consensus").alias("source_kind"), F.when(k % 11 == 0, " ").otherwise("panel").alias("consensus_id"), F.when(k % 29 != 0, "read").alias("verified_by"),
        F.when(u % 4 == 0, at).otherwise(at - SECOND).alias("published_at"), F.when(u % 9 == 0, "second").otherwise("initial").alias("revision_status"), F.when(u % 7 == 0, "2025-12").otherwise("2026-01").alias("reference_period"),
        F.when(k % 23 != 0, body).alias("evidence"), F.when(k % 19 == 0, "0").otherwise(F.sha2(body, 256)).alias("evidence_sha256"),
    )
    return evidence.validated_expectations(records, releases).groupBy("statistic", "refusal").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""WITH c AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) AS t, l_returnflag AS txt, l_partkey % 5 = 0 AND l_linenumber = 1 AS stated, l_orderkey % 7 <> 0 AND l_partkey % 11 <> 0 AS fit, l_quantity FROM lineitem),
b AS (SELECT *, CASE WHEN stated THEN t + CAST(l_quantity - 3 AS BIGINT) * {DAY} END AS z, row_number() OVER (PARTITION BY k ORDER BY t, id) AS rn FROM c WHERE fit),
g AS (SELECT k, count(*) FILTER (WHERE stated) AS stated, count(DISTINCT CASE WHEN stated THEN (t, z) END) AS spans, min(t) FILTER (WHERE stated) AS sf, min(z) AS st, arg_max(txt, (t, id)) FILTER (WHERE stated) AS stx, max(CASE WHEN rn = 1 THEN txt END) AS target, min(t) AS opened, count(*) AS admissible FROM b GROUP BY k),
e AS (SELECT b.k, min(t) AS closed FROM b JOIN g USING (k) WHERE b.txt <> g.target AND b.t > g.opened GROUP BY b.k), a AS (SELECT k, count(*) AS captures FROM c GROUP BY k),
r AS (SELECT a.k, captures, coalesce(admissible, 0) AS admissible, stated, sf, st, stx, target, opened, closed, CASE WHEN g.k IS NULL THEN 'no_dated_source_bounds_the_rule' WHEN spans > 1 THEN 'stated_intervals_disagree' WHEN stated > 0 AND st <= sf THEN 'stated_interval_is_empty' END AS refusal FROM a LEFT JOIN g USING (k) LEFT JOIN e USING (k))
SELECT k AS contract_id, captures, admissible, refusal, CASE WHEN refusal IS NULL THEN CASE WHEN stated > 0 THEN 'stated_interval' ELSE 'observed_live' END END AS basis, CASE WHEN refusal IS NULL THEN CASE WHEN stated > 0 THEN sf ELSE opened END END AS in_force_from,
  CASE WHEN refusal IS NULL THEN CASE WHEN stated > 0 THEN st ELSE closed END END AS in_force_to, CASE WHEN refusal IS NULL THEN sha256(CASE WHEN stated > 0 THEN stx ELSE target END) END AS rule_digest FROM r""")
def rule_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as captures of their part's rule, whose text is the return flag."""
    k, t = F.col("l_partkey"), micros(F.col("l_shipdate"))
    body, stated = F.col("l_comment_bytes"), (k % 5 == 0) & (F.col("l_linenumber") == 1)
    li = read(spark, sf_dir, "lineitem").withColumn("l_comment_bytes", F.col("l_orderkey").cast("string").cast("binary"))
    return evidence.attested_rules(li.select(
        k.alias("contract_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("capture_id"), body.alias("body"), F.when(F.col("l_orderkey") % 7 == 0, "0").otherwise(F.sha2(body, 256)).alias("raw_hash"), F.lit("page").alias("source_kind"),
        F.col("l_returnflag").alias("rule_text"), F.when(k % 11 == 0, "").otherwise("cash").alias("settlement"), t.alias("captured_at"), F.when(stated, t).alias("stated_from"), F.when(stated, t + (F.col("l_quantity") - 3).cast("long") * DAY).alias("stated_to"), t.alias("observed_at"),
    ), kinds=("page",))


RELEASES = f"rel AS (SELECT i AS event_id, 694224000000000 + i * {45 * DAY} AS rt FROM range(70) r(i))"


@query(f"""WITH {RELEASES}, c AS (SELECT l_partkey AS k, min(epoch_us(l_shipdate)) AS o, max(epoch_us(l_shipdate)) AS z FROM lineitem GROUP BY 1), x AS (SELECT l_partkey AS k, epoch_us(l_shipdate) AS i, CASE WHEN l_linenumber > 1 THEN epoch_us(l_shipdate) + l_linenumber * {90 * DAY} END AS e FROM lineitem),
p AS (SELECT event_id, rt, k FROM rel JOIN c ON o <= rt AND rt < z), s AS (SELECT event_id, p.k, min(CASE WHEN i <= rt - 3600000000 AND (e IS NULL OR e >= rt + 7200000000) THEN i END) AS since FROM p LEFT JOIN x USING (k) GROUP BY ALL),
g AS (SELECT event_id, count(*) AS candidates, count(since) AS covered, min(since) AS earliest FROM s GROUP BY 1) SELECT event_id, coalesce(candidates, 0) AS candidates, coalesce(covered, 0) AS covered, earliest, CASE WHEN candidates IS NULL THEN 'no_candidates' WHEN covered > 0 THEN 'met' ELSE 'not_met' END AS state FROM rel LEFT JOIN g USING (event_id)""")
def release_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, t = read(spark, sf_dir, "lineitem"), micros(F.col("l_shipdate"))
    contracts = li.groupBy(F.col("l_partkey").alias("contract_id")).agg(F.min(t).alias("opened"), F.max(t).alias("closed"))
    captures = li.select(F.col("l_partkey").alias("contract_id"), t.alias("instant"), F.when(F.col("l_linenumber") > 1, t + F.col("l_linenumber") * F.lit(90 * DAY)).alias("ends"))
    releases = spark.range(70).select(F.col("id").alias("event_id"), (F.lit(694224000000000) + F.col("id") * F.lit(45 * DAY)).alias("at"))
    return evidence.release_readiness(releases, contracts, captures, 3600 * SECOND, 7200 * SECOND, 365 * DAY)


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Fed chair nominee' WHEN 1 THEN 'Fed funds rate in Brazil' WHEN 2 THEN 'FOMC rate decision' WHEN 3 THEN 'Fed mention' ELSE p_name END AS title, CASE WHEN p_size % 4 = 0 THEN 'news.example' ELSE 'www.federalreserve.gov' END AS host, CASE WHEN p_size % 3 = 0 THEN 'Politics' ELSE ' Economics ' END AS cat FROM part)
SELECT p_partkey, x AS exclusion, x IS NULL AS admitted FROM (SELECT p_partkey, CASE WHEN title = 'Fed chair nominee' THEN 'fed_personnel_or_nomination' WHEN title = 'Fed mention' THEN 'fed_communication_or_mention' WHEN title LIKE '%Brazil' THEN 'foreign_or_non_us_inflation' WHEN host = 'news.example' THEN 'not_us_policy_source' WHEN cat = 'Politics' THEN 'category_not_economics' WHEN title <> 'FOMC rate decision' THEN 'title_not_policy_rate' END AS x FROM s)""")
def policy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.when(k % 6 == 0, "Fed chair nominee").when(k % 6 == 1, "Fed funds rate in Brazil").when(k % 6 == 2, "FOMC rate decision").when(k % 6 == 3, "Fed mention").otherwise(F.col("p_name"))
    hosts = F.array(F.when(F.col("p_size") % 4 == 0, "news.example").otherwise("www.federalreserve.gov"), F.lit("federalreserve.gov"))
    v = evidence.policy_series(F.lit("KX"), title, F.when(F.col("p_size") % 3 == 0, "Politics").otherwise(" Economics "), hosts)
    return p.select("p_partkey", v.alias("v")).select("p_partkey", "v.exclusion", "v.admitted")


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS n FROM part) SELECT k AS partkey, f AS refusal, CASE WHEN f IS NULL THEN CASE WHEN k % 2 = 0 THEN -n ELSE n / 100.0 END END AS threshold, CASE WHEN f IS NULL AND k % 2 = 0 AND k % 3 = 0 THEN 'below' END AS inequality, CASE WHEN f IS NULL THEN CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END END AS orientation, CASE WHEN f IS NULL THEN '2026-03' END AS period
FROM (SELECT *, CASE WHEN k % 13 = 0 THEN 'settlement_subject_unreadable' WHEN k % 2 = 0 AND k % 5 = 0 THEN 'threshold_statements_disagree' WHEN k % 2 = 1 AND k % 5 = 0 THEN 'yes_side_unreadable' WHEN k % 7 = 0 THEN 'month_not_in_calendar' WHEN k % 11 = 0 THEN 'resolution_basis_unreadable' END AS f FROM x)""")
def venue_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the second venue's wording, made from parts; every refusal is planted."""
    p, k, n = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("string")
    month, more = F.when(k % 7 == 0, "April").otherwise("March"), F.when(k % 3 == 0, "+").otherwise("")
    shown, said = F.when(k % 5 == 0, F.concat(n, F.lit("1"))).otherwise(n), F.concat(F.lit("0."), F.lpad(n, 2, "0"))
    subject = F.when(k % 13 == 0, "The price of wheat").otherwise("The upper bound of the target federal funds rate")
    ending = F.concat(F.lit(" after the "), month, F.lit(" 2026 meeting. The resolution source is "), F.when(k % 11 == 0, "a newspaper.").otherwise("the FOMC’s statement."))
    described = F.concat(subject, F.when(k % 2 == 0, F.concat(F.lit(" is decreased by "), n, F.when(k % 3 == 0, " or more").otherwise(""), F.lit(" basis points"))).otherwise(" is what this will resolve to the upper bound of"), ending)
    asked = F.when(k % 2 == 0, F.concat(F.lit("Will the Fed cut rates by "), shown, more, F.lit(" bps?"))).otherwise(F.concat(F.lit("Will the rate be "), said, F.lit("%"), F.when(k % 5 == 0, "").otherwise(" or lower"), F.lit(" then?")))
    calendar = F.create_map(F.lit("2026-03"), F.lit("2026-03-18").cast("date"))
    v = p.select(k.alias("partkey"), text.second_venue_predicate(asked, described, F.lit(None).cast("string"), calendar).alias("v"))
    return v.select("partkey", "v.refusal", "v.threshold", "v.inequality", "v.orientation", "v.period")


@query("""WITH e AS (SELECT event_id, user_id AS ev, event_type AS fam, ts, value AS y, ln(1 + event_id % 17) AS x, value * 0.5 + event_id % 3 AS b, event_id % 4 AS h FROM events),
s AS (SELECT ev, max_by(sh, fam) AS sh FROM (SELECT ev, fam, lag(x) OVER (PARTITION BY fam ORDER BY t, ev) AS sh FROM (SELECT ev, fam, min(ts) AS t, avg(x) AS x FROM e GROUP BY ALL)) WHERE sh IS NOT NULL GROUP BY ev),
q AS (SELECT quantile_cont(b, 0.25) AS a, quantile_cont(b, 0.5) AS m, quantile_cont(b, 0.75) AS c FROM e), r AS (SELECT e.*, sh, CASE WHEN b <= a THEN '0' WHEN b <= m THEN '1' WHEN b <= c THEN '2' ELSE '3' END AS st FROM e LEFT JOIN s USING (ev), q),
u AS (SELECT 'baseline' AS placebo, 'all' AS stratum, ev, y, x FROM r UNION ALL SELECT 'shifted_release_time', 'all', ev, y, sh FROM r UNION ALL SELECT 'reversed_direction', 'all', ev, y, -x FROM r UNION ALL SELECT 'pre_release_lead', 'all', ev, b, x FROM r
  UNION ALL SELECT 'quote_age', st, ev, y, x FROM r UNION ALL SELECT 'endpoint', CAST(h AS VARCHAR), ev, y, x FROM r UNION ALL SELECT 'negative_control', 'all', ev, y, x FROM r WHERE fam = 'error'),
m AS (SELECT placebo, stratum, ev, avg(y) AS y, avg(x) AS x FROM u WHERE x IS NOT NULL GROUP BY ALL) SELECT placebo, stratum, count(*) AS events, round(regr_slope(y, x) * stddev_pop(x), 6) AS slope, 'ok' AS status FROM m GROUP BY ALL""")
def placebo_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as events, types as regimes and cohorts."""
    e = read(spark, sf_dir, "events").withColumns({"x": F.log(1.0 + F.col("event_id") % 17), "b": F.col("value") * 0.5 + F.col("event_id") % 3, "h": F.col("event_id") % 4})
    f = placebo.Frame("value", "x", "user_id", "user_id", "ts", "event_type", before="b", age="b", horizon="h", cohort="event_type", control="error")
    return placebo.placebo_suite(e, f).withColumn("slope", F.round("slope", 6))


@query("""WITH e AS (SELECT user_id AS event, min(event_type) AS family, avg(value) AS y, avg(ln(1.0 + event_id % 17)) AS x FROM events GROUP BY 1),
r AS (SELECT i AS repetition, family, y, row_number() OVER (PARTITION BY i, family ORDER BY event) AS place FROM e, range(99) t(i)), d AS (SELECT i AS repetition, family, x, row_number() OVER (PARTITION BY i, family ORDER BY md5('0:' || i || ':' || event), event) AS place FROM e, range(99) t(i)),
n AS (SELECT repetition, covar_pop(x, y) / var_pop(x) * stddev_pop(x) AS dealt FROM r JOIN d USING (repetition, family, place) GROUP BY 1), s AS (SELECT count(*) AS events, covar_pop(x, y) / var_pop(x) * stddev_pop(x) AS slope FROM e)
SELECT events, round(slope, 6) AS slope, count(dealt) AS repetitions, round((1 + count(*) FILTER (WHERE abs(dealt) >= abs(slope))) / (count(dealt) + 1), 8) AS p FROM n, s GROUP BY events, slope""")
def label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("event")).agg(F.min("event_type").alias("family"), F.avg("value").alias("y"), F.avg(F.log(1.0 + F.col("event_id") % 17)).alias("x"))
    return placebo.label_permutation(e, "family", 99).withColumn("slope", F.round("slope", 6)).withColumn("p", F.round("p", 8))


@query()
def power_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placebo.power(spark, repetitions=80, grid=(12, 36))


@query()
def timing_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases: a rung of the level alone, then flags as level terms, then covariates; scored on held-out orders."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("y"), *[(F.col("l_returnflag") == f).cast("double").alias(f"is_{f}") for f in "ANR"])
    third, flags = F.pmod(F.xxhash64("l_orderkey"), F.lit(3)), ["is_A", "is_N", "is_R"]
    rungs = {"level": ([], []), "family": (flags, []), "quantity": (flags, ["l_quantity"]), "discount": (flags, ["l_quantity", "l_discount"]), "tax": (flags, ["l_quantity", "l_discount", "l_tax"])}
    fits = models.fit_weighted_ladder(li.where(third == 0), li.where(third == 1), rungs, "y", "l_orderkey")
    test = models.release_weights(li.where(third == 2), "l_orderkey")
    errors = test.agg(*[(F.sum(F.col("weight") * F.abs(m.column() - F.col("y"))) / F.sum("weight")).alias(n) for n, m in fits.items()]).first()
    return spark.createDataFrame([(n, m.alpha, errors[n]) for n, m in fits.items()], "kind string, alpha double, mae double")
