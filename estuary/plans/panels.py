"""Panels, as-of joins and their counts over the events table.

A print is a row of events: contract user_id, price value / 400 capped at 1. Releases are thirty daily noons of January
2024; a contract is declared for a release if both leave the same rest by 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import ledger, unknown_if_any
from ..functions.times import SECOND, micros
from ..operators import asof, panel
from .registry import query, read

HOUR = 3600 * SECOND
FIRST, RELEASES = 1704110400 * SECOND, 30
SETTINGS = panel.PanelSettings(12 * HOUR, 24 * HOUR, 12 * HOUR, 12 * HOUR, (1 * HOUR, 6 * HOUR, 12 * HOUR, 24 * HOUR))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("trade_id"), F.col("user_id").alias("contract"), micros(F.col("ts")).alias("time"), F.least(F.col("value") / 400, F.lit(1.0)).alias("price"), F.when(F.col("event_id") % 11 != 0, F.when(F.col("event_id") % 29 == 0, "no").otherwise("yes")).alias("axis")
    )


def releases(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(RELEASES).select(i.alias("event_id"), (F.lit(FIRST) + i * 24 * HOUR).alias("at"), (i % 10 != 9).alias("rule_known"), (i % 13 == 12).alias("closed_before"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("contract"), F.pmod("user_id", F.lit(3)).alias("k")).distinct()
    days = spark.range(RELEASES).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("k"))
    return users.join(days, "k").select("event_id", "contract")


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.trade_panel(prints(spark, sf_dir), releases(spark), candidates(spark, sf_dir), SETTINGS)


PRINTS = """prints AS (
  SELECT event_id AS trade_id, user_id AS contract, epoch_us(ts) AS time, least(value / 400, 1.0) AS price, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 29 = 0 THEN 'no' ELSE 'yes' END END AS axis FROM events
), releases AS (
  SELECT i AS event_id, 1704110400000000 + i * 86400000000 AS "at", i % 10 <> 9 AS rule_known, i % 13 = 12 AS closed_before FROM range(30) t(i)
), declared AS (
  SELECT r.*, c.contract FROM releases r JOIN (SELECT DISTINCT user_id AS contract FROM events) c ON c.contract % 3 = r.event_id % 3
)"""
PANEL = f"""{PRINTS}, near AS (
  SELECT d.event_id, d.contract, d."at", p.trade_id, p.time, p.price, p.axis FROM declared d JOIN prints p ON p.contract = d.contract AND p.time BETWEEN d."at" - 43200000000 AND d."at" + 86400000000
), pre AS (
  SELECT *, max(time) OVER (PARTITION BY event_id, contract) AS top FROM near WHERE time < "at"
), base AS (
  SELECT event_id, contract, max(time) AS baseline_time, avg(price) FILTER (WHERE time = top) AS baseline, string_agg(CAST(trade_id AS VARCHAR), ',' ORDER BY trade_id) FILTER (WHERE time = top) AS baseline_ids, count(*) AS n_pre,
    count(*) FILTER (WHERE time = top AND axis IS NULL) AS unset_pre, min(axis) FILTER (WHERE time = top) AS low_pre, max(axis) FILTER (WHERE time = top) AS high_pre FROM pre GROUP BY ALL
), post AS (
  SELECT n.*, h.horizon, max(time) OVER (PARTITION BY event_id, contract, horizon) AS top
  FROM near n JOIN (SELECT unnest([3600000000, 21600000000, 43200000000, 86400000000]) AS horizon) h ON n.time > n."at" AND n.time - n."at" <= h.horizon
), ends AS (
  SELECT event_id, contract, horizon, max(time) AS endpoint_time, avg(price) FILTER (WHERE time = top) AS endpoint, count(*) AS n_post,
    count(*) FILTER (WHERE time = top AND axis IS NULL) AS unset_post, min(axis) FILTER (WHERE time = top) AS low_post, max(axis) FILTER (WHERE time = top) AS high_post FROM post GROUP BY ALL
), grid AS (
  SELECT d.*, h.horizon FROM declared d, (SELECT unnest([3600000000, 21600000000, 43200000000, 86400000000]) AS horizon) h
), panel AS (
  SELECT g.event_id, g.contract, g.horizon, baseline_time, baseline, coalesce(n_pre, 0) AS n_pre, endpoint, coalesce(n_post, 0) AS n_post,
    CASE WHEN NOT rule_known THEN 'rule_evidence_missing' WHEN closed_before THEN 'closed_before_release' WHEN baseline_time IS NULL THEN 'missing_baseline'
      WHEN "at" - baseline_time > 43200000000 THEN 'stale_baseline' WHEN endpoint_time IS NULL THEN 'no_post_release_trade'
      WHEN "at" + g.horizon - endpoint_time > 43200000000 OR g.horizon > 86400000000 THEN 'endpoint_beyond_cap' WHEN coalesce(unset_pre, 0) + coalesce(unset_post, 0) > 0 OR least(low_pre, low_post) < greatest(high_pre, high_post) THEN 'mixed_axis' END AS exclusion_reason,
    exclusion_reason IS NULL AS valid, CASE WHEN exclusion_reason IS NULL THEN endpoint - baseline END AS response
  FROM grid g LEFT JOIN base USING (event_id, contract) LEFT JOIN ends e ON e.event_id = g.event_id AND e.contract = g.contract AND e.horizon = g.horizon
)"""


@query(f"WITH {PANEL} SELECT event_id, contract, horizon, baseline_time, round(baseline, 6) AS baseline, n_pre, round(endpoint, 6) AS endpoint, n_post, exclusion_reason, valid, round(response, 6) AS response FROM panel")
def trade_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).select("event_id", "contract", "horizon", "baseline_time", F.round("baseline", 6).alias("baseline"), "n_pre", F.round("endpoint", 6).alias("endpoint"), "n_post", "exclusion_reason", "valid", F.round("response", 6).alias("response"))


@query(f"WITH {PANEL} SELECT horizon, round(avg(m), 8) AS mean, count(*) AS events, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT horizon, event_id, avg(response) AS m, count(*) AS n FROM panel WHERE valid GROUP BY ALL) GROUP BY horizon")
def event_equal_weight_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.event_equal_mean(built(spark, sf_dir), ["horizon"]).withColumn("mean", F.round("mean", 8))


@query(f"WITH {PANEL} SELECT count(*) AS rows, count(DISTINCT event_id) AS events, count(DISTINCT contract) AS contracts, count(DISTINCT horizon) AS horizons, CAST(sum(valid::INT) AS BIGINT) AS valid_rows FROM panel")
def panel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"), F.count_distinct("contract").alias("contracts"), F.count_distinct("horizon").alias("horizons"), F.count_if("valid").alias("valid_rows"))


@query(f"WITH {PANEL} SELECT horizon, CAST(sum(valid::INT) AS BIGINT) AS valid_rows, CAST(sum((NOT valid)::INT) AS BIGINT) AS masked_rows FROM panel GROUP BY horizon")
def panel_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).groupBy("horizon").agg(F.count_if("valid").alias("valid_rows"), F.count_if(~F.col("valid")).alias("masked_rows"))


@query(f"WITH {PANEL} SELECT exclusion_reason, count(*) AS rows FROM panel WHERE exclusion_reason IS NOT NULL GROUP BY ALL")
def panel_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(built(spark, sf_dir))


@query(f"""WITH {PANEL} SELECT event_id, count(*) AS rows, count(DISTINCT contract) AS contracts, count(baseline) AS with_baseline, count(endpoint) AS with_endpoint, CAST(sum(valid::INT) AS BIGINT) AS valid_rows,
  round(CASE WHEN count(baseline) > 0 THEN sum(valid::INT) / count(baseline) END, 8) AS valid_share FROM panel GROUP BY ROLLUP (event_id)""")
def panel_count_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.panel_counts(built(spark, sf_dir)).withColumn("valid_share", F.round("valid_share", 8))


@query(f"WITH {PANEL}, one AS (SELECT event_id, horizon, CASE WHEN count(endpoint) = count(*) THEN count(*) FILTER (WHERE endpoint > baseline) END AS risen, count(*) AS pairs FROM panel GROUP BY ALL) SELECT * FROM one")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).groupBy("event_id", "horizon").agg(unknown_if_any(F.col("endpoint"), F.col("endpoint") > F.col("baseline")).alias("risen"), F.count("*").alias("pairs"))


@query(f"WITH {PANEL} SELECT event_id, contract, baseline_ids FROM base JOIN declared USING (event_id, contract)")
def baseline_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prints behind each declared baseline, ties and all."""
    rows = built(spark, sf_dir).where(f"horizon = {SETTINGS.horizons[0]} and baseline_time is not null")
    return rows.select("event_id", "contract", F.array_join(F.transform("baseline_ids", lambda i: i.cast("string")), ",").alias("baseline_ids"))


@query(f"WITH {PANEL} SELECT g.event_id, h.horizon FROM (SELECT DISTINCT event_id FROM panel) g, (SELECT DISTINCT horizon FROM panel) h WHERE NOT EXISTS (FROM panel p WHERE p.event_id = g.event_id AND p.horizon = h.horizon AND p.valid)")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases and horizons without one valid row."""
    rows = built(spark, sf_dir)
    grid = releases(spark).select("event_id").withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in SETTINGS.horizons])))
    return grid.join(rows.select("event_id").distinct(), "event_id", "left_semi").join(rows.where("valid").select("event_id", "horizon"), ["event_id", "horizon"], "left_anti")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases(spark).select("event_id", "at").join(candidates(spark, sf_dir), "event_id")


@query(f"WITH {PRINTS} SELECT d.event_id, d.contract, p.time AS matched_time, p.trade_id AS matched_id, round(p.price, 6) AS price FROM declared d ASOF LEFT JOIN prints p ON p.contract = d.contract AND p.time <= d.\"at\"")
def asof_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = asof.asof_last(probes(spark, sf_dir), prints(spark, sf_dir), ["contract"], "at", "time", "trade_id", ["price"])
    return found.select("event_id", "contract", "matched_time", "matched_id", F.round("matched_price", 6).alias("price"))


@query(f"WITH {PRINTS} SELECT a.trade_id, p.time AS matched_time, p.trade_id AS matched_id FROM prints a ASOF LEFT JOIN prints p ON p.contract = a.contract AND p.time < a.time")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The print before each print."""
    rows = prints(spark, sf_dir)
    return asof.asof_last(rows.select("contract", "time", F.col("trade_id").alias("probe")), rows, ["contract"], "time", "time", "trade_id", ["price"], strict=True).select(F.col("probe").alias("trade_id"), "matched_time", "matched_id")


@query(f"""WITH {PRINTS}, r AS (SELECT trade_id, contract, time, CASE WHEN trade_id % 17 <> 0 THEN time + (trade_id % 5) * 1800000000 END AS usable_time, CASE WHEN trade_id % 19 <> 0 THEN time END AS last_verified, trade_id % 7 <> 0 AS ok, price FROM prints)
SELECT d.event_id, d.contract, r.trade_id AS matched_id,
  CASE WHEN r.time IS NULL THEN 'no_record' WHEN usable_time IS NULL THEN 'usable_time_unknown' WHEN usable_time > d."at" THEN 'not_yet_available' WHEN last_verified IS NULL THEN 'last_verified_unknown'
    WHEN last_verified > d."at" THEN 'last_verified_after_asof_time' WHEN last_verified <= d."at" - 86400000000 THEN 'stale_last_verified' WHEN NOT ok THEN 'invalid_record' END AS exclusion_reason,
  round(CASE WHEN exclusion_reason IS NULL THEN price END, 6) AS value
FROM declared d ASOF LEFT JOIN r ON r.contract = d.contract AND r.time <= d."at" """)
def features_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = prints(spark, sf_dir)
    records = t.select(
        "contract", F.col("trade_id").alias("record_id"), "time", F.when(F.col("trade_id") % 17 != 0, F.col("time") + (F.col("trade_id") % 5) * 1800 * SECOND).alias("usable_time"),
        F.when(F.col("trade_id") % 19 != 0, F.col("time")).alias("last_verified"), (F.col("trade_id") % 7 != 0).alias("valid"), F.col("price").alias("value"),
    )
    found = asof.features_asof(records, probes(spark, sf_dir), ["contract"], "at", 24 * HOUR)
    return found.select("event_id", "contract", "matched_id", "exclusion_reason", F.round("matched_value", 6).alias("value"))


@query(f"WITH {PRINTS} SELECT contract, arg_max(trade_id, (time, trade_id)) AS trade_id, max(time) AS time FROM prints GROUP BY contract")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.latest_by_key(prints(spark, sf_dir), ["contract"], "time", "trade_id").select("contract", "trade_id", "time")


@query(f"""WITH {PRINTS}, n AS (SELECT d.event_id, d.contract, p.time - d."at" AS wait FROM declared d LEFT JOIN prints p ON p.contract = d.contract)
SELECT event_id, contract, count(*) FILTER (WHERE wait >= -43200000000 AND wait < 0) AS baseline, count(*) FILTER (WHERE wait BETWEEN 0 AND 3600000000) AS early, count(*) FILTER (WHERE wait BETWEEN 0 AND 21600000000) AS anchor, count(*) FILTER (WHERE wait > 21600000000 AND wait <= 86400000000) AS target
FROM n GROUP BY ALL""")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts around a release in one range join."""
    p = probes(spark, sf_dir)
    near = asof.window_join(prints(spark, sf_dir), p, "time", "at", 12 * HOUR, 24 * HOUR, ["contract"]).withColumn("wait", F.col("time") - F.col("at"))
    w = F.col("wait")
    counted = near.groupBy("event_id", "contract").agg(
        F.count_if((w >= -12 * HOUR) & (w < 0)).alias("baseline"), F.count_if(w.between(0, HOUR)).alias("early"), F.count_if(w.between(0, 6 * HOUR)).alias("anchor"), F.count_if((w > 6 * HOUR) & (w <= 24 * HOUR)).alias("target")
    )
    return p.select("event_id", "contract").join(counted, ["event_id", "contract"], "left").na.fill(0)


@query(f"""WITH {PRINTS}, x AS (SELECT event_id, contract, "at" AS release, "at" + 3600000000 AS tau, contract - 3 AS donor FROM declared),
near AS (SELECT x.event_id, x.contract, x.release, x.tau, p.time, p.price FROM x JOIN prints p ON p.contract = x.contract AND p.time BETWEEN x.release - 86400000000 AND x.release + 25200000000),
a AS (SELECT event_id, contract, max(time) FILTER (WHERE time <= tau) AS ta, max(time) FILTER (WHERE time <= tau - 21600000000) AS tp, max(time) FILTER (WHERE time > tau) AS tt FROM near GROUP BY ALL),
o AS (SELECT event_id, contract, avg(price) FILTER (WHERE time = ta) AS anchor, avg(price) FILTER (WHERE time = tp) AS prior, avg(price) FILTER (WHERE time = tt) AS lvl FROM near JOIN a USING (event_id, contract) GROUP BY ALL),
b AS (SELECT event_id, contract, max(time) FILTER (WHERE time < release) AS tb, max(time) FILTER (WHERE time >= release AND time <= tau - 600000000) AS ts FROM near GROUP BY ALL),
l AS (SELECT event_id, contract, avg(price) FILTER (WHERE time = tb) AS b0, avg(price) FILTER (WHERE time = ts) AS s0 FROM near JOIN b USING (event_id, contract) GROUP BY ALL)
SELECT x.event_id, x.contract, round(anchor, 6) AS anchor, round(anchor - prior, 6) AS own_lag, round(lvl - anchor, 6) AS target, round(s0 - b0, 6) AS neighbor_lag, CASE WHEN anchor IS NULL THEN 'no_anchor' WHEN lvl IS NULL THEN 'no_target' END AS exclusion_reason
FROM x LEFT JOIN o USING (event_id, contract) LEFT JOIN l ON l.event_id = x.event_id AND l.contract = x.donor""")
def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contract's donor is the one three ids below, declared for the same releases."""
    c = candidates(spark, sf_dir)
    donors = c.select("contract").distinct().select("contract", (F.col("contract") - 3).alias("donor"))
    rows = panel.forecast_rows(prints(spark, sf_dir), releases(spark).select("event_id", F.col("at").alias("release")), c, donors, HOUR, 600 * SECOND, 6 * HOUR, 24 * HOUR, 24 * HOUR)
    return rows.select("event_id", "contract", *[F.round(x, 6).alias(x) for x in ("anchor", "own_lag", "target", "neighbor_lag")], "exclusion_reason")


@query(f"""WITH {PRINTS}, q AS (SELECT contract, trade_id, time, CASE WHEN trade_id % 41 = 0 THEN 'closed' WHEN trade_id % 13 = 0 THEN 'crossed' ELSE 'valid' END AS state, CASE WHEN trade_id % 17 <> 0 THEN time - trade_id % 5 * 3600000000 END AS seen, CASE WHEN trade_id % 19 <> 0 THEN price - 0.01 END AS bid, price + 0.01 AS ask FROM prints),
k AS (SELECT DISTINCT contract, CASE WHEN contract % 31 <> 30 THEN {FIRST - 86400 * SECOND} END AS opened, CASE WHEN contract % 5 = 0 THEN {FIRST + 20 * 86400 * SECOND} END AS closed, CASE WHEN contract % 11 <> 0 THEN {FIRST - 30 * 86400 * SECOND} + contract % 7 * {6 * 86400 * SECOND} END AS rule_from FROM prints WHERE contract % 23 <> 0),
g AS (SELECT d.event_id, d.contract, d."at", h, d."at" + h AS til, d.event_id % 8 = 0 AS dirty FROM declared d, (SELECT unnest([3600000000, 43200000000]) AS h) x),
b AS (SELECT g.*, q.trade_id AS bi, q.time AS bt, q.state AS bs, q.seen AS bv, q.bid AS bb, q.ask AS ba FROM g ASOF LEFT JOIN q ON q.contract = g.contract AND q.time < g."at"),
e AS (SELECT b.*, q.trade_id AS ei, q.time AS et, q.state AS es, q.seen AS ev, q.bid AS eb, q.ask AS ea FROM b ASOF LEFT JOIN q ON q.contract = b.contract AND q.time <= b.til),
z AS (SELECT g.event_id, g.contract, g.h, count(*) > 0 AS shut FROM g JOIN q ON q.contract = g.contract AND q.state = 'closed' AND q.time BETWEEN g."at" AND g.til GROUP BY ALL),
r AS (SELECT e.*, CASE WHEN k.contract IS NULL THEN 'ineligible_contract' WHEN rule_from IS NULL THEN 'unknown_rule_semantics' WHEN rule_from > e."at" THEN 'rule_unavailable' WHEN opened IS NULL OR opened > e."at" OR closed <= til THEN 'contract_not_open' WHEN bt IS NULL THEN 'missing_baseline' WHEN et IS NULL THEN 'missing_endpoint'
  WHEN z.shut THEN 'closed_in_window' WHEN dirty AND e.h >= 7200000000 THEN 'contaminated' WHEN bs <> 'valid' THEN 'baseline_quote_invalid' WHEN bv IS NULL THEN 'baseline_last_verified_unknown' WHEN e."at" - bv > 86400000000 THEN 'baseline_quote_stale' WHEN bb IS NULL THEN 'baseline_side_missing'
  WHEN es <> 'valid' THEN 'endpoint_quote_invalid' WHEN ev IS NULL THEN 'endpoint_last_verified_unknown' WHEN til - ev > 86400000000 THEN 'endpoint_quote_stale' WHEN eb IS NULL THEN 'endpoint_side_missing' END AS reason
  FROM e LEFT JOIN k ON k.contract = e.contract LEFT JOIN z ON z.event_id = e.event_id AND z.contract = e.contract AND z.h = e.h)
SELECT event_id, contract, h AS horizon, bi AS baseline_id, ei AS endpoint_id, reason AS exclusion_reason, round(CASE WHEN reason IS NULL THEN (eb + ea) / 2 - (bb + ba) / 2 END, 6) AS response, CASE WHEN reason IS NULL THEN "at" - bv END AS baseline_age FROM r""")
def quote_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints as quotes of two sides, with planted closings, crossings, unknown verifications, missing sides and contracts."""
    t, i, k, day = prints(spark, sf_dir), F.col("trade_id"), F.col("contract"), 24 * HOUR
    quotes = t.select(
        "contract", i.alias("record_id"), "time", F.when(i % 41 == 0, "closed").when(i % 13 == 0, "crossed").otherwise("valid").alias("state"), F.when(i % 17 != 0, F.col("time") - i % 5 * HOUR).alias("last_verified"),
        F.when(i % 19 != 0, F.col("price") - 0.01).alias("bid"), (F.col("price") + 0.01).alias("ask"),
    )
    contracts = t.where(k % 23 != 0).select("contract").distinct().select(
        "contract", F.when(k % 31 != 30, F.lit(FIRST - day)).alias("opened"), F.when(k % 5 == 0, F.lit(FIRST + 20 * day)).alias("closed"), F.when(k % 11 != 0, F.lit(FIRST - 30 * day) + k % 7 * F.lit(6 * day)).alias("rule_from")
    )
    at = F.col("at")
    declared = releases(spark).select("event_id", "at", F.when(F.col("event_id") % 8 == 0, F.array(F.struct((at + 2 * HOUR).alias("start"), (at + 3 * HOUR).alias("end")))).alias("contaminated"))
    found = panel.quote_panel(quotes, declared, candidates(spark, sf_dir), contracts, (HOUR, 12 * HOUR), day)
    return found.select("event_id", "contract", "horizon", "baseline_id", "endpoint_id", "exclusion_reason", F.round("response", 6).alias("response"), "baseline_age")
