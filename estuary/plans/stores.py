"""Stores, release facts, coverage and ladders' blocks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import panel, rollups, sets
from ..sources import stores
from .markets import QUOTES, quotes
from .panels import HOUR, PRINTS, SETTINGS, built, candidates, prints, releases
from .registry import query, read


@query("""SELECT c_custkey AS event_id, 'balance' AS statistic, round(c_acctbal, 2) AS value, false AS revised FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE), false FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT c_custkey, 'balance_revised', round(c_acctbal + 1, 2), true FROM customer WHERE c_custkey % 3 = 0""")
def release_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of releases whose values and revisions are JSON maps; a release without values has none."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    money = lambda x: F.round(x, 2).cast("decimal(18,2)").cast("string")
    made = c.select(
        k.alias("event_id"), F.col("c_mktsegment").alias("family"), k.alias("release_time"), F.lit("p").alias("reference_period"), F.when(k % 4 != 0, F.to_json(F.create_map(F.lit("balance"), money(F.col("c_acctbal")), F.lit("nation"), F.col("c_nationkey").cast("string")))).alias("values"),
        F.when(k % 3 == 0, F.to_json(F.create_map(F.lit("balance_revised"), money(F.col("c_acctbal") + 1)))).alias("revisions"),
    )
    return stores.release_facts(made).select("event_id", "statistic", F.col("value").cast("double").alias("value"), "revised")


@query("""WITH e AS (SELECT o_custkey AS event_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS quality FROM orders GROUP BY 1), a AS (SELECT o_custkey AS event_id, min(epoch_us(o_orderdate)) AS closed FROM orders GROUP BY 1)
SELECT c_custkey AS event_id, quality AS rule_quality, quality IS NOT NULL AS rule_known, coalesce(closed < 820454400000000 + c_custkey * 86400000000, false) AS closed_before FROM customer LEFT JOIN e ON e.event_id = c_custkey LEFT JOIN a ON a.event_id = c_custkey""")
def event_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    evidence = o.select(F.col("o_custkey").alias("event_id"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("rule_hash"), F.col("o_orderstatus").alias("quality"), times.micros(F.col("o_orderdate")).alias("observed_at"))
    audit = o.select(F.col("o_custkey").alias("event_id"), times.micros(F.col("o_orderdate")).alias("close_time"))
    planned = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), (F.lit(820_454_400_000_000) + F.col("c_custkey") * 24 * HOUR).alias("release_time"))
    return stores.event_specs(planned, evidence, audit).select("event_id", "rule_quality", "rule_known", "closed_before")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS found FROM events""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings that name an id, at whatever depth they lie."""
    i = F.col("event_id")
    own = F.concat(F.lit('{"event_id": '), i.cast("string"), F.lit(', "k": 1}'))
    doc = F.when(i % 4 == 0, F.concat(F.lit('{"a": [{"b": '), own, F.lit("}, "), own, F.lit("]}"))).when(i % 4 == 1, F.concat(F.lit("["), own, F.lit(', {"event_id": -1, "k": 2}]'))).when(i % 4 == 2, F.concat(F.lit('{"event_id": '), i.cast("string"), F.lit("}"))).otherwise("no json")
    return read(spark, sf_dir, "events").select("event_id", F.size(stores.json_find(doc, "event_id", i, ("k",))).alias("found"))


@query(f"""WITH {QUOTES}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY apr, symbol, ord, venue) AS rn FROM q WHERE apr IS NOT NULL), d AS (SELECT s.asset, s.apr - l.apr AS spread FROM k l JOIN k s ON l.asset = s.asset AND l.rn < s.rn AND (l.venue <> s.venue OR l.symbol <> s.symbol))
SELECT round(spread, 8) AS spread FROM d ORDER BY spread DESC LIMIT 50""")
def widest_differentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first fifty, the widest first."""
    d = sets.funding_differentials(quotes(spark, sf_dir), ["asset"])
    return stores.widest_first(d, "apr_spread", ["asset", "long_order", "short_order"]).limit(50).select(F.round("apr_spread", 8).alias("spread"))


@query("""WITH p AS (SELECT event_id % 500 AS condition, event_id // 100 AS page_hash, event_id AS position, event_type, event_id // 100 AS received FROM events WHERE event_id % 500 <> 0)
SELECT condition, arg_min(position, (received, page_hash, position)) AS position, count(*) AS times, min(event_type) <> max(event_type) AS conflict FROM p GROUP BY 1""")
def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pages = read(spark, sf_dir, "events").select(F.when(i % 500 != 0, i % 500).alias("condition"), F.floor(i / 100).alias("page_hash"), i.alias("position"), "event_type", F.floor(i / 100).alias("received"))
    return stores.metadata_records(pages, "condition", ["event_type"]).select("condition", "position", "times", "conflict")


@query("""WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0)
SELECT CASE WHEN b.p_partkey IS NULL THEN 'only_sealed' WHEN a.p_partkey IS NULL THEN 'only_parsed' WHEN a.p_size = b.p_size THEN 'confirmed' ELSE 'differs' END AS finding, count(*) AS statements FROM a FULL JOIN b ON a.p_partkey = b.p_partkey GROUP BY 1""")
def reverified_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    parsed = p.where(k % 3 != 0).withColumn("p_size", F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return stores.reverified(p.where(k % 5 != 0), parsed, ["p_partkey"], "p_size").groupBy("finding").agg(F.count("*").alias("statements"))


COVERED = f"""{PRINTS}, m AS (SELECT d.event_id, d.contract, d."at", CASE WHEN d.contract % 20 <> 7 THEN (SELECT count(*) FROM prints p WHERE p.contract = d.contract AND p.time BETWEEN d."at" - 43200000000 AND d."at" + 86400000000) END AS n FROM declared d),
g AS (SELECT *, CASE WHEN contract % 31 = 0 THEN 'not_open_at_release' WHEN contract % 29 = 0 THEN 'closed_before_release' WHEN contract % 13 = 0 THEN 'rule_not_verified' WHEN contract % 11 = 0 AND event_id < 15 THEN 'rule_not_in_force' WHEN n IS NULL THEN 'window_not_measured' WHEN n = 0 THEN 'no_prints' END AS reason FROM m)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, first = F.col("contract"), int(1704110400 * times.SECOND)
    pairs = candidates(spark, sf_dir).withColumns({"opened": F.when(k % 31 != 0, F.lit(0)), "closed": F.when(k % 29 == 0, F.lit(first))})
    contracts = pairs.select("contract").distinct()
    evidence = contracts.select("contract", (k % 13 != 0).alias("verified"), F.when(k % 11 == 0, F.lit(first + 15 * 24 * HOUR)).otherwise(F.lit(0)).alias("from"), F.lit(None).cast("long").alias("to"))
    from ..operators import asof

    near = asof.window_join(prints(spark, sf_dir), pairs.select("event_id", "contract").join(releases(spark).select("event_id", "at"), "event_id"), "time", "at", 12 * HOUR, 24 * HOUR, ["contract"])
    counted = near.groupBy("event_id", "contract").agg(F.count("*").alias("n"))
    measured = pairs.select("event_id", "contract").join(counted, ["event_id", "contract"], "left").select("event_id", "contract", F.when(k % 20 != 7, F.coalesce("n", F.lit(0))).alias("prints"))
    return stores.coverage_pairs(releases(spark).select("event_id", "at"), pairs, evidence, measured)


@query(f"WITH {COVERED} SELECT event_id, contract, n AS prints, reason, reason IS NULL AS covered FROM g")
def coverage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared release and contract, with the first reason why it is not covered."""
    return _covered(spark, sf_dir).select("event_id", "contract", "prints", "reason", "covered")


@query(f"WITH {COVERED} SELECT event_id, count(*) AS pairs, count(*) FILTER (WHERE reason IS NULL) AS covered, CASE WHEN count(n) = count(*) THEN count(*) FILTER (WHERE n > 0) END AS with_prints FROM g GROUP BY 1")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.coverage_totals(_covered(spark, sf_dir))


@query("""WITH d AS (SELECT event_type AS family, user_id, CASE WHEN event_id % 2 = 0 THEN value END AS own, CASE WHEN event_id % 10 = 0 AND event_type <> 'click' THEN value END AS lent FROM events)
SELECT family, 'own' AS rung, count(DISTINCT CASE WHEN own IS NOT NULL THEN user_id END) AS events, count(own) AS complete_rows, CASE WHEN count(own) = 0 THEN 'never_known:own' WHEN count(DISTINCT CASE WHEN own IS NOT NULL THEN user_id END) < 20 THEN 'too_few_events' END AS blocked FROM d GROUP BY 1
UNION ALL SELECT family, 'network', count(DISTINCT CASE WHEN own IS NOT NULL AND lent IS NOT NULL THEN user_id END), count(*) FILTER (WHERE own IS NOT NULL AND lent IS NOT NULL),
  CASE WHEN count(lent) = 0 THEN 'never_known:lent' WHEN count(DISTINCT CASE WHEN own IS NOT NULL AND lent IS NOT NULL THEN user_id END) < 20 THEN 'too_few_events' END FROM d GROUP BY 1""")
def rung_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    d = read(spark, sf_dir, "events").select(F.col("event_type").alias("family"), "user_id", F.when(i % 2 == 0, F.col("value")).alias("own"), F.when((i % 10 == 0) & (F.col("event_type") != "click"), F.col("value")).alias("lent"))
    return stores.rung_blocks(d, {"own": ["own"], "network": ["own", "lent"]}, "user_id", 20)


@query(f"""WITH {PRINTS}, x AS (SELECT event_id, contract, "at" AS release, "at" + 3600000000 AS tau FROM declared), n AS (SELECT x.*, p.time FROM x LEFT JOIN prints p ON p.contract = x.contract AND p.time BETWEEN x.release - 86400000000 AND x.tau + 21600000000),
r AS (SELECT event_id, contract, count(*) FILTER (WHERE time <= tau) > 0 AS anchored, count(*) FILTER (WHERE time > tau) > 0 AS ended FROM n GROUP BY ALL)
SELECT count(*) AS rows, count(*) FILTER (WHERE anchored AND ended) AS valid_rows, count(*) FILTER (WHERE anchored AND ended) AS rows_with_target, count(DISTINCT contract) AS receivers, count(DISTINCT event_id) AS events FROM r""")
def forecast_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    donors = c.select("contract").distinct().select("contract", (F.col("contract") - 3).alias("donor"))
    rows = panel.forecast_rows(prints(spark, sf_dir), releases(spark).select("event_id", F.col("at").alias("release")), c, donors, HOUR, 600 * times.SECOND, 6 * HOUR, 24 * HOUR, 24 * HOUR)
    return rollups.forecast_counts(rows).drop("rows_with_neighbor_lag")


@query("""SELECT * FROM (VALUES ('FED-A', 'level', CAST(4.5 AS DOUBLE), NULL), ('FED-B', NULL, NULL, 'payout_text_unreadable'), ('FED-C', 'change', -25.0, NULL)) t(ticker, subject, threshold, refusal)""")
def first_venue_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("FED-C", "Cut 25bps", ""), ("FED-A", "Above 4.5%", "federal funds rate"), ("FEDX-Z", "No change", ""), ("FED-B", "maybe", "")]
    return stores.first_venue_predicates(spark.createDataFrame(rows, "ticker string, subtitle string, title string"), ["FED"]).select("ticker", "subject", "threshold", "refusal")


@query()
def absorption_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over releases of each release's median half-way time, with what was refused."""
    from ..operators import absorption

    paths = absorption.absorption(built(spark, sf_dir), ["event_id", "contract"], "horizon", "response", SETTINGS.horizons[-1])
    return rollups.absorption_summary(paths, "event_id")
