"""Universes, occurrences, gaps, pairs, grades and donor edges over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, masking, text
from ..functions.times import SECOND, epoch_seconds, micros
from ..operators import asof, sets
from .registry import query, read


@query("""WITH live AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END AS owner FROM orders WHERE o_orderkey % 3 <> 0),
archive AS (SELECT o_orderkey AS id, lower(o_orderstatus) AS status, o_custkey + 1 AS owner FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(l.id, a.id) AS id, coalesce(l.status, a.status) AS status, coalesce(l.owner, a.owner) AS owner, l.id IS NOT NULL AS seen_live, a.id IS NOT NULL AS seen_archive,
  CASE WHEN a.id IS NULL THEN 'live_only' WHEN l.id IS NULL THEN 'archive_only' ELSE 'live_and_archive' END AS origin FROM live l FULL JOIN archive a ON l.id = a.id""")
def universe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    live = o.where(k % 3 != 0).select(k.alias("id"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 6 != 0, F.col("o_custkey")).alias("owner"))
    archive = o.where(k % 5 != 0).select(k.alias("id"), F.lower("o_orderstatus").alias("status"), (F.col("o_custkey") + 1).alias("owner"))
    return sets.union_by_precedence([("live", live), ("archive", archive)], "id", ["status", "owner"])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT k AS custkey FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def layer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.where("o_orderkey % 3 != 0").select(F.col("o_custkey").alias("custkey")).intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("""SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)""")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored minus referenced."""
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("custkey"))


@query("""WITH r AS (SELECT sha256(text) AS body, doc_id, lang, source, count(*) OVER (PARTITION BY sha256(text)) AS times, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n, min(source) OVER (PARTITION BY sha256(text)) <> max(source) OVER (PARTITION BY sha256(text)) AS conflict FROM documents)
SELECT body, doc_id, lang, source, times, conflict FROM r WHERE n = 1""")
def content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One blob for each content; receipts that disagree about their source conflict."""
    d = read(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("body"), "doc_id", "lang", "source")
    return sets.first_occurrences(d, ["body"], ["doc_id"], ["source"])


@query("""WITH e AS (SELECT *, user_id % 50 AS venue, event_id // 3 AS occurrence FROM events), r AS (SELECT venue, occurrence, event_id, event_type, row_number() OVER w AS n, count(*) OVER p AS times, min(event_type) OVER p <> max(event_type) OVER p AS conflict FROM e WINDOW p AS (PARTITION BY venue, occurrence), w AS (PARTITION BY venue, occurrence ORDER BY ts, event_id))
SELECT venue, occurrence, event_id, event_type, times, conflict FROM r WHERE n = 1""")
def occurrence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(50)).alias("venue"), F.floor(F.col("event_id") / 3).alias("occurrence"), "event_id", "event_type", "ts")
    return sets.first_occurrences(e, ["venue", "occurrence"], ["ts", "event_id"], ["event_type"]).drop("ts")


@query("""WITH e AS (SELECT event_type AS venue, epoch_us(date_trunc('hour', ts)) AS stamp FROM events), h AS (SELECT DISTINCT venue, CASE WHEN stamp // 3600000000 % 7 = 3 THEN stamp - 3600000000 WHEN stamp // 3600000000 % 11 = 5 THEN stamp + 1800000000 ELSE stamp END AS stamp FROM e), g AS (SELECT *, stamp - lag(stamp) OVER (PARTITION BY venue ORDER BY stamp) AS delta FROM h)
SELECT venue, count(*) AS stamps, CAST(coalesce(sum(CASE WHEN delta % 3600000000 = 0 AND delta > 3600000000 THEN delta // 3600000000 - 1 END), 0) AS BIGINT) AS missing, count(*) FILTER (WHERE delta % 3600000000 <> 0) AS off_grid, max(delta) AS widest FROM g GROUP BY venue""")
def candle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours at which a venue printed, with gaps and stamps off the grid planted by moving whole hours."""
    hour = F.floor(micros(F.col("ts")) / (3600 * SECOND))
    moved = F.when(hour % 7 == 3, (hour - 1) * 3600 * SECOND).when(hour % 11 == 5, hour * 3600 * SECOND + 1800 * SECOND).otherwise(hour * 3600 * SECOND)
    h = read(spark, sf_dir, "events").select(F.col("event_type").alias("venue"), moved.alias("stamp")).distinct()
    gaps = sets.spacing(h, ["venue"], "stamp", 3600 * SECOND)
    return gaps.groupBy("venue").agg(F.count("*").alias("stamps"), F.sum("missing").alias("missing"), F.count_if("off_grid").alias("off_grid"), F.max("delta").alias("widest"))


QUOTES = """q AS (SELECT l_partkey AS asset, l_suppkey AS venue, l_orderkey AS symbol, l_linenumber AS ord, l_discount / 100 AS rate, CASE WHEN l_linenumber % 4 <> 0 THEN l_tax - l_discount END AS apr, l_extendedprice / l_quantity AS price,
  CASE WHEN l_returnflag = 'A' THEN 8.0 WHEN l_returnflag = 'N' THEN 4.0 END AS hours, CASE WHEN l_linestatus = 'F' THEN l_tax END AS paid FROM lineitem)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("venue"), F.col("l_orderkey").alias("symbol"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("order"), (F.col("l_discount") / 100).alias("rate"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax") - F.col("l_discount")).alias("apr"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_returnflag") == "A", 8.0).when(F.col("l_returnflag") == "N", 4.0).alias("hours"), F.when(F.col("l_linestatus") == "F", F.col("l_tax")).alias("paid_30d"),
    )


@query(f"""WITH {QUOTES}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY apr, symbol, ord, venue) AS rn FROM q WHERE apr IS NOT NULL)
SELECT s.asset, count(*) AS pairs, round(max(s.apr - l.apr), 8) AS widest, round(avg(s.apr - l.apr), 8) AS mean, count(s.rate / s.hours - l.rate / l.hours) AS with_hours, count(s.paid - l.paid) AS settled
FROM k l JOIN k s ON l.asset = s.asset AND l.rn < s.rn AND (l.venue <> s.venue OR l.symbol <> s.symbol) GROUP BY s.asset""")
def funding_differentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sets.funding_differentials(quotes(spark, sf_dir), ["asset"])
    return d.groupBy("asset").agg(F.count("*").alias("pairs"), F.round(F.max("apr_spread"), 8).alias("widest"), F.round(F.avg("apr_spread"), 8).alias("mean"), F.count("per_hour").alias("with_hours"), F.count("settled_30d").alias("settled"))


@query(f"""WITH {QUOTES}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY price, symbol, ord, venue) AS rn FROM q WHERE price > 0)
SELECT a.asset, count(*) AS pairs, round(max(ln(b.price) - ln(a.price)), 8) AS widest FROM k a JOIN k b ON a.asset = b.asset AND a.rn < b.rn GROUP BY a.asset""")
def cross_venue_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sets.cross_venue_basis(quotes(spark, sf_dir), ["asset"])
    return d.groupBy("asset").agg(F.count("*").alias("pairs"), F.round(F.max("basis"), 8).alias("widest"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS rate, l_discount * (1095 + l_suppkey % 5 * 40) AS apr, CASE WHEN l_orderkey % 2 = 0 THEN 90 + l_orderkey % 10 END AS n FROM lineitem),
h AS (SELECT *, CASE WHEN apr <> 0 AND rate <> 0 THEN rate * 8760 / apr END AS a, CASE WHEN n > 0 THEN 30.0 * 24 / n END AS b FROM q),
s AS (SELECT *, (SELECT min((abs(a - x) / x, x)) FROM (VALUES (1.0::DOUBLE), (4.0), (8.0)) v(x)) AS sa, (SELECT min((abs(b - x) / x, x)) FROM (VALUES (1.0::DOUBLE), (4.0), (8.0)) v(x)) AS sb FROM h),
i AS (SELECT CASE WHEN a IS NOT NULL AND sa[1] <= 0.15 THEN sa[2] END AS ha, CASE WHEN b IS NOT NULL AND sb[1] <= 0.15 THEN sb[2] END AS hb FROM s)
SELECT CASE WHEN ha <> hb THEN NULL ELSE coalesce(ha, hb) END AS hours, CASE WHEN ha <> hb THEN 'interval_disagrees' WHEN coalesce(ha, hb) IS NULL THEN 'interval_underivable' END AS refusal, count(*) AS quotes FROM i GROUP BY ALL""")
def interval_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("rate"), (F.col("l_discount") * (1095 + F.col("l_suppkey") % 5 * 40)).alias("apr"), F.lit(30.0).alias("window_days"), F.when(F.col("l_orderkey") % 2 == 0, 90 + F.col("l_orderkey") % 10).alias("settlements")
    )
    return sets.implied_interval(q).groupBy(F.col("interval_hours").alias("hours"), F.col("interval_refusal").alias("refusal")).agg(F.count("*").alias("quotes"))


PREDICATES = """l AS (SELECT p_partkey AS id, p_size % 7 <> 0 AS readable, p_brand AS underlying_event, CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS reference_period, CAST(p_size AS DOUBLE) AS threshold, CASE WHEN p_size % 2 = 0 THEN 'above' ELSE 'below' END AS operator, split_part(p_name, ' ', 1) AS settlement_criterion, p_size % 3 AS reference_horizon, 'pct' AS unit FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT p_partkey AS id, p_size % 7 <> 0 AS readable, p_brand AS underlying_event, p_type AS reference_period, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size * 100 ELSE p_size END AS DOUBLE) AS threshold, CASE WHEN p_size % 2 = 0 THEN 'above' ELSE 'below' END AS operator, split_part(p_name, ' ', 2) AS settlement_criterion, p_size % 3 AS reference_horizon, CASE WHEN p_partkey % 3 = 0 THEN 'bps' ELSE 'pct' END AS unit FROM part WHERE p_partkey % 2 = 1),
v AS (SELECT l.id AS a, r.id AS b, l.readable AND r.readable AS ok, l.reference_period IS NULL AS unseen, l.reference_period <> r.reference_period AS pd, l.operator <> r.operator AS od, l.settlement_criterion <> r.settlement_criterion OR l.reference_horizon <> r.reference_horizon AS other, CASE WHEN l.threshold = r.threshold AND l.unit = r.unit THEN 'equal'
  WHEN abs(l.threshold * CASE l.unit WHEN 'pct' THEN 1.0 ELSE 0.01 END - r.threshold * CASE r.unit WHEN 'pct' THEN 1.0 ELSE 0.01 END) < 1e-9 THEN 'equivalent' ELSE 'differs' END AS tv FROM l JOIN r USING (underlying_event)),
g AS (SELECT *, CASE WHEN NOT ok OR unseen OR pd OR od OR tv = 'differs' THEN 'REJECT' WHEN tv = 'equivalent' THEN 'ECONOMICALLY_EQUIVALENT' WHEN other THEN 'APPROXIMATE' ELSE 'EXACT' END AS grade FROM v)"""


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair classes of two venues' predicates: even parts on the one, odd ones, some in another unit, on the other."""
    p, k, n = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("double")
    word = F.split("p_name", " ")
    both = [k.alias("id"), (F.col("p_size") % 7 != 0).alias("readable"), F.col("p_brand").alias("underlying_event"), F.when(F.col("p_size") % 2 == 0, "above").otherwise("below").alias("operator"), (F.col("p_size") % 3).alias("reference_horizon")]
    left = p.where(k % 2 == 0).select(*both, n.alias("threshold"), F.when(k % 9 != 0, F.col("p_type")).alias("reference_period"), word[0].alias("settlement_criterion"), F.lit("pct").alias("unit"))
    right = p.where(k % 2 == 1).select(*both, F.when(k % 3 == 0, n * 100).otherwise(n).alias("threshold"), F.col("p_type").alias("reference_period"), F.coalesce(F.get(word, F.lit(1)), F.lit("")).alias("settlement_criterion"), F.when(k % 3 == 0, "bps").otherwise("pct").alias("unit"))
    return sets.graded_classes(left, right, list(sets.COMPONENTS), list(sets.REQUIRED_COMPONENTS), "threshold", {"pct": 1.0, "bps": 0.01}, "underlying_event")


@query(f"WITH {PREDICATES} SELECT grade, count(*) AS pairs FROM g GROUP BY ALL")
def graded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.registry_counts(predicates(spark, sf_dir))[0]


@query(f"""WITH {PREDICATES}, x AS (SELECT unnest(list_filter([CASE WHEN NOT ok THEN 'unreadable' END, CASE WHEN unseen THEN 'reference_period_unobserved' END, CASE WHEN pd THEN 'reference_period_differs' END, CASE WHEN tv = 'differs' THEN 'threshold_differs' END, CASE WHEN od THEN 'operator_differs' END], lambda y: y IS NOT NULL)) AS reason FROM g)
SELECT reason, count(*) AS pairs FROM x GROUP BY reason""")
def grade_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by each reason of a rejection; a pair counts under all of its reasons."""
    return sets.registry_counts(predicates(spark, sf_dir))[1]


@query("""WITH c AS (SELECT o_orderkey AS contract, CASE o_orderkey % 12 WHEN 6 THEN 7 ELSE o_orderkey % 12 END AS date, o_custkey % 20 AS strike, o_orderkey % 7 AS opened, CASE WHEN o_orderkey % 5 <> 0 THEN 8 + o_orderkey % 60 END AS closed, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 9 END AS vf, CASE WHEN o_orderkey % 2 = 0 THEN 20 + o_orderkey % 60 END AS vt FROM orders),
cal AS (SELECT date, date * 4 AS origin, date * 4 + 3 AS we, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT unnest(range(12)) AS date)),
r AS (SELECT c.*, origin, we, prev FROM c JOIN cal USING (date)),
m AS (SELECT r.contract, count(d.contract) AS same, count(d.contract) FILTER (WHERE d.opened <= origin AND coalesce(d.closed > origin AND d.closed > we, true)) AS live, min(d.contract) FILTER (WHERE d.opened <= origin AND coalesce(d.closed > origin AND d.closed > we, true) AND coalesce(d.vf <= origin, false) AND coalesce(we < d.vt, true)) AS donor
  FROM r LEFT JOIN c d ON d.date = r.prev AND d.strike = r.strike GROUP BY r.contract)
SELECT contract, date, reason, CASE WHEN reason IS NULL THEN donor END AS donor FROM (SELECT r.contract, r.date, donor, CASE WHEN NOT (opened <= origin AND coalesce(closed > origin, true)) THEN 'receiver_not_open' WHEN NOT coalesce(closed > we, true) THEN 'receiver_not_open_through_window' WHEN NOT (coalesce(vf <= origin, false) AND coalesce(we < vt, true)) THEN 'receiver_rule_not_verified'
  WHEN prev IS NULL THEN 'no_earlier_meeting' WHEN prev NOT IN (SELECT date FROM c) THEN 'no_contract_at_previous_meeting' WHEN same = 0 THEN 'no_matching_contract' WHEN live = 0 THEN 'donor_not_open' WHEN donor IS NULL THEN 'donor_rule_not_verified' END AS reason
FROM r JOIN m USING (contract))""")
def neighbor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = read(spark, sf_dir, "orders").select(
        k.alias("contract"), F.when(k % 12 == 6, 7).otherwise(k % 12).alias("date"), (F.col("o_custkey") % 20).alias("strike"), (k % 7).alias("opened"), F.when(k % 5 != 0, 8 + k % 60).alias("closed"), F.when(k % 11 != 0, k % 9).alias("verified_from"), F.when(k % 2 == 0, 20 + k % 60).alias("verified_to")
    )
    cal = spark.range(12).select(F.col("id").alias("date"), (F.col("id") * 4).alias("origin"), (F.col("id") * 4 + 3).alias("window_end"))
    return sets.neighbor_edges(c, cal, ["strike"])


@query("""SELECT p_brand AS name, p_type AS key FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND regexp_matches(p_brand, '#[1-3]')) ORDER BY 1, 2 LIMIT 40""")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the operator's own: sorted candidates, the first forty."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("key"))
    return sets.distinct_names(p, "name", "key", "#[1-3]", 40)[0]


@query("""SELECT c_custkey AS custkey FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-06-30' AND (o_orderstatus <> 'F' OR o_orderdate >= TIMESTAMP '1996-01-01'))""")
def covered_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval overlap with a window: opened by its end and, where closed, not before its start."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("opened"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed"))
    end, start = F.lit("1996-06-30").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")
    met = o.where((F.col("opened") <= end) & (F.col("closed").isNull() | (F.col("closed") >= start)))
    return read(spark, sf_dir, "customer").join(met, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("custkey"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) / 100 AS price, CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN -1 END AS side,
  concat_ws(',', CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 0 THEN 'zero_cent_price' END, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) NOT BETWEEN 0 AND 99 THEN 'price_outside_range' END, CASE WHEN event_id % 50 = 0 THEN 'legs_not_100' END) AS flags FROM events""")
def normalised_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents to price, side to sign, flags instead of repairs."""
    e = read(spark, sf_dir, "events").withColumn("cents", F.get_json_object("props", "$.k").cast("long"))
    flags = masking.reasons((F.col("cents") == 0, "zero_cent_price"), (~F.col("cents").between(0, 99), "price_outside_range"), (F.col("event_id") % 50 == 0, "legs_not_100"))
    return e.select("event_id", (F.col("cents") / 100).alias("price"), F.when(F.col("user_id") % 3 == 0, 1).when(F.col("user_id") % 3 == 1, -1).alias("side"), F.array_join(flags, ",").alias("flags"))


@query("""SELECT flag, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount = 0 THEN 'undiscounted' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS flag FROM lineitem) GROUP BY flag""")
def flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = masking.reasons((F.col("l_quantity") > 40, "large"), (F.col("l_discount") == 0, "undiscounted"), (F.col("l_returnflag") == "R", "returned"))
    return read(spark, sf_dir, "lineitem").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))


@query("""SELECT coalesce(CASE WHEN l_quantity > 45 THEN 'too_large' END, CASE WHEN l_discount = 0 THEN 'undiscounted' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, 'kept') AS reason, count(*) AS rows FROM lineitem GROUP BY 1""")
def drop_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row once, under its first reason."""
    first = F.try_element_at(masking.reasons((F.col("l_quantity") > 45, "too_large"), (F.col("l_discount") == 0, "undiscounted"), (F.col("l_returnflag") == "R", "returned")), F.lit(1))
    return read(spark, sf_dir, "lineitem").groupBy(F.coalesce(first, F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@query("""SELECT o_orderkey AS orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1997-01-01' AND coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END > TIMESTAMP '1997-01-10', true) THEN true ELSE false END AS open FROM orders""")
def lifecycle_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    closed = F.when(F.col("o_orderstatus") == "F", t + F.expr("INTERVAL 30 DAYS"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), asof.open_during(t, closed, F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-01-10").cast("timestamp_ntz")).alias("open"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS visible, sha256(html) AS digest FROM pages""")
def visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html")).alias("visible"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


@query("""SELECT p_partkey AS partkey, split_part(p_brand, '#', 1) AS series, p_brand || '|' || p_type AS market, CASE WHEN regexp_matches(CAST(p_size AS VARCHAR), '^[+-]?\\d+(\\.\\d+)?$') THEN CAST(p_size AS DOUBLE) END AS size, p_retailprice * 1000 AS notional FROM part""")
def text_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    thousands = F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(18,6)").cast("string"), F.lit("K"))
    return p.select(F.col("p_partkey").alias("partkey"), F.substring_index("p_brand", "#", 1).alias("series"), text.market_key(F.col("p_brand"), F.col("p_type")).alias("market"), text.strict_decimal(F.col("p_size").cast("string")).cast("double").alias("size"), text.figure(thousands).alias("notional"))


@query("""SELECT user_id, count(*) AS plausible FROM events WHERE abs(event_id * 500000) < 4102444800 GROUP BY user_id""")
def epoch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose stated seconds are seconds."""
    e = read(spark, sf_dir, "events").withColumn("at", epoch_seconds(F.col("event_id") * F.lit(500000).cast("long")))
    return e.where("at is not null").groupBy("user_id").agg(F.count("*").alias("plausible"))


@query("""WITH x AS (SELECT p_partkey, t.op, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.5' ELSE p_size || '.25' END AS threshold, p_size + p_partkey % 8 / 8.0 AS atom FROM part, (VALUES ('above'), ('at_least'), ('below'), ('at_most'), ('equal')) t(op)),
r AS (SELECT *, CAST(threshold AS DOUBLE) AS th, CASE p_partkey % 3 WHEN 0 THEN floor(atom + 0.5) WHEN 1 THEN floor(atom * 10 + 0.5) / 10 ELSE floor(atom * 100 + 0.5) / 100 END AS seen FROM x)
SELECT p_partkey AS partkey, op AS operator, threshold, CAST(CASE op WHEN 'above' THEN seen > th WHEN 'at_least' THEN seen >= th WHEN 'below' THEN seen < th WHEN 'at_most' THEN seen <= th ELSE seen = th END AS INT) AS payoff, CASE WHEN op IN ('above', 'at_least') THEN 1 WHEN op = 'equal' THEN 0 ELSE -1 END AS orientation FROM r""")
def threshold_payoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes brought to each threshold's own places, half up, before they are compared."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    threshold = F.when(k % 3 == 0, size).when(k % 3 == 1, F.concat(size, F.lit(".5"))).otherwise(F.concat(size, F.lit(".25")))
    p = read(spark, sf_dir, "part").withColumn("operator", F.explode(F.array(*map(F.lit, ("above", "at_least", "below", "at_most", "equal"))))).withColumn("threshold", threshold)
    return p.select(k.alias("partkey"), "operator", "threshold", geometry.payoff(F.col("threshold"), F.col("operator"), F.col("p_size") + k % 8 / 8.0).alias("payoff"), geometry.orientation(F.col("operator")).alias("orientation"))


@query("""WITH l AS (SELECT l_orderkey AS orderkey, l_linenumber, l_extendedprice / l_quantity AS p, l_quantity AS s, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / l_quantity, l_linenumber, l_quantity, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem)
SELECT orderkey, CASE WHEN sum(s) >= 60 THEN round(sum(p * least(s, greatest(60 - before, 0))) + 0.00137, 2) END AS cost FROM l GROUP BY orderkey""")
def fill_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of sixty units off an order's lines, the cheapest first. The small constant keeps exact halves from rounding by the order of sums."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    levels = F.array_sort(F.collect_list(F.struct(price.alias("price"), F.col("l_linenumber"), F.col("l_quantity").alias("size"))))
    book = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(levels.alias("levels"))
    return book.select("orderkey", F.round(geometry.fill_cost(F.col("levels"), F.lit(60)) + 0.00137, 2).alias("cost"))
