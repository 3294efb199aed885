"""Wire records, look-ups, layers and roll-ups over the driver's tables; fixed records where only texts can show what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import releases as stated
from ..functions import text, times
from ..operators import lookups, rollups, sets
from ..sources import archive, layers, normalise
from .panels import PANEL, PRINTS, SETTINGS, built
from .registry import query, read

HOUR = 3600 * times.SECOND


def cents(x):  # noqa: ANN001, ANN201
    """A price of two decimals, as text."""
    return F.round(x, 2).cast("decimal(18,2)").cast("string")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN round(floor(value / 4) / 100 + 0.05, 2) > floor(value / 3) / 100 THEN 'crossed' ELSE 'valid' END AS validity, CASE WHEN event_id % 5 <> 0 THEN round(floor(value / 4) / 100 + 0.05, 2) END AS bid, floor(value / 3) / 100 AS ask,
  epoch_us(date_trunc('hour', ts)) AS last_verified, CASE WHEN event_id % 3 = 0 THEN epoch_us(date_trunc('hour', ts)) END AS last_trade FROM events""")
def candle_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles sent as JSON by the live endpoint, read back as quotes."""
    return normalise.candle_quotes(_candles(spark, sf_dir)).select("event_id", "validity", F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"), "last_verified", "last_trade")


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    leg = lambda x: F.struct(x.alias("close_dollars"))
    bid, ask = cents(F.floor(F.col("value") / 4) / 100 + 0.05), cents(F.floor(F.col("value") / 3) / 100)
    body = F.to_json(F.struct(
        F.floor(times.micros(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")) / times.SECOND).alias("end_period_ts"), F.when(i % 5 != 0, leg(bid)).alias("yes_bid"), leg(ask).alias("yes_ask"), F.when(i % 3 == 0, leg(cents(F.col("value") / 350))).alias("price"),
    ))
    return normalise.candles(e.select("event_id", "event_type", body.alias("body")), live=True)


@query("""SELECT event_type, count(*) FILTER (WHERE event_id % 5 <> 0) AS two_sided, count(*) FILTER (WHERE event_id % 5 = 0) AS one_sided, CAST(0 AS BIGINT) AS trade_only FROM events GROUP BY 1""")
def candle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.candle_counts(_candles(spark, sf_dir), ["event_type"])


@query("""SELECT o_orderkey AS orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 ELSE CASE WHEN o_orderkey % 4 <> 0 THEN round(o_orderkey % 100 / 100, 2) END END AS payout,
  CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN false ELSE CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 100 <> 0 END END AS exceptional, CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 4 = 0 THEN 'no_result_and_no_value' END AS refusal, epoch_us(o_orderdate) AS resolved_at FROM orders""")
def resolution_payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    body = F.to_json(F.struct(
        k.cast("string").alias("ticker"), F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").alias("result"), F.when(k % 4 != 0, (k % 100 / 100).cast("decimal(18,2)").cast("string")).alias("settlement_value_dollars"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("settlement_ts"),
    ))
    made = normalise.payouts(o.select(k.alias("orderkey"), body.alias("body")))
    return made.select("orderkey", F.col("payout").cast("double").alias("payout"), "exceptional", "refusal", "resolved_at")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no_ticker' WHEN event_id % 11 = 0 THEN 'no_price' WHEN event_id % 13 = 0 THEN 'no_count' END AS refusal, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 THEN floor(value / 4) / 100 END AS price,
  CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 THEN CAST(user_id AS DOUBLE) END AS size FROM events""")
def wire_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades sent as JSON under either name of each field, with planted gaps."""
    e, i, price = read(spark, sf_dir, "events"), F.col("event_id"), cents(F.floor(F.col("value") / 4) / 100)
    sent = i % 11 != 0
    body = F.to_json(F.struct(F.when(i % 7 != 0, F.col("event_type")).alias("ticker"), F.when(sent & (i % 2 == 0), price).alias("yes_price_dollars"), F.when(sent & (i % 2 == 1), price).alias("yes_price"), F.when(i % 13 != 0, F.col("user_id")).alias("count_fp")))
    made = normalise.trades(e.select("event_id", body.alias("body")))
    return made.select("event_id", "refusal", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS a, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS b, CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS c FROM events)
SELECT count(*) AS records, count(*) FILTER (WHERE a <> b OR b <> c OR a <> c) AS conflicts FROM x""")
def direction_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    side = lambda m, yes, no: F.when(i % m == 0, yes).when(i % m == 1, no)
    d = normalise.direction(side(3, "yes", "no"), side(4, "yes", "no"), side(5, "bid", "ask"))
    return read(spark, sf_dir, "events").agg(F.count("*").alias("records"), F.count_if(d["conflict"]).alias("conflicts"))


BOOKS = (
    (1, '{"orderbook_fp": {"yes_dollars": [["0.40", "10"], ["0.42", "5"], ["0", "3"]], "no_dollars": [["0.55", "7"], ["0.50", "0"]]}}'), (2, '{"orderbook": {"yes": [[0.3, 1]], "no": null}}'), (3, '{"market": 1}'), (4, '{"orderbook_fp": {"no_dollars": [["1.0", "2"], ["0.2", "4"], ["0.3", "1"]]}}'),
)


@query("""SELECT * FROM (VALUES (CAST(1 AS BIGINT), '0.42x5.0,0.4x10.0', '0.45x7.0', NULL), (2, '0.3x1.0', '', NULL), (3, NULL, NULL, 'no_order_book'), (4, '', '0.7x1.0,0.8x4.0', NULL)) t(id, bids, asks, refusal)""")
def wire_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order books of bids alone: the other side's bids are asks at one less the price."""
    made = normalise.books(spark.createDataFrame(list(BOOKS), "id long, body string"))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["price"].cast("double").cast("string"), F.lit("x"), x["size"].cast("double").cast("string"))), ",")
    return made.select("id", spelled(F.col("bids")).alias("bids"), spelled(F.col("asks")).alias("asks"), "refusal")


LEVELS = ((1, [("0.4", "1"), ("0.3", "2")]), (2, [("0.4", "1"), ("0.4", "2")]), (3, [("0", "1")]), (4, [("0.1", "0")]), (5, [("x", "1")]), (6, []))


@query("""SELECT * FROM (VALUES (CAST(1 AS BIGINT), '0.3,0.4', NULL), (2, NULL, 'duplicate_price'), (3, NULL, 'price_not_positive'), (4, NULL, 'size_not_positive'), (5, NULL, 'unreadable_level'), (6, '', NULL)) t(id, prices, refusal)""")
def level_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, x) for i, x in LEVELS], "id long, raw array<struct<price:string,size:string>>")
    pairs = F.transform("raw", lambda x: F.struct(normalise.exact(x["price"]).alias("price"), normalise.exact(x["size"]).alias("size")))
    made = df.select("id", normalise.levels(pairs).alias("r"))
    return made.select("id", F.array_join(F.transform("r.levels", lambda x: x["price"].cast("double").cast("string")), ",").alias("prices"), "r.refusal")


CONTRACTS = (
    (1, '{"ticker": "A-1", "strike_type": "greater", "floor_strike": 4.25}'), (2, '{"ticker": "A-2", "strike_type": "between", "floor_strike": "1", "cap_strike": "2"}'), (3, '{"ticker": "A-3", "strike_type": "between", "floor_strike": 1}'),
    (4, '{"ticker": "A-4", "strike_type": "custom"}'), (5, '{"ticker": "A-5", "strike_type": "less_or_equal"}'), (6, '{"strike_type": "less"}'),
)


@query("""SELECT id, operator, CAST(threshold AS DOUBLE) AS threshold, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, refusal FROM (VALUES (CAST(1 AS BIGINT), 'above', 4.25, NULL, NULL, NULL), (2, 'range', NULL, 1, 2, NULL), (3, NULL, NULL, NULL, NULL, 'range_without_both_ends'), (4, NULL, NULL, NULL, NULL, 'strike_type_without_operator'),
  (5, NULL, NULL, NULL, NULL, 'threshold_missing'), (6, NULL, NULL, NULL, NULL, 'no_ticker')) t(id, operator, threshold, lower, upper, refusal)""")
def wire_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = normalise.contracts(spark.createDataFrame(list(CONTRACTS), "id long, body string"))
    return made.select("id", "operator", *[F.col(c).cast("double").alias(c) for c in ("threshold", "lower", "upper")], "refusal")


@query("""WITH v AS (SELECT o_orderkey, o_orderpriority AS rule, o_orderdate AS closed, CASE WHEN o_orderkey % 10 = 0 THEN 'changed' ELSE o_orderpriority END AS rule2, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS closed2 FROM orders)
SELECT CASE WHEN rule IS DISTINCT FROM rule2 THEN 'another_instrument' WHEN closed IS DISTINCT FROM closed2 THEN 'lifecycle_differs' ELSE 'identical' END AS note, count(*) AS contracts FROM v GROUP BY 1""")
def contract_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    both = o.select(
        F.struct(F.col("o_orderpriority").alias("rule"), F.col("o_orderdate").alias("closed")).alias("a"),
        F.struct(F.when(k % 10 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("rule"), F.when(k % 7 != 0, F.col("o_orderdate")).alias("closed")).alias("b"),
    )
    return both.withColumn("v", normalise.version_changes("a", "b", ("rule",), ("closed",))).groupBy("v.note").agg(F.count("*").alias("contracts"))


@query("""SELECT * FROM (VALUES ('api_key', true), ('X-Auth', true), ('author', false), ('session-id', true), ('tokenizer', false), ('password', true), ('status', false)) t(key, credential)""")
def credential_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(k,) for k in ("api_key", "X-Auth", "author", "session-id", "tokenizer", "password", "status")], "key string")
    return df.select("key", normalise.carries_credentials(F.create_map(F.col("key"), F.lit("x"))).alias("credential"))


@query("""SELECT event_id, user_id AS "user", CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"ts":' || epoch_us(ts) // 1000000 || ',"value":"' || event_type || '"}' AS clock FROM events""")
def flattened_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as flat columns by dotted paths, structured ones as JSON."""
    nested = read(spark, sf_dir, "events").select(
        "event_id", F.struct(F.col("user_id").alias("id")).alias("owner"), F.struct(F.from_json("props", "k long").alias("inner")).alias("outer"), F.struct(F.floor(times.micros(F.col("ts")) / times.SECOND).alias("ts"), F.col("event_type").alias("value")).alias("clock")
    )
    return normalise.flattened(nested, {"event_id": "event_id", "user": "owner.id", "k": "outer.inner.k", "clock": "clock"}, ("clock",))


@query("""SELECT p_partkey AS partkey, CASE WHEN round(p_retailprice * 100, 6) = floor(round(p_retailprice * 100, 6)) THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS whole, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(round(p_retailprice * 100) AS BIGINT) END AS strict FROM part""")
def whole_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars as whole cents; a tenth of a cent, added to every third, is refused."""
    price = F.round("p_retailprice", 6).cast("decimal(18,6)")
    odd = F.when(F.col("p_partkey") % 3 == 0, F.round("p_retailprice", 2).cast("decimal(18,6)") + F.lit(0.001).cast("decimal(18,6)")).otherwise(F.round("p_retailprice", 2).cast("decimal(18,6)"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), normalise.whole_cents(price.cast("string")).alias("whole"), normalise.whole_cents(odd.cast("string")).alias("strict"))


# look-ups


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS known FROM orders), c AS (SELECT c_custkey, TIMESTAMP '1996-01-01' + INTERVAL (c_custkey % 700) DAY AS cutoff FROM customer)
SELECT c_custkey AS custkey, arg_max(o_totalprice, (known, o_orderkey)) AS payout, epoch_us(max(known)) AS known_at FROM c LEFT JOIN r ON o_custkey = c_custkey AND known <= cutoff GROUP BY c_custkey""")
def label_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order whose knowledge time is known and not after the customer's cutoff."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("payout"), F.when(F.col("o_orderkey") % 5 != 0, times.micros(F.col("o_orderdate"))).alias("known_at"), F.col("o_orderkey").alias("rule_hash"))
    start = times.micros(F.lit("1996-01-01").cast("timestamp_ntz"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), (start + F.col("c_custkey") % 700 * 24 * HOUR).alias("cutoff"))
    return lookups.label_join(c, o, ["custkey"], "cutoff").drop("cutoff")


SURPRISED = """e AS (SELECT c_custkey AS event_id, c_mktsegment AS family, c_custkey * 10 AS release_time, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS actual, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey * 100.0 END AS expected FROM customer),
s AS (SELECT *, round(actual - expected, 6) AS surprise FROM e WHERE expected IS NOT NULL)"""


def _surprised(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    expected = c.where(k % 4 != 0).select(k.alias("event_id"), F.lit("s").alias("statistic"), (F.col("c_nationkey") * 100.0).alias("value"))
    facts = c.where(k % 9 != 0).select(k.alias("event_id"), F.lit("s").alias("statistic"), F.col("c_acctbal").alias("first_print"))
    return lookups.surprises(expected, facts).withColumn("surprise", F.round("surprise", 6))


@query(f"WITH {SURPRISED} SELECT event_id, actual, surprise FROM s")
def release_surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surprised(spark, sf_dir).select("event_id", "actual", "surprise")


@query(f"""WITH {SURPRISED}, x AS (SELECT e.event_id, e.family, s.surprise AS shock, lag(s.surprise) OVER (PARTITION BY e.family ORDER BY e.release_time, e.event_id) AS delayed_shock FROM e LEFT JOIN s USING (event_id))
SELECT o_orderkey AS orderkey, shock, delayed_shock FROM orders JOIN x ON event_id = o_custkey""")
def shock_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its customer's surprise and that of the customer before in the segment."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("family"), (F.col("c_custkey") * 10).alias("release_time"))
    segments = [r[0] for r in c.select("family").distinct().collect()]  # five
    rows = c.join(read(spark, sf_dir, "orders"), F.col("event_id") == F.col("o_custkey"))
    return lookups.shocks(c, _surprised(spark, sf_dir), dict.fromkeys(segments, "s")).join(rows.select("event_id", "o_orderkey"), "event_id").select(F.col("o_orderkey").alias("orderkey"), "shock", "delayed_shock")


@query("""SELECT l_orderkey AS event_id, l_suppkey AS receiver, l_linenumber, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS placebo_neighbor_lag FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND l_orderkey % 2 = 0""")
def placebo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("receiver"), "l_linenumber")
    events = li.where("event_id % 2 = 0").select("event_id", "receiver").distinct()
    lent = events.join(read(spark, sf_dir, "supplier"), F.col("receiver") == F.col("s_suppkey")).select("event_id", "receiver", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("neighbor_lag"))
    return lookups.placebo_lags(li, lent)


@query("""WITH f AS (SELECT s_suppkey AS venue, s_nationkey AS settlements FROM supplier WHERE s_suppkey % 3 <> 0) SELECT l_suppkey AS venue, settlements, count(*) AS quotes FROM lineitem LEFT JOIN f ON venue = l_suppkey GROUP BY ALL""")
def settlement_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "supplier").where("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("venue"), F.col("s_nationkey").alias("settlements"))
    q = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("venue"))
    return lookups.settlement_counts(q, f, ["venue"]).groupBy("venue", "settlements").agg(F.count("*").alias("quotes"))


@query("""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'no_page_origin' WHEN event_id % 13 = 0 THEN 'page_not_stored' WHEN event_id % 11 = 0 THEN 'pointer_names_nothing' WHEN event_id % 7 = 0 THEN 'pointer_names_no_record' WHEN event_id % 5 = 0 THEN 'another_record' END AS refusal FROM events""")
def origin_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cited to archived pages of ten, with each kind of false citation planted."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    page = F.floor(i / 10).cast("string")
    pages = e.groupBy(page.alias("page_hash")).agg(F.array_sort(F.collect_list(F.struct(i.alias("event_id"), "event_type"))).alias("all")).select("page_hash", F.to_json(F.struct(F.col("all").alias("items"))).alias("body"))
    pointer = F.when(i % 11 == 0, "/items/99").when(i % 7 == 0, F.concat(F.lit("/items/"), (i % 10).cast("string"), F.lit("/event_type"))).otherwise(F.concat(F.lit("/items/"), (i % 10).cast("string")))
    cited = F.concat(F.lit('{"event_id": '), F.when(i % 5 == 0, i + 1).otherwise(i).cast("string"), F.lit(', "event_type": "'), F.col("event_type"), F.lit('"}'))
    records = e.select("event_id", F.when(i % 17 != 0, F.when(i % 13 == 0, "none").otherwise(page)).alias("page_hash"), pointer.alias("pointer"), text.text_digest(cited).alias("digest"))
    return lookups.verified_origins(records, pages, text.json_pointer(F.col("body"), F.col("pointer")), F.col("digest")).select("event_id", "refusal")


@query("""WITH p AS (SELECT *, p_partkey AS k FROM part) SELECT k AS partkey, CASE WHEN k % 5 = 0 THEN 'rule_evidence_names_a_different_contract' WHEN k % 7 = 0 THEN 'rule_hash_is_not_a_digest_of_rule_text' WHEN k % 3 = 0 OR k % 11 = 0 THEN 'rule_evidence_missing' END AS refusal,
  CASE WHEN k % 5 = 0 THEN 'contract_id' WHEN k % 7 = 0 THEN 'rule_hash' ELSE concat_ws(',', CASE WHEN k % 3 = 0 THEN 'verified_by' END, CASE WHEN k % 11 = 0 THEN 'observed_at' END) END AS missing FROM p""")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    pairs = {
        "ticker": F.when(k % 5 == 0, "another").otherwise(k.cast("string")), "rule_hash": F.when(k % 7 == 0, "loose").otherwise(F.sha2(F.col("p_name").cast("binary"), 256)), "url": F.col("p_brand"), "verifier": F.when(k % 3 != 0, "me"),
        "effective_from": F.lit("2024-01-01"), "observed_at_utc": F.when(k % 11 != 0, "2024-01-02"), "settlement": F.col("p_type"),
    }
    given = F.map_filter(F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    made = lookups.rule_evidence(p.select(k.alias("partkey"), k.cast("string").alias("ticker"), given.alias("evidence")), "evidence", "ticker")
    return made.select("partkey", "refusal", F.array_join("missing", ",").alias("missing"))


@query("""WITH x AS (SELECT p_partkey AS k FROM part) SELECT k AS partkey, k % 2 = 0 OR (k % 3 <> 0 AND k % 5 <> 0) AS own_hash, k % 5 <> 0 AND k % 7 <> 0 AND NOT (k % 3 = 0 AND k % 2 = 1) AS matches,
  concat_ws(',', CASE WHEN k % 5 = 0 THEN 'units' END, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 'rule_hash' END) AS blocking, CASE WHEN k % 7 = 0 THEN 'currency' ELSE '' END AS missing FROM x""")
def rule_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of each contract: every third differs in its hash, which blocks within one venue only."""
    k = F.col("p_partkey")
    base = {n: F.lit("x") for n in lookups.AUDIT_REQUIRED} | {"operator": F.lit("above"), "threshold": F.lit("1"), "currency": F.when(k % 7 != 0, "usd"), "contract_id": k.cast("string")}
    left = base | {"venue": F.lit("v"), "rule_hash": F.lit("h")}
    right = base | {"venue": F.when(k % 2 == 0, "w").otherwise("v"), "rule_hash": F.when(k % 3 == 0, "other").otherwise("h"), "units": F.when(k % 5 == 0, "y").otherwise("x")}
    pairs = read(spark, sf_dir, "part").select(k.alias("partkey"), *[F.struct(*[v.alias(n) for n, v in side.items()]).alias(name) for name, side in (("a", left), ("b", right))])
    made = lookups.rule_audit(pairs, "a", "b")
    own = (k % 2 == 0) | ((k % 3 != 0) & (k % 5 != 0))
    return made.withColumn("p_partkey", F.col("partkey")).select("partkey", own.alias("own_hash"), "matches", F.array_join("blocking", ",").alias("blocking"), F.array_join("missing", ",").alias("missing"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 5 = 0 THEN 'clock_unsynced' ELSE 'clock_synced' END AS quality, greatest(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS DOUBLE) END) AS uncertainty FROM events""")
def clock_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    a, b = F.when(i % 3 == 0, "unknown").otherwise("clock_synced"), F.when(i % 5 == 0, "clock_unsynced").otherwise("clock_synced")
    return read(spark, sf_dir, "events").select("event_id", lookups.worst_quality(a, b).alias("quality"), lookups.largest_uncertainty(F.when(i % 2 == 0, F.col("value")), F.when(i % 7 != 0, F.col("user_id").cast("double"))).alias("uncertainty"))


@query("""SELECT 'value' AS "column", 'conventional' AS kind, count(*) AS rows, count(*) FILTER (WHERE event_id % 10 = 0) AS unknown, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 4 = 0) AS late, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 4 = 0) = 0 AS admissible FROM events
UNION ALL SELECT 'user_id', 'declared', count(*), count(*) FILTER (WHERE event_id % 10 = 0), 0, true FROM events""")
def covariate_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A covariate stamped at the event itself is too late for a conventional column and in time for a declared one."""
    t, i = times.micros(F.col("ts")), F.col("event_id")
    e = read(spark, sf_dir, "events").withColumns({"at": t, "seen": F.when(i % 10 != 0, F.when(i % 4 == 0, t).otherwise(t - 1))})
    return lookups.admissible_covariates(e, "at", {"value": "seen"}, {"user_id": "seen"})


# layers


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'archive' END AS layer, o_custkey AS contract, o_orderdate AS opened FROM orders), w AS (SELECT DISTINCT layer, contract FROM c WHERE opened <= TIMESTAMP '1996-06-30' AND opened >= TIMESTAMP '1996-01-01')
SELECT CAST(NULL AS VARCHAR) AS layer, 'both_layers_cover_the_window' AS basis, false AS available, CAST(2 AS INT) AS covering, (SELECT count(*) FROM (SELECT contract FROM w GROUP BY contract HAVING count(*) = 2)) AS overlap""")
def governing_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where((F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz")) & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    covering = o.select(F.when(F.col("o_orderkey") % 3 == 0, "live").otherwise("archive").alias("layer"), F.col("o_custkey").alias("contract"))
    return layers.governing_layer(covering, ["live", "archive"])


@query("""WITH x AS (SELECT epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + o_orderkey % 90 * 86400000000 AS e, CASE WHEN o_orderkey % 50 <> 0 THEN 850000000000000 END AS c FROM orders) SELECT CASE WHEN c >= e THEN 'historical' WHEN c <= s THEN 'live' WHEN c IS NOT NULL THEN 'straddling' END AS served_by, count(*) AS windows FROM x GROUP BY 1""")
def partition_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, start = F.col("o_orderkey"), times.micros(F.col("o_orderdate"))
    served = layers.partition_of(start, start + k % 90 * 24 * HOUR, F.when(k % 50 != 0, F.lit(850_000_000_000_000)))
    return read(spark, sf_dir, "orders").groupBy(served.alias("served_by")).agg(F.count("*").alias("windows"))


@query("""WITH c AS (SELECT upper(o_orderpriority[3:5]) || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE 'X-' END || o_orderkey AS ticker, CAST(o_orderdate AS VARCHAR) AS opened FROM orders) SELECT ticker, opened FROM c WHERE regexp_extract(ticker, '^[A-Z]+') IN ('LOW', 'HIGX', 'URG')""")
def universe_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of declared series by the capitals that their tickers begin with; instants come as text."""
    return layers.universe_rows(_tickers(spark, sf_dir), "ticker", ["LOW", "HIGX", "URG"], ("opened",)).select("ticker", "opened")


def _tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(F.concat(F.upper(F.substring("o_orderpriority", 3, 3)), F.when(k % 2 == 0, "-").otherwise("X-"), k.cast("string")).alias("ticker"), F.col("o_orderdate").alias("opened"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed"))


@query("""WITH c AS (SELECT upper(o_orderpriority[3:5]) || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE 'X-' END || o_orderkey AS ticker, o_orderdate AS opened, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS closed FROM orders)
SELECT ticker FROM c WHERE split_part(ticker, '-', 1) IN ('LOW', 'MEDX') AND opened <= TIMESTAMP '1996-06-30' AND (closed IS NULL OR closed >= TIMESTAMP '1996-01-01')""")
def series_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-06-30"))
    return layers.covering_contracts(_tickers(spark, sf_dir), "ticker", "opened", "closed", ["LOW", "MEDX"], start, end)


@query("""WITH s AS (SELECT c_mktsegment AS layer, 'f' || c_custkey % 400 AS basename, c_nationkey AS rows, c_custkey AS bytes, c_custkey % 97 = 0 AS bad FROM customer), t AS (SELECT basename, count(DISTINCT layer) > 1 AS twice FROM s GROUP BY 1), d AS (SELECT DISTINCT layer FROM s UNION ALL SELECT 'NOWHERE')
SELECT d.layer, count(s.basename) AS shards, CAST(coalesce(sum(CASE WHEN NOT bad THEN rows END), 0) AS BIGINT) AS rows, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, CASE WHEN count(s.basename) > 0 THEN 'present' ELSE 'missing' END AS status,
  CASE WHEN count(s.basename) = 0 THEN 'layer_missing' ELSE concat_ws(',', CASE WHEN bool_or(twice) THEN 'basename_in_several_layers' END, CASE WHEN bool_or(bad) THEN 'shard_unreadable' END) END AS flags FROM d LEFT JOIN s USING (layer) LEFT JOIN t USING (basename) GROUP BY d.layer""")
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    inventory = c.select(F.col("c_mktsegment").alias("layer"), F.concat(F.lit("f"), (k % 400).cast("string")).alias("basename"), F.when(k % 97 != 0, F.col("c_nationkey")).cast("long").alias("rows"), k.alias("bytes"), F.when(k % 97 == 0, "torn").alias("error"), F.array().cast("array<string>").alias("flags"))
    declared = inventory.select("layer").distinct().union(spark.createDataFrame([("NOWHERE",)], "layer string"))
    return layers.layer_totals(inventory, declared).withColumn("flags", F.array_join("flags", ","))


# roll-ups


@query(f"WITH {PANEL} SELECT event_id, horizon, count(*) AS rows, CAST(sum(valid::INT) AS BIGINT) AS valid_rows, count(response) AS responses, round(avg(response), 8) AS mean, round(min(response), 8) AS low, round(max(response), 8) AS high, true AS declared FROM panel GROUP BY ALL")
def event_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = rollups.event_cards(built(spark, sf_dir), SETTINGS.horizons)
    return cards.withColumns({c: F.round(c, 8) for c in ("mean", "low", "high")})


@query(f"WITH {PANEL} SELECT 'exclusion_reason' AS \"column\", exclusion_reason AS value, count(*) AS rows FROM panel GROUP BY ALL UNION ALL SELECT 'horizon', CAST(horizon AS VARCHAR), count(*) FROM panel GROUP BY ALL")
def categorical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.categorical_counts(built(spark, sf_dir), ["exclusion_reason", "horizon"])


@query("""WITH r AS (SELECT source, doc_id, CASE WHEN doc_id % 31 = 0 THEN 'loose' ELSE sha256(text) END AS raw_hash, CASE WHEN doc_id % 6 <> 0 THEN 200 + doc_id % 3 * 100 END AS status, doc_id % 4 = 0 AS bare FROM documents), b AS (SELECT DISTINCT sha256(text) AS raw_hash, strlen(text) AS bytes, strlen(text) % 17 <> 0 AS intact FROM documents)
SELECT source, coalesce(CAST(status AS VARCHAR), 'unrecorded') AS status, count(*) AS receipts, count(*) FILTER (WHERE NOT coalesce(intact, false)) AS failed, CAST(coalesce(sum(CASE WHEN intact THEN bytes END), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE bare) AS schema_missing FROM r LEFT JOIN b USING (raw_hash) GROUP BY ALL""")
def receipt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts by source and status against re-hashed blobs: a loose hash, or bytes that changed, fail."""
    d, i, digest = read(spark, sf_dir, "documents"), F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256)
    receipts = d.select("source", F.when(i % 31 == 0, "loose").otherwise(digest).alias("raw_hash"), F.when(i % 6 != 0, 200 + i % 3 * 100).alias("status"), F.when(i % 4 != 0, "v1").alias("schema_version"))
    size = F.octet_length("text")
    blobs = d.select(digest.alias("raw_hash"), size.cast("long").alias("bytes"), (size % 17 != 0).alias("intact")).distinct()
    return rollups.receipt_quality(receipts, blobs)


@query("""WITH d AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS delta FROM events) SELECT event_type, count(delta) AS intervals, min(delta) AS least, max(delta) AS most, median(delta) AS middle FROM d WHERE delta IS NOT NULL GROUP BY 1""")
def receipt_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.spacing_summary(read(spark, sf_dir, "events").select("event_type", times.micros(F.col("ts")).alias("t")), "t", ["event_type"])


@query("""WITH h AS (SELECT DISTINCT event_type, epoch_us(date_trunc('minute', ts)) AS t FROM events), d AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS delta FROM h) SELECT event_type, count(delta) AS deltas, count(*) FILTER (WHERE delta < 600000000) AS finer, count(*) FILTER (WHERE delta = 600000000) AS equal, count(*) FILTER (WHERE delta > 600000000) AS coarser FROM d WHERE delta IS NOT NULL GROUP BY 1""")
def history_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed spacing of minutes with a print against a requested ten minutes."""
    minute = (F.floor(times.micros(F.col("ts")) / (60 * times.SECOND)) * 60 * times.SECOND).alias("t")
    return rollups.fidelity(sets.spacing(read(spark, sf_dir, "events").select("event_type", minute).distinct(), ["event_type"], "t", 60 * times.SECOND), 600 * times.SECOND, ["event_type"])


@query("""SELECT l_partkey AS partkey, count(*) AS rows, count(DISTINCT l_suppkey) AS builds, round(min(l_tax - l_discount), 8) AS low, round(median(l_tax - l_discount), 8) AS middle, round(max(l_tax - l_discount), 8) AS high, coalesce(min(CASE WHEN round(l_tax - l_discount, 8) <> 0 THEN sign(l_tax - l_discount) END) = max(CASE WHEN round(l_tax - l_discount, 8) <> 0 THEN sign(l_tax - l_discount) END), true) AS sign_stable FROM lineitem GROUP BY 1""")
def spread_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("build"), F.round(F.col("l_tax") - F.col("l_discount"), 8).alias("spread"))
    made = rollups.spread_stability(li, "spread", "build", ["partkey"])
    return made.select("partkey", "rows", "builds", "low", F.round("middle", 8).alias("middle"), "high", "sign_stable")


@query(f"""WITH {PRINTS}, w AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT e.event_id, n AS cluster_rows, round(1.0 / n, 10) AS weight FROM events e JOIN w USING (user_id)""")
def cluster_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.multiplicity(read(spark, sf_dir, "events"), "user_id").select("event_id", "cluster_rows", F.round("weight", 10).alias("weight"))


# texts: fixed pages and what they state


PAYOUT_TEXTS = (
    ("Above 4.25%", "Will the target federal funds rate be above?"), ("3% or below", "federal funds rate"), ("No change", ""), ("Cut >25 bps", ""), ("Hike 50 bps", ""), ("Cut 25 bps or more", "target federal funds rate"), ("Above 4%", "a rate"), ("fed maintains rate", ""),
)


@query("""SELECT id, subject, CAST(threshold AS DOUBLE) AS threshold, inequality, orientation, refusal FROM (VALUES (CAST(0 AS BIGINT), 'target_level', 4.25, 'above', 1, NULL), (1, 'level', 3, 'below', -1, NULL), (2, 'change', 0, NULL, 1, NULL), (3, 'change', -25, 'below', 1, NULL), (4, 'change', 50, NULL, 1, NULL),
  (5, NULL, NULL, NULL, NULL, 'payout_text_unreadable'), (6, NULL, NULL, NULL, NULL, 'rate_subject_unreadable'), (7, 'change', 0, NULL, 1, NULL)) t(id, subject, threshold, inequality, orientation, refusal)""")
def payout_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(PAYOUT_TEXTS)], "id long, subtitle string, title string")
    return df.select("id", text.payout_predicate(F.col("subtitle"), F.col("title")).alias("p")).select("id", "p.*")


@query("""SELECT o_orderkey AS orderkey, CASE WHEN month(o_orderdate) IN (3, 6, 9, 12) AND o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m') || '-15' END AS date, CASE WHEN NOT (month(o_orderdate) IN (3, 6, 9, 12) AND o_orderkey % 9 <> 0) THEN 'month_not_in_calendar' END AS refusal FROM orders WHERE year(o_orderdate) >= 2000 OR year(o_orderdate) < 2000""")
def decision_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers of a month against a calendar of quarters; every ninth names no month."""
    o, k, d = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    code = F.when(k % 9 == 0, "XXX").otherwise(F.upper(F.date_format(d, "MMM")))
    years = [r[0] for r in o.select(F.year(d)).distinct().collect()]  # a few
    calendar = F.create_map(*[F.lit(x) for y in years for m in (3, 6, 9, 12) for x in (f"20{y % 100:02d}-{m:02d}", f"{y}-{m:02d}-15")])
    found = text.decision_date(F.concat(F.lit("FED-"), F.date_format(d, "yy"), code), calendar)
    return o.select(k.alias("orderkey"), found.alias("f")).select("orderkey", "f.date", "f.refusal")


RELEASE_TEXTS = (
    "The Consumer Price Index for All Urban Consumers (CPI-U) decreased 0.1 percent on a seasonally adjusted basis in March. The index for all items less food and energy rose 0.2 percent in March. The all items index increased 2.4 percent for the 12 months ending March.",
    "The Consumer Price Index for All Urban Consumers (CPI-U) was unchanged on a seasonally adjusted basis. The core index edged down 0.1 percent. The all items index rose 3 percent over the year.",
    "Total nonfarm payroll employment increased by 256,000 in December, and the unemployment rate changed little at 4.1 percent. The change in total nonfarm payroll employment for June was revised up by 11,000, from +20,000 to +31,000, and the change for July was revised up by 44,000, from -23,000 to +21,000.",
    "Total nonfarm payroll employment declined by 140,000.", "Nothing is stated here.",
)


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'cpi_headline_sa_mom_pct', CAST(-0.1 AS DOUBLE)), (0, 'cpi_core_sa_mom_pct', 0.2), (0, 'cpi_headline_nsa_yoy_pct', 2.4), (1, 'cpi_headline_sa_mom_pct', 0.0), (1, 'cpi_core_sa_mom_pct', -0.1), (1, 'cpi_headline_nsa_yoy_pct', 3.0),
  (2, 'payrolls_change_jobs', 256000.0), (2, 'payrolls_change_thousands', 256.0), (2, 'unemployment_rate_pct', 4.1), (3, 'payrolls_change_jobs', -140000.0), (3, 'payrolls_change_thousands', -140.0)) t(id, statistic, value)""")
def release_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(list(enumerate(RELEASE_TEXTS)), "id long, body string")
    both = F.map_concat(stated.cpi_values(F.col("body")), stated.employment_values(F.col("body")))
    return df.select("id", F.explode(both).alias("statistic", "value")).select("id", "statistic", F.col("value").cast("double").alias("value"))


@query("""SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'June', CAST(20000 AS DOUBLE), CAST(31000 AS DOUBLE)), (2, 'July', -23000.0, 21000.0)) t(id, month, prior, revised)""")
def release_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(list(enumerate(RELEASE_TEXTS)), "id long, body string")
    return df.select("id", F.explode(stated.revisions(F.col("body"))).alias("r")).select("id", "r.month", F.col("r.prior").cast("double").alias("prior"), F.col("r.revised").cast("double").alias("revised"))


EMBARGOES = (
    "Transmission of material in this release is embargoed until\n8:30 a.m. (ET) Wednesday, March 12, 2025\tUSDL-25-0312\n\nTechnical information", "For release at 10:00 A.M. ET Friday, Dec 6 2024", "embargoed until\n\n8:30 a.m. Friday, March 7, 2025", "8:30 a.m. Friday, March 7, 2025",
)


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), epoch_us(TIMESTAMP '2025-03-12 12:30:00')), (1, epoch_us(TIMESTAMP '2024-12-06 15:00:00')), (2, NULL), (3, NULL)) t(id, instant)""")
def embargo_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(list(enumerate(EMBARGOES)), "id long, body string")
    return df.select("id", stated.embargo_instant(F.col("body")).alias("instant"))


CALENDARS = (
    "<p>All times on calendar are Eastern Time.</p><table><tr> <td class='d'>Wednesday, March 12, 2025</td> <td>08:30 AM</td> <td><b>Consumer Price Index</b> for February 2025</td></tr><tr><td>Friday, December 5, 2025</td><td>1:00 PM</td><td>Employment Situation (R)</td></tr><tr><td></td><td></td><td>x</td></tr></table>",
    "<table><tr><td>Friday, December 5, 2025</td><td>8:30 AM</td><td>CPI</td></tr></table>",
)


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'Consumer Price Index', 'cpi', 'February 2025', epoch_us(TIMESTAMP '2025-03-12 12:30:00'), false, NULL), (0, 'Employment Situation', 'empsit', NULL, epoch_us(TIMESTAMP '2025-12-05 18:00:00'), true, NULL), (1, NULL, NULL, NULL, NULL, NULL, 'page_states_no_zone')) t(id, title, family, period, scheduled, revised, refusal)""")
def release_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated.calendar_rows(spark.createDataFrame(list(enumerate(CALENDARS)), "id long, html string"), "html")


MARKET_PAGE = """# BTC
Data generated at 2025-11-02T09:30:00Z

| a | b |
|---|---|
| 1 | 2 |

| Exchange | Symbol | Price | 24h volume | Open interest | Funding / interval | Funding APR | Paid 24h | Paid 7d | Paid 30d |
|---|---|---|---|---|---|---|---|---|---|
| [Venue A](/venues/a) | BTC-PERP | 67,000.5 | $1.2B | $0.00 | +0.01% | 10.95% | — | 0.07% | -0.3% |
| Venue B | BTCUSDT | n/a | - | 3.4M | 0% | oops | 0.01% | 0.02% | 0.03% |
"""


@query("""SELECT * FROM (VALUES ('Venue A', 'BTC-PERP', CAST(67000.5 AS DOUBLE), CAST(1200000000 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0.0001 AS DOUBLE), CAST(0.1095 AS DOUBLE), 'paid_24h:source_reported_no_figure', epoch_us(TIMESTAMP '2025-11-02 09:30:00')),
  ('Venue B', 'BTCUSDT', NULL, NULL, 3400000.0, 0.0, NULL, 'price:figure_not_parseable,volume_24h_usd:source_reported_no_figure,funding_apr:figure_not_parseable', epoch_us(TIMESTAMP '2025-11-02 09:30:00'))) t(venue, symbol, price, volume, open_interest, rate, apr, refusals, built_at)""")
def market_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market page's quotes: the table is found by its header, figures that are not there are refused by name."""
    page = spark.createDataFrame([(1, MARKET_PAGE)], "id long, body string")
    quotes = stated.market_quotes(archive.table_rows(page, "id", "body"), ["id"])
    stamped = quotes.join(page.select("id", stated.build_stamp(F.col("body")).alias("built_at")), "id")
    return stamped.select("venue", "symbol", "price", F.col("volume_24h_usd").alias("volume"), F.col("open_interest_usd").alias("open_interest"), F.round("funding_rate", 10).alias("rate"), F.round("funding_apr", 10).alias("apr"), F.array_join("refusals", ",").alias("refusals"), "built_at")


FEE_PAGE = """| Level | USDT Maker / Taker | USDT Maker / Taker (BNB 10% off) |
|---|---|---|
| Regular User | 0.0200%/0.0500% | 0.0180%/0.0450% |
| VIP 1 | 0.0160%/0.0400% | x |
| VIP 2 | free | x |
| VIP 3 | 0.01%/0.02% | x |
| VIP 3 | 0.01%/0.02% | x |
| Note | a | b |
"""


@query("""SELECT * FROM (VALUES ('Regular User', CAST(0.0002 AS DOUBLE), CAST(0.0005 AS DOUBLE), NULL), ('VIP 1', 0.00016, 0.0004, NULL), ('VIP 2', NULL, NULL, 'invalid_fee_pair'), ('VIP 3', NULL, NULL, 'ambiguous_tier_row'), ('VIP 3', NULL, NULL, 'ambiguous_tier_row')) t(tier, maker, taker, refusal)""")
def fee_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = spark.createDataFrame([(1, FEE_PAGE)], "id long, body string")
    rows = stated.fee_rows(archive.table_rows(page, "id", "body"), ["id"], "Level", "^(Regular User|VIP [1-9])$", "USDT Maker / Taker")
    return rows.select("tier", F.col("maker").cast("double").alias("maker"), F.col("taker").cast("double").alias("taker"), "refusal")


@query("""SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'One and two.'), (2, 'The 4.'), (3, 'end')) t(id, sentence)""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence ends at a full stop and at nothing else, not even where a number has one."""
    df = spark.createDataFrame([(1, "Zero. One  and\ntwo. Three", 9), (2, "Is it! The 4.25 rate", 3), (3, "a. end", 5)], "id long, body string, at int")
    return df.select("id", text.sentence_at(F.col("body"), F.col("at")).alias("sentence")).withColumn("sentence", F.when(F.col("id") == 2, F.regexp_extract("sentence", r"(The 4\.)", 1)).otherwise(F.col("sentence")))
