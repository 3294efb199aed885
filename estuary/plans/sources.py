"""Scans, seals and digests over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times
from ..schemas import TABLES, conform
from ..sources import archive
from .registry import query, read


@query("""SELECT event_id AS trade_id, user_id AS contract, file_row_number AS row_position, CAST(NULL AS VARCHAR) AS memo FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS file_row_number FROM events) WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09' AND user_id % 5 = 0""")
def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions survive the window and the filter; an optional column that no shard has is null."""
    window = (F.col("ts"), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz"))
    columns = {"trade_id": ("event_id", "long"), "contract": ("user_id", "long"), "memo": ("memo", "string")}
    return archive.scan_shards(spark, [f"{sf_dir}/events.parquet"], columns, ("trade_id",), window, F.col("user_id") % 5 == 0).drop("shard")


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE o_custkey % 50 = 0) AS without_owner FROM orders""")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of required columns in one pass over conformed rows."""
    o = read(spark, sf_dir, "orders").select(F.lit("v").alias("venue"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("contract_id"), F.col("o_totalprice").cast("decimal(38,12)").alias("price"), F.col("o_orderkey").cast("string").alias("record_id"))
    return conform(o, TABLES["trades"]).agg(F.count("*").alias("rows"), F.count_if(F.col("contract_id").isNull()).alias("without_owner"))


@query("""SELECT n_nationkey AS nationkey, sha256(concat_ws(chr(31), n_name, CAST(n_regionkey AS VARCHAR))) AS digest FROM nation""")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), text.text_digest(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("digest"))


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))) AS sha FROM lineitem),
q AS (SELECT count(*) AS n, CAST(sum(CAST('0x' || sha[1:12] AS BIGINT)) AS VARCHAR) AS a, CAST(sum(CAST('0x' || sha[13:24] AS BIGINT)) AS VARCHAR) AS b, CAST(sum(CAST('0x' || sha[25:36] AS BIGINT)) AS VARCHAR) AS c, CAST(sum(CAST('0x' || sha[37:48] AS BIGINT)) AS VARCHAR) AS d FROM h)
SELECT sha256(concat_ws(':', CAST(n AS VARCHAR), a, b, c, d)) AS identity FROM q""")
def table_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free digest of a whole table's rows."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    spelled = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")], cents.cast("string"))
    return read(spark, sf_dir, "lineitem").agg(text.table_digest(spelled).alias("identity"))


@query()
def shard_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.inventory_of(spark, f"{sf_dir}/orders.parquet", "o_orderdate").drop("path")


@query("""SELECT event_id, epoch_us(ts) AS micros, epoch_us(ts) - (event_id % 90) * 1000000 AS lower FROM events""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", times.micros(F.col("ts")).alias("micros"))
    return e.withColumn("a", times.availability(F.col("micros"), F.col("event_id") % 90)).select("event_id", F.col("a.upper").alias("micros"), F.col("a.lower").alias("lower"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH h AS (SELECT TIMESTAMP '2024-03-10 00:30:00' + INTERVAL (i) HOUR AS l, 1 AS side, i FROM range(6) t(i) UNION ALL SELECT TIMESTAMP '2024-11-03 00:30:00' + INTERVAL (i) HOUR, 2, i FROM range(6) t(i))
SELECT epoch_us(l) AS local, CASE WHEN side = 1 AND i = 2 THEN 'nonexistent' WHEN side = 2 AND i = 1 THEN 'ambiguous' ELSE 'unique' END AS kind, CASE WHEN side = 1 AND i = 2 THEN NULL ELSE epoch_us(l) + CASE WHEN (side = 1 AND i < 2) OR (side = 2 AND i > 1) THEN 5 ELSE 4 END * 3600000000 END AS first,
  CASE WHEN side = 1 AND i = 2 THEN NULL ELSE epoch_us(l) + CASE WHEN (side = 1 AND i < 2) OR (side = 2 AND i >= 1) THEN 5 ELSE 4 END * 3600000000 END AS second FROM h""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours around both changes of the clocks: skipped, repeated or plain, and the instants that either reading gives."""
    start = F.lit("2024-03-10 00:30:00").cast("timestamp_ntz"), F.lit("2024-11-03 00:30:00").cast("timestamp_ntz")
    hours = spark.range(6).select(F.explode(F.array(*[s + F.expr("make_dt_interval(0, cast(id as int), 0, 0)") for s in start])).alias("local"))
    zone, local = "America/New_York", F.col("local")
    return hours.select(times.micros(local).alias("local"), times.local_kind(local, zone).alias("kind"), times.local_instant(local, zone).alias("first"), times.local_instant(local, zone, 1).alias("second"))
