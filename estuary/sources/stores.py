"""Stores beside the sealed ones: configurations, receipts, snapshots by build, captured shards, inventories, release facts, metadata records and what re-parsing confirms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.masking import reasons, unknown_if_any
from ..functions.text import payout_predicate, table_digest
from ..operators.sets import first_occurrences
from .layers import series_contracts
from .sealed import SealError, _file, create_once


def read_config(spark: SparkSession, path: str, required: tuple[str, ...]) -> dict:
    """A JSON configuration, read once on the driver; one that is no mapping, or lacks a required key, raises."""
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(raw, dict) or (absent := [k for k in required if k not in raw]):
        raise ValueError(f"{path} lacks {absent if isinstance(raw, dict) else 'a mapping'}")
    return raw


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """All receipts by (received, raw_hash, receipt_id): JSON files with these fields and source, record_id and metadata."""
    spec = "receipt_id string, source string, record_id string, raw_hash string, received string, metadata map<string,string>"
    found = spark.read.schema(spec).json(path, multiLine=True)
    return found.withColumn("received_at", F.unix_micros(F.try_to_timestamp("received"))).orderBy(F.col("received_at").asc_nulls_first(), "raw_hash", "receipt_id")


def write_captured(df: DataFrame, root: str, stamp: str) -> bool:
    """Writes a capture's rows as the shards of one stamp, once; False, and nothing written, if the stamp is held."""
    spark = df.sparkSession
    if not create_once(spark, f"{root}/{stamp}/_claimed", stamp.encode()):
        return False
    df.write.parquet(f"{root}/{stamp}/rows")
    return True


def snapshots(market: DataFrame, funding: DataFrame) -> DataFrame:
    """market (class, asset, build, venue, ...) with settlements of the funding page of the same build; a venue that the page lacks, or a build without a page, stays
    unknown."""
    keys = ["class", "asset", "build", "venue"]
    return market.join(funding.select(*keys, "settlements"), keys, "left")


def inventory_identity(inventory: DataFrame) -> str:
    """Digest of an inventory, whatever the order of its records."""
    return inventory.agg(table_digest(F.to_json(F.struct(*sorted(inventory.columns)), {"ignoreNullFields": "false"})).alias("d")).first()["d"]


def write_inventory(inventory: DataFrame, path: str) -> str:
    """Writes the records and, last, their identity."""
    inventory.write.mode("errorifexists").parquet(f"{path}/records")
    identity = inventory_identity(inventory.sparkSession.read.parquet(f"{path}/records"))
    create_once(inventory.sparkSession, f"{path}/identity.json", json.dumps({"identity": identity}).encode())
    return identity


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The records, if they are what was written."""
    fs, at = _file(spark, f"{path}/identity.json")
    if not fs.exists(at):
        raise SealError(f"{path} has no identity")
    found = spark.read.parquet(f"{path}/records")
    if json.loads(spark.read.text(f"{path}/identity.json", wholetext=True).first()[0])["identity"] != inventory_identity(found):
        raise SealError(f"{path} changed since it was written")
    return found


def release_facts(releases: DataFrame) -> DataFrame:
    """(event_id, family, release_time, reference_period, statistic, value, revised) of releases whose values and revisions are JSON maps: a first print each, or a
    revision of an earlier one. A value that is no number is null."""
    maps = [F.map_entries(F.coalesce(F.from_json(c, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))) for c in ("values", "revisions")]
    each = F.concat(*[_facts(m, r) for m, r in zip(maps, (False, True), strict=True)])
    return releases.select("event_id", "family", "release_time", "reference_period", F.explode(each).alias("f")).select("event_id", "family", "release_time", "reference_period", "f.*")


def _facts(entries: Column, revised: bool) -> Column:
    return F.transform(entries, lambda e: F.struct(e["key"].alias("statistic"), e["value"].try_cast("decimal(38,12)").alias("value"), F.lit(revised).alias("revised")))


def event_specs(releases: DataFrame, evidence: DataFrame, audit: DataFrame) -> DataFrame:
    """One row for each release, by its time: (event_id, at, rule_hash, rule_quality, rule_known, closed_before). evidence (event_id, rule_hash, quality, observed_at): the latest
    observation counts; audit (event_id, close_time): closed before if any close lies before the release. Releases without either stay, unknown."""
    latest = evidence.groupBy("event_id").agg(F.max_by(F.struct("rule_hash", "quality"), F.struct("observed_at", "rule_hash")).alias("e"))
    closes = audit.groupBy("event_id").agg(F.min("close_time").alias("_close"))
    both = releases.join(latest, "event_id", "left").join(closes, "event_id", "left")
    return both.select(
        "event_id", F.col("release_time").alias("at"), F.col("e.rule_hash").alias("rule_hash"), F.col("e.quality").alias("rule_quality"), (F.col("e.quality").isNotNull() & F.col("e.rule_hash").isNotNull()).alias("rule_known"),
        F.coalesce(F.col("_close") < F.col("release_time"), F.lit(False)).alias("closed_before"),
    )


def first_venue_predicates(contracts: DataFrame, series: list[str]) -> DataFrame:
    """contracts (ticker, subtitle, title) of the declared series with what their texts state, by ticker; what is refused stays, with its code."""
    return series_contracts(contracts, "ticker", series).withColumn("p", payout_predicate(F.col("subtitle"), F.col("title"))).select(*contracts.columns, "p.*")


def json_find(document: Column, key: str, wanted: Column, needs: tuple[str, ...] = ()) -> Column:
    """array<string>: every mapping at any depth of a JSON text whose key has the wanted value (as text) and that has all needed keys, as JSON with sorted keys, in the
    document's order. No JSON gives none."""

    @pandas_udf("array<string>")
    def find(docs, values):  # noqa: ANN001, ANN202
        def walk(x: object, value: str, out: list[str]) -> list[str]:
            if isinstance(x, dict):
                if key in x and x[key] is not None and str(x[key]) == value and all(n in x for n in needs):
                    out.append(json.dumps(x, sort_keys=True))
                x = list(x.values())
            for inner in x if isinstance(x, list) else ():
                walk(inner, value, out)
            return out

        def one(doc: str | None, value: str | None) -> list[str]:
            try:
                return walk(json.loads(doc), value, []) if doc is not None and value is not None else []
            except ValueError:
                return []

        return docs.combine(values, one)

    return find(document, wanted.cast("string"))


def widest_first(differentials: DataFrame, spread: str, ties: list[str]) -> DataFrame:
    """The report's order: by spread, the widest first, unknown ones last."""
    return differentials.orderBy(F.col(spread).desc_nulls_last(), *ties)


def metadata_records(pages: DataFrame, identity: str, content: list[str]) -> DataFrame:
    """One record for each contract, the first by (received, page_hash, position), cited to the page that holds it, with how often it came and whether its content
    conflicts. Records without an identity are left out."""
    return first_occurrences(pages.where(F.col(identity).isNotNull()), [identity], ["received", "page_hash", "position"], content)


def reverified(sealed: DataFrame, parsed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, sealed, parsed, finding) of every statement that either side has: confirmed, differs, only_sealed or only_parsed."""
    a, b = sealed.select(*keys, F.col(value).alias("sealed"), F.lit(True).alias("_a")), parsed.select(*keys, F.col(value).alias("parsed"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    finding = F.when(F.col("_b").isNull(), "only_sealed").when(F.col("_a").isNull(), "only_parsed").when(F.col("sealed").eqNullSafe(F.col("parsed")), "confirmed").otherwise("differs")
    return both.select(*keys, "sealed", "parsed", finding.alias("finding"))


def coverage_pairs(releases: DataFrame, candidates: DataFrame, evidence: DataFrame, measured: DataFrame) -> DataFrame:
    """Every declared (event_id, contract) with reasons in order, reason and covered. candidates (event_id, contract, opened, closed), releases (event_id, at), evidence (contract,
    verified, from, to), measured (event_id, contract, prints): prints is null where the window was not scanned, which is no zero."""
    rows = candidates.join(releases, "event_id").join(evidence.withColumnRenamed("from", "_from").withColumnRenamed("to", "_to"), "contract", "left").join(measured, ["event_id", "contract"], "left")
    at = F.col("at")
    ladder = (
        (F.col("opened").isNull() | (F.col("opened") > at), "not_open_at_release"), (F.col("closed") <= at, "closed_before_release"), (~F.coalesce(F.col("verified"), F.lit(False)), "rule_not_verified"),
        ((F.col("_from") > at) | (F.col("_to") <= at), "rule_not_in_force"), (F.col("prints").isNull(), "window_not_measured"), (F.col("prints") == 0, "no_prints"),
    )
    out = rows.withColumn("reasons", reasons(*ladder))
    return out.select("event_id", "contract", "prints", "reasons", F.try_element_at("reasons", F.lit(1)).alias("reason"), (F.size("reasons") == 0).alias("covered"))


def coverage_totals(pairs: DataFrame) -> DataFrame:
    """(event_id, pairs, covered, with_prints) by event; with_prints is unknown, not a number, if any pair was not measured."""
    return pairs.groupBy("event_id").agg(F.count("*").alias("pairs"), F.count_if("covered").alias("covered"), unknown_if_any(F.col("prints"), F.col("prints") > 0).alias("with_prints"))


def rung_blocks(design: DataFrame, rungs: dict[str, list[str]], event: str, least_events: int) -> DataFrame:
    """(family, rung, events, complete_rows, blocked): why a rung of a family's ladder cannot be fitted: a column that no row knows, or too few events with complete rows."""
    out = None
    for name, columns in rungs.items():
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(c).isNotNull()
        unknown = F.filter(F.array(*[F.when(F.count(c) == 0, F.lit(c)) for c in columns], F.lit(None).cast("string")), lambda x: x.isNotNull())
        rows = design.groupBy("family").agg(F.count_distinct(F.when(whole, F.col(event))).alias("events"), F.count_if(whole).alias("complete_rows"), unknown.alias("_unknown"))
        blocked = F.when(F.size("_unknown") > 0, F.concat(F.lit("never_known:"), F.array_join("_unknown", ","))).when(F.col("events") < least_events, "too_few_events")
        made = rows.select("family", F.lit(name).alias("rung"), "events", "complete_rows", blocked.alias("blocked"))
        out = made if out is None else out.unionByName(made)
    return out
