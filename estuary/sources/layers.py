"""Layers of an archive: which governs a window, which contracts they cover, what their inventories add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# On what ground a layer governs a window, or none does.
NAMED, SOLE, BOTH, NONE = "layer_named_explicitly", "sole_covering_layer", "both_layers_cover_the_window", "no_layer_covers_the_window"


def series_prefix(ticker: Column) -> Column:
    """The capital letters that a ticker begins with."""
    return F.regexp_extract(ticker, "^[A-Z]+", 0)


def universe_rows(contracts: DataFrame, ticker: str, series: list[str], text_columns: tuple[str, ...] = ()) -> DataFrame:
    """Contracts of the declared series, by prefix, with the named columns (instants) as text."""
    return contracts.where(series_prefix(F.col(ticker)).isin(series)).withColumns({c: F.col(c).cast("string") for c in text_columns})


def series_contracts(contracts: DataFrame, ticker: str, series: list[str]) -> DataFrame:
    """Contracts whose series, all that stands before the first dash, is one of the declared; by ticker."""
    return contracts.where(F.substring_index(F.col(ticker), "-", 1).isin(series)).orderBy(ticker)


def covering_contracts(contracts: DataFrame, ticker: str, opened: str, closed: str, series: list[str], start: Column, end: Column) -> DataFrame:
    """Distinct tickers of the declared series whose listing meets [start, end]: opened by its end and, if closed, not before its start."""
    met = (F.col(opened) <= end) & (F.col(closed).isNull() | (F.col(closed) >= start))
    return contracts.where(met & F.substring_index(F.col(ticker), "-", 1).isin(series)).select(ticker).distinct()


def governing_layer(covering: DataFrame, declared: list[str], named: str | None = None) -> DataFrame:
    """One row (layer, basis, available, covering, overlap): covering (layer, contract) are the contracts with which layers meet the window.

    A layer that is named governs; else the only one that covers does; where several cover, or none, no layer does, and overlap counts the contracts that
    all of them hold. A name that is not declared raises.
    """
    if named is not None and named not in declared:
        raise ValueError(f"{named} is not one of {declared}")
    held = covering.where(F.col("layer").isin(declared)).distinct()
    layers = held.agg(F.array_sort(F.collect_set("layer")).alias("names"))
    shared = held.groupBy("contract").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("contracts"))
    overlap = shared.agg(F.collect_list(F.struct("n", "contracts")).alias("by"))  # a row for each number of layers
    both = layers.crossJoin(overlap)  # one row each
    n = F.size("names")
    common = F.coalesce(F.try_element_at(F.transform(F.filter("by", lambda x: x["n"] == n), lambda x: x["contracts"]), F.lit(1)), F.lit(0))
    layer = F.lit(named) if named else F.when(n == 1, F.get("names", F.lit(0)))
    basis = F.lit(NAMED) if named else F.when(n == 0, NONE).when(n == 1, SOLE).otherwise(BOTH)
    return both.select(layer.cast("string").alias("layer"), basis.alias("basis"), layer.isNotNull().alias("available"), n.alias("covering"), F.when((n > 1) & layer.isNull(), common).otherwise(0).cast("long").alias("overlap"))


def partition_of(start: Column, end: Column, cutoff: Column) -> Column:
    """Which partition serves a window: historical where the cutoff is not before its end, live where it is not after its start, straddling between; a
    window that ends before it starts is invalid."""
    return F.when(end < start, "invalid").when(cutoff >= end, "historical").when(cutoff <= start, "live").when(cutoff.isNotNull(), "straddling")


def layer_totals(inventory: DataFrame, declared: DataFrame) -> DataFrame:
    """Each declared layer (layer) with shards, rows, bytes, status and flags of its inventory (layer, basename, rows, bytes, error, flags); a layer without a shard is
    missing. A basename that several layers hold is flagged in all of them, and so is an unreadable shard."""
    twice = inventory.groupBy("basename").agg((F.count_distinct("layer") > 1).alias("_twice"))
    marked = inventory.join(twice, "basename", "left")
    sums = marked.groupBy("layer").agg(
        F.count("*").alias("shards"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("bytes").alias("bytes"), F.bool_or(F.col("error").isNotNull()).alias("_bad"), F.bool_or("_twice").alias("_shared"), F.array_distinct(F.flatten(F.collect_set("flags"))).alias("_flags")
    )
    whole = declared.join(sums, "layer", "left")
    there = F.col("shards").isNotNull()
    found = F.concat(F.coalesce("_flags", F.array().cast("array<string>")), F.when(F.col("_bad"), F.array(F.lit("shard_unreadable"))).otherwise(F.array().cast("array<string>")), F.when(F.col("_shared"), F.array(F.lit("basename_in_several_layers"))).otherwise(F.array().cast("array<string>")))
    flags = F.when(there, F.array_sort(F.array_distinct(found))).otherwise(F.array(F.lit("layer_missing")))
    return whole.select("layer", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shards", "rows", "bytes")], F.when(there, "present").otherwise("missing").alias("status"), flags.alias("flags"))


def probe_schema(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Columns and types of one shard from its footer; None if it cannot be read, so that the shard is skipped with a reason."""
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError

    try:
        return dict(spark.read.parquet(path).dtypes)
    except (PySparkException, Py4JJavaError):
        return None


def admitted_shards(spark: SparkSession, paths: list[str], columns: dict[str, tuple[str, str]], required: tuple[str, ...], bounds: dict[str, tuple] | None = None, window: tuple | None = None) -> tuple[dict[str, dict[str, str]], list[tuple[str, str]]]:
    """(shards to scan with their columns, (shard, why not) of the rest): unreadable, without a required column, or with footer bounds outside the window. Control plane: one
    footer a shard."""
    kept, skipped = {}, []
    for path in paths:
        low, high = (bounds or {}).get(path, (None, None))
        if window and low is not None and high is not None and (high < window[0] or low > window[1]):
            skipped.append((path, "outside_window"))
            continue
        schema = probe_schema(spark, path)
        if schema is None:
            skipped.append((path, "unreadable"))
        elif absent := [n for n in required if columns[n][0] not in schema]:
            skipped.append((path, "missing_required:" + ",".join(absent)))
        else:
            kept[path] = schema
    return kept, skipped
