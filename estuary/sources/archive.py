"""Archive shards: scans that keep each row's position, column maps, inventories and page sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import reasons
from .layers import admitted_shards

#: Columns that tell how a market ended; no scan may ask for them.
NEVER_SELECTED = ("winning_outcome_label", "resolution_status")


def shard_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The parquet files of paths, folders included, by name. Names are read, contents are not."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths)
    return sorted(r[0] for r in listed.select("path").collect())  # one row a shard


def scan_shards(spark: SparkSession, paths: list[str], columns: dict[str, tuple[str, str]], required: tuple[str, ...], window: tuple[Column, Column, Column] | None = None, keep: Column | None = None) -> DataFrame:
    """name -> (source column, type) of many shards, with shard and row_position. A missing optional column is null; a shard without a required one raises, see extract() for
    leaving it out. The window (time, from, to) and keep are pushed to the scan, and positions survive them."""
    df, skipped = extract(spark, paths, columns, required, window, keep)
    if absent := [x for x in skipped if x[1].startswith("missing_required")]:
        raise ValueError(f"required columns are missing: {absent[:3]}")
    return df


def extract(
    spark: SparkSession, paths: list[str], columns: dict[str, tuple[str, str]], required: tuple[str, ...], window: tuple[Column, Column, Column] | None = None, keep: Column | None = None, bounds: dict[str, tuple] | None = None,
    span: tuple | None = None,
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(rows of all admitted shards, (shard, why not) of the rest): see layers.admitted_shards. bounds, from an inventory, and span tell which shards can hold the window.
    Shards are read by groups of one schema, so that a column that some lack is null there and an error nowhere."""
    if banned := [s for s, _ in columns.values() if s in NEVER_SELECTED]:
        raise ValueError(f"{banned} may not be selected")
    admitted, skipped = admitted_shards(spark, shard_files(spark, paths), columns, required, bounds, span)
    if not admitted:
        if any(why.startswith("missing_required") for _, why in skipped):
            raise ValueError(f"required columns are missing: {skipped[:3]}")
        spec = ", ".join([*(f"{n} {k}" for n, (_, k) in columns.items()), "shard string", "row_position long"])
        return spark.createDataFrame([], spec), skipped
    groups: dict[frozenset, list[str]] = {}
    for path, have in admitted.items():
        groups.setdefault(frozenset(have), []).append(path)
    out = None
    for have, files in groups.items():
        df = spark.read.parquet(*files)
        if window:
            df = df.where((window[0] >= window[1]) & (window[0] <= window[2]))
        if keep is not None:
            df = df.where(keep)
        chosen = [F.col(s).cast(k).alias(n) if s in have else F.lit(None).cast(k).alias(n) for n, (s, k) in columns.items()]
        rows = df.select(*chosen, F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_position"))
        out = rows if out is None else out.unionByName(rows)
    return out, skipped


def occurrence(rows: DataFrame, shard_hashes: DataFrame) -> DataFrame:
    """Adds occurrence_id <sha256 of the shard>:<row>: equal fills at two places stay two. shard_hashes (shard, sha256): one row a file."""
    return rows.join(shard_hashes, "shard", "left").withColumn("occurrence_id", F.concat_ws(":", "sha256", F.col("row_position").cast("string")))


def bounded(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first rows by shard and position, and whether any were cut."""
    got = rows.orderBy("shard", "row_position").limit(most + 1)
    return got.limit(most), got.count() > most


# Flags of archived trades, of either venue.
LEGS_NOT_WHOLE, ZERO_CENT, OUTSIDE_CENTS = "yes_no_cents_sum_not_100", "zero_cent_price", "price_outside_documented_cents_range"
NO_OUTCOME, OTHER_AXIS, ZERO_PRICE, NO_DIRECTION = "unknown_outcome", "axis_differs_from_stored", "zero_price_row", "unknown_direction"


def cents_trades(rows: DataFrame) -> DataFrame:
    """(ticker, yes_price, no_price, count, taker_side, created_time) in cents -> price, signs and flags; rows without an id, time or count are not trades."""
    flags = reasons((F.col("yes_price") + F.col("no_price") != 100, LEGS_NOT_WHOLE), ((F.col("yes_price") == 0) | (F.col("no_price") == 0), ZERO_CENT), (~F.col("yes_price").between(0, 99), OUTSIDE_CENTS))
    sign = F.when(F.col("taker_side") == "yes", 1).when(F.col("taker_side") == "no", -1)
    return rows.where("ticker is not null and created_time is not null and count is not null").withColumns({"price": (F.col("yes_price").cast("decimal(18,12)") / 100).cast("decimal(18,12)"), "taker_sign": sign, "flags": flags})


def outcome_trades(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(outcome_seq, price, p_event, taker_direction): the event axis is the price of outcome 1 and its complement for 2; else null and flagged."""
    axis = F.when(F.col("outcome_seq") == 1, F.col("price")).when(F.col("outcome_seq") == 2, 1 - F.col("price"))
    flags = reasons((axis.isNull(), NO_OUTCOME), (F.abs(axis - F.col("p_event")) > tolerance, OTHER_AXIS), (F.col("price") == 0, ZERO_PRICE), (~F.coalesce(F.col("taker_direction"), F.lit(0)).isin(-1, 0, 1), NO_DIRECTION))
    return rows.withColumns({"axis_price": axis, "taker_sign": F.coalesce(F.col("taker_direction"), F.lit(0)), "flags": flags})


INVENTORY = "path string, bytes long, rows long, row_groups long, schema_fingerprint string, low string, high string, sha256 string, error string"


def _bounds(metadata: pq.FileMetaData, column: str) -> tuple[str | None, str | None]:
    """Least and largest value by the row groups' statistics; unknown if any group has none or they cannot be read."""
    import pyarrow as pa

    at = [i for i in range(metadata.num_columns) if metadata.schema.column(i).name == column]
    try:
        found = [metadata.row_group(g).column(at[0]).statistics for g in range(metadata.num_row_groups)] if at else []
        if not found or any(s is None or not s.has_min_max for s in found):
            return None, None
        return str(min(s.min for s in found)), str(max(s.max for s in found))
    except pa.ArrowException:
        return None, None


def inventory(spark: SparkSession, files: DataFrame, time_column: str) -> DataFrame:
    """One record for each file of (path, content binary): size, footer counts, schema digest, the time column's bounds and sha256. Files are read
    by Spark, so any store will do; unreadable ones carry their error."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                base = {"path": path, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}
                try:
                    m = pq.ParquetFile(pa.BufferReader(content)).metadata
                    names = ";".join(f"{m.schema.column(i).path}:{m.schema.column(i).physical_type}" for i in range(m.num_columns))
                    base |= {"rows": m.num_rows, "row_groups": m.num_row_groups, "schema_fingerprint": hashlib.sha256(names.encode()).hexdigest()}
                    base["low"], base["high"] = _bounds(m, time_column)
                except (pa.ArrowException, OSError) as e:
                    base["error"] = str(e)[:200]
                out.append(base)
            got = pd.DataFrame(out, columns=[c.split()[0] for c in INVENTORY.split(", ")]).astype(object)
            yield got.where(got.notna(), None)

    return files.select("path", "content").mapInPandas(run, INVENTORY)


def inventory_of(spark: SparkSession, pattern: str, time_column: str) -> DataFrame:
    return inventory(spark, spark.read.format("binaryFile").load(pattern), time_column)


def moved(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose hash changed, that are gone or that are new."""
    a, b = stored.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("is"))
    return a.join(b, "path", "full").where(~F.col("was").eqNullSafe(F.col("is")))


def table_rows(pages: DataFrame, id_column: str, text: str) -> DataFrame:
    """Cells of the pipe tables in texts: (id, table, row, cells). A table is a run of lines between pipes; the rule under its header is left out."""
    from pyspark.sql import Window as W

    lines = pages.select(id_column, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    w = W.partitionBy(id_column).orderBy("line")
    inside = F.col("body").rlike(r"^\s*\|.*\|\s*$")
    runs = lines.withColumn("inside", inside).withColumn("table", F.sum(F.when(F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    kept = runs.where(F.col("inside") & ~F.col("body").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("body"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return kept.select(id_column, "table", (F.row_number().over(W.partitionBy(id_column, "table").orderBy("line")) - 1).alias("row"), cells.alias("cells"))


def paginate(fetch: object, start: str | None, identity: list[str], max_pages: int, max_items: int | None = None) -> tuple[list[dict], str]:
    """Follows cursors: fetch(cursor) -> (items, next cursor or None). Items repeat by their first known identity and count once. Returns the
    items and why it stopped."""
    items, seen, cursors, cursor = [], set(), set(), start
    for _ in range(max_pages):
        page, after = fetch(cursor)
        for x in page:
            key = next((x[k] for k in identity if x.get(k) is not None), None)
            if key is None or key not in seen:
                items.append(x)
                seen.add(key)
            if max_items is not None and len(items) >= max_items:
                return items, "max_items"
        if after is None:
            return items, "exhausted"
        if not page:
            return items, "empty_page_with_cursor"
        if after in cursors:
            return items, "cursor_loop"
        cursors.add(after)
        cursor = after
    return items, "max_pages"
