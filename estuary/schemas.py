"""Declared tables: columns, required ones and sort keys. What is undeclared is refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMAL = "decimal(38,12)"


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, str]
    required: tuple[str, ...]
    sort_by: tuple[str, ...]
    json_columns: tuple[str, ...] = ()
    version: int = 1

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(", ".join(f"{c} {k}" for c, k in self.columns.items()))


def _table(name: str, spec: str, required: str, sort_by: str, json_columns: str = "", version: int = 1) -> Table:
    columns = {}
    for part in spec.split(";"):
        kind, names = part.strip().split(":")
        columns |= dict.fromkeys(names.split(), kind.strip())
    return Table(name, columns, tuple(required.split()), tuple(sort_by.split()), tuple(json_columns.split()), version)


_CLOCK = "timestamp: source_time received_time usable_time; string: availability_quality raw_hash record_id source"
TABLES = {
    t.name: t
    for t in (
        _table("book_events", f"string: venue contract_id connection_id sequence_scope kind operation side bid_levels ask_levels; bigint: sequence; {DECIMAL}: price size; {_CLOCK}", "venue contract_id kind record_id", "venue contract_id sequence_scope sequence usable_time record_id", "bid_levels ask_levels"),
        _table("quotes", f"string: venue contract_id validity; {DECIMAL}: bid ask midpoint spread; timestamp: last_verified; {_CLOCK}", "venue contract_id validity record_id", "venue contract_id usable_time source_time record_id"),
        _table("trades", f"string: venue contract_id side; {DECIMAL}: price size; {_CLOCK}", "venue contract_id price record_id", "venue contract_id usable_time record_id"),
        _table("historical_trades", f"string: venue contract_id layer axis_name flags; {DECIMAL}: price axis_price size; int: taker_sign; {_CLOCK}", "venue contract_id price record_id", "venue contract_id source_time record_id", "flags"),
        _table("contracts", "string: venue contract_id rule_hash inequality yes_axis; int: orientation; timestamp: open_time close_time", "venue contract_id", "venue contract_id rule_hash"),
        _table("releases", "string: event_id cluster_id family values; timestamp: event_time usable_time", "event_id event_time", "event_id usable_time", "values"),
        _table("expectations", f"string: event_id statistic unit source_kind; {DECIMAL}: value; timestamp: published_at", "event_id statistic value", "event_id statistic source_kind published_at"),
        _table("resolutions", f"string: contract_id rule_hash outcome; {DECIMAL}: payout; timestamp: known_at", "contract_id outcome", "contract_id rule_hash"),
        _table("event_panel", f"string: event_id contract_id venue exclusion_reason exclusion_reasons; bigint: horizon_seconds; {DECIMAL}: baseline endpoint response; boolean: valid; timestamp: event_time baseline_time endpoint_time", "event_id contract_id horizon_seconds valid", "event_id contract_id venue horizon_seconds", "exclusion_reasons"),
        _table("trade_panel", f"string: event_id contract_id exclusion_reason exclusion_reasons; bigint: horizon_seconds n_pre n_post; {DECIMAL}: baseline endpoint response; boolean: valid; timestamp: event_time baseline_time endpoint_time", "event_id contract_id horizon_seconds valid", "event_id contract_id horizon_seconds", "exclusion_reasons"),
        _table("forecast", "string: event_id contract_id exclusion_reason; bigint: horizon_seconds; double: current_price own_lag neighbor_lag target; timestamp: prediction_time", "event_id contract_id horizon_seconds prediction_time", "event_id contract_id horizon_seconds prediction_time", version=3),
        _table("historical_forecast", f"string: event_id receiver_id donor_id exclusion_reason; {DECIMAL}: anchor own_lag neighbor_lag target; boolean: valid; timestamp: origin", "event_id receiver_id origin valid", "event_id receiver_id origin"),
    )
}


WHOLE = ("byte", "short", "integer", "long")
FRACTIONAL = ("float", "double")


def _refused(own: str, kind: str) -> str | None:
    """Why a column of type own may not become kind; None if it may."""
    to = kind.split("(")[0]
    if own == "boolean" and to != "boolean":
        return "a boolean is no value of it"
    if to == "decimal" and own in FRACTIONAL:
        return "a float is no exact decimal; convert it where it comes from"
    if to == "timestamp" and own != "timestamp":
        return "an instant needs a time zone"
    if to == "boolean" and own != "boolean":
        return "only a boolean is one"
    if to in ("bigint", "int") and own not in (*WHOLE, *FRACTIONAL):
        return "only a number is one"
    if to == "double" and own not in (*WHOLE, *FRACTIONAL) and not own.startswith("decimal"):
        return "only a number is one"
    if to == "string" and (own in FRACTIONAL or own in ("timestamp", "timestamp_ntz", "date", "binary")):
        return "only text, whole numbers and decimals are text"
    return None


def conform(df: DataFrame, table: Table) -> DataFrame:
    """df with the table's columns in their types. Missing optional columns are null; undeclared columns, and columns whose type says something else than the
    declared one, raise: no boolean becomes a number, no float a decimal, no time without a zone an instant. Structured values of JSON columns are spelled. NaN and infinities
    become null; a fraction in a column of whole numbers fails the query."""
    extra = set(df.columns) - set(table.columns)
    if extra:
        raise ValueError(f"{table.name} does not declare {sorted(extra)}")
    out = []
    for c, kind in table.columns.items():
        if c not in df.columns:
            out.append(F.lit(None).cast(kind).alias(c))
            continue
        x, own = F.col(c), df.schema[c].dataType.typeName()
        if c in table.json_columns and own in ("array", "struct", "map"):
            out.append(F.to_json(x).alias(c))
            continue
        if own != "void" and (why := _refused(own, kind)):
            raise TypeError(f"{table.name}.{c} is {own}, declared {kind}: {why}")
        if own in FRACTIONAL:
            x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
            if kind in ("bigint", "int"):
                x = F.when((x == F.floor(x)) | x.isNull(), x).otherwise(F.raise_error(F.lit(f"{table.name}.{c} holds a fraction")))
        out.append(x.cast(kind).alias(c))
    return df.select(*out)


def missing_required(df: DataFrame, table: Table) -> list[str]:
    """Required columns that are null in any row, in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in table.required]).first()
    return [c for c in table.required if row[c]]
