"""Mask, never drop: ordered reasons, the first of which a row carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(*ladder: tuple[Column, str]) -> Column:
    """array<string> of the reasons whose condition holds, in the ladder's order; an unknown condition does not hold."""
    return F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in ladder]), lambda r: r.isNotNull())


def masked(df: DataFrame, ladder: list[tuple[Column, str]], null_when_masked: list[str] = ()) -> DataFrame:
    """Adds exclusion_reasons, exclusion_reason (the first) and valid; nulls the named columns of masked rows."""
    df = df.withColumn("exclusion_reasons", reasons(*ladder))
    df = df.withColumn("exclusion_reason", F.try_element_at("exclusion_reasons", F.lit(1))).withColumn("valid", F.size("exclusion_reasons") == 0)
    return df.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in null_when_masked})


def ledger(df: DataFrame, reason: str = "exclusion_reason") -> DataFrame:
    """Rows by their first reason, most frequent first."""
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), reason)


def unmasked_if_only(df: DataFrame, forgiven: list[str], needs: list[str], restore: dict[str, Column]) -> DataFrame:
    """Rows whose reasons all lie in forgiven, and whose needed columns are known, become valid again; restore recomputes what was nulled."""
    free = (F.size(F.array_except("exclusion_reasons", F.array(*map(F.lit, forgiven)))) == 0) & (F.size("exclusion_reasons") > 0)
    for c in needs:
        free = free & F.col(c).isNotNull()
    out = df.withColumn("_free", free).withColumns({c: F.when(F.col("_free"), e).otherwise(F.col(c)) for c, e in restore.items()})
    return out.withColumn("valid", F.col("valid") | F.col("_free")).withColumn("exclusion_reason", F.when(~F.col("_free"), F.col("exclusion_reason"))).drop("_free")


def unknown_if_any(counted: Column, by: Column) -> Column:
    """Aggregate: how often ``by`` holds, or null (not 0) if ``counted`` is unknown in any row."""
    return F.when(F.bool_and(counted.isNotNull()), F.count_if(by))
