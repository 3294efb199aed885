"""A corpus pipeline: quality, toxicity, near copies, secrets, packing; each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estuary.llm import common, near_copies, packing, quality, secrets, toxicity


def _apart(docs: DataFrame, *names: str) -> tuple[str, ...]:
    return tuple(common.fresh(docs.columns, n) for n in names)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. Null texts, languages and sources count as empty; repeated rows are judged alike and a
    null id like any other; columns stay, whatever their names; an empty table stays empty, and without labels all documents stay."""
    names = _apart(docs, *quality.NAMES)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.scorer(model, spark, names)(docs).where(F.col(names[0]) >= quality.REJECT_BELOW).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated toxicity is a half or more. A null text counts as empty; repeated rows are judged alike and a null id
    like any other; columns stay, whatever their names; an empty table stays empty, and where no term marks toxic texts all documents stay."""
    names = _apart(docs, "toxicity", "evidence")
    index = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scorer(index, spark, names)(docs).where((F.col(names[0]) < 0.5) | (F.size(names[1]) == 0)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more. The smallest id stays, rows without an id come
    last; different texts of one id are different documents, equal rows one; all texts without a word are copies; an empty table stays empty."""
    return near_copies.keep_one(docs, words=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows where a text changes. No row is dropped or merged; a null text stays null; other columns stay,
    whatever their names; an empty table stays empty."""
    (spans,) = _apart(docs, "secret_spans")
    masked = secrets.redact(secrets.scan(docs, spans=spans), spans=spans)
    return masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens. A null text is an empty one, its end alone; repeated rows are packed as documents of
    their own; a null id stays null; further columns are left out; an empty table gives no piece."""
    return packing.pack(docs, packing.byte_bpe(), keep_ids=False).select(*packing.COLUMNS[:7])


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]

#: Models, fingerprints and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and deleted once the next one is written."""
    work, docs, before = common.Scratch(spark), common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir))
        if before is not None:
            work.drop(before)
        before = docs
    return docs
