"""Sealed datasets: written once in a declared order, read only if they are what was sealed."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table_digest
from ..schemas import TABLES, conform, missing_required


class SealError(ValueError):
    pass


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    """Hadoop's own file system and path, so that any store Spark reads works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def identity(df: DataFrame) -> str:
    """Digest of the rows, whatever their order or files."""
    return df.agg(table_digest(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias("d")).first()["d"]


def create_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Writes a file whole and only if there is none: it is written beside its place and then moved there, a move that does not overwrite. False if one was there."""
    fs, at = _file(spark, path)
    if fs.exists(at):
        return False
    sc = spark.sparkContext
    fs_package = sc._jvm.org.apache.hadoop.fs
    beside = fs.makeQualified(fs_package.Path(f"{path}.{uuid.uuid4().hex}.part"))
    out = fs.create(beside, False)
    out.write(bytearray(content))
    out.close()
    how = sc._gateway.new_array(fs_package.Options.Rename, 1)
    how[0] = fs_package.Options.Rename.NONE
    try:
        fs_package.FileContext.getFileContext(beside.toUri(), sc._jsc.hadoopConfiguration()).rename(beside, fs.makeQualified(at), how)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def write_sealed(df: DataFrame, path: str, table: str) -> dict:
    """Conform, check required columns, write in the table's order, and leave a manifest. An existing dataset of the same rows stays as it
    is; other rows at that place are refused.

    Rows go to a folder of their own, and the manifest, which names it, comes last and at once: a write that breaks off leaves nothing that is read and
    nothing that blocks the place."""
    spark, spec = df.sparkSession, TABLES[table]
    rows = conform(df, spec)
    if missing := missing_required(rows, spec):
        raise SealError(f"{table}: null in required {missing}")
    manifest = {"table": table, "version": spec.version, "rows": rows.count(), "identity": identity(rows)}
    fs, at = _file(spark, f"{path}/manifest.json")
    if not fs.exists(at):
        folder = f"rows-{uuid.uuid4().hex}"
        rows.orderBy(*[F.col(c).asc_nulls_last() for c in spec.sort_by]).write.mode("errorifexists").parquet(f"{path}/{folder}")
        if create_once(spark, f"{path}/manifest.json", json.dumps(manifest | {"folder": folder}, sort_keys=True).encode()):
            return manifest
        _, unused = _file(spark, f"{path}/{folder}")
        fs.delete(unused, True)
    held = _manifest(spark, path)
    if {k: v for k, v in held.items() if k != "folder"} != manifest:
        raise SealError(f"{path} holds other rows")
    return manifest


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def read_sealed(spark: SparkSession, path: str, table: str, verify: bool = True) -> DataFrame:
    """The rows of a sealed dataset, or an error: another table or version, another schema, no manifest, other content."""
    spec = TABLES[table]
    fs, at = _file(spark, f"{path}/manifest.json")
    if not fs.exists(at):
        raise SealError(f"{path} has no manifest")
    manifest = _manifest(spark, path)
    if (manifest["table"], manifest["version"]) != (table, spec.version):
        raise SealError(f"{path} holds {manifest['table']} v{manifest['version']}")
    df = spark.read.parquet(f"{path}/{manifest['folder']}")
    if dict(df.dtypes) != dict((c, f.dataType.simpleString()) for c, f in ((f.name, f) for f in spec.schema)):
        raise SealError(f"{path} has another schema")
    if verify and identity(df) != manifest["identity"]:
        raise SealError(f"{path} changed since it was sealed")
    return df


def load_sealed(spark: SparkSession, path: str, table: str, column: str | None = None, values: list | None = None) -> DataFrame:
    """The verified rows, all or those whose column is one of the values; a long list is joined, not spelled into the plan."""
    df = read_sealed(spark, path, table)
    if values is None:
        return df
    if len(values) <= 100:
        return df.where(F.col(column).isin(values))
    return df.join(spark.createDataFrame([(v,) for v in set(values)], f"{column} {df.schema[column].dataType.simpleString()}"), column, "left_semi").select(*df.columns)


def query_sealed(spark: SparkSession, path: str, table: str, sql: str, parameters: list | None = None) -> DataFrame:
    """Caller's SQL over one verified dataset, a view by the table's name; ? stand for parameters."""
    read_sealed(spark, path, table).createOrReplaceTempView(table)
    return spark.sql(sql, args=parameters or [])


def append_log(spark: SparkSession, records: list[dict], path: str) -> None:
    spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in records], "value string").coalesce(1).write.mode("append").text(path)


def write_build(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends builds (partitions by keys) that are not held yet; a build that is held stays untouched. Returns the rows that were new."""
    spark = df.sparkSession
    fs, at = _file(spark, path)
    if fs.exists(at):
        held = spark.read.parquet(path).select(*keys).distinct()
        df = df.join(held, keys, "left_anti")
    n = df.count()
    if n:
        df.write.mode("append").partitionBy(*keys).parquet(path)
    return n


def put_blobs(blobs: DataFrame, path: str) -> DataFrame:
    """Stores (source, record_id, payload) by content and returns receipts (receipt_id, source, record_id, raw_hash, bytes).

    A blob is written once under its sha256. A receipt's id comes from source and record; one id with two payloads raises, here and against what is stored;
    records without an id are occurrences of their own."""
    spark = blobs.sparkSession
    known = F.concat_ws("\x1f", "source", "record_id")
    digest = F.sha2("payload", 256)
    own = F.when(F.col("record_id").isNotNull(), F.sha2(known.cast("binary"), 256)).otherwise(F.expr("uuid()"))
    rows = blobs.select(own.alias("receipt_id"), "source", "record_id", digest.alias("raw_hash"), F.octet_length("payload").cast("long").alias("bytes"), "payload")
    made = rows.groupBy("receipt_id").agg(F.first(F.struct("source", "record_id", "raw_hash", "bytes")).alias("r"), F.count_distinct("raw_hash").alias("n"))
    if clash := made.where("n > 1 and r.record_id is not null").limit(1).collect():
        raise SealError(f"record {clash[0]['r']['record_id']} comes with two payloads")
    fs, at = _file(spark, f"{path}/receipts")
    receipts = made.select("receipt_id", "r.*")
    if fs.exists(at):
        held = spark.read.parquet(f"{path}/receipts")
        both = receipts.join(held.select("receipt_id", F.col("raw_hash").alias("was")), "receipt_id")
        if clash := both.where("raw_hash != was").limit(1).collect():
            raise SealError(f"record {clash[0]['record_id']} is stored with another payload")
        receipts = receipts.join(held.select("receipt_id"), "receipt_id", "left_anti")
        stored = spark.read.parquet(f"{path}/blobs").select("raw_hash")
        rows = rows.join(stored, "raw_hash", "left_anti")
    rows.groupBy("raw_hash").agg(F.first("payload").alias("payload")).write.mode("append").parquet(f"{path}/blobs")
    receipts.write.mode("append").parquet(f"{path}/receipts")
    return spark.read.parquet(f"{path}/receipts")


def verified_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(raw_hash, bytes, intact, payload): stored blobs, each re-hashed; what is not what its name says is not intact and has no payload."""
    b = spark.read.parquet(f"{path}/blobs")
    intact = F.sha2("payload", 256) == F.col("raw_hash")
    return b.select("raw_hash", F.octet_length("payload").cast("long").alias("bytes"), intact.alias("intact"), F.when(intact, F.col("payload")).alias("payload"))
