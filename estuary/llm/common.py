"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What a word is separated by: space and the five ASCII control spaces.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: The most rows (of a few longs each) that are sent to every executor; more are shuffled.
BROADCAST_ROWS = 1_000_000


#: Rows that a Python worker is handed at a time: texts may be long, and a worker holds a batch of them and what it makes of it.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold: the session's batches of rows become no larger than BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the session names. Where none is named, a local session gets a temporary one; on a cluster that raises."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="estuary-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, so that later stages neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder, each deleted as soon as its successor is written. While one is written, shuffle files go with the query that made them."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        return self.measured(df)[0]

    def measured(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
        """The table, and sums over its rows that are made while it is written."""
        path, before = f"{self.root}/{len(self.paths)}", self.spark.conf.get(self.CLEANUP, "false")
        seen = Observation()
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            (df.observe(seen, *[e.alias(n) for n, e in sums.items()]) if sums else df).write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = found
        return found, seen.get if sums else {}

    def drop(self, *kept: DataFrame) -> None:
        sc = self.spark.sparkContext
        for path, df in self.paths.items():
            if any(df is k for k in kept):
                place = sc._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def fresh(taken: list[str], name: str) -> str:
    """name, or name with as many underscores before it as keep it apart from the columns taken (whatever their case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id falls in no fold (null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def spelled_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def hash_sample(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most limit rows, those with the smallest hashes of key: a uniform sample that no layout changes. Hashes that
    cannot be among them, by a wide margin, are dropped where they are read, so no task meets more than about limit rows."""
    spread = 1 << 30
    n = df.count()
    share = min(1.0, (limit + 8 * limit**0.5 + 64) / max(n, 1))
    place = F.pmod(F.xxhash64(key), F.lit(spread))
    return df.where(place < F.lit(int(share * spread) + 1)).orderBy(place, key).limit(limit)


def join_checked(big: DataFrame, small: DataFrame, on: list[str] | Column, how: str) -> DataFrame:
    """big joined to a table of a few narrow columns: sent to every executor if it holds at most BROADCAST_ROWS rows, else shuffled."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def spread_join(rows: DataFrame, classes: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """rows left-joined to classes on key. Classes that hold over a thousandth of all rows number under a
    thousand, whatever the data: those are broadcast, and only the rest are shuffled."""
    hot = classes.where(F.col(count) * 1000 > total)
    cold = classes.where(F.col(count) * 1000 <= total)
    tagged = rows.join(F.broadcast(hot.select(*key, *[F.col(c).alias(f"_hot_{c}") for c in classes.columns if c not in key])), key, "left")
    others = [c for c in classes.columns if c not in key]
    done = tagged.where(F.col(f"_hot_{count}").isNotNull()).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in others])
    rest = tagged.where(F.col(f"_hot_{count}").isNull()).select(*rows.columns).join(cold, key, "left").select(*rows.columns, *others)
    return done.unionByName(rest)


def batches(it: Iterator, columns: list[str], rows: int = 256) -> Iterator[list[list]]:
    """Python lists of the named columns, at most rows at a time, from Arrow record batches."""
    for batch in it:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield [part.column(c).to_pylist() for c in columns]
