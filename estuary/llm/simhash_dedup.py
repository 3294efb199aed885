"""SimHash near-dedup: fingerprints, pigeonhole blocks, exact Hamming verification and components.

Split a fingerprint into more blocks than bits may differ: two close fingerprints then agree on
at least ``blocks - radius`` whole blocks. Each choice of that many blocks is a table; fingerprints
that share a table's key are compared. Equal fingerprints are one class from the start, so copies are
never paired with each other.

A key shared by more than ``small`` classes is not paired at all. Its classes emit themselves and
every fingerprint one bit away. Two fingerprints within two bits share such a midpoint, and all that
share one lie within two bits of each other, so a star over each midpoint (65 members at most) links
exactly what pairs would. This is exact for radius 2 and linear in the classes of a crowded key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, small_batches, spread_join, table
from .graph import connected_components

CHUNK = 1 << 15


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, the lowest first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def voted(counts: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are those that over half of n hashes have."""
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def simhash(text: bytes, words: int = 3) -> int:
    """64 majority bits over XXH64 (seed 42) of the word shingles, repeats included; no words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(w) - words + 1)
    for at in range(0, n, CHUNK):
        part = w[at : at + CHUNK + words - 1]
        m = max(1, len(part) - words + 1)
        shingles = map(b" ".join, zip(*(part[i : i + m] for i in range(words)), strict=True)) if len(part) >= words else [b" ".join(part)]
        total += majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, m))
    return voted(total, n)


def _mapper(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([simhash(t.as_py() or b"", words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; the whole text counts, a null text is an empty one. An empty table gives no row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_mapper(words), "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def table_masks(radius: int, blocks: int) -> list[int]:
    """One mask for every choice of blocks - radius blocks of 64 bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [signed(sum(own[i] for i in kept)) for kept in combinations(range(blocks), blocks - radius)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(classes: DataFrame, radius: int = 2, blocks: int = 4, small: int = 48) -> DataFrame:
    """classes (fp, rep; fp unique) -> edges (a, b) between reps that connect exactly what pairs within the radius would."""
    if radius > 2:
        raise ValueError("midpoint stars are exact up to two bits")
    keyed = classes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(table_masks(radius, blocks))])).alias("b")).select("fp", "rep", "b.t", "b.k")
    crowds = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    work = Scratch(classes.sparkSession)
    shared = work.keep(keyed.join(crowds, ["t", "k"]))
    few = shared.where(F.col("n") <= small)
    a, b = few.alias("a"), few.alias("b")
    near = (
        a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")))
        .where(distance(F.col("a.fp"), F.col("b.fp")) <= radius)
        .select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    )
    crowded = shared.where(F.col("n") > small).select("fp", "rep").distinct()
    if radius < 2:
        steps = [signed(1 << i) for i in range(64)] if radius else []
        moved = crowded.select(F.col("rep").alias("b"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in steps]) if steps else F.expr("array(cast(null as bigint))")).alias("fp"))
        return near.union(moved.join(crowded, "fp").select(F.col("rep").alias("a"), "b"))
    reach = [0, *(signed(1 << i) for i in range(64))]
    stars = (
        crowded.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in reach])).alias("middle"))
        .groupBy("middle")
        .agg(F.min("rep").alias("a"), F.collect_list("rep").alias("all"))
        .where(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .where("a != b")
    )
    return near.union(stars)


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of at most radius differing bits, the
    document itself included. Null texts are empty, empty texts have fingerprint zero and link like any
    other; repeated rows come back as often as they came; a null doc_id gets the component of its
    fingerprint (null if no row with an id reaches it). Further columns of docs are ignored.
    """
    fps = cut(fingerprints(docs, words))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    total = classes.agg(F.sum("copies")).first()[0] or 0
    found = connected_components(links(classes.where("rep is not null").select("fp", "rep"), radius, blocks))
    named = classes.join(found, classes["rep"] == found["vertex"], "left").select("fp", "copies", F.coalesce("component", "rep").alias("component_id"))
    return spread_join(fps, named, ["fp"], "copies", total).select("doc_id", "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
