"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _written(work: Scratch, edges: DataFrame) -> tuple[DataFrame, dict]:
    """edges (hi, lo) as a table, and what tells them from another set, summed while they are written."""
    return work.measured(edges, n=F.count(F.lit(1)), mix=F.bit_xor(F.xxhash64("hi", "lo")), total=F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31))))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (vertex, component): the smallest vertex that each vertex reaches.

    Null ends and loops are left out, repeated edges count once; no edges give no row. Every round holds at most as many
    edges as the last, whose table is deleted then, and a hub's edges are summed before they move.
    """
    work = Scratch(edges.sparkSession)
    stars, last = _written(
        work,
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
    )
    for _ in range(max_rounds):
        if not last["n"]:
            break
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(floor, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi != lo")
            .distinct()
        )
        before = stars
        stars, now = _written(work, small)
        work.drop(before)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.groupBy(F.col("hi").alias("vertex")).agg(F.min("lo").alias("component")).union(stars.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct())


def merged(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of linked (vertex, component) once edges (a, b) are added: only the components that edges touch are linked anew."""
    ends = edges
    for end in ("a", "b"):
        named = linked.select(F.col("vertex").alias(end), F.col("component").alias("_c"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    above = connected_components(ends.select("a", "b")).select(F.col("vertex").alias("component"), F.col("component").alias("_top"))
    old = linked.join(above, "component", "left").select("vertex", F.coalesce("_top", "component").alias("component"))
    new = above.select(F.col("component").alias("vertex"), F.col("_top").alias("component"))
    return old.unionByName(new).groupBy("vertex").agg(F.min("component").alias("component"))
