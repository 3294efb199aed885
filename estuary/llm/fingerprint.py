"""Document fingerprints by SimHash, in DataFrame functions alone.

Terms are adjacent word pairs (a single word where there is but one). A term's hash votes on every
bit with the term's weight: its length in code points, up to 16, once for each occurrence, so that
long and hence rare terms outweigh pairs of function words. 128 bits: two 64-bit hashes. The votes
of two bits share one long sum, 32 bits each, so 64 sums do the work of 128 inside generated code.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, join_checked, table, text_or_empty

LANES = 32
PAIR = (1 << 32) + 1
LOW = (1 << 32) - 1
WEIGHT_CAP = 16


def terms(text: Column) -> Column:
    """array<struct<h1, h2, w>>: one entry for each occurrence of each term; empty where there is no word."""
    words = F.filter(F.split(text, ASCII_SPACE), lambda w: w != "")

    def term(w: Column, after: Column) -> Column:
        weight = F.least(F.char_length(w) + F.coalesce(F.char_length(after), F.lit(0)), F.lit(WEIGHT_CAP)).cast("long")
        return F.struct(F.xxhash64(w, after).alias("h1"), F.xxhash64(after, w, F.lit(1)).alias("h2"), weight.alias("w"))

    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, after: F.when(after.isNotNull(), term(w, after)))
    return F.when(F.size(words) > 1, F.filter(pairs, lambda t: t.isNotNull())).otherwise(F.transform(words, lambda w: term(w, F.lit(None).cast("string"))))


def fold(df: DataFrame, keys: list[str], terms_column: str) -> DataFrame:
    """One row for each of keys with fp1, fp2: bit i is 1 where over half the weight voted for it. No terms: 0, 0."""
    votes = df.select(*keys, F.explode_outer(terms_column).alias("t")).select(*keys, F.col("t.h1").alias("h1"), F.col("t.h2").alias("h2"), F.col("t.w").alias("w"))
    sums = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(PAIR)) * F.col("w")).alias(f"{h}_{i}") for h in ("h1", "h2") for i in range(LANES)]
    counted = votes.groupBy(*keys).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("all"), *sums)

    def majority(h: str) -> Column:
        bits = F.lit(0).cast("long")
        for i in range(LANES):
            both = F.coalesce(F.col(f"{h}_{i}"), F.lit(0))
            low, high = both.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(both, 32)
            bits = bits.bitwiseOR(F.when(low * 2 > F.col("all"), F.lit(1 << i)).otherwise(F.lit(0)))
            top = (1 << (i + 32)) if i < 31 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(high * 2 > F.col("all"), F.lit(top)).otherwise(F.lit(0)))
        return bits

    return counted.select(*keys, majority("h1").alias("fp1"), majority("h2").alias("fp2"))


def fingerprint(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, fp1, fp2). keys must name one row each; a null text is an empty one, whose fingerprint is 0, 0."""
    return fold(docs.select(*keys, terms(text_or_empty(text)).alias("_terms")), keys, "_terms")


def hex128(fp1: Column, fp2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(fp1), 16, "0"), F.lpad(F.hex(fp2), 16, "0")))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """1 - (differing bits) / 128."""
    return F.lit(1.0) - (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))) / F.lit(128.0)


def permuted_tables(radius: int, blocks: int) -> list[tuple[int, int]]:
    """Masks over (fp1, fp2). Each table permutes the blocks that must agree to the front; its key is that prefix."""
    edges = [round(i * 128 / blocks) for i in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    whole = [sum(own[i] for i in front) for front in combinations(range(blocks), blocks - radius)]
    return [tuple(x - (1 << 64) if x >> 63 else x for x in (m & ((1 << 64) - 1), m >> 64)) for m in whole]


def close_classes(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(q1, q2, s1, s2, distance): all pairs of distinct fingerprints (fp1, fp2) of queries and of stored rows at most radius bits apart.

    Both sides are reduced to distinct fingerprints first, so copies meet once; each close pair is kept in the first table that both share. A null
    fingerprint is close to none.
    """
    masks = permuted_tables(radius, blocks)

    def keyed(df: DataFrame, side: str) -> DataFrame:
        own = df.select("fp1", "fp2").where("fp1 is not null and fp2 is not null").distinct()
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp1").bitwiseAND(F.lit(a)).alias("k1"), F.col("fp2").bitwiseAND(F.lit(b)).alias("k2")) for t, (a, b) in enumerate(masks)])
        return own.select(F.col("fp1").alias(f"{side}1"), F.col("fp2").alias(f"{side}2"), F.explode(keys).alias("k")).select(f"{side}1", f"{side}2", "k.t", "k.k1", "k.k2")

    bits = F.bit_count(F.col("q1").bitwiseXOR(F.col("s1"))) + F.bit_count(F.col("q2").bitwiseXOR(F.col("s2")))
    first = F.array_min(F.array(*[F.when((F.col("q1").bitwiseXOR(F.col("s1")).bitwiseAND(F.lit(a)) == 0) & (F.col("q2").bitwiseXOR(F.col("s2")).bitwiseAND(F.lit(b)) == 0), F.lit(t)) for t, (a, b) in enumerate(masks)]))
    return keyed(queries, "q").join(keyed(stored, "s"), ["t", "k1", "k2"]).withColumn("distance", bits).where((F.col("distance") <= radius) & (F.col("t") == first)).select("q1", "q2", "s1", "s2", "distance")


def find_within(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All (query_id, id, distance) with fingerprints at most radius bits apart; repeated rows come as often as they are.

    queries (query_id, fp1, fp2), stored (id, fp1, fp2), further columns are left out; null fingerprints find nothing and are found by none.
    """
    pairs = close_classes(queries, stored, radius, blocks)
    named = queries.select("query_id", F.col("fp1").alias("q1"), F.col("fp2").alias("q2")).join(pairs, ["q1", "q2"])
    return named.join(stored.select("id", F.col("fp1").alias("s1"), F.col("fp2").alias("s2")), ["s1", "s2"]).select("query_id", "id", "distance")


def counted_within(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fp1, fp2, n_within) for each distinct fingerprint of queries: how many stored rows lie within radius bits. Rows of one fingerprint are
    counted together before they meet, so no list of copies is made."""
    copies = stored.groupBy(F.col("fp1").alias("s1"), F.col("fp2").alias("s2")).agg(F.count("*").alias("copies"))
    return close_classes(queries, stored, radius, blocks).join(copies, ["s1", "s2"]).groupBy(F.col("q1").alias("fp1"), F.col("q2").alias("fp2")).agg(F.sum("copies").alias("n_within"))


def with_next(docs: DataFrame, bucket_rows: int = 512, max_buckets: int = 65_536) -> DataFrame:
    """Rows of docs (doc_id, text) ordered by doc_id within buckets of ids, each bucket closed by copies of the
    next one's first rows (the last by the first's), so that lead() finds every row's successor without a global sort.

    Adds bucket, copy (true for the closing rows) and place, the order within the bucket. Bucket limits
    are quantiles and thus ids that occur; an id's rows all lie in one bucket. Beyond bucket_rows * max_buckets rows
    buckets grow; they are sorted, on disk if need be, and read in order.
    """
    n = docs.agg(F.count("doc_id")).first()[0]
    parts = max(1, min(max_buckets, n // bucket_rows))
    at = F.percentile_approx("doc_id", F.from_json(F.lit(json.dumps([i / parts for i in range(parts)])), "array<double>"), F.lit(max(10_000, 4 * parts)))
    limits = sorted(set(docs.agg(at.alias("q")).first()["q"] or [])) or [0]
    held = F.from_json(F.lit(json.dumps(limits)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(limits).bit_length()))]
    known = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda pos, s: F.when(F.get(held, pos + s - 1) <= F.col("doc_id"), pos + s).otherwise(pos))
    own = (known - 1).alias("bucket")
    copies = F.when(F.get(held, F.col("bucket")) == F.col("doc_id"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = docs.where("doc_id is not null").select("doc_id", "text", own).select("doc_id", "text", "bucket", F.explode(copies).alias("copy"))
    return rows.withColumn("bucket", F.when(F.col("copy"), F.pmod(F.col("bucket") - 1, F.lit(len(limits)))).otherwise(F.col("bucket"))).withColumn("place", F.xxhash64("text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document (fp1 and fp2, and in hexadecimal), of its edited text and how like they are. An empty table gives no row.

    Edited: the last floor(n/2) code points replaced by the first as many (or all) of the next document by
    doc_id, ties by the text's hash; after the last comes the first. A row with a null doc_id stands in no order:
    it has no edited text (nulls there). A single document is its own next.
    """
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = W.partitionBy("bucket").orderBy("copy", "doc_id", "place")
    half = F.floor(F.char_length("text") / 2).cast("int")
    paired = (
        with_next(clean)
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("row", F.row_number().over(order))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.when(~F.col("copy"), F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))))
    )
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))
    keys = ["bucket", "row", "copy", "doc_id", "n_chars", "edited_sha256", "which"]
    voted = fold(
        paired.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
        .select("bucket", "row", "copy", "doc_id", "n_chars", "edited_sha256", F.explode(F.when(F.col("copy"), F.slice(texts, 1, 1)).otherwise(texts)).alias("v"))
        .select(*keys[:-1], F.col("v.which").alias("which"), terms(F.col("v.body")).alias("_terms")),
        keys,
        "_terms",
    )
    by_row = voted.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{name}{c[-1]}") for w, name in ((0, "f"), (1, "e")) for c in ("fp1", "fp2")])
    following = W.partitionBy("bucket").orderBy("row")
    joined = by_row.withColumn("n1", F.lead("f1").over(following)).withColumn("n2", F.lead("f2").over(following)).where(~F.col("copy"))
    placed = joined.select(
        "doc_id", "n_chars", "edited_sha256", F.col("f1").alias("fp1"), F.col("f2").alias("fp2"),
        hex128(F.col("f1"), F.col("f2")).alias("fingerprint"),
        hex128(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
        likeness(F.col("f1"), F.col("f2"), F.col("e1"), F.col("e2")).alias("near_edited"),
        likeness(F.col("f1"), F.col("f2"), F.col("n1"), F.col("n2")).alias("near_next"),
    )
    nowhere = clean.where("doc_id is null").withColumn("_row", F.monotonically_increasing_id()).withColumn("n_chars", F.char_length("text").cast("long"))
    lone = fingerprint(nowhere, ["_row", "doc_id", "n_chars"])
    none = F.lit(None)
    return placed.unionByName(
        lone.select("doc_id", "n_chars", none.cast("string").alias("edited_sha256"), "fp1", "fp2", hex128(F.col("fp1"), F.col("fp2")).alias("fingerprint"), none.cast("string").alias("edited_fingerprint"), none.cast("double").alias("near_edited"), none.cast("double").alias("near_next"))
    )


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprints and likenesses; for those whose doc_id is divisible by 100 also n_within, how many other documents have a
    fingerprint within three bits, found by the permuted tables (null for others). See edited_fingerprints() for odd rows."""
    made = Scratch(spark).keep(edited_fingerprints(table(spark, sf_dir, "documents")))
    asks = F.col("doc_id") % 100 == 0
    counts = counted_within(made.where(asks), made)
    found = join_checked(made, counts, ["fp1", "fp2"], "left")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.when(asks, F.col("n_within") - 1).alias("n_within"))
