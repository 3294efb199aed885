"""Merkle fixity audit of WARC replicas.

A record is a page written as a WARC response record. Records are laid out in files of ``SLOTS`` consecutive page
ids; a record's slot is its place in that range, so that a lost record shifts no other leaf. A leaf hashes a
slot's bytes; a node hashes, in order, its children's slots, hashes and offset ranges, counted from its own start, and spans their range. What is
lost or cut thus changes the nodes above it, and none beside it, though all that follows in the file has moved. Files' roots are the leaves of
the tree above, which has levels until one root is left.

The audit compares the roots of two replicas and descends, level by level, into the children of nodes that differ
and nowhere else. Every group that is gathered holds at most ``FAN_OUT`` nodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

SLOTS, FAN_OUT = 1024, 16
CRLF = "\r\n"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """The record as text; its UTF-8 bytes are what a WARC file holds."""
    head = [F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(f">{CRLF}WARC-Target-URI: "), url]
    return F.concat(*head, F.lit(f"{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF), html, F.lit(CRLF + CRLF))


def parse(content: bytes) -> list[tuple[int, int, str, bytes]]:
    """(offset, length, record id, payload) of each record of a WARC file's bytes."""
    found, at = [], 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        head = content[at:end].decode()
        size = int(re.search(r"Content-Length: (\d+)", head)[1])
        found.append((at, end - at + size + 4, re.search(r"WARC-Record-ID: <(.*?)>", head)[1], content[end : end + size]))
        at = end + size + 4
    return found


def warc_files(pages: DataFrame) -> DataFrame:
    """(file_id, content binary): the files themselves, records in order. A file holds SLOTS ids."""
    rows = _cleaned(pages).select("file_id", "page_id", F.encode(record_bytes(F.col("page_id"), F.col("url"), F.col("html")), "UTF-8").alias("bytes"))
    order = F.array_sort(F.collect_list(F.struct("page_id", "bytes")))
    return rows.groupBy("file_id").agg(F.aggregate(order, F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"])).alias("content"))


def _cleaned(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), text_or_empty("url").alias("url"), text_or_empty("html").alias("html")).withColumn("file_id", F.floor(F.col("page_id") / F.lit(SLOTS)).cast("long"))


def leaves(pages: DataFrame) -> DataFrame:
    """(file_id, slot, page_id, offset, length, digest), one row for each page id that occurs.

    A null url or html is an empty one. Pages without an id make one leaf of a file without an id. Rows that share an id make one leaf: its
    digest is the record's own where there is one, else a Merkle root over all versions, each with the times it comes, by their hashes' first
    digits, so that no id is too frequent; its length is that of all its records. Further columns are left out; no pages give no leaf.
    """
    records = _cleaned(pages).withColumn("record", record_bytes(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), F.col("html")))
    versions = records.select("file_id", "page_id", F.sha2(F.col("record").cast("binary"), 256).alias("sha"), F.octet_length("record").cast("long").alias("bytes")).groupBy("file_id", "page_id", "sha", "bytes").agg(F.count("*").alias("copies"))
    spelled = lambda name, by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, name))), lambda x: F.concat_ws(":", x[by], x[name])), "|").cast("binary"), 256)
    first = versions.withColumn("times", F.col("copies").cast("string")).groupBy("file_id", "page_id", F.substring("sha", 1, 4).alias("head")).agg(
        F.sum(F.col("bytes") * F.col("copies")).alias("length"), F.min("sha").alias("least"), F.sum("copies").alias("n"), spelled("times", "sha").alias("hash")
    )
    ids = first.groupBy("file_id", "page_id").agg(F.sum("length").alias("length"), F.min("least").alias("least"), F.sum("n").alias("n"), spelled("hash", "head").alias("hash"))
    digest = F.when(F.col("n") == 1, F.col("least")).otherwise(F.col("hash"))
    before = W.partitionBy("file_id").orderBy("page_id").rowsBetween(W.unboundedPreceding, -1)
    slot = F.coalesce(F.pmod("page_id", F.lit(SLOTS)), F.lit(0)).cast("long")
    return ids.select("file_id", slot.alias("slot"), "page_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", digest.alias("digest"))


@dataclass
class Tree:
    """levels[0]: (file_id, node, hash, start, end, parts) of leaves; the last of levels: the files' roots; top: the levels above, up to one."""

    levels: list[DataFrame]
    top: list[DataFrame]


def _above(level: DataFrame, keys: list[str]) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "start", "end", "hash")))

    def spell(found: Column) -> Column:
        start = F.get(found, F.lit(0))["start"]
        return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["node"].cast("string"), (c["start"] - start).cast("string"), (c["end"] - start).cast("string"), c["hash"])), "|")

    spelled = F.get(F.transform(F.array(children), spell), F.lit(0))
    up = level.withColumn("up", F.floor(F.col("node") / FAN_OUT).cast("long")).groupBy(*keys, "up")
    return up.agg(F.sha2(spelled.cast("binary"), 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("parts").alias("parts")).withColumnRenamed("up", "node")


def tree(found: DataFrame, file_range: tuple[int, int]) -> Tree:
    """The tree over leaves; file_range: the least and the largest file of both replicas, so that their trees have one shape."""
    low, high = file_range
    levels = [found.select("file_id", F.col("slot").alias("node"), F.col("digest").alias("hash"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.lit(1).cast("long").alias("parts"))]
    width = SLOTS
    while width > 1:
        levels.append(cut(_above(levels[-1], ["file_id"])))
        width = -(-width // FAN_OUT)
    top = [levels[-1].select((F.col("file_id") - low).alias("node"), "hash", "start", "end", "parts")]
    width = high - low + 1
    while width > 1:
        top.append(cut(_above(top[-1], [])))
        width = -(-width // FAN_OUT)
    return Tree(levels, top)


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = a.select(*keys, F.col("hash").alias("hash_a")), b.select(*keys, F.col("hash").alias("hash_b"))
    return left.join(right, keys, "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(*keys)


def _below(level: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    return level.withColumn("up", F.floor(F.col("node") / FAN_OUT).cast("long")).join(bad.withColumnRenamed("node", "up"), [*keys, "up"], "left_semi").drop("up")


def mismatches(a: Tree, b: Tree, first_file: int) -> DataFrame:
    """(file_id, slot) of the leaves that differ, found from the roots down."""
    bad = _differing(a.top[-1], b.top[-1], ["node"])
    for x, y in zip(a.top[-2::-1], b.top[-2::-1], strict=True):
        bad = cut(_differing(_below(x, bad, []), _below(y, bad, []), ["node"]))
    bad = bad.select((F.col("node") + first_file).alias("file_id"), F.lit(0).cast("long").alias("node"))
    for x, y in zip(a.levels[-2::-1], b.levels[-2::-1], strict=True):
        bad = cut(_differing(_below(x, bad, ["file_id"]), _below(y, bad, ["file_id"]), ["file_id", "node"]))
    return bad.withColumnRenamed("node", "slot")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every leaf of either replica with its status: ok, changed, missing (not in replica) or extra (only there).

    Returns file_id, slot, page_id, offset, length, digest (of the primary; of the replica where extra), replica_digest and status. Pages without an
    id are one leaf whose file_id and page_id are null. Repeated rows count in their leaf's digest; further columns of either table
    are left out. Two empty tables give no row.
    """
    a, b = cut(leaves(primary)), cut(leaves(replica))
    low, high = a.select("file_id").union(b.select("file_id")).agg(F.min("file_id"), F.max("file_id")).first()
    nowhere = 0 if high is None else high + 1  # the file of pages without an id, beyond all others
    a, b = (x.withColumn("file_id", F.coalesce("file_id", F.lit(nowhere).cast("long"))) for x in (a, b))
    file_range = (nowhere if low is None else low, nowhere)
    keys = ["file_id", "slot"]
    if a.isEmpty() and b.isEmpty():
        bad = a.select(*keys)
    else:
        bad = mismatches(tree(a, file_range), tree(b, file_range), file_range[0])
    located = bad.join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("page_id", "offset", "length", "digest")]), keys, "left")
    joined = a.join(located.withColumn("_bad", F.lit(True)), keys, "full")
    status = F.when(F.col("_bad").isNull(), "ok").when(F.col("digest").isNull(), "extra").when(F.col("b_digest").isNull(), "missing").otherwise("changed")
    own = [F.coalesce(c, f"b_{c}").alias(c) for c in ("page_id", "offset", "length", "digest")]
    file_id = F.when(F.col("file_id") != nowhere, F.col("file_id")).alias("file_id")
    return joined.select(file_id, "slot", *own, F.when(F.col("_bad").isNull(), F.col("digest")).otherwise(F.col("b_digest")).alias("replica_digest"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica that decayed in a known way: by page_id mod 97, 5: the last character of html replaced, 6: lost, 7: cut to half."""
    kind, n = F.pmod(F.col("page_id"), F.lit(97)), F.char_length("html")
    hurt = F.when(kind == 5, F.concat(F.substring(F.col("html"), F.lit(1), n - 1), F.lit("\x01"))).when(kind == 7, F.substring(F.col("html"), F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.col("html"))
    return pages.where(F.coalesce(kind != 6, F.lit(True))).select("page_id", "url", hurt.alias("html"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica that decayed in a known way; see audit() for odd rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


OP9_SQL = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, page_id % 97 AS k FROM pages
), v AS (
  SELECT *, CASE k WHEN 5 THEN substring(html, 1, greatest(length(html) - 1, 0)) || chr(1) WHEN 7 THEN substring(html, 1, length(html) // 2) ELSE html END AS other FROM p
), r AS (
  SELECT page_id, k,
    'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || url || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS a,
    'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || url || e || 'Content-Length: ' || strlen(other) || e || e || other || e || e AS b
  FROM v, (SELECT chr(13) || chr(10) AS e)
)
SELECT page_id // 1024 AS file_id, page_id % 1024 AS slot, page_id,
  CAST(coalesce(sum(strlen(a)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(strlen(a) AS BIGINT) AS length, sha256(a) AS digest,
  CASE WHEN k = 6 THEN NULL ELSE sha256(b) END AS replica_digest,
  CASE WHEN k = 6 THEN 'missing' WHEN a = b THEN 'ok' ELSE 'changed' END AS status
FROM r
"""
