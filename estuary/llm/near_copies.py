"""One document of each group of near copies: SimHash links first, exact similarity for every link, and no pair left out.

Two documents are near copies if the sets of their ``words``-word shingles have a Jaccard similarity of ``similarity`` or more. Documents of
equal sets are one class from the start. Classes are linked in two steps.

First, SimHash near-dedup over the shingle sets (pigeonhole blocks, Hamming distance, see simhash_dedup) proposes links, and so does a
prefix filter: of two similar sets, each has a shingle of the other's among its first fifth, whatever order all sets use, so classes are keyed
by those, the rarest first; in each key a class meets the first class and the one before it. What is proposed is verified exactly, and
components are formed. In a few rounds, each class then meets one bounded block of each of its keys and proposes the member of another component
that is nearest by bitmap, so that large groups are whole before any pairs of them are listed.

Then what is still apart is completed: in each key, members of different components meet, in blocks, so that no task holds a crowded key.
Fingerprints of fifteen differing bits in a hundred, which similarity 0.8 allows, are beyond any number of blocks; hence the prefix keys. A pair is
ruled out where its key's places in both sets leave too few shingles after it, and is held against parity bitmaps: each bit is the parity of the
shingles that fall on it, so two sets differ in at least as many shingles as their bitmaps in bits, however long they are. What the bitmaps part is
proven to be unlike, and only the rest moves its shingles. In a key all bitmaps have NARROW bits; after it, at least one for each shingle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_checked, small_batches, spread_join, text_or_empty
from .graph import connected_components, merged
from .simhash_dedup import links, majority, voted

#: Texts whose shingles order the others' (any order finds the same pairs), shingles that are remembered, and how often a frequent one is met there.
SAMPLE, COMMON, FREQUENT = 16_000, 200_000, 16
#: Bits of the bitmaps that a pair is held against in a key; members of a key that a task compares with as many others.
NARROW, BLOCK = 1024, 512
#: Rounds in which classes propose links to other components, the members of a key that each meets in a round, and how many that it was tried
#: with before it passes over.
ROUNDS, MET, TRIED = 2, 64, 16
REMEMBERED = 1 << 16


class _Hashes(dict):
    """The hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = found
        return found


_hashes = _Hashes()


def shingles_of(text: bytes, words: int) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes, A-Z lower-cased; a text of fewer words is one shingle, one of none too."""
    w = text.lower().split()
    if not w:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    m, x = len(w) - n + 1, np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        x = (x ^ h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles on each of NARROW bits, or of the power of two that is no less than their number, as longs."""
    width = max(NARROW, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles >> np.uint64(7)).astype(np.int64) % width, minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def narrowed(bits: np.ndarray) -> np.ndarray:
    """The bitmap of NARROW bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, NARROW // 64), axis=0)


def _rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h tells texts of one id apart."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; how often) of the most frequent shingles that two or more of about SAMPLE texts hold."""
    spread, n = 1 << 30, rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("h", "doc_id"), F.lit(spread)) < F.lit(min(spread, math.ceil(SAMPLE / max(n, 1) * spread))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles_of(text.as_py(), words).view(np.int64))], names=["s"])

    counted = chosen.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    got = counted.orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    s, times = got.column("s").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(s.view(np.uint64))
    return s.view(np.uint64)[order], times[order]


def prefix_of(shingles: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, so many that no set of that similarity can miss them all: rare ones by hash, then common ones, the rarest
    first. Beside each, whether it is frequent."""
    size = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    known, times = common
    if not len(known):
        return shingles[:size], np.zeros(size, bool)
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    often = np.where(known[at] == shingles, times[at], 0)
    first = np.lexsort((shingles, often))[:size]
    return shingles[first], often[first] >= FREQUENT


SKETCH = "doc_id long, h long, n int, d1 long, d2 long, fp long, bits array<bigint>, narrow array<bigint>, rare array<bigint>, frequent array<bigint>"


def _sketcher(words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in SKETCH.split(", ")]

    def one(text: bytes) -> tuple:
        s = shingles_of(text, words)
        digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
        first, often = prefix_of(s, similarity, common)
        fp = np.uint64(voted(majority(s), len(s))).view(np.int64)
        bits = bitmap(s)
        return len(s), digest[0], digest[1], fp, bits, narrowed(bits), first[~often].view(np.int64), first[often].view(np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                cols = list(zip(*(one(t.as_py()) for t in part.column("text")), strict=True))
                types = [pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 4]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)
        _hashes.clear()

    return run


def _apart_by(x: str, y: str) -> Column:
    """In how many bits two bitmaps of NARROW bits differ."""
    differ = F.lit(0)
    for i in range(NARROW // 64):
        differ = differ + F.bit_count(F.get(F.col(x), F.lit(i)).bitwiseXOR(F.get(F.col(y), F.lit(i))))
    return differ


def _wide_apart_by(x: str, y: str) -> Column:
    """In how many bits two bitmaps differ whose sets are close in size; the wider one is folded to the other's width, which is no less than its half."""

    def fitted(one: Column, other: Column) -> Column:
        half = (F.size(one) / 2).cast("int")
        return F.when(F.size(one) > F.size(other), F.zip_with(F.slice(one, F.lit(1), half), F.slice(one, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(one)

    bits = F.zip_with(fitted(F.col(x), F.col(y)), fitted(F.col(y), F.col(x)), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def _few(differ: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles that differ in so many can be similar."""
    return differ <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _sized(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6


class _Verifier:
    """Exact similarity of proposed pairs of classes."""

    def __init__(self, docs: DataFrame, members: DataFrame, attributes: DataFrame, words: int, similarity: float, work: Scratch) -> None:
        self.docs, self.members, self.attributes, self.words, self.similarity, self.work = docs, members, attributes, words, similarity, work

    def _sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of the classes ids (id); a class may come once for each task that meets its text."""
        keys = self.work.keep(self.members.where("row = rep").join(ids, F.col("row") == F.col("id"), "left_semi").select(F.col("row").alias("id"), F.col("doc_id").alias("_d"), F.col("h").alias("_h")))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
        texts = join_checked(_rows_of(self.docs), keys, same, "inner").select("id", "text")
        words = self.words

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in it:
                ids, out = [], []
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                    if i not in seen:
                        seen.add(i)
                        ids.append(i)
                        out.append(shingles_of(text.as_py(), words).view(np.int64))
                        if len(out) == 128:
                            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "shingles"])
                            ids, out = [], []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "shingles"])

        found = self.work.keep(texts.mapInArrow(run, "id long, shingles array<bigint>"))
        self.work.drop(keys)
        return found

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and bitmaps do not rule out, as a table."""
        own = lambda end: self.attributes.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
        n, m = F.col("n_a"), F.col("n_b")
        both = pairs.join(own("a"), "a").join(own("b"), "b")
        return self.work.keep(both.where(_sized(n, m, self.similarity) & _few(_wide_apart_by("bits_a", "bits_b"), n, m, self.similarity)).select(*pairs.columns))

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets have a Jaccard similarity of at least ``similarity``, as a table (a, b)."""
        sets = self._sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        found = self.work.keep(both.where(common >= self.similarity * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b"))
        self.work.drop(sets)
        return found


def proposed(attributes: DataFrame, keyed: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, to begin with; whatever they miss is completed later.

    SimHash near-dedup links fingerprints of at most two differing bits; classes of one fingerprint are linked to the first. In each key, a class
    is proposed to the smallest and to the one before it, and of all keys' proposals it keeps those that come most often.
    """
    prints = attributes.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    total = attributes.count()
    same = spread_join(attributes.select("id", "fp"), prints.where("copies > 1"), ["fp"], "copies", total).where("rep is not null and rep != id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    out = same.union(links(prints.select("fp", "rep")).select("a", "b"))
    order = W.partitionBy("k", "salt").orderBy("n", "id")
    met = keyed.withColumn("first", F.first(F.struct("n", "id")).over(order)).withColumn("last", F.lag(F.struct("n", "id")).over(order))
    for other in (F.col("first"), F.col("last")):
        pairs = met.where(other.isNotNull() & (other["id"] != F.col("id")) & (other["n"] > 0)).groupBy(F.col("id").alias("b"), other["id"].alias("a")).agg(F.count("*").alias("times"))
        out = out.union(pairs.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _enough(similarity: float) -> Column:
    """Whether the members x and y of a key can be similar if it is the first that they share: the rest of either, from its place on, holds all others."""
    n, m = F.col("x.n"), F.col("y.n")
    return F.least(n - F.col("x.at"), m - F.col("y.at")) >= (n + m) * (similarity / (1 + similarity)) - 1e-6


def _open(keyed: DataFrame, linked: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of keyed with their component c, where a key's members lie in several, as a table; and (k, main, m, kinds) of every frequent or crowded
    key: the largest component, the members and the components."""
    rows = keyed.join(linked.select(F.col("vertex").alias("id"), "component"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    key = W.partitionBy("k", "salt")
    rows = rows.withColumn("m", F.count("*").over(key)).withColumn("lo", F.min("c").over(key)).withColumn("hi", F.max("c").over(key))
    found = work.keep(rows.where("frequent or lo < hi").drop("salt", "lo", "hi"))
    large = found.where(f"frequent or m > {BLOCK}")
    counts = large.groupBy("k", "c").agg(F.count("*").alias("of")).groupBy("k").agg(F.sum("of").alias("m"), F.max_by("c", F.struct("of", "c")).alias("main"), F.count("*").alias("kinds"))
    return found, work.keep(counts.where("kinds > 1"))


NEAR = "id long, a long, b long, far double"


def _nearest(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (k, block, id, n, c, seeks, tried, narrow), those of one k and block together -> NEAR: for each row that seeks, the nearest by bitmap of those
    beside it that lie in another component, are not tried and may be similar. Rows are compared with those 1, 2, ... places on while any has the same block."""

    def nearest(rows: pa.RecordBatch) -> pa.RecordBatch:
        k, block, ids, n, c, seeks = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("k", "block", "id", "n", "c", "seeks"))
        bits = rows.column("narrow").flatten().to_numpy().view(np.uint64).reshape(len(ids), NARROW // 64)
        total, ends, step, i = n.astype(np.int64), [], 0, np.arange(len(ids))
        tried = [set(t or ()) for t in rows.column("tried").to_pylist()]
        while len(i):
            step += 1
            i = i[i + step < len(ids)]
            i = i[(k[i] == k[i + step]) & (block[i] == block[i + step])]
            x, y = i, i + step
            open_ = (c[x] != c[y]) & (seeks[x] | seeks[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6)
            x, y = x[open_], y[open_]
            both, differ = total[x] + total[y], np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            few = differ <= both * ((1 - similarity) / (1 + similarity)) + 1e-6
            x, y, far = x[few], y[few], (differ / both)[few]
            ends += [(x[seeks[x]], y[seeks[x]], far[seeks[x]]), (y[seeks[y]], x[seeks[y]], far[seeks[y]])]
        x, y, far = (np.concatenate(e) for e in zip(*ends, strict=True))
        order = np.lexsort((ids[y], far, x))
        x, y, far = x[order], y[order], far[order]
        new = np.fromiter((b not in tried[a] for a, b in zip(x.tolist(), ids[y].tolist(), strict=True)), bool, len(x))
        x, y, far = x[new], y[new], far[new]
        first = np.searchsorted(x, np.unique(x))
        x, y, far = ids[x[first]], ids[y[first]], far[first]
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(far)], names=[e.split()[0] for e in NEAR.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            k, block = rows.column("k").to_numpy(), rows.column("block").to_numpy()
            # The last block may go on in the next batch.
            whole = int(np.argmax((k == k[-1]) & (block == block[-1])))
            if whole:
                yield nearest(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None:
            yield nearest(held)

    return run


def nearest_apart(keyed: DataFrame, attributes: DataFrame, linked: DataFrame, tried: DataFrame | None, seed: int, similarity: float, work: Scratch) -> DataFrame:
    """(a, b), a < b: for each class the nearest by bitmap, of another component, among those that it meets: about MET members of each of its keys. tried are
    pairs that are known to be unlike. In a frequent or crowded key, the members of the largest component propose nothing.

    Classes that are much alike share hundreds of keys, so the pairs that meet are not listed: where a block of a key lies together, each class gives
    its nearest alone, which makes no more rows than keyed has.
    """
    rows, crowded = _open(keyed, linked, work)
    narrow = ["k", "id", "n", "c", "m", "main"]
    small = rows.where(f"not frequent and m <= {BLOCK}").withColumn("main", F.lit(None).cast("long")).select(*narrow)
    large = join_checked(rows.where(f"frequent or m > {BLOCK}").drop("m"), crowded, ["k"], "inner").select(*narrow)
    block = F.pmod(F.xxhash64("k", "id", F.lit(seed)), F.ceil(F.col("m") / MET)).cast("int").alias("block")
    members = small.union(large).join(attributes.select("id", "narrow"), "id").select("k", block, "id", "n", "c", (F.col("main").isNull() | (F.col("c") != F.col("main"))).alias("seeks"), "narrow")
    if tried is None:
        members = members.withColumn("tried", F.lit(None).cast("array<bigint>"))
    else:
        both = tried.select(F.col("a").alias("id"), F.col("b").alias("other")).union(tried.select("b", "a"))
        members = members.join(both.groupBy("id").agg(F.slice(F.collect_set("other"), 1, TRIED).alias("tried")), "id", "left")
    together = members.repartition("k", "block").sortWithinPartitions("k", "block")
    pairs = together.mapInArrow(_nearest(similarity), NEAR).groupBy("id").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    found = work.keep(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
    work.drop(rows, crowded)
    return found


def apart(keyed: DataFrame, attributes: DataFrame, linked: DataFrame, similarity: float, work: Scratch) -> DataFrame:
    """(a, b, ca, cb), a < b: all pairs that share a key, lie in different components ca and cb and that places and bitmaps do not rule out.

    keyed: (k, id, n, at, salt, frequent, earlier); at is the key's place in the class's set, in the order that all classes share, and earlier are
    its frequent keys before k. A key of up to BLOCK members is compared in one task. In a larger one, members outside the key's largest component go to every block of the
    key and meet the block's members; the largest component, which holds nearly all where many copies of one text meet, is never paired with itself.
    """
    rows, crowded = _open(keyed, linked, work)
    own = attributes.select("id", "narrow")
    small = work.keep(rows.where(f"not frequent and m <= {BLOCK}").select("k", "id", "n", "c", "at").join(own, "id"))
    blocks = crowded.select("k", "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    placed = work.keep(join_checked(rows.where(f"frequent or m > {BLOCK}").select("k", "id", "n", "c", "at", "earlier"), blocks, ["k"], "inner").join(own, "id"))
    others = placed.where("c != main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x, y = small.alias("x"), small.alias("y")
    u, v = others.alias("x"), members.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    fits = (F.col("x.c") != F.col("y.c")) & _sized(n, m, similarity) & _enough(similarity) & _few(_apart_by("x.narrow", "y.narrow"), n, m, similarity)
    once = F.col("x.id") < F.col("y.id")
    ends = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.least("x.c", "y.c").alias("ca"), F.greatest("x.c", "y.c").alias("cb")]
    few = x.join(y, (F.col("x.k") == F.col("y.k")) & once & fits).select(*ends)
    # Texts that are much alike share many frequent keys: a pair is given by the first of them alone.
    first = ~F.arrays_overlap("x.earlier", "y.earlier")
    many = u.join(v, (F.col("x.k") == F.col("y.k")) & (F.col("x.block") == F.col("y.block")) & (once | (F.col("y.c") == F.col("y.main"))) & fits & first).select(*ends)
    found = work.keep(few.union(many).distinct())
    work.drop(rows, crowded, small, placed)
    return found


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one document of each group of near copies: of a group the row with the smallest doc_id stays, of equal ids
    the one whose text has the smaller hash, of equal rows any one. Rows without an id come after all others.

    Two documents are near copies if the sets of their ``words``-word shingles have a Jaccard similarity of ``similarity`` or more, which holds or
    not for every pair, exactly; a group is what such pairs connect. A null text is an empty one; all texts without a word are copies. Rows that share
    an id but hold different texts are different documents. All columns stay as they are, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession)
    rows = _rows_of(docs)
    common = common_shingles(rows, words)
    sketch = work.keep(rows.mapInArrow(_sketcher(words, similarity, common), SKETCH).withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "row")
    classes = work.keep(sketch.groupBy("d1", "d2").agg(F.min(rank).alias("least"), F.count("*").alias("copies")).select("d1", "d2", F.col("least.row").alias("rep"), "copies"))
    total = sketch.count()
    members = work.keep(spread_join(sketch.select("row", "doc_id", "h", "d1", "d2"), classes, ["d1", "d2"], "copies", total).select("row", "doc_id", "h", "rep"))
    copies = members.where("row != rep").select("row")
    base = join_checked(sketch, copies, ["row"], "left_anti").withColumnRenamed("row", "id")
    attributes = work.keep(base.select("id", "n", "fp", "bits", "narrow"))
    none = F.array().cast("array<bigint>")
    rare = base.select("id", "n", F.posexplode("rare").alias("at", "k")).withColumn("m", F.count("*").over(W.partitionBy("k"))).where("m > 1")
    rare = rare.select("k", "id", "n", "at", F.lit(0).alias("salt"), F.lit(False).alias("frequent"), none.alias("earlier"))
    often = base.select("id", "n", F.size("rare").alias("before"), "frequent", F.posexplode("frequent").alias("i", "k"))
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, total // (64 * BLOCK)))).cast("int")
    often = often.select("k", "id", "n", (F.col("before") + F.col("i")).alias("at"), salt.alias("salt"), F.lit(True).alias("frequent"), F.slice("frequent", F.lit(1), F.col("i")).alias("earlier"))
    keyed = work.keep(rare.union(often))
    work.drop(sketch, classes)

    verifier = _Verifier(docs, members, attributes, words, similarity, work)
    first = verifier.possible(proposed(attributes, keyed))
    edges = verifier.alike(first)
    linked = work.keep(connected_components(edges))
    unlike = None
    for seed in range(ROUNDS):
        near = nearest_apart(keyed, attributes, linked, unlike, seed, similarity, work)
        possible = verifier.possible(near)
        found = verifier.alike(possible)
        before, linked = linked, work.keep(merged(linked, found))
        failed = near.join(found, ["a", "b"], "left_anti")
        unlike = work.keep(failed if unlike is None else failed.union(unlike))
        work.drop(near, possible, found, before)
    rest = apart(keyed, attributes, linked, similarity, work)
    left = verifier.possible(rest.join(unlike, ["a", "b"], "left_anti"))
    work.drop(first, rest, keyed, unlike)
    best = work.keep(left.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))
    more = verifier.alike(best)
    linked = work.keep(merged(linked, more))
    for end in ("a", "b"):
        left = left.join(linked.select(F.col("vertex").alias(end), F.col("component").alias(f"now_{end}")), end, "left")
    open_still = work.keep(left.where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).select("a", "b").join(best, ["a", "b"], "left_anti"))
    last = verifier.alike(open_still)
    linked = work.keep(merged(linked, last))

    reps = members.where("row = rep").join(linked, F.col("rep") == F.col("vertex"))
    winners = reps.groupBy("component").agg(F.min(rank).alias("least")).select(F.col("least.row").alias("winner"))
    beaten = reps.join(winners, F.col("row") == F.col("winner"), "left_anti").select("row", "doc_id", "h")
    d, h = fresh(docs.columns, "_doc"), fresh(docs.columns, "_hash")
    extra = members.where("row != rep").select(F.col("rep").alias("of"), "doc_id", "h")
    own = members.where("row = rep").select(F.col("row").alias("of"), F.col("doc_id").alias("own_id"), F.col("h").alias("own_h"))
    # A copy that repeats its class's row in full has that row's key: it goes by counting, all other copies by their key.
    judged = extra.join(own, "of").withColumn("again", F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h")))
    keys = lambda df: df.select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    gone = work.keep(keys(judged.where("not again").select("doc_id", "h").union(beaten.select("doc_id", "h"))))
    again = work.keep(keys(judged.where("again")))
    work.drop(attributes, edges, left, best, more, open_still, last, linked, members)

    here = docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text_or_empty()) == F.col(h))
    kept = join_checked(docs, gone, here, "left_anti")
    if not again.count():
        return kept
    once = join_checked(kept, again, here, "left_semi").withColumn(h, F.xxhash64(text_or_empty()))
    first = once.groupBy("doc_id", h).agg(F.first(F.struct(*[once[c] for c in docs.columns])).alias(d)).select(f"{d}.*")
    return join_checked(kept, again, here, "left_anti").unionByName(first)
