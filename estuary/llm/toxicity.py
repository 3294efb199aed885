"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are letter runs of the lower-cased text. One pass over all documents counts in how many each term occurs, and in how many of the labelled and
of the toxic ones. A term is indexed if it marks toxic texts beyond chance (log-likelihood ratio over all training labels) and more often than
not; its idf is that of all documents. What has none of these terms has no direction, and its score is the share of toxic examples among
those. The examples, a bounded sample (``EXAMPLES``, by the hash of the id), lie in an inverted index cut into blocks; each term keeps
its largest weight in each block. A block is opened only while its bound can still beat the k-th cosine found, so neighbours are exact.
Votes weigh by cosine; a prior of weight ``PRIOR`` pulls thin evidence to the base rate, and a logistic curve
fitted on each example's score without itself makes the votes calibrated probabilities.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, hash_sample, join_checked, small_batches, spelled_schema, table, text_or_empty

EXAMPLES, MOST_TERMS, NEIGHBOURS, BLOCK, PRIOR = 24_000, 20_000, 15, 64, 0.5
LEAST_RATIO, LEAST_SHARE, LEAST_DOCS = 15.0, 0.6, 4
HELD_TERMS = 60_000
WORD = re.compile(r"[^\W\d_]+")


def term_counts(text: str, known: dict[str, int] | None = None) -> Counter:
    found = WORD.findall(text.lower())
    return Counter(found if known is None else [w for w in found if w in known])


def _counter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents, labelled, toxic) of each task's texts, summed in pieces of at most HELD_TERMS terms. The three counts share one number."""
    seen: dict[str, int] = {}
    get, low = seen.get, (1 << 32) - 1

    def out() -> pa.RecordBatch:
        n = list(seen.values())
        counts = ([x & low for x in n], [x >> 32 & low for x in n], [x >> 64 for x in n])
        return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["term", "documents", "labelled", "toxic"])

    for batch in it:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            one = 1 + ((label is not None) << 32) + (bool(label) << 64)
            for term in set(WORD.findall(text.as_py().lower())):
                seen[term] = get(term, 0) + one
        if len(seen) > HELD_TERMS:
            yield out()
            seen.clear()
    if seen:
        yield out()


class Index:
    """Postings of examples by term, each term's in the order of blocks; the block maxima bound what a block can hold."""

    def __init__(self, terms: dict[str, int], idf: np.ndarray, counts: list[Counter], toxic: np.ndarray, ids: np.ndarray) -> None:
        self.terms, self.idf = terms, idf
        rows = [self.vector(c) for c in counts]
        kept = [i for i, (t, _) in enumerate(rows) if len(t)]
        none = np.ones(len(rows), bool)
        none[kept] = False
        self.silent = (toxic[none].sum() + 0.5) / (none.sum() + 1.0) if len(rows) else 0.5
        self.base = (toxic[kept].sum() + 0.5) / (len(kept) + 1.0)
        self.toxic, self.ids, self.n = toxic[kept].astype(float), ids[kept], len(kept)
        self.vectors = [rows[i] for i in kept]
        term = np.concatenate([t for t, _ in self.vectors]) if kept else np.array([], int)
        weight = np.concatenate([w for _, w in self.vectors]) if kept else np.array([])
        own = np.repeat(np.arange(self.n), [len(t) for t, _ in self.vectors])
        order = np.lexsort((own, term))
        term, self.weight, self.example = term[order], weight[order], own[order]
        # A run holds the postings of one term in one block: runs[first[t]:first[t + 1]] are those of term t, the postings of run r start[r]:start[r + 1].
        block = self.example // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.start, self.block = np.append(at, len(term)), block[at]
        self.largest = np.maximum.reduceat(self.weight, at) if len(at) else np.array([])
        self.first = np.searchsorted(term[at], np.arange(len(terms) + 1))
        self.blocks = -(-self.n // BLOCK)
        self.curve = (0.0, 1.0)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        by_id = {self.terms[w]: n for w, n in counts.items() if w in self.terms}
        if not by_id:
            return np.array([], int), np.array([])
        t = np.array(sorted(by_id))
        w = (1 + np.log([by_id[i] for i in t.tolist()])) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest positive cosine, ties to the earlier example."""
        runs = [(int(self.first[t]), int(self.first[t + 1]), float(w)) for t, w in zip(*vector, strict=True)]
        bounds = np.zeros(self.blocks)
        for a, z, w in runs:
            bounds[self.block[a:z]] += w * self.largest[a:z]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < -best[-1][0] - 1e-12):
                break
            sums = np.zeros(BLOCK)
            for a, z, w in runs:
                r = a + int(np.searchsorted(self.block[a:z], b))
                if r < z and self.block[r] == b:
                    held = slice(self.start[r], self.start[r + 1])
                    sums[self.example[held] - b * BLOCK] += w * self.weight[held]
            near = np.flatnonzero(sums > 0)
            best += [(-round(float(sums[i]), 12), b * BLOCK + int(i)) for i in near if b * BLOCK + i != without]
            best = sorted(best)[:k]
        return [(-s, i) for s, i in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        weight = sum(s for s, _ in near)
        return (sum(s * self.toxic[i] for s, i in near) + PRIOR * self.base) / (weight + PRIOR)

    def calibrate(self) -> None:
        """Newton's method for a logistic curve over the votes' log-odds, each example without itself."""
        if not self.n:
            return
        p = np.array([self.vote(self.nearest(v, without=i)) for i, v in enumerate(self.vectors)])
        x, y, (a, b) = _logit(p), self.toxic, (0.0, 1.0)
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
            g = np.array([(y - q).sum() - 0.1 * a, ((y - q) * x).sum() - 0.1 * (b - 1)])
            h = q * (1 - q)
            m = np.array([[h.sum() + 0.1, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 0.1]])
            step = np.linalg.solve(m, g)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-8:
                break
        if b > 0:
            self.curve = (float(a), float(b))

    def score(self, text: str) -> tuple[float, list[int]]:
        vector = self.vector(term_counts(text, self.terms))
        if not len(vector[0]) or not self.n:
            return float(self.silent), []
        near = self.nearest(vector)
        a, b = self.curve
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * float(_logit(np.array([self.vote(near)]))[0])))))), [int(self.ids[i]) for _, i in near[:5]]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, examples: int = EXAMPLES) -> Index:
    """An index over at most ``examples`` labelled rows outside held_fold; terms are chosen by all labels outside it, and idf counts all documents.

    labels (doc_id, toxic): of several labels of one document the largest counts; null ids and labels are left out, labels without a
    document too. A null text is an empty one. Of documents that repeat a labelled id all count for the terms, and the text of the least hash is the
    example. Without labels, or documents, nothing is indexed and every text scores a half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = labels.where((crc_fold(F.col("doc_id"), folds) != held_fold) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    marked = join_checked(texts, labelled, ["doc_id"], "left")
    n_all = docs.count()
    n, n1 = join_checked(texts.select("doc_id"), labelled, ["doc_id"], "inner").agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counted = marked.select("text", "toxic").mapInArrow(_counter, "term string, documents long, labelled long, toxic long")
    term = counted.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("labelled").alias("df"), F.sum("toxic").alias("k"))
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    df, k, share = F.col("df").cast("double"), F.col("k").cast("double"), max(n1, 1) / max(n, 1)
    ratio = 2 * (cell(k, df * share) + cell(df - k, df * (1 - share + 1e-12)) + cell(F.lit(float(n1)) - k, (F.lit(float(n)) - df) * share + 1e-12) + cell(F.lit(float(n - n1)) - (df - k), (F.lit(float(n)) - df) * (1 - share) + 1e-12))
    picked = term.where((F.col("df") >= LEAST_DOCS) & (k / df >= LEAST_SHARE)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(MOST_TERMS).collect()
    terms = {r["term"]: i for i, r in enumerate(picked)}
    idf = np.log((n_all + 1) / (np.array([r["documents"] for r in picked], float) + 0.5))
    chosen = hash_sample(labelled, F.col("doc_id"), examples).collect()
    small = spark.createDataFrame(pa.table({"doc_id": pa.array([r[0] for r in chosen], pa.int64()), "toxic": pa.array([r[1] for r in chosen], pa.int32())}))
    rows = texts.join(F.broadcast(small), "doc_id").mapInArrow(_counts_mapper(terms), "doc_id long, toxic int, h long, terms array<string>, counts array<int>")
    got = rows.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "terms", "counts"), "h").alias("r")).select("doc_id", "r.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    index = Index(terms, idf, [Counter(dict(zip(r["terms"], r["counts"], strict=True))) for r in got], np.array([r["toxic"] for r in got], float), np.array([r["doc_id"] for r in got], np.int64))
    index.calibrate()
    return index


def _counts_mapper(terms: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("text").to_pylist()
            each = [term_counts(t, terms) for t in texts]
            h = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) >> 1 for t in texts]
            cols = [pa.array(h, pa.int64()), pa.array([list(c) for c in each], pa.list_(pa.string())), pa.array([list(c.values()) for c in each], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *cols], names=["doc_id", "toxic", "h", "terms", "counts"])

    return run


def scorer(index: Index, spark: SparkSession, names: tuple[str, str] = ("toxicity", "evidence")) -> Callable[[DataFrame], DataFrame]:
    """Adds a score (double) and its evidence (ids of up to five nearest examples) to rows with a column text; all other columns stay, but for
    those of the two names, which are replaced. A null text is an empty one; repeated rows score alike; no row gives no row."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(pickle.dumps(index))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(held.value)
        for batch in it:
            each = [own.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in each], pa.float64()), pa.array([e for _, e in each], pa.list_(pa.int64()))], names=[*batch.schema.names, *names])

    def apply(rows: DataFrame) -> DataFrame:
        kept = rows.drop(*names).withColumn("text", F.col("text").cast("string"))
        return kept.mapInArrow(run, f"{spelled_schema(kept)}, {names[0]} double, {names[1]} array<bigint>")

    return apply


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is an empty one; a row with a null id is learned from by no fold, so it is held out, and scored like any other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scorer(fit(docs, table(spark, sf_dir, "labels")), spark)(docs)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "evidence")
