"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, that scores whole texts.

Counts of all training tokens come first. The model's outcomes are the ``model_words`` most frequent words, the
end, and classes by their first two bytes for all other words: the score of w after (u, v) is
(r_u A + r_v B) . q_w + b_w. Every task
trains on the counted trigrams of its own documents from one common start, noise drawn from the unigram
distribution and shared by a batch; the tasks' parameters are averaged by their tokens, group by group.

exp of the score is a product of a factor in (u, w) and one in (v, w), so the normalisers of all contexts are one
matrix product, and a token's normalised log-probability is three look-ups. A word of a class has that class's
probability times its add-one share of the class, in which one more outcome stands for all unseen words.

Counts of the ``held_words`` most frequent words (a bound in rows and, as long words are replaced by a digest,
in bytes) travel with the model; the rest are joined by word. No such word is frequent, so no key is hot.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, cut, small_batches, table, text_or_empty

CLASSES, MODEL_WORDS, HELD_WORDS, DIM = 256, 767, 1 << 18, 16
BATCH, NOISE, RATE, BUFFER = 512, 64, 0.1, 1 << 20
LONGEST, FAN_IN = 48, 64
END = CLASSES


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space; one of over LONGEST bytes stands as a digest, which no word equals as it holds a space."""
    words = text.lower().split()
    if len(text) > LONGEST and any(len(w) > LONGEST for w in words):
        words = [w if len(w) <= LONGEST else b" " + hashlib.sha256(w).digest() for w in words]
    return words


def class_of(word: bytes) -> int:
    return zlib.crc32(word[:2]) % CLASSES


class _Ids(dict):
    """Outcome of each word; a word that is not the model's own is an outcome by its class."""

    def __missing__(self, word: bytes) -> int:
        return class_of(word)


def _counter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    seen: Counter = Counter()
    for batch in it:
        for text in batch.column("text"):
            seen.update(words_of(text.as_py()))
            if len(seen) > 400_000:
                yield out(seen)
                seen = Counter()
    if seen:
        yield out(seen)


class Parameters:
    def __init__(self, bias: np.ndarray, dim: int) -> None:
        rng = np.random.default_rng(7)
        n = len(bias)
        self.r = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        self.a, self.b = (np.eye(dim, dtype=np.float32) * x for x in (0.5, 1.0))
        self.bias = bias.astype(np.float32)

    NAMES = ("r", "q", "a", "b", "bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Parameters:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self


class Trainer:
    """NCE with AdaGrad over counted (u, v, w) events."""

    def __init__(self, start: Parameters, unigram: np.ndarray, seed: int) -> None:
        self.p, self.rng = start, np.random.default_rng(seed)
        self.noise_log = np.log(NOISE * unigram).astype(np.float32)
        self.cumulative = np.cumsum(unigram)
        self.squares = {n: np.full_like(getattr(start, n), 1e-3) for n in Parameters.NAMES}
        self.size = len(unigram)

    def _step(self, name: str, gradient: np.ndarray) -> None:
        s = self.squares[name]
        s += gradient * gradient
        getattr(self.p, name)[...] += RATE * gradient / np.sqrt(s)

    def _gather(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, weights=rows[:, d], minlength=self.size) for d in range(rows.shape[1])], axis=1).astype(np.float32)

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, weight: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        for at in range(0, len(w), BATCH):
            pick = order[at : at + BATCH]
            self._batch(u[pick], v[pick], w[pick], weight[pick])

    def _batch(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, weight: np.ndarray) -> None:
        p = self.p
        ru, rv, qw = p.r[u], p.r[v], p.q[w]
        hat = ru @ p.a + rv @ p.b
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), self.size - 1)
        true = (hat * qw).sum(axis=1) + p.bias[w] - self.noise_log[w]
        false = hat @ p.q[noise].T + p.bias[noise] - self.noise_log[noise]
        scale = (weight / weight.sum()).astype(np.float32) * np.float32(min(len(w), 512))
        g = scale / (1 + np.exp(np.clip(true, -30, 30)))
        f = -scale[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
        d_hat = g[:, None] * qw + f @ p.q[noise]
        d_q = self._gather(np.concatenate([w, noise]), np.concatenate([g[:, None] * hat, f.T @ hat]))
        d_bias = np.bincount(w, weights=g, minlength=self.size) + np.bincount(noise, weights=f.sum(axis=0), minlength=self.size)
        d_r = self._gather(np.concatenate([u, v]), np.concatenate([d_hat @ p.a.T, d_hat @ p.b.T]))
        d_a, d_b = ru.T @ d_hat, rv.T @ d_hat
        for name, gradient in (("q", d_q), ("bias", d_bias.astype(np.float32)), ("r", d_r), ("a", d_a), ("b", d_b)):
            self._step(name, gradient)


def _contexts(ids: list[int]) -> tuple[list[int], list[int]]:
    return [END, END, *ids[:-2]][: len(ids)], [END, *ids[:-1]]


def _trainer(start: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unigram, parameters = pickle.loads(start)
        known = _Ids(own)
        part = TaskContext.get().partitionId()
        trainer, size, tokens = Trainer(parameters, unigram, 1000 + part), len(unigram), 0
        held: list[np.ndarray] = []

        def learn() -> None:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            trainer.learn(codes // (size * size), codes // size % size, codes % size, n)

        waiting = 0
        for batch in it:
            for text in batch.column("text"):
                ids = list(map(known.__getitem__, words_of(text.as_py())))
                ids.append(END)
                u, v = _contexts(ids)
                held.append((np.array(u, np.int64) * size + np.array(v, np.int64)) * size + np.array(ids, np.int64))
                waiting += len(ids)
                tokens += len(ids)
                if waiting >= BUFFER:
                    learn()
                    waiting = 0
        if held:
            learn()
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([trainer.p.flat().astype("<f4").tobytes()], pa.binary())], names=["part", "tokens", "flat"])

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    total, flat = int(pdf["tokens"].sum()), 0.0
    for tokens, raw in zip(pdf["tokens"], pdf["flat"], strict=True):
        flat = flat + np.frombuffer(raw, "<f4").astype(np.float64) * (tokens / total)
    return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN_IN], "tokens": [total], "flat": [flat.astype("<f4").tobytes()]})


class Tables:
    """Log-factors and log-normalisers of every context, from a model's parameters."""

    def __init__(self, p: Parameters) -> None:
        self.first, self.second = (p.r @ p.a) @ p.q.T, (p.r @ p.b) @ p.q.T + p.bias
        m1, m2 = self.first.max(axis=1, keepdims=True), self.second.max(axis=1, keepdims=True)
        self.log_z = np.log(np.exp(self.first - m1) @ np.exp(self.second - m2).T) + m1 + m2.T

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.first[u, w] + self.second[v, w] - self.log_z[u, v]).astype(np.float64) / math.log(10)


_loaded: dict[bytes, tuple] = {}


def _load(model: bytes, digest: bytes) -> tuple:
    """A worker builds the tables of one model once, not for each task."""
    if digest not in _loaded:
        known, held, share, parameters = pickle.loads(model)
        _loaded.clear()
        _loaded[digest] = _Ids(known), held, share, Tables(parameters)
    return _loaded[digest]


def _scorer(model: object, digest: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, share, tables = _load(model.value, digest)
        for batch in it:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out: list[tuple] = []
                us, vs, ws, ends = [], [], [], []
                for text in part.column("text"):
                    words = words_of(text.as_py())
                    ids = list(map(known.__getitem__, words))
                    ids.append(END)
                    u, v = _contexts(ids)
                    us += u
                    vs += v
                    ws += ids
                    ends.append(len(ws))
                    rare = Counter(w for w in words if w not in held)
                    held_n = len(words) - sum(rare.values())
                    logs = math.fsum(held[w] for w in words if w in held)
                    others = [held.get(w, 0.0) - share[i] for w, i in zip(words, ids, strict=False) if i < CLASSES]
                    out.append((len(ids), held_n, logs, math.fsum(others), [{"word": w, "n": n} for w, n in rare.items()]))
                each = tables.log10(np.array(us), np.array(vs), np.array(ws))
                sums = np.add.reduceat(each, np.array([0, *ends[:-1]])) if ends else each
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(sums, pa.float64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                    names=["row", "doc_id", "held_out", "model", "n_tokens", "n_held", "held_log", "other_log", "rare"],
                )

    return run


def most_frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """(word, n) of at most limit words, by descending n: all whose count lies above the highest power of 2**(1/32) that
    leaves no more. The power comes from a histogram of bounded size; no task sorts the vocabulary."""
    level = F.floor(F.log2("n") * 32)
    kept, cut_at = 0, None
    for at, n in sorted(counts.groupBy(level.alias("at")).agg(F.count("*")).collect(), reverse=True):
        if kept + n > limit:
            break
        kept, cut_at = kept + n, at
    if cut_at is None:
        return []
    found = [(bytes(r["word"]), r["n"]) for r in counts.where(level >= F.lit(cut_at)).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


SCORED = "row long, doc_id long, held_out boolean, model double, n_tokens long, n_held long, held_log double, other_log double, rare array<struct<word:binary,n:bigint>>"


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, model_words: int = MODEL_WORDS, held_words: int = HELD_WORDS) -> DataFrame:
    """Trains on the rows outside held_fold and scores every row's whole text.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score
    (log10 probability by the model). A null text is an empty one: its end alone. A null doc_id is in no
    fold: it is scored, not learned from, and held_out. Repeated rows are documents of their own. With no training
    row at all every token is unseen, and the model near to uniform over its classes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = crc_fold(F.col("doc_id"), folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), F.coalesce(fold == held_fold, F.lit(True)).alias("held_out"))
    train = rows.where("not held_out")
    counts = cut(train.select("text").mapInArrow(_counter, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n_docs = train.count()
    distinct, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, vocabulary = tokens + n_docs, distinct + (n_docs > 0)
    top = most_frequent(counts, held_words)
    known = {w: i + CLASSES + 1 for i, (w, _) in enumerate(top[:model_words])}
    held = {w: math.log10(n + 1) for w, n in top}
    inside = np.array([n for _, n in top[:model_words]], np.float64)
    rest, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, words in counts.groupBy(F.pmod(F.crc32(F.substring("word", 1, 2)), F.lit(CLASSES)).cast("int").alias("k")).agg(F.sum("n"), F.count("*")).collect():
        rest[k], kinds[k] = n, words
    for w, n in top[:model_words]:
        rest[class_of(w)] -= n
        kinds[class_of(w)] -= 1
    unigram = np.array([*(rest + 1), n_docs + 1, *(inside + 1)])
    unigram /= unigram.sum()
    start = Parameters(np.log(unigram), DIM)
    fitted = train.select("text").mapInArrow(_trainer(pickle.dumps((known, unigram, start))), "part long, tokens long, flat binary")
    fitted = cut(fitted)
    while fitted.count() > 1:
        fitted = cut(fitted.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_average, "part long, tokens long, flat binary"))
    last = fitted.first()
    parameters = start.load(np.frombuffer(last["flat"], "<f4")) if last else start
    raw = pickle.dumps((known, held, [math.log10(x) for x in (rest + kinds + 1).tolist()], parameters))
    model = spark.sparkContext.broadcast(raw)
    scored = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scorer(model, hashlib.sha256(raw).digest()), SCORED)
    doc = [c for c in scored.columns if c not in ("row", "rare")]
    own = F.struct(F.concat(F.lit(b"  "), F.col("row").cast("string").cast("binary")).alias("word"), F.lit(0).cast("long").alias("n"), F.struct(*doc).alias("doc"))
    none = F.when(F.lit(False), F.struct(*doc))
    entries = F.concat(F.array(own), F.transform("rare", lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"), none.alias("doc"))))
    each = scored.select("row", F.explode(entries).alias("e")).select("row", "e.word", F.col("e.n").alias("times"), "e.doc")
    tail_log = F.col("times") * F.log10(F.col("n") + 1)
    summed = (
        each.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.first("doc", ignorenulls=True).alias("doc"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))), F.lit(0)).alias("rare_known"), F.coalesce(F.sum(tail_log), F.lit(0.0)).alias("rare_log"))
        .select("doc.*", "rare_known", "rare_log")
    )
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_held") + F.col("rare_known") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("held_log") + F.col("rare_log") + F.lit(math.log10(n_docs + 1)) - F.col("n_tokens") * F.lit(math.log10(total + vocabulary + 1))).alias("base_score"),
        (F.col("model") + F.col("other_log") + F.col("rare_log")).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
