"""A quality classifier by co-training on two views of a document.

The text view sees words and their shapes (hashed); the metadata view sees what a page record tells besides its
words: language, source, length, lines and shares of kinds of characters and of repetition. Each view has a
logistic classifier. Over ``ROUNDS`` rounds, each labels the documents of a pool that it is surest of, in the labels'
own proportions, and hands them to the other; then the pool is filled up from further documents. Each view is calibrated on labelled rows that neither
trained on; the views' log-odds are combined there too, and all documents are scored, by the whole of their texts.

Fitting is bounded: at most ``LABELLED`` labelled rows, and as co-training has it a pool of ``POOL`` unlabelled ones, with ``REFILL`` more in each
round; all are chosen by the hash of the id. A document without a label is only ever used for pseudo-labels.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, small_batches, spelled_schema, table, text_or_empty

LABELLED, POOL, REFILL, ROUNDS, EACH_ROUND = 6_000, 4_000, 400, 4, 400
BUCKETS, KINDS = 1 << 14, 32
STEPS, DECAY = 40, 1e-4
LONGEST = 64
PIECE = 1 << 18
REJECT_BELOW = 0.5

_DIGIT, _LETTERS = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")


def shape(word: str) -> str:
    """Letter runs become a, digit runs 0; other characters stay."""
    return _LETTERS.sub("a", _DIGIT.sub("0", word))


def words_of(text: str) -> list[str]:
    """What white space separates; a run of over LONGEST characters counts as several words of that length."""
    words = text.split()
    if len(text) > LONGEST and max(map(len, words), default=0) > LONGEST:
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


class _Buckets(dict):
    """The buckets of a word and of its shape, remembered."""

    def __missing__(self, word: str) -> tuple[int, int]:
        found = zlib.crc32(word.lower().encode("utf-8", "replace")) % BUCKETS, BUCKETS + zlib.crc32(shape(word).encode("utf-8", "replace")) % BUCKETS
        if len(self) < 40_000:
            self[word] = found
        return found


_buckets = _Buckets()
AGAIN = 2 * BUCKETS


def text_view(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight): square roots of shares, so that long and short texts compare."""
    if not words:
        return np.array([AGAIN + 1]), np.array([1.0], np.float32)
    pairs = np.array([_buckets[w] for w in words])
    at, n = np.unique(pairs.ravel(), return_counts=True)
    again = sum(map(str.__eq__, words, words[1:]))
    at, n = np.append(at, AGAIN), np.append(n, again)
    return at.astype(np.int64), np.sqrt(n / len(words)).astype(np.float32)


META = 14 + 2 * KINDS


def meta_view(text: str, words: list[str], lang: str | None, source: str | None) -> np.ndarray:
    n, w = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    raw = text.encode("utf-8", "replace")
    ascii_letters = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    stops = len(raw) - len(raw.translate(None, b".,;:?'-"))
    marks = len(raw) - len(raw.translate(None, b"!\"#$%&()*+/<=>@[\\]^_`{|}~"))
    high = len(raw) - len(raw.translate(None, bytes(range(128, 256))))
    out = np.zeros(META, np.float32)
    out[:14] = [
        1.0, np.log1p(len(text)) / 10, np.log1p(len(words)) / 8, np.log1p(len(lines)) / 5, np.log1p(n / len(lines)) / 8, len(set(lines)) / len(lines), len(set(words)) / w,
        min(3.0, n / w / 8), ascii_letters / n, 5 * capitals / n, 5 * digits / n, 5 * stops / n, 5 * marks / n, high / n,
    ]
    out[14 + zlib.crc32((lang or "").encode()) % KINDS] = 0.3
    out[14 + KINDS + zlib.crc32((source or "").encode()) % KINDS] = 0.3
    return out


def views(text: str | None, lang: str | None, source: str | None) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    words = words_of(text or "")
    return text_view(words), meta_view(text or "", words, lang, source)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sparse:
    """Rows of (feature, weight), flat: at and w one after the other, n of them in each row."""

    def __init__(self, at: np.ndarray, w: np.ndarray, n: np.ndarray, width: int) -> None:
        self.at, self.w, self.n, self.width = at, w, len(n), width
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)

    def _parts(self) -> Iterator[slice]:
        """Sums are made piece by piece, so that what numpy widens is small."""
        return (slice(i, i + PIECE) for i in range(0, len(self.at), PIECE))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out, narrow = np.zeros(self.n), weights.astype(np.float32)
        for p in self._parts():
            out += np.bincount(self.row[p], weights=self.w[p] * narrow[self.at[p]], minlength=self.n)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out, narrow = np.zeros(self.width), g.astype(np.float32)
        for p in self._parts():
            out += np.bincount(self.at[p], weights=self.w[p] * narrow[self.row[p]], minlength=self.width)
        return out


class Dense:
    def __init__(self, matrix: np.ndarray) -> None:
        self.m, self.n, self.width = matrix.astype(float), len(matrix), matrix.shape[1]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return self.m @ weights

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.m.T @ g


def logistic(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps: int = STEPS, rate: float = 0.3) -> np.ndarray:
    """Weights of a logistic classifier (the last one is the bias) by full AdaGrad steps, from those of the last round."""
    w, squares = np.zeros(x.width + 1) if start is None else start.copy(), np.full(x.width + 1, 1e-8)
    total = max(weight.sum(), 1e-9)
    for _ in range(steps):
        g = weight * (y - _sigmoid(x.dot(w[:-1]) + w[-1]))
        gradient = np.append(x.back(g), g.sum()) / total - DECAY * w
        squares += gradient * gradient
        w += rate * gradient / np.sqrt(squares)
    return w


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of a few dense columns by Newton's method, with a weak pull to zero."""
    m = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(m.shape[1]), np.full(m.shape[1], 0.05)
    for _ in range(30):
        q = _sigmoid(m @ w)
        step = np.linalg.solve((m * (q * (1 - q))[:, None]).T @ m + np.diag(pull), m.T @ (y - q) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_curve: np.ndarray
    meta_curve: np.ndarray
    both: np.ndarray
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def score(self, view: tuple[tuple[np.ndarray, np.ndarray], np.ndarray]) -> tuple[float, float, float]:
        """Calibrated probabilities of good quality: of both views together, of the text, of the metadata."""
        (at, w), meta = view
        a = float(w @ self.text[at] + self.text[-1])
        b = float(meta @ self.meta[:-1] + self.meta[-1])
        t, m = a * self.text_curve[0] + self.text_curve[1], b * self.meta_curve[0] + self.meta_curve[1]
        return tuple(float(_sigmoid(np.float64(z))) for z in (t * self.both[0] + m * self.both[1] + self.both[2], t, m))


def co_train(text: Sparse, meta: Dense, labels: np.ndarray, held: np.ndarray, arrives: np.ndarray | None = None) -> Model:
    """labels: 0, 1 or nan (unlabelled); held: labelled rows kept for calibration; arrives: the round in which an unlabelled row joins the pool."""
    arrives = np.zeros(len(labels), int) if arrives is None else arrives
    train = ~np.isnan(labels) & ~held
    pool = np.isnan(labels)
    given = {"text": np.where(train, labels, np.nan), "meta": np.where(train, labels, np.nan)}
    good = float(labels[train].mean()) if train.any() else 0.5
    view, weights, exchanged = {"text": text, "meta": meta}, {}, []
    for turn in range(ROUNDS + 1):
        for name, x in view.items():
            known = ~np.isnan(given[name])
            weights[name] = logistic(x, np.nan_to_num(given[name]), known * np.where(train, 1.0, 0.5), weights.get(name))
        if turn == ROUNDS or not pool.any():
            break
        moved = []
        for name, other in (("text", "meta"), ("meta", "text")):
            z = view[name].dot(weights[name][:-1]) + weights[name][-1]
            free = np.flatnonzero(pool & (arrives <= turn) & np.isnan(given[other]))
            order = free[np.argsort(z[free], kind="stable")]
            sure = np.abs(z[order]) > 2.0
            bad = order[(z[order] < 0) & sure][: round(EACH_ROUND * (1 - good))]
            fine = order[(z[order] > 0) & sure][::-1][: round(EACH_ROUND * good)]
            moved.append((other, bad, fine))
        for other, bad, fine in moved:
            given[other][bad], given[other][fine] = 0.0, 1.0
        exchanged.append((sum(len(m[1]) for m in moved), sum(len(m[2]) for m in moved)))
    z = {n: view[n].dot(weights[n][:-1]) + weights[n][-1] for n in view}
    use = held if held.any() else train
    curves = {n: curve(z[n][use][:, None], labels[use]) for n in view}
    calibrated = np.column_stack([z[n][use] * curves[n][0] + curves[n][1] for n in ("text", "meta")])
    return Model(weights["text"], weights["meta"], curves["text"], curves["meta"], curve(calibrated, labels[use]), exchanged)


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        each = [views(t.as_py(), g.as_py(), s.as_py()) for t, g, s in zip(batch.column("text"), batch.column("lang"), batch.column("source"), strict=True)]
        raw = ([v[0][0].astype("<i4").tobytes() for v in each], [v[0][1].astype("<f4").tobytes() for v in each], [v[1].astype("<f4").tobytes() for v in each])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(r, pa.binary()) for r in raw)], names=["doc_id", "quality", "at", "w", "meta"])
    _buckets.clear()


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, refill: int = REFILL) -> Model:
    """labels (doc_id, quality): of several labels of one document the least counts; null ids and labels are left out, labels without a document too.
    Of documents that share an id one counts, the least by its features. Null texts, languages and sources are empty ones. Without labels, or
    documents, every document scores 0.5."""
    spark = docs.sparkSession
    small_batches(spark)
    known = hash_sample(labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")), F.col("doc_id"), labelled).collect()
    ids, wanted = {r[0] for r in known}, pool + ROUNDS * refill
    others = [r[0] for r in hash_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), F.col("doc_id"), wanted + labelled).collect()]
    free = [i for i in others if i not in ids][:wanted]
    joins = {i: max(0, (k - pool) // refill + 1) for k, i in enumerate(free)}
    listed = pa.table({"doc_id": pa.array([*(r[0] for r in known), *free], pa.int64()), "quality": pa.array([*(r[1] for r in known), *[-1] * len(free)], pa.int32())})
    small = spark.createDataFrame(listed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).join(F.broadcast(small), "doc_id")
    made = rows.select("doc_id", "text", "lang", "source", "quality").mapInArrow(_extract, "doc_id long, quality int, at binary, w binary, meta binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("at", "w", "meta", "quality")).alias("r")).select("doc_id", "r.*")
    # Features go straight into flat arrays; the rows' order is that of the ids, whatever the order in which they come.
    doc, quality, at, w, meta, sizes = [], [], bytearray(), bytearray(), bytearray(), []
    for r in one.coalesce(8).toLocalIterator():
        doc.append(r["doc_id"])
        quality.append(r["quality"])
        sizes.append(len(r["at"]) // 4)
        at += r["at"]
        w += r["w"]
        meta += r["meta"]
    y = np.array([q if q >= 0 else np.nan for q in quality], float)
    if np.isnan(y).all():
        return Model(np.zeros(AGAIN + 3), np.zeros(META + 1), np.zeros(2), np.zeros(2), np.zeros(3))
    order, n = np.argsort(np.array(doc, np.int64), kind="stable"), np.array(sizes)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    gather = lambda raw, kind: np.concatenate([np.frombuffer(raw, kind, n[i], 4 * starts[i]) for i in order.tolist()])
    text = Sparse(gather(at, "<i4"), gather(w, "<f4"), n[order], AGAIN + 2)
    dense = Dense(np.frombuffer(meta, "<f4").reshape(-1, META)[order])
    del at, w, meta
    doc, y = [doc[i] for i in order], y[order]
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 1 for i in doc]) & ~np.isnan(y)
    return co_train(text, dense, y, held, np.array([joins.get(i, 0) for i in doc]))


NAMES = ("quality_score", "text_score", "meta_score")


def scorer(model: Model, spark: SparkSession, names: tuple[str, str, str] = NAMES) -> Callable[[DataFrame], DataFrame]:
    """Adds the scores of both views together, of the text and of the metadata to rows with text, lang and source; all other columns stay, but for
    those of the three names, which are replaced. Nulls are empty texts; repeated rows score alike; no row gives no row."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in it:
            each = [own.score(views(t.as_py(), g.as_py(), s.as_py())) for t, g, s in zip(batch.column("text"), batch.column("lang"), batch.column("source"), strict=True)]
            cols = list(zip(*each, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in cols)], names=[*batch.schema.names, *names])
        _buckets.clear()

    def apply(rows: DataFrame) -> DataFrame:
        kept = rows.drop(*names).withColumns({c: F.col(c).cast("string") for c in ("text", "lang", "source")})
        return kept.mapInArrow(run, f"{spelled_schema(kept)}, {', '.join(f'{n} double' for n in names)}")

    return apply


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores and predicted quality; null texts are empty ones, null ids are scored like any other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = scorer(fit(docs, table(spark, sf_dir, "labels")), spark)(docs)
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= REJECT_BELOW).cast("int").alias("predicted"), "text_score", "meta_score")
