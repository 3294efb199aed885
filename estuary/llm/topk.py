"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors stay where they lie and are indexed in blocks. A component is a posting of its dimension; its impact is its size in units of the block's
largest, rounded down to one of ``IMPACTS`` levels, and a segment holds the postings of one dimension, sign and impact. A query processes segments
by descending impact times the size of its own component, and adds the segment's middle to the accumulators of the vectors in it. A posting
processed is off by half a level at most, and one still to come brings no more than the next segment's bound; so the error of every accumulator is known.
Processing stops only on proof: when the vectors that can still reach the k-th proven score are few, or no segment is left. These possible
members, ties included, are scored exactly. Where sums may pass 2**62 all vectors of the block are scored, in whole numbers of any length.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

VECTOR_BLOCK, QUERY_BLOCK = 32_768, 4096
IMPACTS, FEW, PROOFS = 12, 0.4, 10
OUT = "query_id long, vec_id long, score long"
LONG = (1 << 63) - 1


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, or null where the vector is null, empty or has a null or non-finite one."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    fit = (F.size(wide) > 0) & F.forall(wide, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fit, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


class Index:
    """Impact-ordered segments over a block of vectors of one length."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, impacts: int = IMPACTS) -> None:
        self.vectors, self.ids, self.n, self.dim = vectors, ids, len(vectors), vectors.shape[1]
        wide = vectors.astype(np.float64)
        self.largest = float(np.abs(wide).max(initial=0.0))
        self.step = max(self.largest / impacts, 1e-300)
        level = np.minimum((np.abs(wide) / self.step).astype(np.int64), impacts - 1)
        row, dim = np.nonzero(vectors)
        impact, sign = level[row, dim], (vectors[row, dim] > 0).astype(np.int64)
        order = np.lexsort((row, -impact, sign, dim))
        row, dim, impact, sign = row[order], dim[order], impact[order], sign[order]
        new = np.ones(len(row), bool)
        new[1:] = (dim[1:] != dim[:-1]) | (sign[1:] != sign[:-1]) | (impact[1:] != impact[:-1])
        self.start = np.append(np.flatnonzero(new), len(row))
        self.rows = row.astype(np.int32)
        at = self.start[:-1]
        self.seg_dim, self.seg_sign, self.seg_impact = dim[at], np.where(sign[at] == 1, 1.0, -1.0), impact[at]
        self.top = np.zeros(self.dim)
        np.maximum.at(self.top, self.seg_dim, (self.seg_impact + 1) * self.step)

    def wide(self, query: np.ndarray) -> bool:
        """Whether a product may pass 2**62."""
        return self.largest * float(np.abs(query.astype(np.float64)).max(initial=0.0)) * self.dim >= 2.0**62

    def exact(self, query: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Scores as whole numbers. Where a product may pass 2**62 it is made without a fixed width; beyond a long it is the nearest long."""
        if not self.wide(query):
            return self.vectors[members] @ query
        sums = (sum(a * b for a, b in zip(self.vectors[m].tolist(), query.tolist(), strict=True)) for m in members)
        return np.array([max(-LONG - 1, min(LONG, x)) for x in sums], np.int64)

    def possible(self, query: np.ndarray, own: np.ndarray, k: int, few: float = FEW) -> np.ndarray:
        """The vectors that can be among the query's k best; own: those that may not be found. Stops once they are no more than that share of the block."""
        q = query.astype(np.float64)
        size = np.abs(q)
        weight = size[self.seg_dim]
        bound = weight * (self.seg_impact + 1) * self.step
        order = np.argsort(-bound, kind="stable")
        middle = ((q[self.seg_dim] * self.seg_sign) * (self.seg_impact + 0.5) * self.step)[order].tolist()
        starts, ends, coming = self.start[:-1][order].tolist(), self.start[1:][order].tolist(), [*bound[order][1:].tolist(), 0.0]
        # What a processed posting may be off by, and the most that a dimension can still bring.
        off, most = 0.5 * size.sum() * self.step, size * self.top
        score, rows, done, next_proof, total = np.zeros(self.n), self.rows, 0, 1 / PROOFS, max(1, len(self.rows))
        may = ~own
        for at, (a, z, m) in enumerate(zip(starts, ends, middle, strict=True)):
            score[rows[a:z]] += m
            done += z - a
            if done < next_proof * total and at + 1 < len(order):
                continue
            next_proof = done / total + 1 / PROOFS
            reach = (off + np.minimum(most, coming[at]).sum()) * (1 + 1e-9) + 1e-9 * float(np.abs(score).max(initial=0.0))
            found = score if not own.any() else np.where(own, -np.inf, score)
            kth = np.partition(found, self.n - k)[self.n - k] if self.n > k else -np.inf
            may = (found >= kth - 2 * reach) & ~own
            if may.sum() <= max(k, few * self.n):
                break
        return np.flatnonzero(may)

    def topk(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the query's k best, ties to the smaller id."""
        own = self.ids == query_id
        members = np.flatnonzero(~own) if self.wide(query) else self.possible(query, own, k)
        scores = self.exact(query, members)
        if len(scores) > k:  # all that reach the k-th score, ties among them
            kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            members, scores = members[kept], scores[kept]
        return sorted(zip(scores.tolist(), self.ids[members].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]


def _matrices(ids: np.ndarray, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for the vectors of each length."""
    lengths = np.asarray(lists.value_lengths())
    flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield ids[at], flat[starts[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0), np.int64)


def _searcher(sent: object, k: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[np.ndarray, np.ndarray]] = pickle.loads(sent.value)
        best: dict[int, list[tuple[int, int]]] = {}

        def search(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("v").chunk(0) if t.num_rows else None
            for ids, vectors in _matrices(t.column("vec_id").to_numpy(), lists) if lists is not None else ():
                query_ids, queries = asked.get(vectors.shape[1], ([], []))
                if not len(query_ids):
                    continue
                index = Index(vectors, ids)
                for i, q in zip(query_ids, queries, strict=True):
                    i = int(i)
                    found = index.topk(q, i, k)
                    best[i] = sorted([*best.get(i, []), *found], key=lambda x: (-x[0], x[1]))[:k]

        held, waiting = [], 0
        for batch in it:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if waiting + part.num_rows > block and held:
                    search(held)
                    held, waiting = [], 0
                held.append(part)
                waiting += part.num_rows
        if held:
            search(held)
        rows = [(q, i, s) for q, found in best.items() for s, i in found]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of each query with vectors of another id.

    vectors, queries (vec_id long, v array<long>); further columns are left out. Null ids and null vectors take no part, empty tables give no row;
    only vectors of the query's own length compare. Rows that repeat a vector's id count each; of repeated queries the one with the smallest vector
    asks. Ties go to the smaller id. A score beyond a long counts as the nearest long.

    Queries are sent out in blocks of about query_block (that many vectors, whatever the data) and meet the vectors where these lie, so no vector
    moves; each task gives at most k rows for each query, and these are what is shuffled.
    """
    spark = vectors.sparkSession
    held = cut(vectors.where("vec_id is not null and v is not null").select("vec_id", "v"))
    asked = cut(queries.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = -(-asked.count() // query_block)
    near = None
    for b in range(max(1, blocks)):
        t = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))) == b).orderBy("vec_id").toArrow()
        lists = t.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
        by_length = {m.shape[1]: (ids, m) for ids, m in _matrices(t.column("vec_id").to_numpy(), lists)} if t.num_rows else {}
        sent = spark.sparkContext.broadcast(pickle.dumps(by_length))
        found = held.mapInArrow(_searcher(sent, k, vector_block), OUT)
        near = found if near is None else near.union(found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector, against all; vectors null or holding null or non-finite components take no part."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    return topk(rows, rows.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
