"""Bounded-space online packing of tokenised documents into fixed windows.

A task keeps at most ``open_windows`` open windows. What is left of a document after its whole windows goes
to the open window that it fills best. If it fits none and no further window may be opened, the fullest is
topped up with a cut of the document and emitted. At the end a task merges its open windows, so that
one unfinished window stays; these few are merged over groups of tasks, level by level, until one is left.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, text_or_empty

WINDOW, OPEN_WINDOWS, END = 1024, 32, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long, unfinished boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
FAN_IN = 128


class ByteBpe:
    """Ids of the byte-level BPE vocabulary. The rank file holds the same vocabulary as the tokenizer file and is
    several times as fast; a text that holds the special token's own string goes through the tokenizer file."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}  # noqa: SIM115
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except ValueError:  # its expressions give up on very long runs of white space
            return self.whole.encode(text, add_special_tokens=False).ids


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    used: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece.ids)


def split(piece: Piece, at: int) -> tuple[Piece, Piece]:
    return Piece(piece.doc_id, piece.start, piece.ids[:at], piece.doc_tokens), Piece(piece.doc_id, piece.start + at, piece.ids[at:], piece.doc_tokens)


class Packer:
    """Takes documents, gives full windows; close() gives what is left in one unfinished window at most."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.most, self.open = window, max(1, open_windows), []

    def put(self, piece: Piece) -> Iterator[Window]:
        while len(piece.ids) >= self.window:
            head, piece = split(piece, self.window)
            yield Window([head], self.window)
        while len(piece.ids):
            fits = [w for w in self.open if self.window - w.used >= len(piece.ids)]
            if fits:
                best = max(fits, key=lambda w: w.used)
                best.add(piece)
                if best.used == self.window:
                    self.open.remove(best)
                    yield best
                return
            if len(self.open) < self.most:
                self.open.append(Window([piece], len(piece.ids)))
                return
            fullest = max(self.open, key=lambda w: w.used)
            head, piece = split(piece, self.window - fullest.used)
            fullest.add(head)
            self.open.remove(fullest)
            yield fullest

    def close(self) -> Iterator[Window]:
        last = Window()
        for w in sorted(self.open, key=lambda w: -w.used):
            for piece in w.pieces:
                while last.used + len(piece.ids) >= self.window:
                    head, piece = split(piece, self.window - last.used)
                    last.add(head)
                    yield last
                    last = Window()
                if len(piece.ids):
                    last.add(piece)
        self.open = []
        if last.used:
            yield last


def _rows(window: Window, sequence: int, part: int, unfinished: bool, keep_ids: bool) -> Iterable[tuple]:
    offset = 0
    for p in window.pieces:
        raw = p.ids.astype("<u4").tobytes()
        yield p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, sequence, offset, raw if keep_ids or unfinished else None, part, unfinished
        offset += len(p.ids)


def _mapper(make: Callable[[], Callable[[str], list[int]]], window: int, open_windows: int, keep_ids: bool) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, packer, n = make(), TaskContext.get().partitionId(), Packer(window, open_windows), 0
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COLUMNS[1:7]], ("ids", pa.binary()), ("part", pa.int64()), ("unfinished", pa.bool_())])
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for b in it:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.array([*encode(text.as_py()), END], np.uint32)
                for w in packer.put(Piece(doc_id, 0, ids, len(ids))):
                    rows += _rows(w, (part << 32) + n, part, False, keep_ids)
                    n += 1
                if len(rows) >= 4096:
                    yield batch()
        for w in packer.close():
            rows += _rows(w, (part << 32) + n, part, w.used < window, keep_ids)
            n += 1
        if rows:
            yield batch()

    return run


def _merger(window: int, keep_ids: bool, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["part"].iloc[0]) // FAN_IN
        packer = Packer(window)
        held: dict[int, Window] = {}
        for r in pdf.sort_values(["part", "sequence_id", "offset"]).itertuples():
            held.setdefault(r.sequence_id, Window()).add(Piece(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), np.frombuffer(r.ids, "<u4"), int(r.doc_tokens)))
        packer.open = list(held.values())
        rows = []
        for n, w in enumerate(packer.close()):
            rows += _rows(w, (level << 56) + (group << 24) + n, group, w.used < window, keep_ids)
        out = pd.DataFrame(rows, columns=COLUMNS)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack(docs: DataFrame, make_encode: Callable[[], Callable[[str], list[int]]], window: int = WINDOW, open_windows: int = OPEN_WINDOWS, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents (SCHEMA): each id lies in exactly one piece, offsets in a sequence are gapless from 0.

    docs (doc_id, text, ...): a null text is an empty one, which is its end id alone. Rows that repeat a
    doc_id are packed as documents of their own; a null doc_id stays null. ids: little-endian uint32 (null
    but for unfinished windows unless keep_ids). One sequence at most is shorter than the window.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    made = cut(rows.mapInArrow(_mapper(make_encode, window, open_windows, keep_ids), SCHEMA))
    done, left, level = made.where("not unfinished"), made.where("unfinished"), 0
    while left.select("part").distinct().count() > 1:
        level += 1
        merged = cut(left.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_merger(window, keep_ids, level), SCHEMA))
        done, left = done.union(merged.where("not unfinished")), merged.where("unfinished")
    return done.union(left)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): pieces that kept their ids, put together. A sequence is one window at most."""
    order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(order, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def byte_bpe(path: str | None = None) -> Callable[[], ByteBpe]:
    def make() -> ByteBpe:
        import public_tokenizers

        return ByteBpe(path or public_tokenizers.path("byte_bpe_50k.json"))

    return make


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe(), keep_ids=False).select(*COLUMNS[:7])
