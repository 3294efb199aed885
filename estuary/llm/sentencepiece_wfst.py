"""SentencePiece encoding and decoding as a weighted finite-state transducer.

compile_model() turns a model file into one transducer of three parts. The normaliser is a sequential transducer: at each place the longest
rewrite of the precompiled character map, white space to U+2581, the dummy prefix; it has one path for each text, so composing with it is applying
it. The pieces are a trie whose accepting states are arcs that emit an id. For each character that no piece spells there is a fallback arc that
emits the pieces of its bytes (or the unknown piece). Encoding composes all three with a text and takes the shortest path in the tropical semiring:
weights add along a path, the least wins, and what the path's arcs emit is the encoding.

Unigram models weigh a piece by its negated score. In a BPE model a path is the encoding if and only if
every two neighbours on it are what merging their joined text gives; such an arc weighs 0 and any other
infinity, so the state is the position and the last piece, and one finite path is left. That holds as a merge within
an encoding never looks past the neighbouring piece. Where no piece spans a place (before a white-space mark, around
a character that occurs in no piece) the lattice falls apart; parts are solved once and remembered.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_COST = 10.0
#: Parts that a worker remembers, twice over: those met since the last change of generation, and the ones before.
REMEMBERED, LONG_PART = 300_000, 48


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: integers for varints, bytes for everything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + n]
        at += n


def _char_map(blob: bytes) -> dict[str, str]:
    """The rewrites of a precompiled character map: a double-array trie whose values are offsets of zero-ended strings."""
    if len(blob) < 4:
        return {}
    n = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob[4 : 4 + n], "<u4").tolist(), blob[4 + n :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    rules: dict[str, str] = {}
    stack = [(offset(units[0]), b"")]
    while stack:
        base, key = stack.pop()
        for c in range(1, 256):
            at = base ^ c
            if at < len(units) and (units[at] & ((1 << 31) | 0xFF)) == c:
                below = at ^ offset(units[at])
                if (units[at] >> 8) & 1:
                    start = units[below] & ((1 << 31) - 1)
                    rules[(key + bytes([c])).decode("utf-8", "ignore")] = texts[start : texts.index(b"\0", start)].decode()
                stack.append((below, key + bytes([c])))
    return rules


class _Parts(dict):
    """What each part of a text encodes to. Parts met since the last change of generation and the ones before are remembered."""

    def __init__(self, solve: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.solve, self.older = solve, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.older.get(part)
        if ids is None:
            ids = self.solve(part)
        if len(part) <= LONG_PART:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Transducer:
    """pieces: (text, score, type) by id."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool = False, dummy_prefix: bool = True, collapse: bool = False, rules: dict[str, str] | None = None) -> None:
        self.pieces, self.kind, self.dummy, self.collapse = pieces, kind, dummy_prefix, collapse
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(t[1:-1], 16): i for i, (t, _, k) in enumerate(pieces) if k == BYTE} if byte_fallback else {}
        self.ids = {t: i for i, (t, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.score = {t: pieces[i][1] for t, i in self.ids.items()}
        self.floor = min(self.score.values(), default=0.0) - UNKNOWN_COST
        spelled = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelling = [spelled[i] if i in spelled else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.encode() for i, (t, _, k) in enumerate(pieces)]
        rules = rules or {}
        self.rules = rules
        self.rewrite = re.compile("|".join(map(re.escape, sorted(rules, key=len, reverse=True)))) if rules else None
        self.trie = self._trie()
        inside = set().union(*self.ids) if self.ids else set()
        loose = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        spans = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        cut = loose + ("" if spans else SPACE)
        parts = [] if spans else [f"{SPACE}+[^{cut}]*"]
        parts.append(f"[^{cut}]+" if cut else "(?s:.+)")
        after = "".join(re.escape(c) for c in string.punctuation if not any(re.search(f"[^\\W\\d_]{re.escape(c)}", t) for t in self.ids if c in t))
        if after and not spans:  # no piece goes on from a letter to one of these
            parts.insert(0, f"{SPACE}*[^\\W\\d_]++(?=[{after}])")
        self.part = re.compile("|".join([*parts, f"[{loose}]"] if loose else parts))
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0
        self.solved = _Parts(self._solve)

    def _trie(self) -> dict:
        """character -> (children, arc); the arc of an accepting state is (text, what it emits), else None."""
        root: dict = {}
        for t, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            children = root
            for c in t[:-1]:
                children = children.setdefault(c, ({}, None))[0]
            below = children[t[-1]][0] if t[-1] in children else {}
            children[t[-1]] = below, (t, (i,))
        return root

    def normalise(self, text: str) -> str:
        if self.rewrite:
            text = self.rewrite.sub(lambda m: self.rules[m[0]], text)
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.dummy else "") + text).replace(" ", SPACE)

    def fallback(self, character: str) -> tuple[str, tuple[int, ...]]:
        """The arc of a character that no piece spells: it emits its bytes' pieces, or the unknown piece."""
        return character, tuple(self.bytes[b] for b in character.encode("utf-8", "replace")) if self.bytes else (self.unknown,)

    def merge(self, text: str) -> list[str]:
        """Merges neighbours, the best-scored result first, the leftmost of equals: what neighbours are compared with."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _judge(self, a: str, b: str, known: dict[str, bool]) -> bool:
        """Whether merging a + b gives a and b; remembered in known, what is known to follow a."""
        if self.known_pairs > 2 * REMEMBERED:
            self.pairs.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        known[b] = self.merge(a + b) == ([a, b] if a else [b])
        return known[b]

    def shortest(self, part: str) -> list[tuple[str, tuple[int, ...]]]:
        """The arcs of the shortest path through the part's lattice."""
        came = self._finite(part) if self.kind == BPE else self._least(part)
        path, at = [], len(part)
        while at:
            path.append(came[at])
            at -= len(came[at][0])
        return path[::-1]

    def _finite(self, part: str) -> list:
        """The last arc of the path to each place that one of weight 0 reaches; arcs that do not follow the one before weigh infinity."""
        n = len(part)
        came: list = [None] * (n + 1)
        came[0] = ("", ())
        for i in range(n):
            if came[i] is None:
                continue
            children, before = self.trie, came[i][0]
            follows = self.pairs.get(before)
            if follows is None:
                follows = self.pairs[before] = {}
            single = False
            for j in range(i, n):
                step = children.get(part[j])
                if step is None:
                    break
                children, arc = step
                if arc is None:
                    continue
                single |= j == i
                if came[j + 1] is None:
                    fits = follows.get(arc[0])
                    if fits if fits is not None else self._judge(before, arc[0], follows):
                        came[j + 1] = arc
            if not single and came[i + 1] is None:
                fits = follows.get(part[i])
                if fits if fits is not None else self._judge(before, part[i], follows):
                    came[i + 1] = self.fallback(part[i])
        return came

    def _least(self, part: str) -> list:
        """The last arc of the path of least weight to each place."""
        n, infinite = len(part), float("inf")
        cost = [0.0] + [infinite] * n
        came: list = [("", ())] * (n + 1)
        for i in range(n):
            if cost[i] == infinite:
                continue
            children, single = self.trie, False
            for j in range(i, n):
                step = children.get(part[j])
                if step is None:
                    break
                children, arc = step
                if arc is None:
                    continue
                single |= j == i
                if cost[i] - self.score[arc[0]] < cost[j + 1]:
                    cost[j + 1], came[j + 1] = cost[i] - self.score[arc[0]], arc
            if not single and cost[i] - self.floor < cost[i + 1]:
                cost[i + 1], came[i + 1] = cost[i] - self.floor, self.fallback(part[i])
        return came

    def _solve(self, part: str) -> tuple[int, ...]:
        """What the path emits; in a unigram model unknown characters that adjoin are one unknown piece."""
        out: list[int] = []
        for _, ids in self.shortest(part):
            if self.kind != BPE and ids == (self.unknown,) and out[-1:] == [self.unknown]:
                continue
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.solved.__getitem__, self.part.findall(self.normalise(text)))))

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse transducer: each id's spelling; bytes that spell no character become U+FFFD, one for each."""
        ids = list(ids)
        raw = b"".join(map(self.spelling.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            whole = set(self.bytes.values())
            runs = ((b, b"".join(map(self.spelling.__getitem__, g))) for b, g in groupby(ids, whole.__contains__))
            text = "".join(_spell(r) if b else r.decode() for b, r in runs)
        text = text.replace(SPACE, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


def _spell(raw: bytes) -> str:
    """UTF-8; each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def compile_model(path: str) -> Transducer:
    pieces, kind, fallback, name = [], UNIGRAM, False, {}
    with open(path, "rb") as f:
        raw = f.read()
    for number, value in _fields(raw):
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            t = dict(_fields(value))
            kind, fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
        elif number == 3:
            name = dict(_fields(value))
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models have pieces with such paths")
    return Transducer(pieces, kind, fallback, bool(name.get(3, 1)), bool(name.get(4, 1)), _char_map(name.get(2, b"")))


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = compile_model(path)
    return _compiled[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encoder(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path or default_model())
        for batch in it:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [t.encode(text) for text in part.column("text").to_pylist()]
                flat = np.fromiter(chain.from_iterable(ids), "<i4")
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                raw = flat.tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise(ends.tolist())]
                decoded = [hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, flat), pa.array(crcs, pa.int64()), pa.array(decoded)], names=["doc_id", "ids", "ids_crc32", "decoded_sha256"])

    return run


def _decoder(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path or default_model())
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, ids_crc32, decoded_sha256) of each row's whole text, however long. A null text is an empty one and has no ids;
    repeated rows and null ids stay as they are, further columns of docs are left out, an empty table gives no row. path: the model
    file, the same on every machine. A part of a text that no piece spans is solved alone, so a long text takes memory by its longest part."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_encoder(path), "doc_id long, ids array<int>, ids_crc32 long, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to an empty text, an empty table to no row."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their number, and a digest of what they decode to; see encode() for odd rows."""
    return encode(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.size("ids").cast("long"))
