"""Order-book replay: a fold of snapshots, deltas, halts, closes, disconnects and trades into quotes, with sequence gaps.

The state belongs to a scope (venue, connection, sequence scope): one cursor, one generation, and the books on it. A gap or a disconnect
starts a new generation, and a book is trusted again only by a snapshot in it. ``Scope`` is the fold itself; the batch form streams each
scope's sorted events through it, so that a task holds the open books of one scope and no more; the streaming form keeps the scope as state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCOPE = ["venue", "connection_id", "scope"]
QUOTE = (
    "venue string, connection_id string, scope string, record_id long, contract string, kind string, sequence long, time long, bid double, ask double, bid_size double, ask_size double, validity string, issue string, missing long, generation int, "
    "last_price_change long, last_verified long, last_trade long"
)
QUOTE_COLUMNS = [c.split()[0] for c in QUOTE.split(", ")]
EVENT_COLUMNS = ["record_id", "contract", "kind", "sequence", "operation", "side", "price", "size", "levels", "time", "seen_at"]


@dataclass
class Book:
    bids: dict[float, float] = field(default_factory=dict)
    asks: dict[float, float] = field(default_factory=dict)
    cursor: int | None = None
    generation: int | None = None
    pending: str | None = "awaiting_snapshot"
    halted: bool = False
    closed: bool = False
    changed: int | None = None
    verified: int | None = None
    traded: int | None = None

    def top(self) -> tuple[float | None, float | None]:
        return max(self.bids, default=None), min(self.asks, default=None)


@dataclass
class Scope:
    cursor: int | None = None
    generation: int = 0
    disconnected: bool = False
    gap: bool = False
    books: dict[str, Book] = field(default_factory=dict)

    def _distrust(self, why: str) -> None:
        self.generation += 1
        for book in self.books.values():
            book.pending = why

    def _jump(self) -> None:
        self.gap = True
        self._distrust("gap")

    def _number(self, n: int | None, book: Book, snapshot: bool) -> tuple[bool, str | None, int]:
        """Whether an event of that number may touch the book, what is wrong with the number, and how many numbers are missing before it."""
        if n is None:
            if not snapshot and book.generation != self.generation:
                book.pending = "disconnected" if self.disconnected else "gap" if self.gap else "awaiting_snapshot"
                return False, None, 0
            return True, None, 0
        if self.cursor is None:
            self.cursor = n
            if snapshot:
                book.cursor = n
                return True, None, 0
            self._jump()
            return False, "sequence_baseline_missing", 0
        if n > self.cursor:
            missing = n - self.cursor - 1
            if missing:
                self._jump()
            self.cursor = book.cursor = n
            return True, "sequence_gap" if missing else None, missing
        if snapshot:
            book.cursor = n
            return True, None, 0
        if n < self.cursor:
            return False, "stale_sequence", 0
        if book.cursor is not None and book.cursor >= n:
            return False, "duplicate_sequence", 0
        book.cursor = n
        return True, None, 0

    def apply(self, e: dict) -> tuple[Book, str | None, int]:
        book, kind, at = self.books.setdefault(e["contract"], Book()), e["kind"], e["seen_at"]
        if kind == "disconnect":
            self.disconnected = True
            self._distrust("disconnected")
            return book, None, 0
        if kind in ("close", "halt"):
            issue, missing = self._number(e["sequence"], book, False)[1:] if e["sequence"] is not None else (None, 0)
            book.closed, book.halted = book.closed or kind == "close", book.halted or kind == "halt"
            book.verified = at if at is not None else book.verified
            return book, issue, missing
        may, issue, missing = self._number(e["sequence"], book, kind == "snapshot")
        if may:
            before = book.top()
            if kind == "snapshot":
                levels = json.loads(e["levels"] or "{}")
                book.bids, book.asks = ({float(p): float(s) for p, s in levels.get(side, [])} for side in ("bids", "asks"))
                book.generation, book.pending, book.halted = self.generation, None, False
                self.disconnected = self.gap = False
                moved = before != book.top() and (book.changed is None or (at is not None and at > book.changed))
            else:
                moved = self._edit(book.bids if e["side"] == "bid" else book.asks, e)
            if moved:
                book.changed = at if at is not None or kind != "snapshot" else book.changed
            book.verified = at if at is not None else book.verified
        return book, issue, missing

    @staticmethod
    def _edit(side: dict[float, float], e: dict) -> bool:
        price, old = e["price"], side.get(e["price"])
        if e["operation"] == "delete":
            return side.pop(price, None) is not None
        size = e["size"] if e["operation"] == "replace" else (old or 0.0) + e["size"]
        if e["operation"] == "replace" or size > 0:
            side[price] = size
        else:
            side.pop(price, None)
        return size != (old if e["operation"] == "replace" else old or 0.0)

    def trade(self, e: dict) -> None:
        """A trade marks every book of its contract that is known by now; it never sets a side."""
        book, at = self.books.get(e["contract"]), e["seen_at"]
        if book is not None and (book.traded is None or (at is not None and at > book.traded)):
            book.traded = at

    def validity(self, book: Book) -> str:
        if book.closed:
            return "closed"
        if self.disconnected:
            return "disconnected"
        if book.generation != self.generation:
            return "gap" if self.gap or book.generation is not None else book.pending or "awaiting_snapshot"
        bid, ask = book.top()
        ladder = ((book.pending is not None, book.pending), (book.halted, "halted"), (bid is not None and ask is not None and bid >= ask, "crossed"))
        return next((name for hit, name in ladder if hit), "valid")

    def quote(self, e: dict) -> tuple | None:
        """The quote after a book event; a trade gives none."""
        if e["kind"] == "trade":
            self.trade(e)
            return None
        book, issue, missing = self.apply(e)
        bid, ask = book.top()
        return (
            e["record_id"], e["contract"], e["kind"], e["sequence"], e["time"], bid, ask, book.bids.get(bid), book.asks.get(ask), self.validity(book), issue, missing, self.generation, book.changed, book.verified, book.traded,
        )

    def state(self) -> str:
        books = {c: {**asdict(b), "bids": list(b.bids.items()), "asks": list(b.asks.items())} for c, b in self.books.items()}
        return json.dumps({"cursor": self.cursor, "generation": self.generation, "disconnected": self.disconnected, "gap": self.gap, "books": books})

    @staticmethod
    def load(state: str) -> Scope:
        raw = json.loads(state)
        books = {c: Book(**{**b, "bids": dict(map(tuple, b["bids"])), "asks": dict(map(tuple, b["asks"]))}) for c, b in raw.pop("books").items()}
        return Scope(**raw, books=books)


def _rows(quotes: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    types = [kinds[c.split()[1]] for c in QUOTE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*quotes, strict=True), types, strict=True)], names=QUOTE_COLUMNS)


def _fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of whole scopes, sorted: one scope's state lives at a time."""
    key, scope = None, Scope()
    for batch in it:
        out = []
        for e in batch.to_pylist():
            own = tuple(e[c] for c in SCOPE)
            if own != key:
                key, scope = own, Scope()
            quote = scope.quote(e)
            if quote is not None:
                out.append((*own, *quote))
        if out:
            yield _rows(out)


def ordered(events: DataFrame, order: str, trades: DataFrame | None = None) -> DataFrame:
    """events with time (the fold's own axis) and seen_at (usable, else source time), and a row for each scope that holds a trade's contract."""
    fallback = {"source_time": "usable_time", "usable_time": "source_time"}[order]
    rows = events.select(*SCOPE, "record_id", "contract", "kind", "sequence", "operation", "side", "price", "size", "levels", F.col(order).alias("time"), F.col(fallback).alias("other_time"), F.coalesce("usable_time", "source_time").alias("seen_at"))
    if trades is None:
        return rows
    held = events.select(*SCOPE, "contract").distinct()  # scopes and contracts, not records
    own = trades.select("venue", "contract", "record_id", "source_time", "usable_time")
    marks = own.join(held, ["venue", "contract"]).select(*SCOPE, "record_id", "contract", F.lit("trade").alias("kind"), F.col(order).alias("time"), F.col(fallback).alias("other_time"), F.coalesce("usable_time", "source_time").alias("seen_at"))
    return rows.unionByName(marks, allowMissingColumns=True)


def replay(events: DataFrame, order: str, trades: DataFrame | None = None, by_other_time: bool = True) -> DataFrame:
    """Quotes (QUOTE) after every book event of each scope, by the named time, source_time or usable_time.

    events: venue, connection_id, scope, record_id, contract, kind (snapshot, delta, halt, close, disconnect), sequence, operation, side,
    price, size, levels, source_time, usable_time. trades (optional): venue, contract, record_id, source_time, usable_time; they only move
    last_trade. Events without the time come last; equal times go by the other time (unless by_other_time is False, for streams whose numbers
    do not follow it), trades after book events, then contract and id. A scope
    is one connection's sequence, the unit that cannot be split: its events are sorted (on disk, if need be) and streamed through one task.
    """
    rows = ordered(events, order, trades)
    other = [F.col("other_time").isNull(), F.col("other_time")] if by_other_time else []
    keys = [F.col("time").isNull(), F.col("time"), *other, F.col("kind") == "trade", F.col("contract"), F.col("record_id")]
    placed = rows.repartition(*SCOPE).sortWithinPartitions(*SCOPE, *keys)
    return placed.select(*SCOPE, *EVENT_COLUMNS).mapInArrow(_fold, QUOTE)


def compare_orders(events: DataFrame, one: str, other: str) -> DataFrame:
    """Occurrences of two folds of the same events: side (both, or the fold that alone has a time for it), the two states, and whether they are the same.

    (venue, connection_id, scope, record_id, side, a, b, same); a and b are struct(bid, ask, validity)."""
    state = F.struct("bid", "ask", "validity")
    a = replay(events, one).select(*SCOPE, "record_id", state.alias("a"), F.col("time").alias("_a"))
    b = replay(events, other).select(*SCOPE, "record_id", state.alias("b"), F.col("time").alias("_b"))
    side = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), f"only_{one}").when(F.col("_b").isNotNull(), f"only_{other}").otherwise("neither")
    return a.join(b, [*SCOPE, "record_id"], "full").withColumn("side", side).withColumn("same", F.col("a").eqNullSafe(F.col("b"))).drop("_a", "_b")


def sequence_gaps(events: DataFrame, order: str, bucket: int = 86_400_000_000) -> DataFrame:
    """Jumps of each scope's numbers, without a fold: a number beyond the largest before it by more than one.

    The running maximum is taken within (scope, time bucket), and what reaches a bucket from earlier ones comes from a summary of one row a bucket."""
    rows = events.where("sequence is not null").withColumn("_slot", F.floor(F.col(order) / bucket).cast("long"))
    own = W.partitionBy(*SCOPE, "_slot").orderBy(order, "contract", "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.max("sequence").over(own))
    tops = rows.groupBy(*SCOPE, "_slot").agg(F.max("sequence").alias("_top"))
    earlier = W.partitionBy(*SCOPE).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    far = tops.withColumn("_far", F.max("_top").over(earlier)).drop("_top")
    same = F.lit(True)
    for k in (*SCOPE, "_slot"):
        same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"f.{k}"))
    both = near.alias("n").join(far.alias("f"), same, "left").select("n.*", F.greatest("_near", "_far").alias("before"))
    return both.where(F.col("sequence") > F.col("before") + 1).select(*SCOPE, "record_id", "before", "sequence")


def coverage(quotes: DataFrame) -> DataFrame:
    """One row for each scope: quotes, contracts, first and last time, gaps, those still open, and contracts whose last quote is valid.

    A gap is a jump, a start without a snapshot or a disconnect. It stays open until a quote at or after it is valid and the book ends valid: by its
    last quote, and in the scope's last generation, for what another book's gap ended has no quote of its own."""
    last = F.struct(F.col("time").isNotNull().alias("known"), "time", "record_id")
    ends = quotes.groupBy(*SCOPE, "contract").agg(
        F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.max_by("validity", last).alias("end"), F.max_by("generation", last).alias("generation"),
        F.max(F.when(F.col("validity") == "valid", F.col("time"))).alias("last_valid"),
    )
    newest = ends.groupBy(*SCOPE).agg(F.max("generation").alias("newest"))
    ends = ends.join(newest, SCOPE).withColumn("whole", (F.col("end") == "valid") & (F.col("generation") == F.col("newest")))
    broken = F.col("issue").isin("sequence_gap", "sequence_baseline_missing") | (F.col("kind") == "disconnect")
    gaps = quotes.where(F.coalesce(broken, F.lit(False)))
    by_scope = ends.groupBy(*SCOPE).agg(
        F.sum("n").alias("quotes"), F.count("*").alias("contracts"), F.min("first").alias("first_time"), F.max("last").alias("last_time"), F.count_if("whole").alias("valid_contracts"),
        F.max(F.when(F.col("whole"), F.col("last_valid"))).alias("_healed"),
    )
    marked = gaps.join(by_scope.select(*SCOPE, "_healed"), SCOPE).groupBy(*SCOPE).agg(F.count("*").alias("gaps"), F.sum("missing").alias("missing"), F.count_if(F.coalesce(F.col("_healed") < F.col("time"), F.lit(True))).alias("open_gaps"))
    out = by_scope.drop("_healed").join(marked, SCOPE, "left").na.fill(0, ["gaps", "missing", "open_gaps"])
    return out.withColumn("all_valid", F.col("valid_contracts") == F.col("contracts"))


def totals(covered: DataFrame) -> DataFrame:
    """The whole replay in one row, from the rows of coverage()."""
    sums = ("quotes", "contracts", "valid_contracts", "gaps", "open_gaps")
    return covered.agg(F.count("*").alias("scopes"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.coalesce(F.bool_and("all_valid"), F.lit(False)).alias("all_valid"))


def _clean(r: dict) -> dict:
    return {k: None if v is None or v != v else int(v) if k in ("sequence", "record_id", "time", "seen_at") else v for k, v in r.items()}


def stream_fold(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState: the scope lives in the state as JSON."""
    scope = Scope.load(state.get[0]) if state.exists else Scope()
    quotes = (scope.quote(_clean(r)) for pdf in batches for r in pdf.sort_values(["time", "contract", "record_id"], na_position="last").to_dict("records"))
    rows = [(*key, *q) for q in quotes if q is not None]
    state.update((scope.state(),))
    yield pd.DataFrame(rows, columns=QUOTE_COLUMNS).astype({c.split()[0]: "Int64" for c in QUOTE.split(", ") if c.split()[1] == "long"})


# The venue's message types and the kinds of event that they become, its sides, and the name of the scope that it leaves out.
MESSAGE_KINDS = {"book": "snapshot", "price_change": "delta", "last_trade_price": "trade"}
SIDES = {"BUY": "bid", "SELL": "ask"}
CHANNEL = "polymarket"
_UPDATE = "asset_id:string,price:string,size:string,side:string,timestamp:string"
MESSAGE = (
    "event_type string, asset_id string, timestamp string, price string, size string, side string, bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>, "
    f"price_changes array<struct<{_UPDATE}>>"
)


def stated_micros(text: Column) -> Column:
    """A stated instant in microseconds: seconds, or milliseconds where the magnitude tells, or ISO text; else null."""
    number = text.try_cast("double")
    plain = F.when(number > 1e11, number * 1000).otherwise(number * 1_000_000)
    return F.coalesce(F.round(plain).cast("long"), F.unix_micros(F.try_to_timestamp(text)))


def channel_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, counts) of a market channel's messages: (connection_id, position, received, body).

    A book becomes a snapshot, each entry of a price change a delta (size 0 deletes, else replaces the level), a last trade a trade. counts (event_type,
    messages, refused): every type is counted, other types change nothing, and a message is refused if a trade lacks price or size or a delta's
    side is neither of the two; entries without a price or a size are passed over. record_id is position * 1024 + the entry's place, so that
    occurrences stay apart. A channel has no numbers, so each asset of a connection is a scope of its own.
    """
    m = messages.withColumn("m", F.from_json("body", MESSAGE))
    number = lambda x: x.try_cast("double")
    side_of = lambda x: F.try_element_at(F.create_map(*[F.lit(v) for pair in SIDES.items() for v in pair]), F.upper(F.trim(x)))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in MESSAGE_KINDS.items() for x in pair]), F.col("m.event_type"))
    own = F.struct(*[F.col(f"m.{c.split(':')[0]}").alias(c.split(":")[0]) for c in _UPDATE.split(",")])
    stated = F.filter(F.coalesce(F.col("m.price_changes"), F.array(own)), lambda x: number(x["price"]).isNotNull() & number(x["size"]).isNotNull())
    m = m.withColumn("kind", kind).withColumn("stated", F.when(kind == "delta", stated))
    bad = F.when(F.col("kind") == "delta", F.exists("stated", lambda x: side_of(x["side"]).isNull())).when(F.col("kind") == "trade", number(F.col("m.price")).isNull() | number(F.col("m.size")).isNull()).otherwise(F.lit(False))
    m = m.withColumn("refused", bad)
    counts = m.groupBy(F.col("m.event_type").alias("event_type")).agg(F.count("*").alias("messages"), F.count_if("refused").alias("refused"))
    none = lambda k: F.lit(None).cast(k)
    levels = lambda s: F.transform(F.filter(s, lambda x: number(x["price"]).isNotNull() & (number(x["size"]) > 0)), lambda x: F.array(number(x["price"]), number(x["size"])))
    nothing = F.array().cast("array<array<double>>")
    whole = F.to_json(F.struct(F.coalesce(levels(F.col("m.bids")), nothing).alias("bids"), F.coalesce(levels(F.col("m.asks")), nothing).alias("asks")))
    entry = lambda i, asset, at, operation, side, price, size, lv: F.struct(i.alias("place"), asset.alias("contract"), at.alias("at"), operation.alias("operation"), side.alias("side"), price.alias("price"), size.alias("size"), lv.alias("levels"))
    sent = F.col("m.timestamp")
    alone = entry(F.lit(0), F.col("m.asset_id"), sent, none("string"), none("string"), number(F.col("m.price")), number(F.col("m.size")), F.when(F.col("kind") == "snapshot", whole))
    changes = F.transform("stated", lambda x, i: entry(
        i, F.coalesce(x["asset_id"], F.col("m.asset_id")), F.coalesce(x["timestamp"], sent), F.when(number(x["size"]) == 0, "delete").otherwise("replace"), side_of(x["side"]), number(x["price"]), F.when(number(x["size"]) != 0, number(x["size"])), none("string"),
    ))
    rows = m.where(F.col("kind").isNotNull() & ~F.col("refused")).withColumn("e", F.explode(F.when(F.col("kind") == "delta", changes).otherwise(F.array(alone))))
    events = rows.select(
        F.lit(CHANNEL).alias("venue"), "connection_id", F.concat_ws(":", F.lit(CHANNEL), "e.contract", "connection_id").alias("scope"), (F.col("position") * 1024 + F.col("e.place")).alias("record_id"), "e.contract", "kind",
        none("long").alias("sequence"), "e.operation", "e.side", "e.price", "e.size", "e.levels", stated_micros(F.col("e.at")).alias("source_time"), F.col("received").alias("usable_time"),
    )
    return events, counts


def disconnect_markers(events: DataFrame, connections: DataFrame) -> DataFrame:
    """A disconnect event for every asset whose book a connection that ended had built, in the scope of the connection itself: connections
    (connection_id, ended). Its source time is unknown; it is usable from the end on."""
    built = events.where((F.col("kind") == "snapshot") | ((F.col("kind") == "delta") & (F.col("operation") != "delete"))).select("venue", "connection_id", "contract").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return built.join(connections.where(F.col("ended").isNotNull()), "connection_id").select(
        "venue", "connection_id", F.col("connection_id").alias("scope"), F.xxhash64("connection_id", "contract").alias("record_id"), "contract", F.lit("disconnect").alias("kind"), none("long").alias("sequence"),
        none("string").alias("operation"), none("string").alias("side"), none("double").alias("price"), none("double").alias("size"), none("string").alias("levels"), none("long").alias("source_time"), F.col("ended").alias("usable_time"),
    )


def _crossed(order: np.ndarray) -> int:
    """Pairs of a sequence of different numbers that stand in falling order, by merging sorted halves."""
    n = len(order)
    if n < 2:
        return 0
    left, right = order[: n // 2], order[n // 2 :]
    count = _crossed(left) + _crossed(right)
    return count + int((len(left) - np.searchsorted(np.sort(left), right)).sum())


def inversions(events: DataFrame, one: str, other: str, keys: list[str] = SCOPE, bucket: int = 86_400_000_000) -> DataFrame:
    """(keys, shared, inversions): of the events that have both times, how many pairs of a group stand differently in the two orders (ties by record_id).

    No pair is built. Times fall into buckets; pairs in different buckets of both times are counted from the table of bucket counts, pairs that share
    a bucket by merging within it, so that a task holds one bucket.
    """
    known = events.where(F.col(one).isNotNull() & F.col(other).isNotNull()).select(*keys, "record_id", F.col(one).alias("x"), F.col(other).alias("y"))
    known = known.withColumn("i", F.floor(F.col("x") / bucket).cast("long")).withColumn("j", F.floor(F.col("y") / bucket).cast("long"))
    spec = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)

    def within(by: str, inner: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            a = pdf.sort_values(["x", "record_id"])
            rank = np.empty(len(a), np.int64)
            rank[np.lexsort((a["record_id"], a["y"]))] = np.arange(len(a))
            count = _crossed(rank)
            if inner:  # pairs that share both buckets were counted with the other time's
                for _, at in a.groupby(inner).indices.items():
                    count -= _crossed(rank[np.sort(at)])
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [count]})

        return run

    near = known.groupBy(*keys, "i").applyInPandas(within("i", ""), f"{spec}, n long")
    near = near.union(known.groupBy(*keys, "j").applyInPandas(within("j", "i"), f"{spec}, n long"))
    cells = known.groupBy(*keys, "i", "j").agg(F.count("*").alias("c"))
    a, b = cells.alias("a"), cells.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    far = a.join(b, same & (F.col("a.i") < F.col("b.i")) & (F.col("a.j") > F.col("b.j"))).select(*[F.col(f"a.{k}").alias(k) for k in keys], (F.col("a.c") * F.col("b.c")).alias("n"))
    shared = known.groupBy(*keys).agg(F.count("*").alias("shared"))
    found = near.union(far).groupBy(*keys).agg(F.sum("n").alias("inversions"))
    return shared.join(found, keys, "left").na.fill(0, ["inversions"])


def generation_state(closed: Column, disconnected: Column, own: Column, current: Column, gap_open: Column, pending: Column, halted: Column, bid: Column, ask: Column) -> Column:
    """Validity from stored state, first hit: closed, disconnected, another generation than the scope's (gap, or never seen), pending, halted, crossed."""
    behind = ~own.eqNullSafe(current)
    return (
        F.when(closed, "closed").when(disconnected, "disconnected").when(behind & (gap_open | own.isNotNull()), "gap").when(behind, F.coalesce(pending, F.lit("awaiting_snapshot"))).when(pending.isNotNull(), pending)
        .when(halted, "halted").when(bid >= ask, "crossed").otherwise("valid")
    )
