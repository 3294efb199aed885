"""Wire records, as JSON text, to typed rows: trades, books, candles, contracts and payouts. What cannot be read is refused by a code, never repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import reasons

EXACT = "decimal(38,12)"

# Names under which venues send a field, the preferred first; operators by strike type; outcomes by result; book sides by outcome.
PRICE_NAMES = ("last_price_dollars", "last_price", "yes_price_dollars", "yes_price")
COUNT_NAMES = ("count_fp", "count")
OPERATORS = {"greater": "above", "greater_or_equal": "at_least", "less": "below", "less_or_equal": "at_most", "equal": "equal", "between": "range"}
RESULTS = {"yes": 1, "no": 0}
BOOK_SIDES = {"bid": "yes", "ask": "no"}
CANDLE_LEGS = ("open", "high", "low", "close")
CREDENTIAL_KEY = r"(?i)(?:^|[_-])(?:api[_-]?key|apikey|authoriz\w*|auth|bearer|cookie|credential|passwo?rd|private[_-]?key|secret|session[_-]?id|signature|token)(?:$|[_-])"


def exact(text: Column) -> Column:
    """A decimal that loses nothing; an empty or unreadable text is null."""
    return F.trim(text).try_cast(EXACT)


def whole_cents(text: Column) -> Column:
    """Dollars as whole cents; a value with a part of a cent is null rather than rounded."""
    scaled = exact(text) * 100
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _fields(body: str, names: str) -> Column:
    return F.from_json(F.col(body), ", ".join(f"{n} string" for n in names.split()))


def trades(messages: DataFrame, body: str = "body") -> DataFrame:
    """messages with contract, trade_id, price, size, is_block and refusal. The price is the first name that is sent; a record without
    a ticker, a price or a count is refused. The aggressor is not inferred."""
    r = messages.withColumn("_r", _fields(body, " ".join(["ticker", "trade_id", "is_block_trade", *PRICE_NAMES, *COUNT_NAMES])))
    price = exact(F.coalesce(*[F.col(f"_r.{n}") for n in PRICE_NAMES]))
    size = exact(F.coalesce(*[F.col(f"_r.{n}") for n in COUNT_NAMES]))
    ticker = F.when(F.col("_r.ticker") != "", F.col("_r.ticker"))
    refusal = F.when(ticker.isNull(), "no_ticker").when(price.isNull(), "no_price").when(size.isNull(), "no_count")
    return r.select(*messages.columns, ticker.alias("contract"), F.col("_r.trade_id").alias("trade_id"), price.alias("price"), size.alias("size"), F.col("_r.is_block_trade").try_cast("boolean").alias("is_block"), refusal.alias("refusal")).withColumns(
        {c: F.when(F.col("refusal").isNull(), F.col(c)) for c in ("price", "size")}
    )


def direction(legacy: Column, outcome: Column, book: Column) -> Column:
    """struct(agents, conflict): what the deprecated and the canonical side fields say, and whether they contradict each other; empty texts say nothing."""
    said = lambda x: F.when(x != "", x)
    agents = F.filter(F.array(said(legacy), said(outcome), _lookup(BOOK_SIDES, book)), lambda x: x.isNotNull())
    return F.struct(agents.alias("agents"), (F.size(F.array_distinct(agents)) > 1).alias("conflict"))


def levels(pairs: Column) -> Column:
    """struct(levels, refusal) of array<struct<price,size>> decimals: the levels, the lowest price first, unless one is not positive or a price repeats."""
    refusal = (
        F.when(F.exists(pairs, lambda x: x["price"].isNull() | x["size"].isNull()), "unreadable_level").when(F.exists(pairs, lambda x: x["price"] <= 0), "price_not_positive")
        .when(F.exists(pairs, lambda x: x["size"] <= 0), "size_not_positive").when(F.size(F.array_distinct(F.transform(pairs, lambda x: x["price"]))) < F.size(pairs), "duplicate_price")
    )
    return F.struct(F.when(refusal.isNull(), F.array_sort(pairs)).alias("levels"), refusal.alias("refusal"))


def books(messages: DataFrame, body: str = "body") -> DataFrame:
    """messages with bids and asks (array<struct<price,size>>, the best first) and refusal. The venue sends bids only: a no bid at p is a yes ask at 1 - p.
    A level without a positive price and size is no resting order and is passed over."""
    sides = "yes array<array<string>>, no array<array<string>>, yes_dollars array<array<string>>, no_dollars array<array<string>>"
    r = messages.withColumn("_r", F.from_json(F.col(body), f"orderbook_fp struct<{sides.replace(' array', ':array')}>, orderbook struct<{sides.replace(' array', ':array')}>"))
    fixed, plain = F.col("_r.orderbook_fp"), F.col("_r.orderbook")
    side = lambda name: F.when(fixed.isNotNull(), fixed[f"{name}_dollars"]).otherwise(plain[name])
    level = lambda xs: F.transform(xs, lambda x: F.struct(exact(F.get(x, F.lit(0))).alias("price"), exact(F.get(x, F.lit(1))).alias("size")))
    resting = lambda xs: F.filter(F.coalesce(xs, F.array().cast(f"array<struct<price:{EXACT},size:{EXACT}>>")), lambda x: (x["price"] > 0) & (x["size"] > 0))
    bids = F.reverse(F.array_sort(resting(level(side("yes")))))
    asks = F.transform(resting(level(side("no"))), lambda x: F.struct((F.lit(1).cast(EXACT) - x["price"]).cast(EXACT).alias("price"), x["size"].alias("size")))
    refusal = F.when(fixed.isNull() & plain.isNull(), "no_order_book")
    return r.select(*messages.columns, F.when(refusal.isNull(), bids).alias("bids"), F.when(refusal.isNull(), F.array_sort(F.filter(asks, lambda x: x["price"] > 0))).alias("asks"), refusal.alias("refusal"))


def candles(messages: DataFrame, live: bool, body: str = "body") -> DataFrame:
    """messages with period_end (microseconds), bid_, ask_ and trade_ legs, volume, open_interest, traded and refusal. live: the endpoint, which alone tells
    how leaves are named; a candle without its end is refused."""
    tail = "_dollars" if live else ""
    count = "_fp" if live else ""
    leaf = ", ".join(f"{x}{tail}:string" for x in (*CANDLE_LEGS, "mean", "previous"))
    spec = f"end_period_ts long, yes_bid struct<{leaf}>, yes_ask struct<{leaf}>, price struct<{leaf}>, volume{count} string, open_interest{count} string"
    r = messages.withColumn("_r", F.from_json(F.col(body), spec))
    out = {f"{to}_{x}": exact(F.col(f"_r.{of}.{x}{tail}")) for of, to in (("yes_bid", "bid"), ("yes_ask", "ask"), ("price", "trade")) for x in CANDLE_LEGS}
    out |= {"volume": exact(F.col(f"_r.volume{count}")), "open_interest": exact(F.col(f"_r.open_interest{count}"))}
    end = F.col("_r.end_period_ts") * 1_000_000
    return r.select(*messages.columns, end.alias("period_end"), *[e.alias(n) for n, e in out.items()], out["trade_close"].isNotNull().alias("traded"), F.when(end.isNull(), "no_period_end").alias("refusal"))


def candle_quotes(made: DataFrame, two_sided: bool = True) -> DataFrame:
    """Candles with bid, ask and validity at the candle's resolution: missing without both closes (if two_sided), crossed where the bid's is above the
    ask's, else valid. Sizes stay unknown; last_verified is the period's end, last_trade too where the period traded."""
    bid, ask = F.col("bid_close"), F.col("ask_close")
    missing = (bid.isNull() | ask.isNull()) & F.lit(two_sided)
    validity = F.when(missing, "missing").when(bid > ask, "crossed").otherwise("valid")
    return made.withColumns({"bid": bid, "ask": ask, "validity": validity, "last_verified": F.col("period_end"), "last_trade": F.when(F.col("traded"), F.col("period_end"))})


def candle_counts(made: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, two_sided, one_sided, trade_only): candles with both closes, those without, and of the latter the ones that only traded."""
    bid, ask = F.col("bid_close").isNotNull(), F.col("ask_close").isNotNull()
    return made.groupBy(*by).agg(F.count_if(bid & ask).alias("two_sided"), F.count_if(~(bid & ask)).alias("one_sided"), F.count_if(~bid & ~ask & F.col("traded")).alias("trade_only"))


def contracts(messages: DataFrame, body: str = "body") -> DataFrame:
    """messages with contract, event, operator, threshold, lower, upper, opened, closed, rule_hash and refusal. Strikes come from the strike fields, never
    from a price; a strike type without an operator, a threshold that is missing and a range without both ends are refused."""
    r = messages.withColumn("_r", _fields(body, "ticker event_ticker strike_type floor_strike cap_strike rules_primary rules_secondary open_time close_time"))
    f = lambda n: F.col(f"_r.{n}")
    operator, low, high = _lookup(OPERATORS, f("strike_type")), exact(f("floor_strike")), exact(f("cap_strike"))
    ranged = operator == "range"
    refusal = (
        F.when(f("ticker").isNull() | (f("ticker") == ""), "no_ticker").when(operator.isNull(), "strike_type_without_operator").when(ranged & (low.isNull() | high.isNull()), "range_without_both_ends")
        .when(~ranged & low.isNull(), "threshold_missing")
    )
    ok = refusal.isNull()
    shown = {"operator": operator, "threshold": F.when(~ranged, low), "lower": F.when(ranged, low), "upper": F.when(ranged, high)}
    rule = F.sha2(F.concat_ws("\x1f", F.coalesce(f("rules_primary"), F.lit("")), F.coalesce(f("rules_secondary"), F.lit(""))).cast("binary"), 256)
    return r.select(
        *messages.columns, f("ticker").alias("contract"), f("event_ticker").alias("event"), *[F.when(ok, e).alias(n) for n, e in shown.items()], F.unix_micros(F.try_to_timestamp(f("open_time"))).alias("opened"),
        F.unix_micros(F.try_to_timestamp(f("close_time"))).alias("closed"), F.when(f("rules_primary").isNotNull() | f("rules_secondary").isNotNull(), rule).alias("rule_hash"), refusal.alias("refusal"),
    )


def payouts(messages: DataFrame, body: str = "body") -> DataFrame:
    """messages with contract, payout, exceptional, resolved_at, known_at and refusal. yes pays 1, no pays 0, else the stated settlement value; any other value than
    0 and 1 is exceptional. When an outcome became known is not what a settlement states, so known_at is null."""
    r = messages.withColumn("_r", _fields(body, "ticker result settlement_value_dollars settlement_ts"))
    payout = F.coalesce(_lookup(RESULTS, F.col("_r.result")).cast(EXACT), exact(F.col("_r.settlement_value_dollars")))
    return r.select(
        *messages.columns, F.col("_r.ticker").alias("contract"), payout.alias("payout"), (~payout.isin(0, 1)).alias("exceptional"), F.unix_micros(F.try_to_timestamp(F.col("_r.settlement_ts"))).alias("resolved_at"),
        F.lit(None).cast("long").alias("known_at"), F.when(payout.isNull(), "no_result_and_no_value").alias("refusal"),
    )


def version_changes(left: str, right: str, rule: tuple[str, ...], lifecycle: tuple[str, ...]) -> Column:
    """struct(rule_differences, lifecycle_differences, comparable, note) of two vintages of a contract, structs named left and right: a changed rule makes another
    instrument, changed times under one rule do not."""
    differ = lambda names: F.filter(F.array(*[F.when(~F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    rules, times = differ(rule), differ(lifecycle)
    note = F.when(F.size(rules) > 0, "another_instrument").when(F.size(times) > 0, "lifecycle_differs").otherwise("identical")
    return F.struct(rules.alias("rule_differences"), times.alias("lifecycle_differences"), (F.size(rules) == 0).alias("comparable"), note.alias("note"))


def carries_credentials(metadata: Column) -> Column:
    """Whether any key of a map looks like a credential; such metadata may not be archived. No metadata carries none."""
    return F.coalesce(F.exists(F.map_keys(metadata), lambda k: k.rlike(CREDENTIAL_KEY)), F.lit(False))


def flattened(records: DataFrame, columns: dict[str, str], json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Columns from dotted paths of nested records (name -> path); those in json_columns are spelled as JSON, null staying null. A top-level field of the records that no
    path starts with raises, as what is undeclared would be lost."""
    used = {p.split(".")[0] for p in columns.values()}
    if extra := sorted(set(records.columns) - used):
        raise ValueError(f"undeclared fields {extra}")
    out = []
    for name, path in columns.items():
        x = F.col(path)
        out.append((F.when(x.isNotNull(), F.to_json(x)) if name in json_columns else x).alias(name))
    return records.select(*out)


def flags(*ladder: tuple[Column, str]) -> Column:
    """Every flag whose condition holds, joined by commas."""
    return F.array_join(reasons(*ladder), ",")
