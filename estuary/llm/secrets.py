"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression is parsed on the driver into a Boolean query of trigrams that every match must hold. The index holds, for each
trigram that any rule asks for, the list of texts that hold it, cut into shards by the texts' hashes so that no list grows with the data. A rule's
query intersects and unites the lists of a shard; the texts that it leaves are candidates, and only they are verified with the expression.
A rule without mandatory trigrams scans every text. Equal texts are one entry, and two texts of one hash are both candidates if either is, so the
index never loses a match. Texts are not moved: the candidates' hashes are sent to them, or shuffled where they are too many.

The offsets of matches come from what lies between them: split() gives the gaps, regexp_extract_all() the
matches, and their lengths add up, in chunks of chunks, so that the cost is linear. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, fresh, spread_join, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: in the dialect that Java and Python share. group: the part whose length must be at least least (0: the match)."""

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 1

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.fold else self.pattern


#: Fixed by the task's contract, in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)

#: A query is True, a trigram, ("and", ...) or ("or", ...).
Query = bool | str | tuple
MOST_STRINGS = 48


def _grams(strings: set[str]) -> Query:
    """What a text that holds one of the strings must hold."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in sorted(strings)])


def _join(how: str, parts: list[Query]) -> Query:
    if how == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    if how == "or":  # a part that asks for more than another adds nothing
        wants = {p: set(p[1:]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts}
        parts = [p for p in parts if not any(wants[q] < wants[p] for q in parts)]
    return True if not parts else parts[0] if len(parts) == 1 else (how, *parts)


def _strings(op: object, arg: object) -> set[str] | None:
    """All strings that a node matches, lower case, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        if any(o is not sre.LITERAL for o, _ in arg) or len(arg) > 8:
            return None
        return {chr(a).lower() for _, a in arg}
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 6 and (one := _sequence(arg[2])) is not None:
        found, last = set(), {""}
        for n in range(int(arg[1]) + 1):
            if n >= arg[0]:
                found |= last
            last = {a + b for a in last for b in one}
            if len(found) + len(last) > MOST_STRINGS:
                return None
        return found
    return None


def _sequence(items: object) -> set[str] | None:
    found = {""}
    for op, arg in items:
        s = _strings(op, arg)
        if s is None or len(found) * len(s) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in s}
    return found


def _inside(op: object, arg: object) -> Query:
    if op is sre.SUBPATTERN:
        return _query(arg[-1])
    if op is sre.BRANCH:
        return _join("or", [_query(x) for x in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
        return _query(arg[2])
    return True


def _query(items: object) -> Query:
    run, must = {""}, []
    for op, arg in items:
        s = _strings(op, arg)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        must += [_grams(run), _inside(op, arg) if s is None else _grams(s)]
        run = {""} if s is None else set(s)
    return _join("and", [*must, _grams(run)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that the lower-cased text of every match of pattern meets."""
    return _query(sre_parser.parse(pattern))


def trigrams(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams, query[1:]))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often use mentions it: it becomes a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Texts of an index shard, about.
SHARD = 4096


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def index(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """(shard, gram, texts, rows): the inverted index. texts: the sorted hashes of the shard's texts that hold gram (an index into grams), each with its
    number of rows. A row without any of the grams is in no list; a null text is an empty one."""
    body = text_or_empty(text)
    lowered = docs.select(text_key(body).alias("key"), F.lower(body).alias("lower"))
    held = _bound(F.col("lower"), lambda lower: F.filter(F.array(*[F.when(F.contains(lower, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull()))
    shards = max(1, docs.count() // SHARD)
    found = lowered.select("key", F.explode(held).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("rows"))
    entry = F.struct("key", "rows")
    return found.groupBy(F.pmod("key", F.lit(shards)).alias("shard"), "gram").agg(F.array_sort(F.collect_list(entry)).alias("texts"))


def _answer(query: Query, lists: dict[str, Column]) -> Column:
    """The texts of a shard that a query leaves: lists are intersected and united as the query says."""
    if isinstance(query, str):
        return lists[query]
    each = [_answer(q, lists) for q in query[1:]]
    out = each[0]
    for x in each[1:]:
        out = F.array_intersect(out, x) if query[0] == "and" else F.array_union(out, x)
    return out


def candidates(postings: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """(key, rules, rows): the texts that any rule's query leaves, with one bit for each such rule. Rules without mandatory trigrams have none."""
    none = F.array().cast("array<struct<key:bigint,rows:bigint>>")
    by_gram = postings.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "texts"))).alias("lists"))
    lists = {g: F.coalesce(F.try_element_at("lists", F.lit(i)), none) for i, g in enumerate(grams)}
    queries = [(1 << k, q) for k, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) is not True]
    left = by_gram.select(F.explode(F.array(*[F.struct(F.lit(bit).cast("long").alias("bit"), _answer(q, lists).alias("texts")) for bit, q in queries])).alias("a")) if queries else None
    if left is None:
        return postings.sparkSession.createDataFrame([], "key long, rules long, rows long")
    return left.select("a.bit", F.explode("a.texts").alias("t")).groupBy(F.col("t.key").alias("key")).agg(F.bit_or("bit").alias("rules"), F.first("t.rows").alias("rows"))


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


#: Elements that a fold appends to one array, and how often arrays are cut into such chunks: beyond CHUNK ** (LEVELS + 1) elements the top fold grows.
CHUNK, LEVELS = 64, 2


def running(values: Column, plus: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each of an array of longs, what plus makes of 0 and all values before it."""
    zero = F.lit(0).cast("long")

    def fold(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, state, lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    if not levels:
        return fold(values, zero)

    def cut(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))
        return _bound(chunks, lambda cs: _bound(running(F.transform(cs, lambda c: F.aggregate(c, zero, plus)), plus, levels - 1), lambda bases: F.flatten(F.zip_with(cs, bases, fold))))

    return _bound(values, lambda xs: F.when(F.size(xs) <= CHUNK, fold(xs, zero)).otherwise(cut(xs)))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All leftmost non-overlapping matches that pass the rule, as SPAN."""
    pattern = F.lit(rule.java)
    size = lambda found: F.transform(found, lambda s: F.char_length(s).cast("long"))
    gaps = size(F.split(text, rule.java, -1))
    whole = size(F.regexp_extract_all(text, pattern, F.lit(0)))
    value = size(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else whole

    def placed(m: Column) -> Column:
        steps = F.transform(m, lambda x: x["gap"] + x["whole"])
        starts = running(steps, lambda a, b: a + b)
        spans = F.zip_with(m, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["whole"]).alias("end"), F.lit(rule.kind).alias("kind"), x["value"].alias("value")))
        fit = F.filter(spans, lambda x: x["value"] >= rule.least)
        return F.transform(fit, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))

    matches = _bound(whole, lambda w: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(w)).alias("gap"), w.alias("whole"), (value if rule.group else w).alias("value")))
    return _bound(matches, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """docs with a column spans: every rule's spans by start, then by the rule's place, then by end.

    A null text is an empty one and has none; an empty table stays empty. No row is dropped or merged, repeated rows get the same spans each; all
    columns of docs stay (spans replaces one of its own name). The cost of a text is linear in its length and matches.
    """
    grams = vocabulary(rules)
    body = text_or_empty(text)
    own = fresh(docs.columns, "_may")
    key = fresh(docs.columns, "_key")
    indexed = docs.withColumn(own, F.lit(0).cast("long"))
    if grams:
        work = Scratch(docs.sparkSession)
        found = work.keep(candidates(index(docs, grams, text), rules, grams))
        keyed = docs.withColumn(key, text_key(body))
        named = found.select(F.col("key").alias(key), F.col("rules").alias(own), F.col("rows").alias("_rows"))
        if found.count() <= BROADCAST_ROWS:
            indexed = keyed.join(F.broadcast(named.drop("_rows")), key, "left").drop(key)
        else:
            count = fresh([*docs.columns, own, key], "_rows")
            indexed = spread_join(keyed, named.withColumnRenamed("_rows", count), [key], count, docs.count()).drop(key, count)
    none = F.from_json(F.lit("[]"), SPAN)
    each = []
    for rank, rule in enumerate(rules):
        may = F.rlike(body, F.lit(rule.java))
        if trigram_query(rule.pattern) is not True:
            may = (F.coalesce(F.col(own), F.lit(0)).bitwiseAND(F.lit(1 << rank)) != 0) & may
        each.append(F.when(may, spans_of(body, rule, rank)).otherwise(none))
    return indexed.withColumn(spans, F.array_sort(F.concat(*each))).drop(own)


PIECE = 1024


def pieces(text: Column) -> Column:
    """A text as an array of strings of PIECE characters, cut in steps of 64, so that no step walks the whole text for each of them."""

    def parts(size: int) -> Callable[[Column], Column]:
        return lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(t) - 1, F.lit(0)) / size).cast("int")), lambda i: F.substring(t, i * size + 1, F.lit(size)))

    out = F.array(text)
    for size in (PIECE * 4096, PIECE * 64, PIECE):
        out = F.flatten(F.transform(out, parts(size)))
    return out


def _between(cut: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text cut by pieces()."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor(F.greatest(end - 1, start) / PIECE).cast("int")
    near = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[secret]", spans: str = "secret_spans") -> DataFrame:
    """Replaces what spans cover by mark (once for spans that overlap); other texts, nulls among them, stay as they are."""

    def masked(found: Column, cut: Column) -> Column:
        ends = F.transform(found, lambda s: s["end"])
        reached = running(ends, lambda a, b: F.greatest(a, b))
        parts = F.zip_with(found, reached, lambda s, at: F.when(s["start"] >= at, F.concat(_between(cut, at, s["start"]), F.lit(mark))).otherwise(""))
        tail = _between(cut, F.array_max(ends), F.char_length(F.col(text)).cast("long"))
        return F.concat(F.array_join(parts, ""), tail)

    whole = _bound(F.col(spans), lambda found: _bound(pieces(F.col(text)), lambda cut: masked(found, cut)))
    return scanned.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text)))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts of the base kinds, their digest, and all spans; see scan() for odd rows."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(spans).alias("spans"))


def reference_spans(text: str | None, rules: tuple[Rule, ...] = BASE + MORE) -> list[tuple[str, int, int]]:
    """Brute force over one text, for tests."""
    found = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.I | re.A if rule.fold else 0):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, m.end(), rule.kind))
    return [(k, a, b) for a, _, b, k in sorted(found)]
