"""Parsing of strings: figures, tickers, pages, predicates, digests."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DECIMAL = "decimal(18,12)"


def market_key(venue: Column, contract: Column) -> Column:
    return F.concat_ws("|", venue, contract)


def series_of(ticker: Column) -> Column:
    """What stands before the first dash."""
    return F.substring_index(ticker, "-", 1)


def strict_decimal(text: Column, kind: str = DECIMAL) -> Column:
    """A plain decimal literal; anything else (NaN, exponents, words) is null."""
    return F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), text.try_cast(kind))


def figure(text: Column) -> Column:
    """$1.2B, 3.4K, 1,250 as double; a dash is unknown, not zero."""
    clean = F.regexp_replace(F.trim(text), r"[$,]", "")
    number = F.regexp_extract(clean, r"(?i)^([+-]?\d+(?:\.\d+)?)([KMBT]?)$", 1)
    suffix = F.upper(F.regexp_extract(clean, r"(?i)^([+-]?\d+(?:\.\d+)?)([KMBT]?)$", 2))
    scale = F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9).when(suffix == "T", 1e12).otherwise(1.0)
    return F.when(number != "", number.cast("double") * scale)


def percent(text: Column) -> Column:
    """+0.98% as 0.0098."""
    number = F.regexp_extract(F.trim(text), r"^([+-]?\d+(?:\.\d+)?)%$", 1)
    return F.when(number != "", number.cast("double") / 100)


def visible_text(html: Column) -> Column:
    """Tags become spaces, scripts and styles go, runs of white space shrink."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def sentence_at(text: Column, position: Column) -> Column:
    """The sentence, from the full stop before to the one at or after the 1-based position, with white space shrunk. Other marks end no sentence."""
    before = F.substring(text, F.lit(1), position - 1)
    after = F.substring(text, position, F.char_length(text))
    head = F.regexp_extract(before, r"(?s)([^.]*)$", 1)
    return F.trim(F.regexp_replace(F.concat(head, F.regexp_extract(after, r"(?s)^([^.]*\.?)", 1)), r"\s+", " "))


def first_of(*columns: Column) -> Column:
    return F.coalesce(*columns)


def text_digest(*parts: Column) -> Column:
    """sha256 of the parts, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


def table_digest(spelled: Column) -> Column:
    """Aggregate: an order-free identity of rows. Each row is hashed; the hashes are summed by quarters, so that no
    group is gathered, and the count and the sums are hashed again."""
    sha = F.sha2(spelled.cast("binary"), 256)
    quarters = [F.sum(F.conv(F.substring(sha, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(q, F.lit(0)).cast("string") for q in quarters]).cast("binary"), 256)


# The first venue's payout texts, the subjects that its titles name, the longer first, and the codes of what is refused.
PAYOUT_ABOVE = r"^Above\s+([0-9]+(?:\.[0-9]+)?)%\s*$"
PAYOUT_BELOW = r"^([0-9]+(?:\.[0-9]+)?)%\s+or\s+below\s*$"
PAYOUT_STILL = r"(?i)^(Fed maintains rate|No change)$"
PAYOUT_CHANGE = r"(?i)^(Cut|Hike)\s+(>)?\s*([0-9]+)\s*bps\s*$"
PAYOUT_SUBJECTS = {"target federal funds rate": "target_level", "federal funds rate": "level"}
TEXT_UNREADABLE, SUBJECT_UNREADABLE, MONTH_UNKNOWN = "payout_text_unreadable", "rate_subject_unreadable", "month_not_in_calendar"
EXPIRY = r"^([A-Z]+)-([0-9]{2})([A-Z]{3})$"
MONTH_CODES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def payout_predicate(subtitle: Column, title: Column) -> Column:
    """struct(subject, threshold, inequality, orientation, refusal) of a rate contract's texts; the subtitle must be one form in full.

    Above R% -> the title's rate, above, +1; R% or below -> the title's rate, below, -1; no change -> change, 0; Cut|Hike [>]N bps -> signed
    basis points, with an inequality in the direction of the change only where > is written. Any other text is refused, and so is a level whose title names
    no rate; a refusal leaves the rest null.
    """
    x = F.trim(F.coalesce(subtitle, F.lit("")))
    above, below = F.regexp_extract(x, PAYOUT_ABOVE, 1), F.regexp_extract(x, PAYOUT_BELOW, 1)
    still = x.rlike(PAYOUT_STILL)
    verb, strict, points = (F.regexp_extract(x, PAYOUT_CHANGE, i) for i in (1, 2, 3))
    changes = still | (verb != "")
    named = F.coalesce(*[F.when(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(t)), F.lit(v)) for t, v in PAYOUT_SUBJECTS.items()])
    down = F.lower(verb) == "cut"
    level = (above != "") | (below != "")
    refusal = F.when(~level & ~changes, TEXT_UNREADABLE).when(level & named.isNull(), SUBJECT_UNREADABLE)
    signed = F.when(down, -points.try_cast("double")).otherwise(points.try_cast("double"))
    threshold = F.when(above != "", above.try_cast("double")).when(below != "", below.try_cast("double")).when(still, 0.0).otherwise(signed)
    inequality = F.when(above != "", "above").when(below != "", "below").when((verb != "") & (strict != ""), F.when(signed > 0, "above").otherwise("below"))
    ok = refusal.isNull()
    return F.struct(
        F.when(ok, F.when(level, named).otherwise("change")).alias("subject"), F.when(ok, threshold).alias("threshold"), F.when(ok, inequality).alias("inequality"),
        F.when(ok, F.when(below != "", -1).otherwise(1)).alias("orientation"), refusal.alias("refusal"),
    )


def decision_month(ticker: Column) -> Column:
    """yyyy-MM of a ticker SERIES-YYMMM; null where it has another form or names no month."""
    code = F.regexp_extract(ticker, EXPIRY, 3)
    number = F.array_position(F.array(*map(F.lit, MONTH_CODES)), code)
    return F.when(number > 0, F.concat(F.lit("20"), F.regexp_extract(ticker, EXPIRY, 2), F.lit("-"), F.lpad(number.cast("string"), 2, "0")))


def decision_date(ticker: Column, calendar: Column) -> Column:
    """struct(date, refusal): the meeting that a declared calendar (map from yyyy-MM) has for the ticker's month; a month that it lacks is refused."""
    date = F.try_element_at(calendar, decision_month(ticker))
    return F.struct(date.alias("date"), F.when(date.isNull(), MONTH_UNKNOWN).alias("refusal"))


def json_pointer(document: Column, pointer: Column) -> Column:
    """What an RFC 6901 pointer names, as JSON text; null where it names nothing."""

    @pandas_udf("string")
    def resolve(docs, pointers):  # noqa: ANN001, ANN202
        def one(doc: str | None, path: str | None) -> str | None:
            try:
                at = json.loads(doc)
                for part in path.split("/")[1:]:
                    part = part.replace("~1", "/").replace("~0", "~")
                    at = at[int(part)] if isinstance(at, list) else at[part]
                return json.dumps(at, sort_keys=True)
            except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                return None

        return docs.combine(pointers, one)

    return resolve(document, pointer)


# How the second venue states subject, form, strike, side, meeting and source. NUMBER and SIDES are parts of the others.
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
SIDES = {"above": 1, "high": 1, "or more": 1, "or higher": 1, "below": -1, "low": -1, "or lower": -1, "or less": -1, "≥": 1, "≤": -1}
SIDE = "(above|high|or more|or higher|below|low|or lower|or less)"
SUBJECT = r"(?i)upper bound of (?:the )?(?:federal reserve[’']s? )?target federal funds (?:range|rate)"
CHANGE_FORM = r"(?i)\bis (?:decreased|increased|changed)\b|amount of basis points|exactly the same as the level"
LEVEL_FORM = r"(?i)resolve(?:s)? (?:according to|to) the upper bound"
DESCRIBED_CHANGE = rf"(?i)\bis (decreased|increased)(?: by)?(?: exactly)? {NUMBER}( or more|\+)? basis points"
DESCRIBED_NONE = r"(?i)\bis exactly the same as the level"
ASKED_CHANGE = rf"(?i)\b(decreas\w*|cut\w*|lower\w*|reduc\w*|increas\w*|raise\w*|hike\w*)\b[^.?]{{0,80}}?\bby {NUMBER}(\+)? bps\b"
ASKED_NONE = r"(?i)\bno change\b"
TITLED_CHANGE = rf"(?i)^{NUMBER}(\+)? bps (decrease|increase)\??$"
TITLED_NONE = r"(?i)^no change\??$"
LEVEL = rf"(?:{SIDE}\s+{NUMBER}\s*%|(≥|≤)\s*{NUMBER}\s*%|{NUMBER}\s*%(?:\s*{SIDE})?)"
ASKED_LEVEL = rf"(?i)\b(?:be|hit|reach|stay)\s+{LEVEL}"
TITLED_LEVEL = rf"(?i)^{LEVEL}$"
MONTHS = "January February March April May June July August September October November December".split()
MONTH = "(" + "|".join(MONTHS) + ")"
MEETING = rf"(?i)(?:{MONTH}\s+([0-9]{{4}})|([0-9]{{4}})\s+{MONTH})[ ,]{{0,2}}(?:federal open market committee \(fomc\) )?meeting"
SOURCE = "(?i)resolution source"
SERVED = r"(?i)fomc[’']?s? statement|official information from the federal reserve"


def _matches(text: Column, pattern: str, groups: int) -> Column:
    """Every match as an array of its groups, groups that took no part as empty strings."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(f"g{i + 1}") for i in range(groups)])


def _changes(text: Column, pattern: str, none: str, direction: int, number: int, extension: int) -> Column:
    """array of struct(value, strict): signed basis points, strict where the text extends them."""

    def read(m: Column) -> Column:
        down = m[f"g{direction}"].rlike("(?i)^(decreas|cut|lower|reduc)")
        points = m[f"g{number}"].cast("double")
        return F.struct(F.when(down, -points).otherwise(points).alias("value"), (m[f"g{extension}"] != "").alias("strict"))

    still = F.when(text.rlike(none), F.array(F.struct(F.lit(0.0).alias("value"), F.lit(False).alias("strict"))))
    return F.concat(F.transform(_matches(text, pattern, 3), read), F.coalesce(still, F.array().cast("array<struct<value:double,strict:boolean>>")))


def _levels(text: Column, pattern: str) -> Column:
    """array of struct(value, side): the rate, and 1, -1 or 0 for the side that is stated."""

    def read(m: Column) -> Column:
        word = F.lower(F.concat(m["g1"], m["g3"], m["g6"]))
        side = F.coalesce(*[F.when(word == w, F.lit(s)) for w, s in SIDES.items()], F.lit(0))
        return F.struct(F.concat(m["g2"], m["g4"], m["g5"]).cast("double").alias("value"), side.alias("side"))

    return F.transform(_matches(text, pattern, 6), read)


def second_venue_predicate(question: Column, description: Column, group_title: Column, calendar: Column) -> Column:
    """struct(subject, threshold, inequality, orientation, period, horizon, refusal) of a market's three texts; nulls count as empty.

    The description must name the rate and a form, change or level. Every strike that the texts state (a level only in question and
    title) must agree, a level's side must be stated somewhere and agree where it is, month and year must be one, the calendar
    (map from yyyy-MM to a date) must hold that month, and a sentence on the resolution source must name an official statement. A change
    has an inequality only where the text extends it. The first failure is the refusal and leaves everything else null.
    """
    q, d, t = (F.coalesce(x, F.lit("")) for x in (question, description, group_title))
    said = F.concat(_changes(d, DESCRIBED_CHANGE, DESCRIBED_NONE, 1, 2, 3), _changes(q, ASKED_CHANGE, ASKED_NONE, 1, 2, 3), _changes(t, TITLED_CHANGE, TITLED_NONE, 3, 1, 2))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m.lower(), f"{i + 1:02d}")])
    periods = F.transform(F.concat(_matches(q, MEETING, 4), _matches(d, MEETING, 4)), lambda m: F.concat(m["g2"], m["g3"], F.lit("-"), F.try_element_at(months, F.lower(F.concat(m["g1"], m["g4"])))))
    served = F.exists(F.split(d, r"(?<=[.!?])\s+"), lambda s: s.rlike(SOURCE) & s.rlike(SERVED))
    read = F.struct(
        d.rlike(SUBJECT).alias("subject"), d.rlike(CHANGE_FORM).alias("change"), d.rlike(LEVEL_FORM).alias("level"), F.array_distinct(said).alias("said"), F.concat(_levels(q, ASKED_LEVEL), _levels(t, TITLED_LEVEL)).alias("levels"),
        F.array_distinct(periods).alias("periods"), served.alias("served"),
    )
    # What was read is bound to a lambda's variable, so that it is evaluated once and not for each mention.
    return F.transform(F.array(read), lambda r: _judged(r, calendar))[0]


def _judged(r: Column, calendar: Column) -> Column:
    change, one = r["change"], F.try_element_at(r["said"], F.lit(1))
    rates = F.array_distinct(F.transform(r["levels"], lambda x: x["value"]))
    sides = F.array_distinct(F.filter(F.transform(r["levels"], lambda x: x["side"]), lambda s: s != 0))
    period = F.try_element_at(r["periods"], F.lit(1))
    horizon = F.try_element_at(calendar, period)
    stated = F.when(change, F.size(r["said"])).otherwise(F.size(rates))
    refusal = (
        F.when(~r["subject"] | ~(change | r["level"]), "settlement_subject_unreadable").when(stated == 0, "threshold_unreadable").when(stated > 1, "threshold_statements_disagree")
        .when(~change & (F.size(sides) == 0), "yes_side_unreadable").when(~change & (F.size(sides) > 1), "yes_side_statements_disagree").when(F.size(r["periods"]) == 0, "reference_period_unreadable")
        .when(F.size(r["periods"]) > 1, "reference_period_statements_disagree").when(horizon.isNull(), "month_not_in_calendar").when(~r["served"], "resolution_basis_unreadable")
    )
    holds = refusal.isNull()
    value = F.when(change, one["value"]).otherwise(F.try_element_at(rates, F.lit(1)))
    inequality = F.when(change & one["strict"], F.when(one["value"] > 0, "above").otherwise("below"))
    return F.struct(
        F.when(holds, F.when(change, "change").otherwise("target_level")).alias("subject"), F.when(holds, value).alias("threshold"), F.when(holds, inequality).alias("inequality"),
        F.when(holds, F.when(change, 1).otherwise(F.try_element_at(sides, F.lit(1)))).alias("orientation"), F.when(holds, period).alias("period"), F.when(holds, horizon).alias("horizon"), refusal.alias("refusal"),
    )
