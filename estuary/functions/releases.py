"""What published pages state: values of releases, revisions, embargo instants, calendars, market pages and fee tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import figure, percent, strict_decimal, visible_text
from .times import micros

# Directions that a release names, and their signs; what states no change; what marks an annual figure; its zone and the note that states it.
DIRECTIONS = {
    "remained unchanged": 0, "changed little": 0, "was unchanged": 0, "were unchanged": 0, "edged up": 1, "edged down": -1, "increased": 1, "advanced": 1, "gained": 1, "decreased": -1, "declined": -1, "dropped": -1, "rose": 1, "fell": -1,
}
UNCHANGED = "(?:was unchanged|remained unchanged|were unchanged)"
NOT_ANNUAL = r"(?!\s*(?:over the (?:last|past|prior|year)|for the 12 months|for 12 months|12-month))"
PERCENT = r"(\d+(?:\.\d+)?)\s*percent"
ZONE, CALENDAR_NOTE = "America/New_York", "All times on calendar are Eastern Time"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# The statements that are read from a price release, in order: statistic -> (what stands before, what stands after, whether an unchanged one is zero).
CPI_STATEMENTS = {
    "cpi_headline_sa_mom_pct": (r"All Urban Consumers \(CPI-U\)", r"\s*on a seasonally adjusted basis", True),
    "cpi_core_sa_mom_pct": (r"(?:all items less food and energy|core)(?: index)?", "", True),
    "cpi_headline_nsa_yoy_pct": (r"all items index", r"\s*(?:for the (?:last )?12 months|over the (?:last|past|year|prior)|over the 12 months)", False),
    "cpi_core_nsa_yoy_pct": (r"all items less food and energy index", r"\s*(?:over the (?:last|past) 12 months|over the year|over the last year|for the 12 months|over the 12 months)", False),
}
JOBS = r"Total nonfarm payroll employment"
UNEMPLOYMENT = r"unemployment rate"
REVISION = r"(?i)(?:change in total nonfarm payroll employment for|the change(?:s)? (?:for|in))\s*([A-Z][a-z]+)\s+was\s+revised\s*(?:up|down)?\s*(?:by\s*\d[\d,]*)?\s*,?\s*from\s*([-+]?\d[\d,]*)\s*to\s*([-+]?\d[\d,]*)"
EMBARGO = r"(?is)^(.*?)(?:embargoed until|for release at)(.*)$"
EMBARGO_TIME = r"(?i)(\d{1,2}):(\d{2})\s*([ap])\.?m\.?\s*(?:\(ET\)|ET|Eastern Time)?\s*[A-Za-z]+,?\s*([A-Za-z]+)\s+(\d{1,2}),?\s*(\d{4})"
CALENDAR_ROW = r"(?is)<tr>\s*<td[^>]*>([^<]*)</td>\s*<td[^>]*>([^<]*)</td>\s*<td[^>]*>(.*?)</td>\s*</tr>"
# The header of a market page, its figures in the columns' order, what states no figure, and the refusals.
MARKET_HEADER = ("Exchange", "Symbol", "Price", "24h volume", "Open interest", "Funding / interval", "Funding APR", "Paid 24h", "Paid 7d", "Paid 30d")
MARKET_FIGURES = {"price": 2, "volume_24h_usd": 3, "open_interest_usd": 4, "funding_rate": 5, "funding_apr": 6, "paid_24h": 7, "paid_7d": 8, "paid_30d": 9}
DASHES = ("—", "–", "-", "--", "")
UNOBSERVED, UNPARSEABLE = "source_reported_no_figure", "figure_not_parseable"
BUILD_STAMP = r"Data generated at (\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)"


def _verbs() -> str:
    return "(" + "|".join(sorted(DIRECTIONS, key=lambda d: (-len(d), d))) + ")"


def _number(text: Column) -> Column:
    return F.regexp_replace(F.ltrim(F.regexp_replace(text, r"^\+", "")), ",", "").try_cast("decimal(38,12)")


def _signed(direction: Column, value: Column) -> Column:
    rises = F.lower(F.regexp_replace(direction, r"\s+", " ")).isin(*[d for d, s in DIRECTIONS.items() if s > 0])
    return F.when(value.isNotNull(), F.when(rises, value).otherwise(-value))


def directed(text: Column, prefix: str, unit: str, tail: str = "", unchanged: bool = False) -> Column:
    """The signed value of the first statement of that form: the verb is the sign. Where an unchanged statement counts, it is the zero that it states; no
    statement is null. An amount whose own tail makes it annual is not read as a monthly one."""
    pattern = rf"(?is){prefix}\s*{_verbs()}\s*(?:by\s*)?(?:to\s*)?(?:at\s*)?{unit}{tail}{NOT_ANNUAL}"
    value = _signed(F.regexp_extract(text, pattern, 1), _number(F.regexp_extract(text, pattern, 2)))
    still = text.rlike(rf"(?s){prefix}\s*{UNCHANGED}{tail}")
    return F.when(still, F.lit(0).cast("decimal(38,12)")).otherwise(value) if unchanged else value


def cpi_values(text: Column) -> Column:
    """map<string,decimal> of the changes that a price release states; statements that it lacks are absent."""
    found = [F.struct(F.lit(n).alias("key"), directed(text, before, PERCENT, after, zero).alias("value")) for n, (before, after, zero) in CPI_STATEMENTS.items()]
    return F.map_from_entries(F.filter(F.array(*found), lambda x: x["value"].isNotNull()))


def employment_values(text: Column) -> Column:
    """map<string,decimal> of what an employment release states: the change in jobs, also in thousands, and the unemployment rate, a level that no verb signs."""
    count = rf"{JOBS}\s*{_verbs()}\s*(?:by\s*)?(?:to\s*)?([\d,]+(?:\.\d+)?)"
    stated = _signed(F.regexp_extract(text, count, 1), _number(F.regexp_extract(text, count, 2)))
    jobs = F.when(stated.isNotNull(), stated).when(text.rlike(rf"{JOBS}\s*{UNCHANGED}"), F.lit(0).cast("decimal(38,12)"))
    rate = _number(F.regexp_extract(text, rf"{UNEMPLOYMENT}\s*{_verbs()}\s*(?:at|to)?\s*(?:by\s*)?{PERCENT}", 2))
    found = {"payrolls_change_jobs": jobs, "payrolls_change_thousands": (jobs / 1000).cast("decimal(38,12)"), "unemployment_rate_pct": rate}
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), x.alias("value")) for n, x in found.items()]), lambda x: x["value"].isNotNull()))


def revisions(text: Column) -> Column:
    """array<struct<month, prior, revised>>: each earlier month that a release revises with both levels, in jobs."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(REVISION), F.lit(i)).alias(n) for i, n in ((1, "month"), (2, "prior"), (3, "revised"))])
    return F.transform(parts, lambda m: F.struct(F.initcap(m["month"]).alias("month"), _number(m["prior"]).alias("prior"), _number(m["revised"]).alias("revised")))


def _month(name: Column) -> Column:
    short = F.substring(F.lower(name), 1, 3)
    known = F.lower(name).isin(*MONTHS) | F.lower(name).isin(*[m[:3] for m in MONTHS], "sept")
    return F.when(known, F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short))


def _instant(year: Column, month: Column, day: Column, hour: Column, minute: Column, half: Column) -> Column:
    """Microseconds of a local time in the release's zone; null where any part is."""
    hours = hour.try_cast("int") % 12 + F.when(F.lower(half).startswith("p"), 12).otherwise(0)
    local = F.try_make_timestamp_ntz(year.try_cast("int"), month.cast("int"), day.try_cast("int"), hours, minute.try_cast("int"), F.lit(0).cast("decimal(16,6)"))
    return micros(F.convert_timezone(F.lit(ZONE), F.lit("UTC"), local))


def embargo_instant(text: Column) -> Column:
    """The instant that a release's own embargo line states, in microseconds; null where the line, or a part of it, is missing. The line's block ends at its first
    blank line, and the release's number in it is passed over."""
    block = F.regexp_replace(F.regexp_extract(text, EMBARGO, 2), r"(?s)\n\s*\n.*$", "")
    header = F.regexp_replace(F.regexp_replace(block, r"\bUSDL-\d{2}-\d{3,5}\b", " "), r"\s+", " ")
    part = lambda i: F.regexp_extract(header, EMBARGO_TIME, i)
    return F.when(text.rlike(EMBARGO) & header.rlike(EMBARGO_TIME), _instant(part(6), _month(part(4)), part(5), part(1), part(2), part(3)))


def calendar_rows(pages: DataFrame, html: str) -> DataFrame:
    """(pages' other columns, title, family, period, scheduled, revised, refusal) for each release row of calendar pages; a page that does not state its zone is one
    refused row, for a time without a zone is no instant."""
    keep = [c for c in pages.columns if c != html]
    zoned = F.contains(F.lower(html), F.lit(CALENDAR_NOTE.lower()))
    cells = F.arrays_zip(*[F.regexp_extract_all(F.col(html), F.lit(CALENDAR_ROW), F.lit(i)).alias(f"c{i}") for i in (1, 2, 3)])
    rows = pages.withColumn("_z", zoned).withColumn("_c", F.explode_outer(F.when(F.col("_z"), cells)))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))
    date, time, text = (clean(F.col(f"_c.c{i}")) for i in (1, 2, 3))
    d = lambda i: F.regexp_extract(date, r"[A-Za-z]+,\s*([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})", i)
    t = lambda i: F.regexp_extract(time, r"(\d{1,2}):(\d{2})\s*([AaPp][Mm])", i)
    whole = (d(1) != "") & (t(1) != "") & (text != "")
    period_of = r"for (?:the )?([A-Za-z]+ ?-? ?\d{4})"
    period = F.regexp_extract(text, period_of, 1)
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"(?s)for (?:the )?[A-Za-z]+ ?-? ?\d{4}.*$", "")), r"\s*\((?:R|P)\)\s*$", ""))
    title = F.when(period != "", bare).otherwise(F.trim(F.regexp_replace(text, r"\s*\((?:R|P)\)\s*$", "")))
    family = F.when(F.contains(F.lower(title), F.lit("consumer price index")) | (F.lower(title) == "cpi"), "cpi").when(F.contains(F.lower(title), F.lit("employment situation")) | (F.lower(title) == "empsit"), "empsit").otherwise(F.replace(F.lower(title), F.lit(" "), F.lit("_")))
    month = _month(d(1))
    refusal = F.when(~F.col("_z"), "page_states_no_zone").when(month.isNull(), "unrecognised_month")
    ok = F.col("_z")
    return rows.where(~F.col("_z") | whole).select(
        *keep, F.when(ok, title).alias("title"), F.when(ok, family).alias("family"), F.when(ok & (period != ""), period).alias("period"), F.when(ok, _instant(d(3), month, d(2), t(1), t(2), t(3))).alias("scheduled"),
        F.when(ok, F.contains(text, F.lit("(R)"))).alias("revised"), refusal.alias("refusal"),
    )


def market_quotes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Quotes of market pages from their table rows (by, table, row, cells, as sources.archive.table_rows gives them): venue, symbol, the figures and refusals.

    The table is the first whose header is the declared one, cell for cell. A venue is its link's text or its name. A figure that the source did not
    report is null and refused as unobserved, any other that cannot be read as unparseable; a zero is a zero.
    """
    header = rows.where((F.col("row") == 0) & (F.col("cells") == F.array(*map(F.lit, MARKET_HEADER)))).groupBy(*by).agg(F.min("table").alias("table"))
    body = rows.where("row > 0").join(header, [*by, "table"])
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    link = F.regexp_extract(cell(0), r"\[([^\]]+)\]\(([^)]+)\)", 1)
    venue = F.trim(F.when(link != "", link).otherwise(cell(0)))
    read = {"price": lambda x: strict_decimal(F.replace(x, F.lit(","), F.lit("")), "decimal(38,12)").cast("double"), "volume_24h_usd": figure, "open_interest_usd": figure}
    values = {n: read.get(n, percent)(cell(i)) for n, i in MARKET_FIGURES.items()}
    refusals = F.filter(F.array(*[F.when(x.isNull(), F.concat(F.lit(f"{n}:"), F.when(F.trim(cell(MARKET_FIGURES[n])).isin(*DASHES), UNOBSERVED).otherwise(UNPARSEABLE))) for n, x in values.items()]), lambda x: x.isNotNull())
    return body.where(venue != "").select(*by, venue.alias("venue"), cell(1).alias("symbol"), *[x.alias(n) for n, x in values.items()], refusals.alias("refusals"))


def build_stamp(text: Column) -> Column:
    """The instant at which a page was generated, in microseconds; a page without the stamp cannot be placed in time (null)."""
    stamp = F.regexp_extract(text, BUILD_STAMP, 1)
    return F.when(stamp != "", F.unix_micros(F.try_to_timestamp(stamp)))


def fee_rows(rows: DataFrame, by: list[str], tier: str, tiers: str, pair: str) -> DataFrame:
    """(by, tier, maker, taker, refusal) of fee tables' rows (by, table, row, cells): the one table whose first header cell is ``tier`` and of whose other cells exactly
    one begins with ``pair``; rows whose tier matches ``tiers`` in full. A pair that is not N%/N% below one, a row of another width or a tier that comes
    twice is refused."""
    heads = rows.where("row = 0").withColumn("_at", F.filter(F.transform("cells", lambda x, i: F.when(x.startswith(pair) & ~F.contains(x, F.lit("BNB")), i)), lambda x: x.isNotNull()))
    fit = heads.where((F.get("cells", F.lit(0)) == tier) & (F.size("_at") == 1)).select(*by, "table", F.get("_at", F.lit(0)).alias("_at"), F.size("cells").alias("_width"))
    one = fit.groupBy(*by).agg(F.count("*").alias("_n"), F.min(F.struct("table", "_at", "_width")).alias("_h")).select(*by, "_n", "_h.*")
    body = rows.where("row > 0").join(one, [*by, "table"]).where(F.get("cells", F.lit(0)).rlike(tiers))
    name, text = F.get("cells", F.lit(0)), F.get("cells", F.col("_at"))
    rate = lambda i: F.regexp_extract(text, r"^(\d+(?:\.\d+)?)%/(\d+(?:\.\d+)?)%$", i).try_cast("decimal(18,12)") / 100
    times = body.groupBy(*by, name.alias("_tier")).agg(F.count("*").alias("_times"))
    read = body.withColumns({"_tier": name, "maker": rate(1).cast("decimal(18,12)"), "taker": rate(2).cast("decimal(18,12)")}).join(times, [*by, "_tier"])
    bad = F.coalesce((F.col("maker") >= 1) | (F.col("taker") >= 1), F.lit(True))
    refusal = F.when(F.col("_n") != 1, "several_fee_tables").when((F.size("cells") != F.col("_width")) | (F.col("_times") > 1), "ambiguous_tier_row").when(bad, "invalid_fee_pair")
    return read.select(*by, F.col("_tier").alias("tier"), *[F.when(refusal.isNull(), F.col(c)).alias(c) for c in ("maker", "taker")], refusal.alias("refusal"))


def release_text(html: Column) -> Column:
    return visible_text(html)
