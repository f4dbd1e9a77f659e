"""Column functions of the domain: hashes, periods, reasons, text and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metric families by profile (fixed values).
PROFILE_METRICS = {
    "GENERAL": (("ebit_ev", "fcf_yield", "book_market"), ("gross_profitability", "roic", "cash_earnings")),
    "BANK": (("earnings_yield", "tangible_book", "net_payout"), ("roa", "cet1", "credit_quality")),
    "PC_INSURER": (("earnings_yield", "tangible_book", "net_payout"), ("operating_roe", "underwriting_margin", "earnings_stability")),
    "LIFE_INSURER": (("earnings_yield", "tangible_book", "net_payout"), ("operating_roe", "operating_roa", "earnings_stability")),
    "EQUITY_REIT": (("ffo_yield", "affo_yield", "ebitdare_yield"), ("noi_growth", "interest_coverage", "leverage_quality")),
}
#: Family weights by candidate (fixed values): value, quality, momentum.
WEIGHTS = {"primary": (0.5, 0.3, 0.2), "balanced": (0.4, 0.4, 0.2), "value_quality": (0.6, 0.4, 0.0), "pure_value": (1.0, 0.0, 0.0)}


def framed_hash(*fields: Column) -> Column:
    """SHA-256 over fields, each as UTF-8 behind its length in four big-endian bytes."""
    parts = []
    for f in fields:
        raw = F.coalesce(f.cast("string"), F.lit("")).cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")), raw]
    return F.sha2(F.concat(*parts), 256)


def content_hash(*fields: Column) -> Column:
    """SHA-256 of fields joined by line feeds."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def lines_hash(value: Column) -> Column:
    """SHA-256 of a group's values in order, each as length, colon, value and line feed. A group is one snapshot, of bounded size."""
    line = F.concat(F.length(value).cast("string"), F.lit(":"), value, F.lit("\n"))
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256)


def period_kind(start: Column, end: Column) -> Column:
    """ANNUAL, QUARTER, YEAR_TO_DATE, INSTANT or OTHER by length."""
    n = F.datediff(end, start) + 1
    return F.when(start.isNull(), "INSTANT").when(n.between(350, 380), "ANNUAL").when(n.between(70, 110), "QUARTER").when(n.between(111, 349), "YEAR_TO_DATE").otherwise("OTHER")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within low and high; null stays null."""
    bound = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.when(x.isNotNull(), F.greatest(bound(low), F.least(bound(high), x)))


def half_even(x: Column, digits: int) -> Column:
    """Rounded to digits, ties to even, on the decimal value."""
    return F.bround(x.cast(f"decimal(38,{digits + 6})"), digits).cast("double")


def listing_name(symbol: Column) -> Column:
    """Symbol as listings write it: upper case, dots and slashes as hyphens."""
    return F.regexp_replace(F.upper(F.trim(symbol)), "[./ ]", "-")


def padded_cik(number: Column) -> Column:
    """Ten-digit registrant number."""
    return F.lpad(F.regexp_replace(number.cast("string"), r"\D", ""), 10, "0")


def share_class(name: Column) -> Column:
    """CLASS_A and so on from a security's name."""
    letter = F.regexp_extract(F.upper(name), r"\b(?:CLASS|CL|SERIES)\s+([A-Z])\b", 1)
    return F.when(letter != "", F.concat(F.lit("CLASS_"), letter)).otherwise("UNSPECIFIED")


def reason_category(reason: Column) -> Column:
    """Family of a reason code: what stands before a colon decides."""
    code = F.substring_index(reason, ":", 1)
    return F.when(code.isin("INSUFFICIENT_HISTORY", "PRICE_BELOW_MINIMUM", "ILLIQUID", "MISSING_SCORE_DATE_BAR"), "MARKET").when(F.startswith(code, F.lit("STALE")), "FRESHNESS").when(F.startswith(code, F.lit("MISSING")) | (code == "NOT_REPORTED"), "INPUT").otherwise("OTHER")


def accounting_profile(sic: Column) -> Column:
    """Accounting profile of an industry code."""
    return F.when(sic == 6798, "EQUITY_REIT").when(sic.between(6020, 6099), "BANK").when(sic.between(6310, 6321), "LIFE_INSURER").when(sic.between(6322, 6399), "PC_INSURER").when(sic.between(6000, 6999), "FINANCIAL_OTHER").otherwise("GENERAL")


def new_york_date(at: Column) -> Column:
    """Trading date of an instant."""
    return F.to_date(F.from_utc_timestamp(at, "America/New_York"))


def reasons(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that hold, sorted; a null rule doesn't hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(rule, F.lit(code)) for rule, code in rules))))


def metric_parts(code: Column) -> tuple[Column, Column]:
    """Base and period type of a metric code such as ``revenue_ttm``."""
    base = F.regexp_replace(code, "_(ttm|prior|latest)$", "")
    kind = F.regexp_extract(code, "_(ttm|prior|latest)$", 1)
    return base, F.when(kind == "", "NONE").otherwise(F.upper(kind))


def explicit_offset(text: Column) -> Column:
    """Whether a timestamp text states its offset."""
    return text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
