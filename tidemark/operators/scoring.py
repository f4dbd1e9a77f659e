"""The full scoring model, from dated inputs to ranked composites, for any number of runs in one job.

Inputs are long rows (run, instrument, key, value, evidence); cards are a row per run and instrument (profile, flags, dates). Each input is
accepted or refused on its own, then one aggregate makes a wide row per card, and quantities are added as plain column expressions: a
null spreads by itself, and beside each quantity stands the reason of the first part that it lacks.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import PROFILE_METRICS, clamp, reasons
from tidemark.operators import model
from tidemark.operators.temporal import settle

# Fixed values of the model.
BALANCES = "TOTAL_ASSETS COMMON_EQUITY CASH DEBT_CURRENT DEBT_NONCURRENT PREFERRED_EQUITY MINORITY_INTEREST GOODWILL INTANGIBLES CET1_CAPITAL RISK_WEIGHTED_ASSETS NONACCRUAL_LOANS PAST_DUE_90_LOANS GROSS_LOANS TOTAL_ADJUSTED_CAPITAL AUTHORIZED_CONTROL_LEVEL_RBC".split()
BARS = ["RAW_CLOSE", "ADJUSTED_CLOSE"]
AREAS = ["OCCUPIED_AREA", "AVAILABLE_AREA"]
QUARTER_BACK = ["AFFO_PRIOR_TTM", "DIVIDENDS_DECLARED_PRIOR_TTM"]
YEAR_DAYS, QUARTER_DAYS = (350, 380), (70, 110)
PRICE_LEAST, VOLUME_LEAST, HISTORY_LEAST, LIQUIDITY_LEAST, FILING_OLDEST = 5, 5_000_000, 252, 20, 180
CET1_WARN, RBC_BROKEN, RBC_WARN, COMBINED_WARN = 0.01, 2, 3, 1.05
COVERAGE_BROKEN, COVERAGE_WARN, LEVERAGE_BROKEN, LEVERAGE_WARN, PAYOUT_BROKEN, PAYOUT_WARN = 1.5, 2, 10, 8, 1.2, 1
TAX_MOST = 0.4
ANCHORS = {"BANK": "cet1", "PC_INSURER": "rbc", "LIFE_INSURER": "rbc", "EQUITY_REIT": "ffo"}
FINANCIALS = ["BANK", "PC_INSURER", "LIFE_INSURER"]
SOFT = """INSUFFICIENT_VALUE_COVERAGE INSUFFICIENT_QUALITY_COVERAGE INSUFFICIENT_NORMALIZED_VALUE INSUFFICIENT_NORMALIZED_QUALITY INSUFFICIENT_NORMALIZED_MOMENTUM MISSING_MOMENTUM_BOUNDARY
INVALID_MARKET_CAP MISSING_INSTRUMENT_SHARES STALE_SHARES STALE INSUFFICIENT_HISTORY INSUFFICIENT_PRICE_HISTORY MISSING_PROFILE_ANCHOR NON_POSITIVE_EBITDARE MISSING_REQUIRED_METRIC:TOTAL_ASSETS""".split()
SOFT_STARTS = ("MODEL_NOT_SUPPORTED", "MISSING_SESSION:", "MISSING_RISK_INPUT:")
SOFT_SINCE = {"1.4": ["STALE_OR_MISSING_FILING"], "1.5": ["NON_PRIMARY_SHARE_CLASS", "INACTIVE_OR_UNSUPPORTED_SECURITY:DEPOSITARY_RECEIPT", "MULTI_CLASS_ISSUER_CAPITALIZATION_UNAVAILABLE"]}

#: Quantities of all profiles: sums of inputs, then quotients (top, bottom, added).
SHARED = {
    "debt": "DEBT_CURRENT + DEBT_NONCURRENT",
    "ev": "market_cap + debt + PREFERRED_EQUITY + MINORITY_INTEREST - CASH",
    "avg_assets": "0.5 * TOTAL_ASSETS + 0.5 * TOTAL_ASSETS_PRIOR",
    "momentum": ("MOMENTUM_RECENT", "MOMENTUM_OLD", -1.0),
}
GENERAL = {
    "ebit": "PRETAX_INCOME_TTM + INTEREST_EXPENSE_TTM",
    "fcf": "OPERATING_CASH_FLOW_TTM - CAPEX_TTM",
    "gross_profit": "REVENUE_TTM - COST_OF_REVENUE_TTM",
    "invested": "COMMON_EQUITY + PREFERRED_EQUITY + DEBT_CURRENT + DEBT_NONCURRENT + MINORITY_INTEREST - CASH",
    "invested_prior": "COMMON_EQUITY_PRIOR + PREFERRED_EQUITY_PRIOR + DEBT_CURRENT_PRIOR + DEBT_NONCURRENT_PRIOR + MINORITY_INTEREST_PRIOR - CASH_PRIOR",
    "avg_invested": "0.5 * invested + 0.5 * invested_prior",
    "nopat": "ebit * (1 - tax_rate)",
    "cash_over_income": "OPERATING_CASH_FLOW_TTM - NET_INCOME_TTM",
    "ebit_ev": ("ebit", "ev", 0.0),
    "fcf_yield": ("fcf", "market_cap", 0.0),
    "book_market": ("COMMON_EQUITY", "market_cap", 0.0),
    "gross_profitability": ("gross_profit", "avg_assets", 0.0),
    "roic": ("nopat", "avg_invested", 0.0),
    "cash_earnings": ("cash_over_income", "avg_assets", 0.0),
}
FINANCIAL = {
    "tce": "COMMON_EQUITY - GOODWILL - INTANGIBLES",
    "tce_prior": "COMMON_EQUITY_PRIOR - GOODWILL_PRIOR - INTANGIBLES_PRIOR",
    "avg_tce": "0.5 * tce + 0.5 * tce_prior",
    "payout": "COMMON_DIVIDENDS_TTM + COMMON_REPURCHASES_TTM - STOCK_ISSUANCE_TTM",
    "earnings_yield": ("NET_INCOME_COMMON_TTM", "market_cap", 0.0),
    "tangible_book": ("tce", "market_cap", 0.0),
    "net_payout": ("payout", "market_cap", 0.0),
    "roa": ("NET_INCOME_TTM", "avg_assets", 0.0),
    "cet1": ("CET1_CAPITAL", "RISK_WEIGHTED_ASSETS", 0.0),
    "bad_loans": "NONACCRUAL_LOANS + PAST_DUE_90_LOANS",
    "bad_share": ("bad_loans", "GROSS_LOANS", 0.0),
    "credit_quality": "-1 * bad_share",
    "operating_roe": ("OPERATING_INCOME_COMMON_TTM", "avg_tce", 0.0),
    "operating_roa": ("OPERATING_INCOME_TTM", "avg_assets", 0.0),
    "underwriting_cost": "LOSSES_LAE_TTM + UNDERWRITING_EXPENSE_TTM",
    "combined_ratio": ("underwriting_cost", "NET_PREMIUMS_TTM", 0.0),
    "underwriting_margin": "1 - combined_ratio",
    "rbc": ("TOTAL_ADJUSTED_CAPITAL", "AUTHORIZED_CONTROL_LEVEL_RBC", 0.0),
}
REIT = {
    "ffo": "NET_INCOME_COMMON_TTM + REAL_ESTATE_DA_TTM - REAL_ESTATE_GAINS_TTM + REAL_ESTATE_LOSSES_TTM + REAL_ESTATE_IMPAIRMENTS_TTM + FFO_JV_NCI_TTM",
    "affo": "ffo - MAINTENANCE_CAPEX_TTM - TENANT_IMPROVEMENTS_TTM - LEASING_COMMISSIONS_TTM - NONCASH_RENT_TTM",
    "ebitdare": "NET_INCOME_TTM + INTEREST_EXPENSE_TTM + TAX_EXPENSE_TTM + DA_TTM - PROPERTY_GAINS_TTM + PROPERTY_LOSSES_TTM + REAL_ESTATE_IMPAIRMENTS_TTM + EBITDARE_AFFILIATES_TTM",
    "net_debt": "debt - CASH",
    "ffo_yield": ("ffo", "market_cap", 0.0),
    "affo_yield": ("affo", "market_cap", 0.0),
    "ebitdare_yield": ("ebitdare", "ev", 0.0),
    "interest_coverage": ("ebitdare", "CASH_INTEREST_TTM", 0.0),
    "leverage": ("net_debt", "ebitdare", 0.0),
    "leverage_quality": "-1 * leverage",
    "affo_payout": ("DIVIDENDS_DECLARED_TTM", "affo", 0.0),
    "affo_payout_prior": ("DIVIDENDS_DECLARED_PRIOR_TTM", "AFFO_PRIOR_TTM", 0.0),
    "occupancy": ("OCCUPIED_AREA", "AVAILABLE_AREA", 0.0),
    "noi_growth": ("SAME_STORE_NOI_TTM", "SAME_STORE_NOI_PRIOR_TTM", -1.0),
}
GROUPS = {"SHARED": SHARED, "GENERAL": GENERAL, "FINANCIAL": FINANCIAL, "REIT": REIT}
_NAME = re.compile(r"[A-Za-z]\w*")


def why(name: str) -> str:
    """Column that holds the reason why a quantity is null."""
    return f"{name}__why"


def accept(inputs: DataFrame, cards: DataFrame, on: list[str]) -> DataFrame:
    """``inputs`` with ``reason``; the value of a refused input is null. Cards (cutoff, score_date, statement_end) meet inputs on ``on``: cards are hashed and inputs, of which there are many more, go by unsorted.

    The ladder: no value; value or evidence unsound; known or dated after the run; unit; then, by the kind of key, its date.
    """
    x = inputs.join(cards.select(*on, "cutoff", "score_date", "statement_end").hint("shuffle_hash"), on)
    key, end = F.col("key"), F.col("period_end")
    unit = F.when(F.startswith(key, F.lit("OPERATING_ROA_Q")) | F.startswith(key, F.lit("CET1_REQUIREMENT_")), "pure").when(key == "SHARES_OUTSTANDING", "shares").when(key.isin(AREAS), "square_feet").otherwise("USD")
    back = F.datediff("statement_end", "period_end")
    late = (F.col("available_at") > F.col("cutoff")) | (F.col("observed_at") > F.col("cutoff")) | (end > F.col("score_date"))
    unsound = F.isnan("value") | (F.abs("value") == float("inf")) | (F.coalesce("sources", F.lit(0)) < 1) | F.col("available_at").isNull() | F.col("observed_at").isNull() | end.isNull()
    in_force = (F.col("effective_from") <= F.col("score_date")) & (F.col("score_date") < F.col("effective_to"))
    dated = (
        F.when(key.isin(BARS), F.when(end != F.col("score_date"), "MISSING_SCORE_DATE_BAR"))
        .when(F.startswith(key, F.lit("CET1_REQUIREMENT_")), F.when(~F.coalesce(in_force, F.lit(False)), "STALE"))
        .when(F.endswith(key, F.lit("_PRIOR")) | (key == "SAME_STORE_NOI_PRIOR_TTM"), F.when(~back.between(*YEAR_DAYS), "INSUFFICIENT_HISTORY"))
        .when(key.isin(QUARTER_BACK), F.when(~back.between(*QUARTER_DAYS), "INSUFFICIENT_HISTORY"))
        .when(F.endswith(key, F.lit("_TTM")) | key.isin(BALANCES), F.when(back != 0, "STALE"))
    )
    reason = F.when(F.col("value").isNull(), "NOT_REPORTED").when(unsound, "FAILED_QUALITY_CHECK").when(late, "FUTURE_INFORMATION").when(~F.col("unit").eqNullSafe(unit), "INVALID_UNIT").otherwise(dated)
    return x.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), F.col("value"))).drop("cutoff", "score_date", "statement_end")


def keys_of(*groups: str) -> list[str]:
    """Inputs that the quantities of some groups read."""
    text = " ".join(x if isinstance(x, str) else f"{x[0]} {x[1]}" for g in ("SHARED", *groups) for x in GROUPS[g].values())
    return [*dict.fromkeys([*(n for n in _NAME.findall(text) if n.isupper()), *BARS, "SHARES_OUTSTANDING", "MEDIAN_DOLLAR_VOLUME"])]


#: Reasons of ``accept``, in order, and how many keys of a card are gathered in one row.
REFUSALS = ["FAILED_QUALITY_CHECK", "FUTURE_INFORMATION", "INSUFFICIENT_HISTORY", "INVALID_UNIT", "MISSING_SCORE_DATE_BAR", "NOT_REPORTED", "STALE"]
SLOTS = 4


def widen(accepted: DataFrame, cards: DataFrame, on: list[str], keys: list[str], dated: list[str] = (), more: dict[str, Column] | None = None) -> DataFrame:
    """Cards with a column per key and one for its reason; an absent input is not reported. ``dated`` keys also get their dates, and ``more`` are sums or counts of a card's inputs.

    A card's inputs are read once. They meet in blocks of SLOTS keys, by numbers alone, so that Spark hashes them and sorts none; an aggregate with a column per key would ask every row
    for every key. Of inputs with the same key the greatest parts count. The wide rows meet their cards unsorted as well.
    """
    more = more or {}
    code = reduce(lambda a, i: a.when(F.col("reason") == REFUSALS[i], i), range(1, len(REFUSALS)), F.when(F.col("reason") == REFUSALS[0], 0))
    parts = {"value": F.col("value"), "code": code} | ({"start": F.col("period_start"), "end": F.col("period_end")} if dated else {})
    places = accepted.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {i // SLOTS}, {i % SLOTS})" for i, k in enumerate(keys)) + " AS t(key, _block, _slot)")
    slots = {f"_{p}{j}": F.max(F.when(F.col("_slot") == j, c)) for j in range(SLOTS) for p, c in parts.items()}
    blocks = accepted.join(F.broadcast(places), "key", "left").groupBy(*on, "_block").agg(*(c.alias(n) for n, c in (slots | more).items()))
    block = F.when(F.col("_block").isNotNull(), F.struct("_block", F.struct(*slots)))
    packed = blocks.groupBy(*on).agg(F.map_from_entries(F.collect_list(block)).alias("_m"), *(F.sum(n).alias(n) for n in more))
    met = packed.join(cards.hint("shuffle_hash"), on, "right")
    found = met.select(*cards.columns, *more, *(F.try_element_at("_m", F.lit(b)).alias(f"_b{b}") for b in range(-(-len(keys) // SLOTS))))
    at = {k: lambda part, i=i: f"_b{i // SLOTS}._{part}{i % SLOTS}" for i, k in enumerate(keys)}
    told = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REFUSALS))
    columns = [x for k in keys for x in (F.col(at[k]("value")).alias(k), F.expr(f"CASE WHEN {at[k]('value')} IS NULL THEN CASE {at[k]('code')} {told} ELSE 'NOT_REPORTED' END END").alias(why(k)))]
    columns += [F.col(at[k](part)).alias(f"{k}__{part}") for k in dated for part in ("start", "end")]
    return found.select(*cards.columns, *more, *columns)


#: Quantities that are refused, when and why.
REFUSED = {
    "momentum": ("MOMENTUM_RECENT <= 0", "FAILED_QUALITY_CHECK"),
    "fcf": ("CAPEX_TTM < 0", "FAILED_QUALITY_CHECK"),
    "book_market": ("COMMON_EQUITY <= 0", "INVALID_DENOMINATOR"),
    "affo_payout_prior": ("NOT (AFFO_PRIOR_TTM__end <=> DIVIDENDS_DECLARED_PRIOR_TTM__end)", "INSUFFICIENT_HISTORY"),
}


def add(wide: DataFrame, quantities: dict[str, str | tuple[str, str, float]]) -> DataFrame:
    """``wide`` with each quantity and its reason: sums are null where a term is, quotients also where the bottom isn't positive, and all where REFUSED says so.

    Quantities are added in as few projections as they need each other: each projection copies the whole row.
    """
    terms = {n: list(dict.fromkeys(_NAME.findall(rule))) if isinstance(rule, str) else list(rule[:2]) for n, rule in quantities.items()}
    depth: dict[str, int] = {}
    for name in quantities:  # parts come before what is made of them
        depth[name] = 1 + max((depth[t] for t in terms[name] if t in depth), default=0)
    known = {*wide.columns, *(x for n in quantities for x in (n, why(n)))}

    def made(name: str) -> dict[str, Column]:
        rule = quantities[name]
        lacks = ", ".join(f"CASE WHEN {t} IS NULL THEN " + (f"coalesce({why(t)}, 'NOT_REPORTED')" if why(t) in known else "'NOT_REPORTED'") + " END" for t in terms[name])
        if isinstance(rule, str):
            value, reason = rule, f"coalesce({lacks})"
        else:
            top, bottom, added = rule
            value, reason = f"CASE WHEN {bottom} > 0 THEN {top} / {bottom} + {added}D END", f"coalesce({lacks}, CASE WHEN {bottom} <= 0 THEN 'INVALID_DENOMINATOR' END)"
        if name in REFUSED:
            bad, told = REFUSED[name]
            value, reason = f"CASE WHEN NOT coalesce({bad}, false) THEN {value} END", f"CASE WHEN {bad} THEN '{told}' ELSE {reason} END"
        return {name: F.expr(value), why(name): F.expr(reason)}

    for d in range(1, max(depth.values(), default=0) + 1):
        wide = wide.withColumns({c: x for n in quantities if depth[n] == d for c, x in made(n).items()})
    return wide


def capital(wide: DataFrame) -> DataFrame:
    """``market_cap``: close times shares, both above zero."""
    close, shares = F.col("RAW_CLOSE"), F.col("SHARES_OUTSTANDING")
    return wide.withColumns({"market_cap": F.when((close > 0) & (shares > 0), close * shares), why("market_cap"): F.lit(None).cast("string")})


def shared(wide: DataFrame) -> DataFrame:
    """Market value, debt, enterprise value, average assets, momentum."""
    return add(capital(wide), SHARED)


YEARS = [f"ANNUAL_{x}_{i}" for i in (1, 2, 3) for x in ("TAX", "PRETAX")]


def normal_tax(wide: DataFrame, statutory: DataFrame) -> DataFrame:
    """``tax_rate``: the middle one of three consecutive yearly rates within 0 and TAX_MOST, else the statutory rate (jurisdiction, effective_from, effective_to, rate) in force; ``tax_fallback`` tells. ``wide`` has YEARS with dates."""
    end = lambda i, x="TAX": F.col(f"ANNUAL_{x}_{i}__end")
    sound = [F.coalesce((F.col(f"ANNUAL_PRETAX_{i}") > 0) & F.col(f"ANNUAL_TAX_{i}").isNotNull() & (end(i) == end(i, "PRETAX")), F.lit(False)) for i in (1, 2, 3)]
    in_row = F.datediff("statement_end", end(1)).between(0, YEAR_DAYS[1]) & F.datediff(end(1), end(2)).between(*YEAR_DAYS) & F.datediff(end(2), end(3)).between(*YEAR_DAYS)
    rates = F.array_sort(F.array(*(F.try_divide(f"ANNUAL_TAX_{i}", f"ANNUAL_PRETAX_{i}") for i in (1, 2, 3))))
    own = F.when(reduce(lambda a, b: a & b, sound) & F.coalesce(in_row, F.lit(False)), clamp(rates[1], 0.0, TAX_MOST))
    law = statutory.select(F.col("jurisdiction").alias("_place"), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), F.col("rate").alias("_rate"))
    met = wide.join(law, (F.col("jurisdiction") == F.col("_place")) & (F.col("score_date") >= F.col("_from")) & (F.col("score_date") < F.col("_to")), "left")
    return met.withColumns({"tax_rate": F.coalesce(own, "_rate"), "tax_fallback": own.isNull() & F.col("_rate").isNotNull()}).drop("_place", "_from", "_to", "_rate")


def general(wide: DataFrame) -> DataFrame:
    """Metrics of the general profile. Negative investment makes free cash flow unsound; equity must be positive."""
    return add(wide, GENERAL)


QUARTERS = [f"OPERATING_ROA_Q{q}" for q in range(1, 13)]


def stability(wide: DataFrame) -> DataFrame:
    """``earnings_stability``: minus the deviation of twelve quarters that follow on each other up to the statement. ``wide`` has QUARTERS with dates."""
    chain = [F.col(f"{QUARTERS[0]}__end") == F.col("statement_end")]
    chain += [F.col(f"{b}__end") == F.date_sub(F.col(f"{a}__start"), 1) for a, b in zip(QUARTERS, QUARTERS[1:], strict=False)]
    chain += [(F.datediff(f"{q}__end", f"{q}__start") + 1).between(*QUARTER_DAYS) & F.col(q).isNotNull() for q in QUARTERS]
    whole = F.coalesce(reduce(lambda a, b: a & b, chain), F.lit(False))
    mean = reduce(lambda a, b: a + b, (F.col(q) for q in QUARTERS)) / len(QUARTERS)
    spread = reduce(lambda a, b: a + b, ((F.col(q) - mean) * (F.col(q) - mean) for q in QUARTERS)) / len(QUARTERS)
    return wide.withColumns({"earnings_stability": F.when(whole, -F.sqrt(spread)), why("earnings_stability"): F.when(~whole, "INSUFFICIENT_HISTORY")})


def risks(wide: DataFrame) -> tuple[list[tuple[Column, str]], list[tuple[Column, str]]]:
    """Rules that exclude and rules that warn, of all profiles: (holds, code). ``requirement`` is the summed capital requirement, null where one is missing or negative."""
    p, c = F.col("profile"), F.col
    bank, insurer, reit = p == "BANK", p.isin("PC_INSURER", "LIFE_INSURER"), p == "EQUITY_REIT"
    need, cover, lever, pay, before = c("requirement"), c("interest_coverage"), c("leverage"), c("affo_payout"), c("affo_payout_prior")
    paid = F.least(pay, before)  # both are there where this is asked
    broken = [
        (p.isin(FINANCIALS) & F.coalesce(c("tce") <= 0, F.lit(True)), "NON_POSITIVE_TANGIBLE_COMMON_EQUITY"),
        (bank & (need.isNull() | c("cet1").isNull()), "MISSING_CET1_REQUIREMENT"),
        (bank & (c("cet1") < need), "CET1_REQUIREMENT_BREACH"),
        (insurer & c("rbc").isNull(), "MODEL_NOT_SUPPORTED"),
        (insurer & (c("rbc") < RBC_BROKEN), "RBC_REGULATORY_RISK"),
        (reit & ~(c("reit_reconciled") & c("same_store_pool_consistent")), "MODEL_NOT_SUPPORTED"),
        (reit & F.coalesce(c("ebitdare") <= 0, F.lit(True)), "NON_POSITIVE_EBITDARE"),
        (reit & cover.isNull(), "MISSING_RISK_INPUT:interest_coverage"),
        (reit & (cover < COVERAGE_BROKEN), "REIT_INTEREST_COVERAGE_BREACH"),
        (reit & lever.isNull(), "MISSING_RISK_INPUT:leverage"),
        (reit & (lever > LEVERAGE_BROKEN), "REIT_LEVERAGE_BREACH"),
        (reit & (pay.isNull() | before.isNull()), "MISSING_RISK_INPUT:affo_payout"),
        (reit & pay.isNotNull() & before.isNotNull() & (paid > PAYOUT_BROKEN), "REIT_PAYOUT_BREACH"),
    ]
    warned = [
        (bank & (c("cet1") >= need) & (c("cet1") < need + CET1_WARN), "LOW_CET1_SURPLUS"),
        (insurer & (c("rbc") >= RBC_BROKEN) & (c("rbc") < RBC_WARN), "RBC_TREND_WARNING"),
        ((p == "PC_INSURER") & (c("combined_ratio") > COMBINED_WARN), "HIGH_COMBINED_RATIO"),
        (reit & (cover >= COVERAGE_BROKEN) & (cover < COVERAGE_WARN), "REIT_INTEREST_COVERAGE_WARNING"),
        (reit & (lever <= LEVERAGE_BROKEN) & (lever > LEVERAGE_WARN), "REIT_LEVERAGE_WARNING"),
        (reit & (pay > PAYOUT_WARN) & ((pay <= PAYOUT_BROKEN) | (before <= PAYOUT_BROKEN)), "REIT_PAYOUT_WARNING"),
    ]
    return broken, warned


def universal(wide: DataFrame) -> list[tuple[Column, str]]:
    """Gates of every profile: model, universe, security, price, liquidity, history, filing, market value."""
    c, no = F.col, lambda x: ~F.coalesce(F.col(x), F.lit(False))
    age = F.datediff("score_date", "filing_date")
    scope = c("profile").isin(FINANCIALS) & ~c("regulatory_scope").eqNullSafe("PUBLIC_PARENT")
    approach = (c("profile") == "BANK") & ~F.coalesce(c("capital_approach").isin("STANDARDIZED", "ADVANCED"), F.lit(False))
    return [
        (scope | approach | no("profile_supported") | ~F.coalesce(c("profile").isin(list(PROFILE_METRICS)), F.lit(False)), "MODEL_NOT_SUPPORTED"),
        (no("in_universe"), "NOT_IN_UNIVERSE"),
        (no("active"), "INACTIVE_SECURITY"),
        (no("primary_class"), "NON_PRIMARY_SHARE_CLASS"),
        (~c("security_type").eqNullSafe("COMMON_STOCK"), "UNSUPPORTED_SECURITY"),
        (c("ADJUSTED_CLOSE").isNull(), "NOT_REPORTED:ADJUSTED_CLOSE"),
        (c("ADJUSTED_CLOSE") < PRICE_LEAST, "PRICE_BELOW_MINIMUM"),
        (c("MEDIAN_DOLLAR_VOLUME").isNull(), "NOT_REPORTED:MEDIAN_DOLLAR_VOLUME"),
        (c("MEDIAN_DOLLAR_VOLUME") < VOLUME_LEAST, "ILLIQUID"),
        (F.coalesce(c("history_count"), F.lit(0)) < HISTORY_LEAST, "INSUFFICIENT_HISTORY"),
        (F.coalesce(c("liquidity_count"), F.lit(0)) < LIQUIDITY_LEAST, "INCOMPLETE_LIQUIDITY_WINDOW"),
        (~F.coalesce(age.between(0, FILING_OLDEST), F.lit(False)), "STALE"),
        (c("market_cap").isNull(), "INVALID_MARKET_CAP"),
    ]


def coverage(wide: DataFrame) -> list[tuple[Column, str]]:
    """Gates on what a profile's metrics cover: two of a family, momentum, the profile's anchor."""
    rules: list[tuple[Column, str]] = [(F.col("momentum").isNull() & F.col("profile").isin(list(PROFILE_METRICS)), "MISSING_MOMENTUM_BOUNDARY")]
    for profile, families in PROFILE_METRICS.items():
        mine = F.col("profile") == profile
        for family, names in zip(("VALUE", "QUALITY"), families, strict=True):
            rules.append((mine & (reduce(lambda a, b: a + b, (F.col(n).isNotNull().cast("int") for n in names)) < 2), f"INSUFFICIENT_{family}_COVERAGE"))
        if profile in ANCHORS:
            rules.append((mine & F.col(ANCHORS[profile]).isNull(), "MISSING_PROFILE_ANCHOR"))
    return rules


def gather(inputs: DataFrame, cards: DataFrame, on: list[str]) -> DataFrame:
    """Cards with all accepted inputs as columns, and ``requirement``: the sum of the inputs named CET1_REQUIREMENT_*, as many as the card's ``requirement_count`` (none: missing)."""
    accepted = accept(inputs, cards, on)
    keys = [*dict.fromkeys([*keys_of("GENERAL", "FINANCIAL", "REIT"), *YEARS, *QUARTERS])]
    named = F.startswith("key", F.lit("CET1_REQUIREMENT_"))
    need = {"_sum": F.sum(F.when(named, F.col("value"))), "_sound": F.count_if(named & (F.col("value") >= 0))}
    wide = widen(accepted, cards, on, keys, [*YEARS, *QUARTERS, *QUARTER_BACK], need)
    return wide.withColumn("requirement", F.when((F.col("requirement_count") > 0) & (F.col("_sound") == F.col("requirement_count")), F.col("_sum"))).drop("_sum", "_sound")


def assess(inputs: DataFrame, cards: DataFrame, on: list[str], statutory: DataFrame) -> DataFrame:
    """A row per card with all quantities, ``errors`` and ``warnings`` (sorted codes). Errors begin with the card's ``blocking_reasons``, if it has such a column."""
    return assess_wide(gather(inputs, cards, on), statutory)


def assess_wide(wide: DataFrame, statutory: DataFrame) -> DataFrame:
    """``assess`` of cards that have their inputs as columns (``gather``)."""
    wide = add(stability(capital(normal_tax(wide, statutory))), SHARED | GENERAL | FINANCIAL | REIT)
    broken, warned = risks(wide)
    tax = ((F.col("profile") == "GENERAL") & F.col("tax_fallback"), "STATUTORY_TAX_FALLBACK")
    errors = reasons(*universal(wide), *broken, *coverage(wide))
    if "blocking_reasons" in wide.columns:
        errors = F.concat(errors, F.coalesce("blocking_reasons", F.array().cast("array<string>")))
    return wide.withColumns({"errors": F.array_sort(F.array_distinct(errors)), "warnings": reasons(*warned, tax)})


def metric_rows(assessed: DataFrame, keep: list[str]) -> DataFrame:
    """Long rows (``keep``, family, metric, raw, reason) of the seven metrics of each row's profile; of no others where the profile is unknown."""
    one = lambda family, name: f"named_struct('family', '{family}', 'metric', '{name}', 'raw', {name}, 'reason', CASE WHEN {name} IS NULL THEN coalesce({why(name)}, 'NOT_REPORTED') END)"
    mine = lambda value, quality: "array(" + ", ".join([*(one("value", n) for n in value), *(one("quality", n) for n in quality), one("momentum", "momentum")]) + ")"
    choice = " ".join(f"WHEN '{p}' THEN {mine(*families)}" for p, families in PROFILE_METRICS.items())
    return assessed.select(*keep, F.explode(F.expr(f"CASE profile {choice} END")).alias("_m")).select(*keep, "_m.*")


def used(assessed: DataFrame) -> list[str]:
    """Columns that metric rows are made of."""
    names = dict.fromkeys(["momentum", *(n for families in PROFILE_METRICS.values() for f in families for n in f)])
    return [c for n in names for c in (n, why(n)) if c in assessed.columns]


def _levels(pool: Column, label: Column) -> list[tuple[Column, Column, int]]:
    """Cohort levels of a metric row: its peer group within the pool, then the pool."""
    peer = F.col("peer_group")
    return [(F.concat(F.lit("PRIMARY:"), peer), F.when(peer != "", F.concat_ws("|", pool, peer)), model.PEER), (label, pool, model.FALLBACK)]


def _too_few() -> Column:
    """Reasons of a card whose families have too few standardised metrics (n_value, n_quality, n_momentum)."""
    return reasons(*((F.col(f"n_{f}") < least, f"INSUFFICIENT_NORMALIZED_{f.upper()}") for f, least in (("value", 2), ("quality", 2), ("momentum", 1))))


def strict(assessed: DataFrame, run: list[str], ident: str, settled: bool = False) -> tuple[DataFrame, DataFrame]:
    """The strict model: standardised metric rows of the cards without errors, and a row per card with composite, ``eligible``, all ``errors`` and ``warnings``.

    Statistics come from those cards once: the peer group within the profile if it has ten, else the profile if it has twenty, of which PEER_FALLBACK:
    and the metric warns. Cards (unless ``settled``) and metric rows are settled in the checkpoint folder, for several aggregates read them.
    """
    assessed = assessed.select(*run, ident, "profile", "peer_group", "errors", "warnings", *used(assessed))
    assessed = assessed if settled else settle(assessed)
    base = metric_rows(assessed.filter(F.size("errors") == 0), [*run, ident, "profile", "peer_group"])
    pool = F.concat(F.lit("PROFILE:"), "profile")
    norm = settle(model.standardize(base, [*run, "metric"], _levels(pool, pool), "raw"))
    fell = F.when(F.startswith("cohort", F.lit("PROFILE:")), F.concat(F.lit("PEER_FALLBACK:"), "metric"))
    families = norm.groupBy(*run, ident).agg(*(model.exact_sum(F.when(F.col("family") == f, F.coalesce("z", F.lit(0.0)))).alias(f) for f in ("value", "quality", "momentum")), *(F.count(F.when(F.col("family") == f, F.col("z"))).alias(f"n_{f}") for f in ("value", "quality", "momentum")), F.collect_set(fell).alias("_fell"))
    scored = families.select(*run, ident, _too_few().alias("_short"), "_fell", (0.5 * F.col("value") / 3 + 0.3 * F.col("quality") / 3 + 0.2 * F.col("momentum")).alias("composite"))
    out = assessed.select(*run, ident, "errors", "warnings").join(scored, [*run, ident], "left")
    none = F.array().cast("array<string>")
    errors, warnings = (F.array_sort(F.array_distinct(F.concat(c, F.coalesce(more, none)))) for c, more in (("errors", "_short"), ("warnings", "_fell")))
    out = out.withColumns({"errors": errors, "warnings": warnings}).withColumn("eligible", F.size("errors") == 0).withColumn("composite", F.when(F.col("eligible"), F.col("composite"))).drop("_short", "_fell")
    return norm, out


#: Versions of the available-components model, and from which on momentum is compared over all prices, and issuers count once.
VERSIONS, PRICE_POOL_SINCE, ISSUER_SINCE = ["1.3", "1.4", "1.5"], "1.4", "1.5"
MULTI_CLASS = "MULTI_CLASS_ISSUER_CAPITALIZATION_UNAVAILABLE"


def assess_versions(inputs: DataFrame, cards: DataFrame, on: list[str], statutory: DataFrame, versions: list[str] = VERSIONS) -> DataFrame:
    """``assess`` for each version: a row per card and ``version``.

    From ISSUER_SINCE on an issuer with several cards in a run has no shares of its own class, and its cards carry MULTI_CLASS. Inputs are gathered once per card; only those
    cards are assessed twice, all others once for all versions. ``cards`` have issuer_id and blocking_reasons; the last of ``on`` tells the cards of a run apart.
    """
    done = _assess_split(inputs, cards, on, statutory, versions)
    return done.withColumn("version", F.explode("_versions")).drop("_versions")


def _assess_split(inputs: DataFrame, cards: DataFrame, on: list[str], statutory: DataFrame, versions: list[str]) -> DataFrame:
    """``assess_versions`` before a row is repeated for each of its ``_versions``."""
    several = F.count(F.lit(1)).over(Window.partitionBy(*on[:-1], "issuer_id")) > 1
    wide = gather(inputs, cards.withColumn("_several", several), on)
    early, late = ([v for v in versions if (v >= ISSUER_SINCE) == since] for since in (False, True))
    of = lambda names: F.array(*(F.lit(v) for v in names)).cast("array<string>")
    as_is, split = (F.struct(F.lit(s).alias("split"), of(v).alias("versions")) for s, v in ((False, early), (True, late)))
    wide = wide.withColumn("_as", F.explode(F.when(F.col("_several"), F.array(as_is, split)).otherwise(F.array(F.struct(F.lit(False).alias("split"), of(versions).alias("versions"))))))
    apart, shares = F.col("_as.split"), "SHARES_OUTSTANDING"
    wide = wide.withColumns({
        shares: F.when(~apart, F.col(shares)), why(shares): F.when(apart, "NOT_REPORTED").otherwise(F.col(why(shares))),
        "blocking_reasons": F.when(apart, F.concat("blocking_reasons", F.array(F.lit(MULTI_CLASS)))).otherwise(F.col("blocking_reasons")), "_versions": F.col("_as.versions"),
    })
    return assess_wide(wide.drop("_as", "_several"), statutory)


def soft(code: Column, version: Column) -> Column:
    """Whether a reason only limits a row under a version of the available-components model."""
    rules = [code.isin(SOFT), *(F.startswith(code, F.lit(s)) for s in SOFT_STARTS), *((version >= since) & code.isin(codes) for since, codes in SOFT_SINCE.items())]
    return reduce(lambda a, b: a | b, rules)


def available_components(assessed: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The reset of each row's ``version`` (1.3 to 1.5): cards with hard ``errors`` and ``warnings`` (LIMITATION: and the soft reasons), and their metric rows as far as they may be used.

    Rows outside a supported general profile keep momentum alone. Stale shares disable value, a stale filing all but momentum, missing
    sessions or a short history momentum. The last reason that applies is told.
    """
    price_only = ~(F.col("profile_supported") & (F.col("profile") == "GENERAL"))
    version = F.col("version")
    cards = assessed.withColumns({
        "_soft": F.filter("errors", lambda e: soft(e, version)),
        "_original": F.col("errors"),
        "errors": F.filter("errors", lambda e: ~soft(e, version)),
        "price_only": F.coalesce(price_only, F.lit(True)),
    })
    limits = F.transform("_soft", lambda e: F.concat(F.lit("LIMITATION:"), e))
    only = F.when(F.col("price_only"), F.array(F.lit("LIMITATION:PRICE_ONLY_UNSUPPORTED_ACCOUNTING_PROFILE"))).otherwise(F.array().cast("array<string>"))
    cards = cards.withColumn("warnings", F.array_sort(F.array_distinct(F.concat("warnings", limits, only))))
    had = lambda code: F.array_contains("_original", code)
    stale = had("STALE") | ((version >= "1.4") & had("STALE_OR_MISSING_FILING"))
    gaps = F.exists("_original", lambda e: F.startswith(e, F.lit("MISSING_SESSION:"))) | (F.coalesce(F.col("history_count"), F.lit(0)) < HISTORY_LEAST)
    cards = settle(cards.withColumns({"_shares": had("STALE_SHARES"), "_stale": stale, "_gaps": gaps}).select(*dict.fromkeys([*keep, "version", "profile", "errors", "warnings", "price_only", "_shares", "_stale", "_gaps", *used(assessed)])))
    rows = metric_rows(cards, [*dict.fromkeys([*keep, "version"]), "errors", "price_only", "_shares", "_stale", "_gaps", "profile"]).filter(~F.col("price_only") | (F.col("family") == "momentum"))
    disabled = F.when((F.col("family") == "momentum") & F.col("_gaps"), "INSUFFICIENT_HISTORY").when((F.col("family") != "momentum") & F.col("_stale"), "STALE_FILING").when((F.col("family") == "value") & F.col("_shares"), "STALE_SHARES")
    rows = rows.withColumns({"reason": F.coalesce(disabled, "reason"), "raw": F.when(disabled.isNull(), F.col("raw"))}).drop("price_only", "_shares", "_stale", "_gaps")
    return cards.drop("_shares", "_stale", "_gaps", *used(assessed)), rows


def insufficient(assessed: DataFrame, run: list[str], ident: str) -> DataFrame:
    """(``run``, ident, _short): the reasons that ``strict`` adds to a card without errors, whose metrics find too few cohorts. They follow from the sizes of cohorts, so no value is ordered or standardised."""
    base = metric_rows(assessed.filter(F.size("errors") == 0), [*run, ident, "profile", "peer_group"])
    pool = F.concat(F.lit("PROFILE:"), "profile")
    placed = model.place(base, [*run, "metric"], _levels(pool, pool), "raw")
    counts = placed.groupBy(*run, ident).agg(*(F.count_if((F.col("family") == f) & F.col("placed")).alias(f"n_{f}") for f in ("value", "quality", "momentum")))
    return counts.select(*run, ident, _too_few().alias("_short"))


def reset_versions(inputs: DataFrame, cards: DataFrame, on: list[str], statutory: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """``available_components`` of all versions in one plan, from inputs and cards: what the strict model finds in each version's own population is where the reset begins.

    Versions before ISSUER_SINCE have one population, and so have those after it: what the strict model finds is found once for each.
    """
    done = _assess_split(inputs, cards, on, statutory, VERSIONS)
    wanted = dict.fromkeys([*on, *keep, "profile", "profile_supported", "peer_group", "history_count", "errors", "warnings", "_versions", *used(done)])
    early = F.filter("_versions", lambda v: v < ISSUER_SINCE)
    sides = F.filter(F.array(early, F.array_except("_versions", early)), lambda a: F.size(a) > 0)
    each = settle(done.select(*wanted)).withColumn("_versions", F.explode(sides)).withColumn("_late", F.col("_versions")[0] >= ISSUER_SINCE)  # one settled row for all versions that share it, without the inputs
    by = ["_late", *on]
    told = each.join(insufficient(each, by[:-1], on[-1]).hint("shuffle_hash"), by, "left")  # the wide cards go by unsorted
    errors = F.array_sort(F.array_distinct(F.concat("errors", F.coalesce("_short", F.array().cast("array<string>")))))
    assessed = told.withColumn("errors", errors).withColumn("version", F.explode("_versions")).drop("_versions", "_late", "_short")
    return available_components(assessed, ["version", *on, *keep])


def versioned_cohorts(rows: DataFrame, run: list[str]) -> DataFrame:
    """Metric rows (version, ``run``, issuer_id, primary_class, profile, peer_group, family, metric, raw) of cards without errors, standardised in each version's cohorts, all in one pass.

    A metric is compared within its profile; momentum, from PRICE_POOL_SINCE on, over all prices of the run. In either pool the peer group comes first.
    From ISSUER_SINCE on statistics come from an issuer's primary classes, or from all its classes if none of them is primary and has a value.
    """
    universe = (F.col("version") >= PRICE_POOL_SINCE) & (F.col("family") == "momentum")
    pool = F.when(universe, F.lit("PRICE_UNIVERSE")).otherwise(F.concat(F.lit("PROFILE:"), "profile"))
    valued = F.col("primary_class") & F.col("raw").isNotNull()
    pooled, late = rows.withColumn("_pool", pool), F.coalesce(F.col("version") >= ISSUER_SINCE, F.lit(True))
    primary = F.max(valued.cast("int")).over(Window.partitionBy("version", *run, "metric", "_pool", "issuer_id")) == 1
    marked = pooled.filter(~late).withColumn("_primary", F.lit(False)).unionByName(pooled.filter(late).withColumn("_primary", primary))  # earlier versions ask nothing of an issuer's other classes
    fit = ~late | F.col("primary_class") | ~F.col("_primary")
    return model.standardize(marked, ["version", *run, "metric"], _levels(F.col("_pool"), F.col("_pool")), "raw", fit).drop("_pool", "_primary")
