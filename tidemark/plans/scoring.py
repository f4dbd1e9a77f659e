"""The full scoring model over yearly cross-sections of the input tables: acceptance, metrics of every profile, gates, cohorts, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import PROFILE_METRICS
from tidemark.operators import model, screener
from tidemark.operators import scoring as M
from tidemark.operators.temporal import settle
from tidemark.plans.views import Registry, Views

R = Registry()
ON = ["run", "instrument_id"]
LAW = "SELECT * FROM VALUES ('US', DATE'1996-01-01', DATE'2001-01-01', 0.35D), ('US', DATE'2001-01-01', DATE'2027-01-01', 0.21D) AS t(jurisdiction, effective_from, effective_to, rate)"
KEYS = [*dict.fromkeys([*M.keys_of("GENERAL", "FINANCIAL", "REIT"), *M.YEARS, *M.QUARTERS])]

ACCEPTED = """a AS (SELECT run, instrument_id, key, CASE WHEN reason IS NULL THEN value END AS value, reason, period_start, period_end FROM (
  SELECT i.*, CASE WHEN value IS NULL THEN 'NOT_REPORTED' WHEN sources < 1 THEN 'FAILED_QUALITY_CHECK'
    WHEN available_at > cutoff OR observed_at > cutoff OR period_end > score_date THEN 'FUTURE_INFORMATION'
    WHEN unit <> CASE WHEN key LIKE 'OPERATING\\_ROA\\_Q%' ESCAPE '\\' OR key LIKE 'CET1\\_REQUIREMENT\\_%' ESCAPE '\\' THEN 'pure' WHEN key = 'SHARES_OUTSTANDING' THEN 'shares' WHEN key IN ('OCCUPIED_AREA', 'AVAILABLE_AREA') THEN 'square_feet' ELSE 'USD' END THEN 'INVALID_UNIT'
    WHEN key IN ('RAW_CLOSE', 'ADJUSTED_CLOSE') THEN CASE WHEN period_end <> score_date THEN 'MISSING_SCORE_DATE_BAR' END
    WHEN starts_with(key, 'CET1_REQUIREMENT_') THEN CASE WHEN NOT (effective_from <= score_date AND score_date < effective_to) THEN 'STALE' END
    WHEN key LIKE '%\\_PRIOR' ESCAPE '\\' OR key = 'SAME_STORE_NOI_PRIOR_TTM' THEN CASE WHEN statement_end - period_end NOT BETWEEN 350 AND 380 THEN 'INSUFFICIENT_HISTORY' END
    WHEN key IN ('AFFO_PRIOR_TTM', 'DIVIDENDS_DECLARED_PRIOR_TTM') THEN CASE WHEN statement_end - period_end NOT BETWEEN 70 AND 110 THEN 'INSUFFICIENT_HISTORY' END
    WHEN key LIKE '%\\_TTM' ESCAPE '\\' OR key IN ('TOTAL_ASSETS', 'COMMON_EQUITY', 'CASH', 'DEBT_CURRENT', 'DEBT_NONCURRENT', 'PREFERRED_EQUITY', 'MINORITY_INTEREST', 'GOODWILL', 'INTANGIBLES', 'CET1_CAPITAL', 'RISK_WEIGHTED_ASSETS', 'NONACCRUAL_LOANS', 'PAST_DUE_90_LOANS', 'GROSS_LOANS', 'TOTAL_ADJUSTED_CAPITAL', 'AUTHORIZED_CONTROL_LEVEL_RBC')
      THEN CASE WHEN period_end <> statement_end THEN 'STALE' END END AS reason
  FROM b_inputs i JOIN b_cards c ON i.run = c.run AND i.instrument_id = c.instrument_id) x)"""
PIVOT = "p AS (SELECT run, instrument_id, " + ", ".join(f"max(value) FILTER (key = '{k}') AS {k}, max(reason) FILTER (key = '{k}') AS {k}__why" for k in KEYS) + ", " + ", ".join(f"max(period_end) FILTER (key = '{k}') AS {k}__end, max(period_start) FILTER (key = '{k}') AS {k}__start" for k in [*M.YEARS, *M.QUARTERS, *M.QUARTER_BACK]) + """,
  sum(value) FILTER (starts_with(key, 'CET1_REQUIREMENT_')) AS need, count(*) FILTER (starts_with(key, 'CET1_REQUIREMENT_') AND value >= 0) AS needs FROM a GROUP BY 1, 2),
w AS (SELECT c.*, p.* EXCLUDE (run, instrument_id) FROM b_cards c LEFT JOIN p ON c.run = p.run AND c.instrument_id = p.instrument_id),
s1 AS (SELECT *, CASE WHEN RAW_CLOSE > 0 AND SHARES_OUTSTANDING > 0 THEN RAW_CLOSE * SHARES_OUTSTANDING END AS market_cap, DEBT_CURRENT + DEBT_NONCURRENT AS debt FROM w),
s2 AS (SELECT *, market_cap + debt + PREFERRED_EQUITY + MINORITY_INTEREST - CASH AS ev, (TOTAL_ASSETS + TOTAL_ASSETS_PRIOR) / 2 AS avg_assets,
  CASE WHEN MOMENTUM_OLD > 0 AND MOMENTUM_RECENT > 0 THEN MOMENTUM_RECENT / MOMENTUM_OLD - 1 END AS momentum FROM s1)"""
TAX = """t1 AS (SELECT *, CASE WHEN ANNUAL_TAX_1 IS NOT NULL AND ANNUAL_TAX_2 IS NOT NULL AND ANNUAL_TAX_3 IS NOT NULL AND ANNUAL_PRETAX_1 > 0 AND ANNUAL_PRETAX_2 > 0 AND ANNUAL_PRETAX_3 > 0
    AND ANNUAL_TAX_1__end = ANNUAL_PRETAX_1__end AND ANNUAL_TAX_2__end = ANNUAL_PRETAX_2__end AND ANNUAL_TAX_3__end = ANNUAL_PRETAX_3__end
    AND statement_end - ANNUAL_TAX_1__end BETWEEN 0 AND 380 AND ANNUAL_TAX_1__end - ANNUAL_TAX_2__end BETWEEN 350 AND 380 AND ANNUAL_TAX_2__end - ANNUAL_TAX_3__end BETWEEN 350 AND 380
    THEN greatest(0, least(0.4, list_sort([ANNUAL_TAX_1 / ANNUAL_PRETAX_1, ANNUAL_TAX_2 / ANNUAL_PRETAX_2, ANNUAL_TAX_3 / ANNUAL_PRETAX_3])[2])) END AS own_rate,
  CASE WHEN jurisdiction = 'US' AND score_date >= DATE '2001-01-01' THEN 0.21 WHEN jurisdiction = 'US' AND score_date >= DATE '1996-01-01' THEN 0.35 END AS law_rate FROM s2),
g AS (SELECT *, PRETAX_INCOME_TTM + INTEREST_EXPENSE_TTM AS ebit, CASE WHEN CAPEX_TTM >= 0 THEN OPERATING_CASH_FLOW_TTM - CAPEX_TTM END AS fcf,
  COMMON_EQUITY + PREFERRED_EQUITY + DEBT_CURRENT + DEBT_NONCURRENT + MINORITY_INTEREST - CASH AS inv1, COMMON_EQUITY_PRIOR + PREFERRED_EQUITY_PRIOR + DEBT_CURRENT_PRIOR + DEBT_NONCURRENT_PRIOR + MINORITY_INTEREST_PRIOR - CASH_PRIOR AS inv0, CAST(coalesce(own_rate, law_rate) AS DOUBLE) AS tax_rate FROM t1),
gm AS (SELECT *, CASE WHEN ev > 0 THEN ebit / ev END AS ebit_ev, CASE WHEN market_cap > 0 THEN fcf / market_cap END AS fcf_yield, CASE WHEN market_cap > 0 AND COMMON_EQUITY > 0 THEN COMMON_EQUITY / market_cap END AS book_market,
  CASE WHEN avg_assets > 0 THEN (REVENUE_TTM - COST_OF_REVENUE_TTM) / avg_assets END AS gross_profitability, CASE WHEN inv1 + inv0 > 0 THEN ebit * (1 - tax_rate) / ((inv1 + inv0) / 2) END AS roic,
  CASE WHEN avg_assets > 0 THEN (OPERATING_CASH_FLOW_TTM - NET_INCOME_TTM) / avg_assets END AS cash_earnings FROM g)"""
FINANCIAL = """f1 AS (SELECT *, COMMON_EQUITY - GOODWILL - INTANGIBLES AS tce, (COMMON_EQUITY - GOODWILL - INTANGIBLES + COMMON_EQUITY_PRIOR - GOODWILL_PRIOR - INTANGIBLES_PRIOR) / 2 AS avg_tce,
  CASE WHEN RISK_WEIGHTED_ASSETS > 0 THEN CET1_CAPITAL / RISK_WEIGHTED_ASSETS END AS cet1, CASE WHEN GROSS_LOANS > 0 THEN -(NONACCRUAL_LOANS + PAST_DUE_90_LOANS) / GROSS_LOANS END AS credit_quality,
  CASE WHEN NET_PREMIUMS_TTM > 0 THEN (LOSSES_LAE_TTM + UNDERWRITING_EXPENSE_TTM) / NET_PREMIUMS_TTM END AS combined_ratio, CASE WHEN AUTHORIZED_CONTROL_LEVEL_RBC > 0 THEN TOTAL_ADJUSTED_CAPITAL / AUTHORIZED_CONTROL_LEVEL_RBC END AS rbc,
  CASE WHEN requirement_count > 0 AND needs = requirement_count THEN need END AS requirement FROM gm),
f AS (SELECT *, CASE WHEN market_cap > 0 THEN NET_INCOME_COMMON_TTM / market_cap END AS earnings_yield, CASE WHEN market_cap > 0 THEN tce / market_cap END AS tangible_book,
  CASE WHEN market_cap > 0 THEN (COMMON_DIVIDENDS_TTM + COMMON_REPURCHASES_TTM - STOCK_ISSUANCE_TTM) / market_cap END AS net_payout, CASE WHEN avg_assets > 0 THEN NET_INCOME_TTM / avg_assets END AS roa,
  CASE WHEN avg_tce > 0 THEN OPERATING_INCOME_COMMON_TTM / avg_tce END AS operating_roe, CASE WHEN avg_assets > 0 THEN OPERATING_INCOME_TTM / avg_assets END AS operating_roa, 1 - combined_ratio AS underwriting_margin,
  CASE WHEN """ + " AND ".join([*(f"OPERATING_ROA_Q{q} IS NOT NULL AND OPERATING_ROA_Q{q}__end - OPERATING_ROA_Q{q}__start + 1 BETWEEN 70 AND 110" for q in range(1, 13)), *(f"OPERATING_ROA_Q{q + 1}__end = OPERATING_ROA_Q{q}__start - 1" for q in range(1, 12)), "OPERATING_ROA_Q1__end = statement_end"]) + "\n  THEN -list_stddev_pop([" + ", ".join(f"OPERATING_ROA_Q{q}" for q in range(1, 13)) + "]) END AS earnings_stability FROM f1)"
REIT = """r1 AS (SELECT *, NET_INCOME_COMMON_TTM + REAL_ESTATE_DA_TTM - REAL_ESTATE_GAINS_TTM + REAL_ESTATE_LOSSES_TTM + REAL_ESTATE_IMPAIRMENTS_TTM + FFO_JV_NCI_TTM AS ffo,
  NET_INCOME_TTM + INTEREST_EXPENSE_TTM + TAX_EXPENSE_TTM + DA_TTM - PROPERTY_GAINS_TTM + PROPERTY_LOSSES_TTM + REAL_ESTATE_IMPAIRMENTS_TTM + EBITDARE_AFFILIATES_TTM AS ebitdare FROM f),
r2 AS (SELECT *, ffo - MAINTENANCE_CAPEX_TTM - TENANT_IMPROVEMENTS_TTM - LEASING_COMMISSIONS_TTM - NONCASH_RENT_TTM AS affo, CASE WHEN ebitdare > 0 THEN (debt - CASH) / ebitdare END AS leverage FROM r1),
m AS (SELECT *, CASE WHEN market_cap > 0 THEN ffo / market_cap END AS ffo_yield, CASE WHEN market_cap > 0 THEN affo / market_cap END AS affo_yield, CASE WHEN ev > 0 THEN ebitdare / ev END AS ebitdare_yield,
  CASE WHEN CASH_INTEREST_TTM > 0 THEN ebitdare / CASH_INTEREST_TTM END AS interest_coverage, -leverage AS leverage_quality, CASE WHEN affo > 0 THEN DIVIDENDS_DECLARED_TTM / affo END AS affo_payout,
  CASE WHEN AFFO_PRIOR_TTM > 0 AND AFFO_PRIOR_TTM__end = DIVIDENDS_DECLARED_PRIOR_TTM__end THEN DIVIDENDS_DECLARED_PRIOR_TTM / AFFO_PRIOR_TTM END AS affo_payout_prior,
  CASE WHEN SAME_STORE_NOI_PRIOR_TTM > 0 THEN SAME_STORE_NOI_TTM / SAME_STORE_NOI_PRIOR_TTM - 1 END AS noi_growth FROM r2)"""
CHAIN = ",\n".join((ACCEPTED, PIVOT, TAX, FINANCIAL, REIT))


def _codes(*rules: tuple[str, str]) -> str:
    """A sorted list of the codes whose rule holds."""
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for rule, code in rules) + "], lambda x: x IS NOT NULL)))"


UNIVERSAL = [
    ("NOT profile_supported OR (profile IN ('BANK', 'PC_INSURER', 'LIFE_INSURER') AND regulatory_scope IS DISTINCT FROM 'PUBLIC_PARENT') OR (profile = 'BANK' AND capital_approach IS NULL)", "MODEL_NOT_SUPPORTED"),
    ("NOT in_universe", "NOT_IN_UNIVERSE"), ("NOT active", "INACTIVE_SECURITY"), ("NOT primary_class", "NON_PRIMARY_SHARE_CLASS"), ("security_type <> 'COMMON_STOCK'", "UNSUPPORTED_SECURITY"),
    ("ADJUSTED_CLOSE IS NULL", "NOT_REPORTED:ADJUSTED_CLOSE"), ("ADJUSTED_CLOSE < 5", "PRICE_BELOW_MINIMUM"), ("MEDIAN_DOLLAR_VOLUME IS NULL", "NOT_REPORTED:MEDIAN_DOLLAR_VOLUME"), ("MEDIAN_DOLLAR_VOLUME < 5000000", "ILLIQUID"),
    ("history_count < 252", "INSUFFICIENT_HISTORY"), ("liquidity_count < 20", "INCOMPLETE_LIQUIDITY_WINDOW"), ("score_date - filing_date NOT BETWEEN 0 AND 180", "STALE"), ("market_cap IS NULL", "INVALID_MARKET_CAP"),
]
BANK_RISK = [("profile = 'BANK' AND (requirement IS NULL OR cet1 IS NULL)", "MISSING_CET1_REQUIREMENT"), ("profile = 'BANK' AND cet1 < requirement", "CET1_REQUIREMENT_BREACH")]
INSURER_RISK = [("profile LIKE '%INSURER' AND rbc IS NULL", "MODEL_NOT_SUPPORTED"), ("profile LIKE '%INSURER' AND rbc < 2", "RBC_REGULATORY_RISK")]
FINANCIAL_RISK = [("profile IN ('BANK', 'PC_INSURER', 'LIFE_INSURER') AND (tce IS NULL OR tce <= 0)", "NON_POSITIVE_TANGIBLE_COMMON_EQUITY"), *BANK_RISK, *INSURER_RISK]
REIT_RISK = [
    ("profile = 'EQUITY_REIT' AND NOT (reit_reconciled AND same_store_pool_consistent)", "MODEL_NOT_SUPPORTED"), ("profile = 'EQUITY_REIT' AND (ebitdare IS NULL OR ebitdare <= 0)", "NON_POSITIVE_EBITDARE"),
    ("profile = 'EQUITY_REIT' AND interest_coverage IS NULL", "MISSING_RISK_INPUT:interest_coverage"), ("profile = 'EQUITY_REIT' AND interest_coverage < 1.5", "REIT_INTEREST_COVERAGE_BREACH"),
    ("profile = 'EQUITY_REIT' AND leverage IS NULL", "MISSING_RISK_INPUT:leverage"), ("profile = 'EQUITY_REIT' AND leverage > 10", "REIT_LEVERAGE_BREACH"),
    ("profile = 'EQUITY_REIT' AND (affo_payout IS NULL OR affo_payout_prior IS NULL)", "MISSING_RISK_INPUT:affo_payout"), ("profile = 'EQUITY_REIT' AND affo_payout > 1.2 AND affo_payout_prior > 1.2", "REIT_PAYOUT_BREACH"),
]
WARNED = [
    ("profile = 'BANK' AND cet1 >= requirement AND cet1 < requirement + 0.01", "LOW_CET1_SURPLUS"), ("profile LIKE '%INSURER' AND rbc >= 2 AND rbc < 3", "RBC_TREND_WARNING"), ("profile = 'PC_INSURER' AND combined_ratio > 1.05", "HIGH_COMBINED_RATIO"),
    ("profile = 'EQUITY_REIT' AND interest_coverage >= 1.5 AND interest_coverage < 2", "REIT_INTEREST_COVERAGE_WARNING"), ("profile = 'EQUITY_REIT' AND leverage > 8 AND leverage <= 10", "REIT_LEVERAGE_WARNING"),
    ("profile = 'EQUITY_REIT' AND affo_payout > 1 AND (affo_payout <= 1.2 OR affo_payout_prior <= 1.2)", "REIT_PAYOUT_WARNING"), ("profile = 'GENERAL' AND own_rate IS NULL AND law_rate IS NOT NULL", "STATUTORY_TAX_FALLBACK"),
]
FAMILIES = {
    "GENERAL": ("ebit_ev fcf_yield book_market", "gross_profitability roic cash_earnings", None), "BANK": ("earnings_yield tangible_book net_payout", "roa cet1 credit_quality", "cet1"),
    "PC_INSURER": ("earnings_yield tangible_book net_payout", "operating_roe underwriting_margin earnings_stability", "rbc"), "LIFE_INSURER": ("earnings_yield tangible_book net_payout", "operating_roe operating_roa earnings_stability", "rbc"),
    "EQUITY_REIT": ("ffo_yield affo_yield ebitdare_yield", "noi_growth interest_coverage leverage_quality", "ffo"),
}
COVERAGE = [("momentum IS NULL", "MISSING_MOMENTUM_BOUNDARY")]
for _p, (_v, _q, _anchor) in FAMILIES.items():
    for _name, _metrics in (("VALUE", _v), ("QUALITY", _q)):
        COVERAGE.append((f"profile = '{_p}' AND " + " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in _metrics.split()) + " < 2", f"INSUFFICIENT_{_name}_COVERAGE"))
    if _anchor:
        COVERAGE.append((f"profile = '{_p}' AND {_anchor} IS NULL", "MISSING_PROFILE_ANCHOR"))
ERRORS = f"(SELECT *, list_sort(list_distinct(list_concat({_codes(*UNIVERSAL, *FINANCIAL_RISK, *REIT_RISK, *COVERAGE)}, list_filter(string_split(blocked, ','), lambda x: x <> '')))) AS errors, {_codes(*WARNED)} AS warnings FROM m)"
ASSESSED = f"{CHAIN},\ne AS {ERRORS}"
#: Long metric rows of table {t}, for the rows that satisfy {where}.
LONG = " UNION ALL ".join(f"SELECT run, instrument_id, profile, peer_group, '{f}' AS family, '{x}' AS metric, {x} AS raw FROM {{t}} WHERE profile = '{p}' AND {{where}}" for p, (v, q, _) in FAMILIES.items() for f, names in (("value", v), ("quality", q), ("momentum", "momentum")) for x in names.split())


def _cards(v: Views) -> DataFrame:
    return v.b_cards.withColumn("blocking_reasons", F.filter(F.split("blocked", ","), lambda x: x != ""))


def _assessed(v: Views) -> DataFrame:
    return M.assess(v.b_inputs, _cards(v), ON, v.spark.sql(LAW))


def _numbers(*names: str) -> list:
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _lacks(*terms: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {t} IS NULL THEN coalesce({t}__why, 'NOT_REPORTED') END" for t in terms) + ")"


@R.add("a02_input_ladder", f"WITH {ACCEPTED} SELECT run, instrument_id, key, round(value, 6) AS value, reason FROM a")
def _a02(v: Views) -> DataFrame:
    return M.accept(v.b_inputs, v.b_cards, ON).select(*ON, "key", F.round("value", 6).alias("value"), "reason")


@R.add("a03_shared_derivations", f"""WITH {ACCEPTED}, {PIVOT} SELECT run, instrument_id, {_rounded('market_cap', 'debt', 'ev', 'avg_assets', 'momentum')},
  {_lacks('DEBT_CURRENT', 'DEBT_NONCURRENT')} AS debt_why, coalesce(CASE WHEN market_cap IS NULL THEN 'NOT_REPORTED' END, {_lacks('DEBT_CURRENT', 'DEBT_NONCURRENT', 'PREFERRED_EQUITY', 'MINORITY_INTEREST', 'CASH')}) AS ev_why,
  CASE WHEN MOMENTUM_RECENT <= 0 THEN 'FAILED_QUALITY_CHECK' ELSE coalesce({_lacks('MOMENTUM_RECENT', 'MOMENTUM_OLD')}, CASE WHEN MOMENTUM_OLD <= 0 THEN 'INVALID_DENOMINATOR' END) END AS momentum_why FROM s2""")
def _a03(v: Views) -> DataFrame:
    wide = M.shared(M.widen(M.accept(v.b_inputs, v.b_cards, ON), v.b_cards, ON, M.keys_of()))
    return wide.select(*ON, *_numbers("market_cap", "debt", "ev", "avg_assets", "momentum"), *(F.col(M.why(n)).alias(f"{n}_why") for n in ("debt", "ev", "momentum")))


@R.add("a04_general_metrics", f"""WITH {ACCEPTED}, {PIVOT}, {TAX} SELECT run, instrument_id, {_rounded('tax_rate', 'ebit_ev', 'fcf_yield', 'book_market', 'gross_profitability', 'roic', 'cash_earnings')},
  CASE WHEN CAPEX_TTM < 0 AND market_cap IS NOT NULL THEN 'FAILED_QUALITY_CHECK' WHEN CAPEX_TTM >= 0 AND OPERATING_CASH_FLOW_TTM IS NOT NULL AND market_cap IS NULL THEN 'NOT_REPORTED' END AS fcf_why FROM gm WHERE profile = 'GENERAL'""")
def _a04(v: Views) -> DataFrame:
    accepted = M.accept(v.b_inputs, v.b_cards, ON)
    wide = M.widen(accepted, v.b_cards.filter("profile = 'GENERAL'"), ON, [*M.keys_of("GENERAL"), *M.YEARS], M.YEARS)
    out = M.general(M.normal_tax(M.shared(wide), v.spark.sql(LAW)))
    fcf, there = F.col(M.why("fcf_yield")), F.col("market_cap").isNotNull()
    told = F.when((F.col("CAPEX_TTM") < 0) & there, fcf).when((F.col("CAPEX_TTM") >= 0) & F.col("OPERATING_CASH_FLOW_TTM").isNotNull() & ~there, fcf)
    return out.select(*ON, *_numbers("tax_rate", "ebit_ev", "fcf_yield", "book_market", "gross_profitability", "roic", "cash_earnings"), told.alias("fcf_why"))


@R.add("a05_bank_metrics", f"WITH {CHAIN} SELECT run, instrument_id, {_rounded('earnings_yield', 'tangible_book', 'net_payout', 'roa', 'cet1', 'credit_quality', 'requirement')}, array_to_string({_codes(*BANK_RISK)}, ',') AS broken, CASE WHEN cet1 >= requirement AND cet1 < requirement + 0.01 THEN 'LOW_CET1_SURPLUS' ELSE '' END AS warned FROM m WHERE profile = 'BANK'")
def _a05(v: Views) -> DataFrame:
    a = _assessed(v).filter("profile = 'BANK'")
    mine = F.array(F.lit("MISSING_CET1_REQUIREMENT"), F.lit("CET1_REQUIREMENT_BREACH"))
    return a.select(*ON, *_numbers("earnings_yield", "tangible_book", "net_payout", "roa", "cet1", "credit_quality", "requirement"), F.array_join(F.array_sort(F.array_intersect("errors", mine)), ",").alias("broken"), F.array_join("warnings", ",").alias("warned"))


@R.add("a06_insurer_metrics", f"""WITH {CHAIN} SELECT run, instrument_id, profile, {_rounded('operating_roe', 'operating_roa', 'underwriting_margin', 'earnings_stability', 'rbc', 'combined_ratio')},
  array_to_string({_codes(*INSURER_RISK[1:], FINANCIAL_RISK[0])}, ',') AS broken, array_to_string({_codes(*WARNED[1:3])}, ',') AS warned FROM m WHERE profile LIKE '%INSURER'""")
def _a06(v: Views) -> DataFrame:
    a = _assessed(v).filter(F.endswith("profile", F.lit("INSURER")))
    mine = F.array(F.lit("RBC_REGULATORY_RISK"), F.lit("NON_POSITIVE_TANGIBLE_COMMON_EQUITY"))
    return a.select(*ON, "profile", *_numbers("operating_roe", "operating_roa", "underwriting_margin", "earnings_stability", "rbc", "combined_ratio"), F.array_join(F.array_sort(F.array_intersect("errors", mine)), ",").alias("broken"), F.array_join("warnings", ",").alias("warned"))


@R.add("a07_reit_metrics", f"""WITH {CHAIN} SELECT run, instrument_id, {_rounded('ffo', 'affo', 'ebitdare', 'ffo_yield', 'affo_yield', 'ebitdare_yield', 'noi_growth', 'interest_coverage', 'leverage', 'affo_payout', 'affo_payout_prior')},
  array_to_string({_codes(*REIT_RISK[1:])}, ',') AS broken, array_to_string({_codes(*WARNED[3:6])}, ',') AS warned FROM m WHERE profile = 'EQUITY_REIT'""")
def _a07(v: Views) -> DataFrame:
    a = _assessed(v).filter("profile = 'EQUITY_REIT'")
    risk = F.filter("errors", lambda e: F.startswith(e, F.lit("REIT_")) | F.startswith(e, F.lit("MISSING_RISK_INPUT:")) | (e == "NON_POSITIVE_EBITDARE"))
    return a.select(*ON, *_numbers("ffo", "affo", "ebitdare", "ffo_yield", "affo_yield", "ebitdare_yield", "noi_growth", "interest_coverage", "leverage", "affo_payout", "affo_payout_prior"), F.array_join(risk, ",").alias("broken"), F.array_join("warnings", ",").alias("warned"))


@R.add("a08_universal_gates", f"WITH {ACCEPTED}, {PIVOT} SELECT run, instrument_id, array_to_string({_codes(*UNIVERSAL)}, ',') AS errors FROM s2")
def _a08(v: Views) -> DataFrame:
    from tidemark.functions.scalars import reasons

    wide = M.shared(M.widen(M.accept(v.b_inputs, v.b_cards, ON), v.b_cards, ON, M.keys_of()))
    return wide.select(*ON, F.array_join(reasons(*M.universal(wide)), ",").alias("errors"))


@R.add("a09_coverage_reasons", f"WITH {ASSESSED}, l AS ({LONG.format(t='e', where='true')}) SELECT e.run, e.instrument_id, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings, have FROM e JOIN (SELECT run, instrument_id, count(raw) AS have FROM l GROUP BY 1, 2) n ON e.run = n.run AND e.instrument_id = n.instrument_id")
def _a09(v: Views) -> DataFrame:
    a = _assessed(v)
    have = sum((F.when(F.col("profile") == p, sum((F.col(n).isNotNull().cast("long") for n in (*value, *quality, "momentum")), F.lit(0))).otherwise(0) for p, (value, quality) in PROFILE_METRICS.items()), F.lit(0))
    return a.select(*ON, F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), have.alias("have"))


def _cohorts(t: str) -> str:
    """Tables k, c, q, st and z (each followed by {t}) of the metric rows b{t}: run, instrument_id, metric, pool, label, peer_group, raw, fit."""
    return f"""k{t} AS (SELECT *, count(raw) FILTER (fit) OVER (PARTITION BY run, metric, pool, peer_group) AS np, count(raw) FILTER (fit) OVER (PARTITION BY run, metric, pool) AS nf FROM b{t}),
c{t} AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN peer_group IS NOT NULL AND np >= 10 THEN 'PRIMARY:' || peer_group WHEN nf >= 20 THEN pool END AS cohort, peer_group IS NOT NULL AND np >= 10 AS near FROM k{t}),
q{t} AS (SELECT *, CASE WHEN near THEN quantile_cont(CASE WHEN fit THEN raw END, 0.025) OVER pw ELSE quantile_cont(CASE WHEN fit THEN raw END, 0.025) OVER fw END AS lo, CASE WHEN near THEN quantile_cont(CASE WHEN fit THEN raw END, 0.975) OVER pw ELSE quantile_cont(CASE WHEN fit THEN raw END, 0.975) OVER fw END AS hi
  FROM c{t} WINDOW pw AS (PARTITION BY run, metric, pool, peer_group), fw AS (PARTITION BY run, metric, pool)),
st{t} AS (SELECT q.run, q.metric, q.instrument_id, avg(greatest(q.lo, least(q.hi, o.raw))) AS mean, stddev_pop(greatest(q.lo, least(q.hi, o.raw))) AS sd FROM q{t} q JOIN b{t} o ON q.run = o.run AND q.metric = o.metric AND q.pool = o.pool AND o.raw IS NOT NULL AND o.fit AND (NOT q.near OR q.peer_group = o.peer_group) WHERE q.cohort IS NOT NULL GROUP BY 1, 2, 3),
z{t} AS (SELECT q.*, CASE WHEN cohort IS NOT NULL THEN greatest(-3, least(3, CASE WHEN sd < 1e-12 THEN 0 ELSE (greatest(lo, least(hi, raw)) - mean) / sd END)) END AS z, CASE WHEN cohort IS NULL THEN NULL WHEN near THEN np ELSE nf END AS cohort_n,
  CASE WHEN raw IS NULL THEN 'NO_VALUE' WHEN cohort IS NULL THEN 'NO_COMPATIBLE_COHORT' WHEN sd < 1e-12 THEN 'NO_DISPERSION' END AS told FROM q{t} q LEFT JOIN st{t} s ON q.run = s.run AND q.metric = s.metric AND q.instrument_id = s.instrument_id)"""


STRICT = f"""b AS (SELECT run, instrument_id, profile, 'PROFILE:' || profile AS pool, nullif(peer_group, '') AS peer_group, family, metric, raw, true AS fit FROM ({LONG.format(t='e', where='len(errors) = 0')}) l),
{_cohorts('')},
fam AS (SELECT run, instrument_id, sum(coalesce(z, 0)) FILTER (family = 'value') / 3 AS fv, sum(coalesce(z, 0)) FILTER (family = 'quality') / 3 AS fq, sum(coalesce(z, 0)) FILTER (family = 'momentum') AS fm,
  count(z) FILTER (family = 'value') AS nv, count(z) FILTER (family = 'quality') AS nq, count(z) FILTER (family = 'momentum') AS nm, list('PEER_FALLBACK:' || metric) FILTER (starts_with(cohort, 'PROFILE:')) AS fell FROM z GROUP BY 1, 2),
o AS (SELECT e.run, e.instrument_id, list_sort(list_distinct(list_concat(errors, CASE WHEN fam.run IS NULL THEN [] ELSE list_filter([CASE WHEN nv < 2 THEN 'INSUFFICIENT_NORMALIZED_VALUE' END, CASE WHEN nq < 2 THEN 'INSUFFICIENT_NORMALIZED_QUALITY' END, CASE WHEN nm < 1 THEN 'INSUFFICIENT_NORMALIZED_MOMENTUM' END], lambda x: x IS NOT NULL) END))) AS errors,
  list_sort(list_distinct(list_concat(warnings, coalesce(fell, [])))) AS warnings, 0.5 * fv + 0.3 * fq + 0.2 * fm AS composite FROM e LEFT JOIN fam ON e.run = fam.run AND e.instrument_id = fam.instrument_id)"""


@R.add("a10_strict_cohorts", f"WITH {ASSESSED}, {STRICT} SELECT run, instrument_id, metric, family, cohort, cohort_n, round(z, 6) AS z, told AS reason FROM z")
def _a10(v: Views) -> DataFrame:
    norm, _ = M.strict(_assessed(v), ["run"], "instrument_id")
    return norm.select(*ON, "metric", "family", "cohort", "cohort_n", F.round("z", 6).alias("z"), "reason")


@R.add("a11_strict_runs", f"""WITH {ASSESSED}, {STRICT}
SELECT run, instrument_id, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings, CASE WHEN len(errors) = 0 THEN round(composite, 6) END AS composite, CASE WHEN len(errors) = 0 THEN row_number() OVER (PARTITION BY run, len(errors) = 0 ORDER BY composite DESC, instrument_id) END AS rank FROM o""")
def _a11(v: Views) -> DataFrame:
    _, out = M.strict(_assessed(v), ["run"], "instrument_id")
    out = settle(out)
    ranked = model.score_runs(out, ["run"]).select(*ON, F.col("rank").cast("long").alias("rank"))
    return out.join(ranked, ON, "left").select(*ON, F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), F.round("composite", 6).alias("composite"), "rank")


SOFT_SQL = """(x IN ('INSUFFICIENT_VALUE_COVERAGE', 'INSUFFICIENT_QUALITY_COVERAGE', 'INSUFFICIENT_NORMALIZED_VALUE', 'INSUFFICIENT_NORMALIZED_QUALITY', 'INSUFFICIENT_NORMALIZED_MOMENTUM', 'MISSING_MOMENTUM_BOUNDARY', 'INVALID_MARKET_CAP', 'STALE_SHARES', 'STALE', 'INSUFFICIENT_HISTORY', 'MISSING_PROFILE_ANCHOR', 'NON_POSITIVE_EBITDARE')
  OR starts_with(x, 'MODEL_NOT_SUPPORTED') OR starts_with(x, 'MISSING_SESSION:') OR starts_with(x, 'MISSING_RISK_INPUT:') OR (version >= '1.4' AND x = 'STALE_OR_MISSING_FILING')
  OR (version >= '1.5' AND x IN ('NON_PRIMARY_SHARE_CLASS', 'INACTIVE_OR_UNSUPPORTED_SECURITY:DEPOSITARY_RECEIPT', 'MULTI_CLASS_ISSUER_CAPITALIZATION_UNAVAILABLE')))"""
#: All versions at once: in these tables a run stands for a run and version (ten times the run, and the version's last digit); while inputs are assessed, cards of issuers with several have a second run 10,000 up.
RESET = f"""vc AS (SELECT *, count(*) OVER (PARTITION BY run, issuer_id) > 1 AS several FROM b_cards), vx AS (SELECT * FROM vc UNION ALL SELECT * REPLACE (run + 10000 AS run, concat_ws(',', nullif(blocked, ''), 'MULTI_CLASS_ISSUER_CAPITALIZATION_UNAVAILABLE') AS blocked) FROM vc WHERE several),
vi AS (SELECT * FROM b_inputs UNION ALL SELECT * REPLACE (run + 10000 AS run) FROM b_inputs i WHERE key <> 'SHARES_OUTSTANDING' AND EXISTS (SELECT 1 FROM vc WHERE several AND vc.run = i.run AND vc.instrument_id = i.instrument_id)),
{CHAIN.replace("b_inputs", "vi").replace("b_cards", "vx")}, e0 AS {ERRORS},
e AS (SELECT e0.* REPLACE (run % 10000 * 10 + d AS run), '1.' || d AS version FROM e0, (VALUES (3), (4), (5)) t(d) WHERE CASE WHEN d < 5 THEN run < 10000 ELSE run >= 10000 OR NOT several END),
{STRICT},
r AS (SELECT e.* REPLACE (list_filter(o.errors, lambda x: NOT {SOFT_SQL}) AS errors, list_sort(list_concat(e.warnings, list_transform(list_filter(o.errors, lambda x: {SOFT_SQL}), lambda x: 'LIMITATION:' || x), CASE WHEN profile_supported AND profile = 'GENERAL' THEN [] ELSE ['LIMITATION:PRICE_ONLY_UNSUPPORTED_ACCOUNTING_PROFILE'] END)) AS warnings),
  NOT (profile_supported AND profile = 'GENERAL') AS price_only, list_contains(o.errors, 'STALE_SHARES') AS old_shares, list_contains(o.errors, 'STALE') OR (version >= '1.4' AND list_contains(o.errors, 'STALE_OR_MISSING_FILING')) AS old_filing,
  history_count < 252 OR len(list_filter(o.errors, lambda x: starts_with(x, 'MISSING_SESSION:'))) > 0 AS gaps FROM e JOIN o ON e.run = o.run AND e.instrument_id = o.instrument_id),
u AS (SELECT r.run, version, l.instrument_id, issuer_id, primary_class, l.profile, nullif(l.peer_group, '') AS peer_group, family, metric, errors, CASE WHEN family = 'momentum' AND gaps THEN 'INSUFFICIENT_HISTORY' WHEN family <> 'momentum' AND old_filing THEN 'STALE_FILING' WHEN family = 'value' AND old_shares THEN 'STALE_SHARES' END AS off, raw AS given
  FROM ({LONG.format(t='r', where='true')}) l JOIN r ON l.run = r.run AND l.instrument_id = r.instrument_id WHERE NOT price_only OR family = 'momentum')"""
VERSIONED = f"""{RESET},
n2 AS (SELECT *, CASE WHEN off IS NULL THEN given END AS raw, CASE WHEN version >= '1.4' AND family = 'momentum' THEN 'PRICE_UNIVERSE' ELSE 'PROFILE:' || profile END AS pool FROM u WHERE len(errors) = 0),
b2 AS (SELECT *, version < '1.5' OR primary_class OR count(*) FILTER (primary_class AND raw IS NOT NULL) OVER (PARTITION BY run, metric, pool, issuer_id) = 0 AS fit FROM n2),
{_cohorts('2')}"""
COMPOSED = f"""{VERSIONED},
g2 AS (SELECT run, instrument_id, avg(z) FILTER (family = 'value') AS fv, avg(z) FILTER (family = 'quality') AS fq, avg(z) FILTER (family = 'momentum') AS fm, count(z) AS normalized, list('PEER_FALLBACK:' || metric) FILTER (NOT starts_with(cohort, 'PRIMARY:')) AS fell FROM z2 GROUP BY 1, 2),
h2 AS (SELECT r.run, r.version, r.instrument_id, r.errors, r.warnings, fv, fq, fm, coalesce(normalized, 0) AS normalized, fell, CASE WHEN len(r.errors) > 0 THEN 0 ELSE CASE WHEN fv IS NULL THEN 0 ELSE 0.5 END + CASE WHEN fq IS NULL THEN 0 ELSE 0.3 END + CASE WHEN fm IS NULL THEN 0 ELSE 0.2 END END AS have FROM r LEFT JOIN g2 ON r.run = g2.run AND r.instrument_id = g2.instrument_id),
i2 AS (SELECT *, CASE WHEN have > 0 THEN round((coalesce(0.5 * fv, 0) + coalesce(0.3 * fq, 0) + coalesce(0.2 * fm, 0)) / CAST(have AS DOUBLE), 10) END AS composite FROM h2),
j2 AS (SELECT *, CASE WHEN have > 0 AND count(*) FILTER (have > 0) OVER (PARTITION BY run) > 1 THEN row_number() OVER (PARTITION BY run, have > 0 ORDER BY composite DESC, instrument_id) END AS rank FROM i2)"""
KEPT = ["issuer_id", "primary_class", "peer_group"]


def _reset(v: Views) -> tuple[DataFrame, DataFrame]:
    return M.reset_versions(v.b_inputs, _cards(v), ON, v.spark.sql(LAW), KEPT)


def _versioned(v: Views) -> tuple[DataFrame, DataFrame]:
    cards, rows = _reset(v)
    return cards, M.versioned_cohorts(rows.filter(F.size("errors") == 0), ["run"])


@R.add("a12_available_components", f"""WITH {RESET} SELECT r.version, CAST(r.run // 10 AS INTEGER) AS run, r.instrument_id, array_to_string(r.errors, ',') AS errors, count(given) FILTER (off IS NULL) AS usable, array_to_string(r.warnings, ',') AS warnings,
  count(*) FILTER (off = 'STALE_FILING') AS stale_filing, count(*) FILTER (off = 'STALE_SHARES') AS stale_shares FROM r LEFT JOIN u ON r.run = u.run AND r.instrument_id = u.instrument_id GROUP BY ALL""")
def _a12(v: Views) -> DataFrame:
    cards, rows = _reset(v)
    usable = rows.groupBy("version", *ON).agg(F.count("raw").alias("usable"), *(F.count_if(F.col("reason") == r).alias(r.lower()) for r in ("STALE_FILING", "STALE_SHARES")))
    none = {c: F.coalesce(c, F.lit(0)) for c in ("usable", "stale_filing", "stale_shares")}
    return cards.join(usable, ["version", *ON], "left").withColumns(none).select("version", *ON, F.array_join("errors", ",").alias("errors"), *none, F.array_join("warnings", ",").alias("warnings"))


@R.add("a15_versioned_cohorts", f"WITH {VERSIONED} SELECT version, CAST(run // 10 AS INTEGER) AS run, instrument_id, family, metric, fit AND raw IS NOT NULL AS fit, cohort, cohort_n, round(z, 6) AS z, told AS reason FROM z2")
def _a15(v: Views) -> DataFrame:
    _, norm = _versioned(v)
    return norm.select("version", *ON, "family", "metric", "fit", "cohort", "cohort_n", F.round("z", 6).alias("z"), "reason")


@R.add("a16_versioned_composites", f"""WITH {COMPOSED} SELECT version, CAST(run // 10 AS INTEGER) AS run, instrument_id, array_to_string(CASE WHEN len(errors) = 0 AND have = 0 THEN ['NO_VALID_NORMALIZED_METRICS'] ELSE errors END, ',') AS errors,
  array_to_string(list_sort(list_concat(warnings, coalesce(fell, []), CASE WHEN have > 0 AND normalized < 7 THEN ['PARTIAL_SCORE:AVAILABLE_COMPONENTS_ONLY'] ELSE [] END)), ',') AS warnings, normalized, round(composite, 6) AS composite, CASE WHEN have > 0 AND fv IS NOT NULL THEN round(0.5 / CAST(have AS DOUBLE), 6) ELSE 0 END AS weight_value,
  CASE WHEN have > 0 THEN round(fm * 0.2 / CAST(have AS DOUBLE), 6) END AS contribution_momentum, CASE WHEN have = 0 THEN 'UNAVAILABLE' WHEN normalized = 7 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, rank FROM j2""")
def _a16(v: Views) -> DataFrame:
    cards, norm = _versioned(v)
    out = model.compose_available(norm, cards, ["version", *ON], ["version", "run"])
    return out.select("version", *ON, F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "normalized", *(F.round(c, 6).alias(c) for c in ("composite", "weight_value", "contribution_momentum")), "status", F.col("rank").cast("long").alias("rank"))


def _composed(v: Views) -> tuple[DataFrame, DataFrame]:
    """Composites of all versions with what the screener shows of a card, and the metric rows behind them."""
    cards, norm = _versioned(v)
    norm = settle(norm)
    out = model.compose_available(norm, cards.select("version", *ON, "errors", "warnings"), ["version", *ON], ["version", "run"])
    shown = v.b_cards.select(*ON, "issuer_id", "primary_class", "profile", F.coalesce(F.nullif("peer_group", F.lit("")), F.lit("UNKNOWN")).alias("sector"))
    return settle(out.select("version", *ON, "eligible", "composite", "rank", "value", "quality", "momentum").join(shown, ON)), norm


MEMBERS = f"""{COMPOSED},
m2 AS (SELECT j2.run, j2.version, j2.instrument_id, e.issuer_id, e.primary_class, coalesce(nullif(e.peer_group, ''), 'UNKNOWN') AS sector, CASE WHEN e.profile = 'GENERAL' THEN 'GENERAL' ELSE 'PRICE_ONLY' END AS comparison, j2.have > 0 AS eligible, composite, rank
  FROM j2 JOIN e ON j2.run = e.run AND j2.instrument_id = e.instrument_id)"""
SECTOR_ROWS = f"""{MEMBERS},
gen AS (SELECT *, primary_class OR count(*) FILTER (primary_class) OVER (PARTITION BY run, sector, issuer_id) = 0 AS one FROM m2 WHERE comparison = 'GENERAL'),
base AS (SELECT run, version, sector, metric, family, n FROM (SELECT run, version, sector, count(*) AS n FROM gen GROUP BY ALL), (VALUES ('book_market', 'value'), ('cash_earnings', 'quality'), ('ebit_ev', 'value'), ('fcf_yield', 'value'), ('gross_profitability', 'quality'), ('momentum', 'momentum'), ('roic', 'quality')) t(metric, family)),
sm AS (SELECT gen.run, gen.sector, z2.metric, count(*) FILTER (one AND eligible AND raw IS NOT NULL) AS observations, quantile_cont(raw, 0.5) FILTER (one AND eligible AND raw IS NOT NULL) AS median, count(*) FILTER (starts_with(cohort, 'PRIMARY:')) AS standardised, count(*) FILTER (NOT starts_with(cohort, 'PRIMARY:')) AS fallback,
  max(cohort_n) FILTER (starts_with(cohort, 'PRIMARY:')) AS peer_size, min(cohort) FILTER (NOT starts_with(cohort, 'PRIMARY:')) AS fallback_cohort, max(cohort_n) FILTER (NOT starts_with(cohort, 'PRIMARY:')) AS fallback_size FROM gen JOIN z2 ON gen.run = z2.run AND gen.instrument_id = z2.instrument_id GROUP BY ALL),
sx AS (SELECT base.*, coalesce(observations, 0) AS observations, median, coalesce(standardised, 0) AS standardised, coalesce(fallback, 0) AS fallback, n - coalesce(standardised, 0) - coalesce(fallback, 0) AS unplaced, peer_size, fallback_cohort, fallback_size
  FROM base LEFT JOIN sm ON base.run = sm.run AND base.sector = sm.sector AND base.metric = sm.metric)"""


@R.add("e04_sector_members", f"""WITH {MEMBERS}, gr AS (SELECT *, row_number() OVER (PARTITION BY run, sector, comparison ORDER BY composite DESC, instrument_id) AS group_rank, count(*) OVER (PARTITION BY run, sector, comparison) AS group_n FROM m2 WHERE rank IS NOT NULL),
  hr AS (SELECT *, CASE WHEN group_n > 1 THEN round(100.0 * (group_n - avg(group_rank) OVER (PARTITION BY run, sector, comparison, composite)) / (group_n - 1), 6) END AS group_percentile FROM gr)
SELECT m2.version, CAST(m2.run // 10 AS INTEGER) AS run, m2.instrument_id, m2.sector, m2.comparison, m2.eligible, group_rank, group_percentile, group_n FROM m2 LEFT JOIN hr ON m2.run = hr.run AND m2.instrument_id = hr.instrument_id""")
def _e04_members(v: Views) -> DataFrame:
    scores, _ = _composed(v)
    return screener.sector_members(scores, ["version", "run"]).select("version", *ON, "sector", "comparison", "eligible", "group_rank", "group_percentile", "group_n")


@R.add("e04_sector_metrics", f"WITH {SECTOR_ROWS} SELECT version, CAST(run // 10 AS INTEGER) AS run, sector, metric, family, observations, round(median, 6) + 0.0 AS median, standardised, fallback, unplaced, peer_size, fallback_cohort, fallback_size, observations < 20 AS small_sample FROM sx")
def _e04_metrics(v: Views) -> DataFrame:
    scores, norm = _composed(v)
    out = screener.sector_metrics(screener.sector_members(scores, ["version", "run"]), norm, ["version", "run"])
    return out.withColumn("median", F.round("median", 6) + F.lit(0.0))


@R.add("e04_sector_overview", f"""WITH {SECTOR_ROWS}, n AS (SELECT run, version, sector, count(*) AS members, count(*) FILTER (eligible) AS eligible, count(*) FILTER (comparison = 'GENERAL') AS general, count(*) FILTER (comparison <> 'GENERAL') AS price_only,
  count(*) FILTER (eligible AND comparison = 'GENERAL') AS g, count(*) FILTER (eligible AND comparison <> 'GENERAL') AS p FROM m2 GROUP BY ALL),
  t AS (SELECT run, sector, 'FALLBACK_NORMALIZATION:' || metric AS w FROM sx WHERE fallback > 0 UNION ALL SELECT run, sector, 'NO_OBSERVATIONS:' || metric FROM sx WHERE observations = 0 UNION ALL SELECT run, sector, 'PUBLISHED_SCORES_NOT_RECALCULATED' FROM n
    UNION ALL SELECT run, sector, 'PEER_GROUP_SMALLER_THAN_SECTOR' FROM n WHERE price_only > 0 UNION ALL SELECT run, sector, 'PRICE_ONLY_MEMBERS_RANKED_SEPARATELY' FROM n WHERE price_only > 0 AND general > 0
    UNION ALL SELECT run, sector, 'SMALL_SAMPLE:GENERAL' FROM n WHERE general > 0 AND g < 20 UNION ALL SELECT run, sector, 'SMALL_SAMPLE:PRICE_ONLY' FROM n WHERE price_only > 0 AND p < 20)
SELECT version, CAST(n.run // 10 AS INTEGER) AS run, n.sector, members, eligible, general, price_only, string_agg(w, ',' ORDER BY w) AS warnings FROM n JOIN t ON n.run = t.run AND n.sector = t.sector GROUP BY ALL""")
def _e04_overview(v: Views) -> DataFrame:
    scores, norm = _composed(v)
    members = settle(screener.sector_members(scores, ["version", "run"]))
    out = screener.sector_overview(members, screener.sector_metrics(members, norm, ["version", "run"]), ["version", "run"])
    return out.withColumn("warnings", F.array_join("warnings", ","))


@R.add("a18_candidate_composites", f"WITH {COMPOSED} SELECT version, CAST(run // 10 AS INTEGER) AS run, instrument_id, candidate, round(fv * a + fq * b + fm * c, 6) + 0.0 AS composite FROM h2, (VALUES ('primary', 0.5, 0.3, 0.2), ('balanced', 0.4, 0.4, 0.2), ('value_quality', 0.6, 0.4, 0.0), ('pure_value', 1.0, 0.0, 0.0)) w(candidate, a, b, c)")
def _a18(v: Views) -> DataFrame:
    scores, _ = _composed(v)
    return model.candidates(scores.select("version", *ON, "value", "quality", "momentum")).select("version", *ON, "candidate", (F.round("candidate_composite", 6) + F.lit(0.0)).alias("composite"))


def _shown(section: str, name: str, unit: str, rule: str, refused: str | None = None) -> str:
    """A figure of the display as a DuckDB struct."""
    top, how, bottom = rule.split() if " " in rule else (rule, None, None)
    told = {n: f"CASE WHEN {n} IS NULL THEN '{n}:' || coalesce({n}__why, 'NOT_REPORTED') END" for n in (top, bottom) if n}
    value = {None: f"{top} * 100" if unit == "PERCENT" else top, "-": f"{top} - {bottom}", "over": f"CASE WHEN {bottom} > 0 THEN ({top} / {bottom} - 1) * 100 END"}.get(how) or f"CASE WHEN {bottom} > 0 THEN {top} * {100 if unit == 'PERCENT' else 1} / {bottom} END"
    below = [f"CASE WHEN {bottom} <= 0 THEN '{refused or 'NON_POSITIVE_DENOMINATOR:' + bottom}' END"] if how in ("/", "over") else []
    return f"{{section: '{section}', figure: '{name}', unit: '{unit}', value: CAST({value} AS DOUBLE), reason: coalesce({', '.join([*told.values(), *below, 'NULL'])})}}"


WHYS = f"""CASE WHEN market_cap IS NULL THEN 'NOT_REPORTED' END AS market_cap__why, {_lacks('DEBT_CURRENT', 'DEBT_NONCURRENT')} AS debt__why, coalesce(CASE WHEN market_cap IS NULL THEN 'NOT_REPORTED' END, {_lacks('DEBT_CURRENT', 'DEBT_NONCURRENT', 'PREFERRED_EQUITY', 'MINORITY_INTEREST', 'CASH')}) AS ev__why,
  {_lacks('TOTAL_ASSETS', 'TOTAL_ASSETS_PRIOR')} AS avg_assets__why, {_lacks('PRETAX_INCOME_TTM', 'INTEREST_EXPENSE_TTM')} AS ebit__why, CASE WHEN CAPEX_TTM < 0 THEN 'FAILED_QUALITY_CHECK' ELSE {_lacks('OPERATING_CASH_FLOW_TTM', 'CAPEX_TTM')} END AS fcf__why,
  REVENUE_TTM - COST_OF_REVENUE_TTM AS gross_profit, {_lacks('REVENUE_TTM', 'COST_OF_REVENUE_TTM')} AS gross_profit__why, CASE WHEN MOMENTUM_RECENT <= 0 THEN 'FAILED_QUALITY_CHECK' ELSE coalesce({_lacks('MOMENTUM_RECENT', 'MOMENTUM_OLD')}, CASE WHEN MOMENTUM_OLD <= 0 THEN 'INVALID_DENOMINATOR' END) END AS momentum__why"""


@R.add("e07_display_figures", f"""WITH {ACCEPTED}, {PIVOT}, {TAX}, y AS (SELECT *, {WHYS} FROM gm),
  u AS (SELECT run, instrument_id, unnest([{', '.join(_shown(*row) for row in screener.DISPLAYED)}]) AS f FROM y)
SELECT run, instrument_id, f.section, f.figure, f.unit, round(f.value, 6) + 0.0 AS value, f.reason FROM u""")
def _e07(v: Views) -> DataFrame:
    keys = [*dict.fromkeys([*M.keys_of("GENERAL"), *M.YEARS, "COMMON_DIVIDENDS_TTM", "OPERATING_INCOME_TTM"])]
    wide = M.widen(M.accept(v.b_inputs, v.b_cards, ON), v.b_cards, ON, keys, M.YEARS)
    shown = screener.display_metrics(M.general(M.normal_tax(M.shared(wide), v.spark.sql(LAW))), ON)
    return shown.select(*ON, "section", "figure", "unit", *_numbers("value"), "reason")
