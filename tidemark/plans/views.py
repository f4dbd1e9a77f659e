"""Domain views over the input tables, in SQL that Spark and DuckDB both run, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Inputs of the scoring views: key, unit, size and days before the statement.
INPUTS = """
RAW_CLOSE:USD:1.6e-04:0 ADJUSTED_CLOSE:USD:1.6e-04:0 SHARES_OUTSTANDING:shares:1:0 MEDIAN_DOLLAR_VOLUME:USD:128:0 MOMENTUM_RECENT:USD:1.1e-05:0
MOMENTUM_OLD:USD:1e-05:0 TOTAL_ASSETS:USD:30:0 COMMON_EQUITY:USD:12:0 CASH:USD:2:0 DEBT_CURRENT:USD:2:0 DEBT_NONCURRENT:USD:6:0
PREFERRED_EQUITY:USD:0.2:0 MINORITY_INTEREST:USD:0.1:0 GOODWILL:USD:1:0 INTANGIBLES:USD:0.5:0 CET1_CAPITAL:USD:3:0 RISK_WEIGHTED_ASSETS:USD:20:0
NONACCRUAL_LOANS:USD:0.2:0 PAST_DUE_90_LOANS:USD:0.1:0 GROSS_LOANS:USD:15:0 TOTAL_ADJUSTED_CAPITAL:USD:4:0 AUTHORIZED_CONTROL_LEVEL_RBC:USD:1:0
PRETAX_INCOME_TTM:USD:3:0 INTEREST_EXPENSE_TTM:USD:0.4:0 OPERATING_CASH_FLOW_TTM:USD:4:0 CAPEX_TTM:USD:1:0 REVENUE_TTM:USD:20:0
COST_OF_REVENUE_TTM:USD:12:0 NET_INCOME_TTM:USD:2:0 NET_INCOME_COMMON_TTM:USD:2:0 COMMON_DIVIDENDS_TTM:USD:0.5:0 COMMON_REPURCHASES_TTM:USD:0.4:0
STOCK_ISSUANCE_TTM:USD:0.2:0 OPERATING_INCOME_COMMON_TTM:USD:2:0 OPERATING_INCOME_TTM:USD:2.5:0 LOSSES_LAE_TTM:USD:6:0 UNDERWRITING_EXPENSE_TTM:USD:3:0
NET_PREMIUMS_TTM:USD:10:0 REAL_ESTATE_DA_TTM:USD:2:0 REAL_ESTATE_GAINS_TTM:USD:0.2:0 REAL_ESTATE_LOSSES_TTM:USD:0.1:0
REAL_ESTATE_IMPAIRMENTS_TTM:USD:0.1:0 FFO_JV_NCI_TTM:USD:0.05:0 MAINTENANCE_CAPEX_TTM:USD:0.3:0 TENANT_IMPROVEMENTS_TTM:USD:0.2:0
LEASING_COMMISSIONS_TTM:USD:0.1:0 NONCASH_RENT_TTM:USD:0.1:0 TAX_EXPENSE_TTM:USD:0.5:0 DA_TTM:USD:2:0 PROPERTY_GAINS_TTM:USD:0.2:0
PROPERTY_LOSSES_TTM:USD:0.1:0 EBITDARE_AFFILIATES_TTM:USD:0.1:0 CASH_INTEREST_TTM:USD:1:0 DIVIDENDS_DECLARED_TTM:USD:2.5:0 SAME_STORE_NOI_TTM:USD:3.3:0
TOTAL_ASSETS_PRIOR:USD:28:365 COMMON_EQUITY_PRIOR:USD:11:365 CASH_PRIOR:USD:2:365 DEBT_CURRENT_PRIOR:USD:2:365 DEBT_NONCURRENT_PRIOR:USD:5:365
PREFERRED_EQUITY_PRIOR:USD:0.2:365 MINORITY_INTEREST_PRIOR:USD:0.1:365 GOODWILL_PRIOR:USD:1:365 INTANGIBLES_PRIOR:USD:0.5:365
SAME_STORE_NOI_PRIOR_TTM:USD:3:365 AFFO_PRIOR_TTM:USD:3.5:91 DIVIDENDS_DECLARED_PRIOR_TTM:USD:2.4:91 OCCUPIED_AREA:square_feet:0.9:0
AVAILABLE_AREA:square_feet:1:0 CET1_REQUIREMENT_BASE:pure:0.045:0 CET1_REQUIREMENT_BUFFER:pure:0.025:0 ANNUAL_TAX_1:USD:0.6:0 ANNUAL_PRETAX_1:USD:3:0
ANNUAL_TAX_2:USD:0.6:365 ANNUAL_PRETAX_2:USD:3:365 ANNUAL_TAX_3:USD:0.6:730 ANNUAL_PRETAX_3:USD:3:730 OPERATING_ROA_Q1:pure:0.02:0
OPERATING_ROA_Q2:pure:0.02:91 OPERATING_ROA_Q3:pure:0.02:182 OPERATING_ROA_Q4:pure:0.02:273 OPERATING_ROA_Q5:pure:0.02:364
OPERATING_ROA_Q6:pure:0.02:455 OPERATING_ROA_Q7:pure:0.02:546 OPERATING_ROA_Q8:pure:0.02:637 OPERATING_ROA_Q9:pure:0.02:728
OPERATING_ROA_Q10:pure:0.02:819 OPERATING_ROA_Q11:pure:0.02:910 OPERATING_ROA_Q12:pure:0.02:1001
"""
_KEYS = ", ".join(f"({i}, '{k}', '{u}', CAST({size} AS DOUBLE), {back})" for i, (k, u, size, back) in enumerate(x.split(":") for x in INPUTS.split()))

VIEWS = {
    "b_instruments": """
        SELECT s_suppkey AS instrument_id, CASE WHEN s_suppkey % 10 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS issuer_id,
               s_suppkey % 10 <> 1 AS primary_class, s_name AS symbol, r_name AS sector,
               CASE WHEN s_suppkey % 10 IN (8, 9) THEN 'FINANCIAL' ELSE 'GENERAL' END AS profile,
               DATE '1990-01-01' AS valid_from, CASE WHEN s_suppkey % 25 = 24 THEN DATE '1999-01-01' END AS valid_to
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "b_sessions": """
        SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS session_date,
               CAST(last_day(CAST(l_shipdate AS DATE)) AS TIMESTAMP) - INTERVAL '30' DAY AS available_at
        FROM {lineitem}""",
    "b_bars": """
        SELECT l_suppkey AS instrument_id, last_day(CAST(l_shipdate AS DATE)) AS session_date,
               floor(l_extendedprice / l_quantity * 100) / 100 AS close, l_quantity AS volume,
               CAST(l_shipdate AS TIMESTAMP) AS available_at, CAST(l_shipdate AS TIMESTAMP) AS observed_at,
               concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING)) AS observation_key,
               CASE WHEN l_linestatus = 'O' THEN 'RAW' ELSE 'SPLIT_DIVIDEND' END AS mode,
               CASE WHEN l_discount >= 0.095 THEN 'REJECTED' ELSE 'VALID' END AS quality_state
        FROM {lineitem}""",
    "b_facts": """
        SELECT CAST(c_nationkey AS BIGINT) AS issuer_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'REVENUE' WHEN '2-HIGH' THEN 'NET_INCOME' WHEN '3-MEDIUM' THEN 'OPERATING_INCOME'
                    WHEN '4-NOT SPECIFIED' THEN 'CAPEX' ELSE 'TOTAL_ASSETS' END AS metric,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(date_trunc('quarter', o_orderdate) AS DATE) END AS period_start,
               last_day(CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL '2' MONTH AS DATE)) AS period_end,
               o_totalprice AS value, o_orderkey AS filing_id, CAST(o_orderdate AS DATE) AS filed_date,
               CAST(o_orderdate AS TIMESTAMP) AS available_at, 1 + o_orderkey % 3 AS priority,
               CASE WHEN o_orderstatus = 'P' THEN 'INVALID_SIGN' ELSE 'VALID' END AS quality_state
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "b_symbols": """
        SELECT key, symbol, effective_from, lead(effective_from) OVER (PARTITION BY key ORDER BY effective_from, part_id) AS effective_to, part_id
        FROM (SELECT p_partkey % 200 AS key, p_brand AS symbol, CAST(DATE '1990-01-01' + CAST(p_partkey AS INT) AS DATE) AS effective_from, p_partkey AS part_id FROM {part}) AS p""",
    "b_events": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS economic_time, user_id AS instrument_id, event_type, value, props AS payload FROM {events}""",
    "b_search": """
        SELECT p_partkey AS document_id, p_brand AS symbol, p_name AS name, p_type AS sector, CAST(p_size AS STRING) AS industry FROM {part}""",
    "b_panel": """
        SELECT instrument_id, session_date AS signal_at, close, volume, close * volume AS market_cap,
               close / lag(close) OVER (PARTITION BY instrument_id ORDER BY session_date) - 1 AS score,
               lead(close) OVER (PARTITION BY instrument_id ORDER BY session_date) / close - 1 AS total_return
        FROM (SELECT instrument_id, session_date, floor(CAST(sum(CAST(floor(close * 100 + 0.5) AS BIGINT)) AS DOUBLE) * 100 / count(*)) / 10000 AS close, sum(volume) AS volume FROM {b_bars} WHERE quality_state = 'VALID' GROUP BY instrument_id, session_date) AS m""",
    "b_scores": """
        SELECT i.instrument_id, i.issuer_id, i.symbol, i.sector, i.profile, i.primary_class, p.signal_at AS as_of, p.score AS composite, p.market_cap,
               p.score IS NOT NULL AND i.profile = 'GENERAL' AS eligible
        FROM {b_panel} AS p JOIN {b_instruments} AS i ON p.instrument_id = i.instrument_id""",
    "b_components": """
        SELECT total_id, fact_id, n, no, start AS period_start, CAST(CASE WHEN n = 3 AND no = 1 OR n = 1 THEN start + 364 WHEN n = 3 THEN start + 180 WHEN total_id % 17 = 0 THEN start + 130 ELSE start + 90 END AS DATE) AS period_end, value, accession, CASE WHEN total_id % 19 <> 0 THEN document END AS artifact_id, document, size, part
        FROM (SELECT l_orderkey AS total_id, l_orderkey * 16 + no AS fact_id, n, no, CAST(DATE '2001-01-01' + CAST(CASE WHEN n = 4 THEN 91 * (no - 1) WHEN n = 3 AND no = 2 THEN 365 ELSE 0 END AS INT) AS DATE) AS start,
                     CAST(l_quantity * 100 AS DECIMAL(18, 4)) AS value, l_orderkey * 8 + no % 2 AS accession, CAST(floor(l_orderkey / 8) AS BIGINT) AS document, CAST(round(l_tax * 100) AS INT) * 10 - 5 AS size, l_partkey AS part
              FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS no, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n FROM {lineitem}) AS l) AS c""",
    "b_totals": """
        SELECT total_id, CASE WHEN total_id % 23 <> 0 THEN sum(CASE WHEN n = 3 AND no = 3 THEN -value ELSE value END) + CASE WHEN total_id % 13 = 0 THEN 0.01 ELSE 0 END END AS total,
               CASE WHEN total_id % 46 = 0 THEN 'STALE' END AS total_reason, CAST(count(*) + CASE WHEN total_id % 29 = 0 THEN 1 ELSE 0 END AS INT) AS sources
        FROM {b_components} GROUP BY total_id""",
    "b_entries": """
        SELECT document AS artifact_id, CASE WHEN k = 1 THEN 'DepreciationDepletionAndAmortization' WHEN k < 4 THEN 'DepreciationAndAmortization' ELSE 'Revenues' END AS concept, accession + CASE WHEN part % 9 = 1 THEN 1 ELSE 0 END AS accn,
               period_start AS start, CAST(period_end + CASE WHEN part % 10 = 1 THEN 1 ELSE 0 END AS DATE) AS ending, CASE WHEN part % 12 = 1 THEN '8-K' WHEN no = 1 THEN '10-K' ELSE '10-Q/A' END AS form, CAST(size * k AS DECIMAL(18, 4)) AS val
        FROM {b_components} JOIN (VALUES (1), (2), (3), (4)) AS t(k) ON CASE k WHEN 1 THEN part % 3 > 0 WHEN 2 THEN part % 8 > 0 WHEN 3 THEN part % 11 = 0 ELSE true END""",
    "b_years": """
        SELECT l_suppkey * 8 + l_partkey % 8 AS instrument_id, l_suppkey AS supplier, CAST(year(l_shipdate) AS INT) AS run, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS size, CAST(count(*) AS INT) AS n
        FROM {lineitem} GROUP BY l_suppkey * 8 + l_partkey % 8, l_suppkey, year(l_shipdate)""",
    "b_cards": """
        SELECT run, instrument_id, issuer_id, make_date(run, 12, 31) AS score_date, CAST(make_date(run, 12, 31) AS TIMESTAMP) + INTERVAL '20' HOUR AS cutoff, make_date(run, 9, 30) AS statement_end,
               CASE WHEN instrument_id % 10 < 5 THEN 'GENERAL' WHEN instrument_id % 10 < 7 THEN 'BANK' WHEN instrument_id % 10 = 7 THEN 'PC_INSURER' WHEN instrument_id % 10 = 8 THEN 'LIFE_INSURER' ELSE 'EQUITY_REIT' END AS profile,
               CASE WHEN h % 11 <> 0 THEN sector END AS peer_group, h % 29 <> 0 AS profile_supported, h % 31 <> 0 AS in_universe, h % 37 <> 0 AS active, instrument_id % 10 <> 1 AS primary_class,
               CASE WHEN h % 23 = 0 THEN 'FUND' ELSE 'COMMON_STOCK' END AS security_type, CAST(CASE WHEN h % 26 = 0 THEN 200 ELSE 260 + h % 50 END AS INT) AS history_count, CAST(CASE WHEN h % 34 = 0 THEN 10 ELSE 20 + h % 5 END AS INT) AS liquidity_count,
               CAST(make_date(run, 12, 31) - CAST(CASE WHEN h % 19 = 0 THEN 200 ELSE 30 + h % 120 END AS INT) AS DATE) AS filing_date, CASE WHEN h % 5 = 0 THEN 'CA' ELSE 'US' END AS jurisdiction,
               CASE WHEN h % 13 = 0 THEN 'SUBSIDIARY' ELSE 'PUBLIC_PARENT' END AS regulatory_scope, CASE WHEN h % 19 <> 0 THEN 'STANDARDIZED' END AS capital_approach,
               h % 7 <> 0 AS reit_reconciled, h % 17 <> 0 AS same_store_pool_consistent, CASE WHEN h % 9 = 0 THEN 0 ELSE 2 END AS requirement_count,
               concat_ws(',', CASE WHEN h % 21 = 0 THEN 'STALE_OR_MISSING_FILING' END, CASE WHEN h % 43 = 0 THEN concat('MISSING_SESSION:', CAST(run AS STRING), '-11-30') END, CASE WHEN h % 41 = 0 THEN 'STALE_SHARES' END, CASE WHEN h % 47 = 0 THEN 'INACTIVE_OR_UNSUPPORTED_SECURITY:DEPOSITARY_RECEIPT' END) AS blocked
        FROM (SELECT run, instrument_id, CASE WHEN instrument_id % 10 = 1 THEN instrument_id - 1 ELSE instrument_id END AS issuer_id, r_name AS sector, CAST((instrument_id * 37 + run * 11 + n * 5) % 1009 AS INT) AS h
              FROM {b_years} AS y JOIN {supplier} ON supplier = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) AS c""",
    "b_inputs": f"""
        SELECT run, instrument_id, key, CASE WHEN fault <> 0 THEN CASE WHEN run = 1998 AND key = 'MOMENTUM_RECENT' THEN 110.0 WHEN run = 1998 AND key = 'MOMENTUM_OLD' THEN 100.0 WHEN unit = 'pure' THEN scale * part ELSE size * scale * part END END AS value,
               CASE WHEN fault = 4 THEN 'EUR' ELSE unit END AS unit, CASE WHEN fault = 1 THEN 0 ELSE 1 END AS sources,
               CAST(CAST(make_date(run, 12, 31) - CASE WHEN fault = 2 THEN -1 ELSE 20 END AS DATE) AS TIMESTAMP) AS available_at,
               CAST(CAST(make_date(run, 12, 31) - CASE WHEN fault = 3 THEN -1 ELSE 19 END AS DATE) AS TIMESTAMP) AS observed_at,
               CAST(period_end - 90 AS DATE) AS period_start, period_end,
               make_date(run, 1, 1) AS effective_from, CASE WHEN fault = 5 THEN make_date(run, 6, 1) ELSE make_date(run + 1, 1, 1) END AS effective_to
        FROM (SELECT *, CAST(CASE WHEN key IN ('RAW_CLOSE', 'ADJUSTED_CLOSE') THEN make_date(run, 12, 31) ELSE make_date(run, 9, 30) END - (back + CASE WHEN fault = 5 THEN 150 WHEN fault = 6 THEN -100 ELSE 0 END) AS DATE) AS period_end
              FROM (SELECT run, instrument_id, size, key, unit, scale, back, (instrument_id * 7 + no * 13 + run * 3) % 523 AS fault, CAST((instrument_id * 31 + run * 17 + no * 7) % 23 + 2 AS DOUBLE) / 14 - CASE WHEN (instrument_id + no * 5 + run) % 211 = 0 THEN 2 ELSE 0 END AS part
                    FROM {{b_years}} AS y JOIN (VALUES {_KEYS}) AS k(no, key, unit, scale, back) ON true) AS e) AS d""",
}

#: Small views from which long ones are made, dealt by the keys that these meet on, so that the long rows are made where they are needed.
DEALT = {"b_years": ["run", "instrument_id"]}


class Views:
    """Input tables and domain views of a folder, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in VIEWS:
                text = VIEWS[name]
                made = self.spark.sql(text, **{n: getattr(self, n) for n in sorted(set(re.findall(r"\{(\w+)\}", text)))})
                self.known[name] = made.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *DEALT[name]) if name in DEALT else made  # by number: few short rows would be put into one task
            elif name in TABLES:
                self.known[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.known[name]


def with_views(body: str) -> str:
    """``body`` behind the definitions of the domain views that it names."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(body)
    heads = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order]
    own = body.strip()
    if own.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*heads, own[15:]])
    if own.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*heads, own[5:]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + own


class Registry:
    """Queries by name, with their SQL."""

    def __init__(self) -> None:
        self.made: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
        def keep(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
            if name in self.made:
                raise ValueError(name)
            self.made[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
            if sql:
                self.sql[name] = with_views(sql)
            return build

        return keep
