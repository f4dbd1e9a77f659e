"""Serving queries: filters, pages, company search, sector comparison and display values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranking import tie_percentile
from tidemark.operators.scoring import why
from tidemark.operators.selection import quantiles

#: Fixed values of the display: section, figure, unit, then the quantity or how it is made of two, and the reason of a bottom that isn't positive.
DISPLAYED = [
    ("VALUATION", "market_cap", "USD", "market_cap"),
    ("VALUATION", "enterprise_value", "USD", "ev"),
    ("VALUATION", "price_to_earnings", "MULTIPLE", "market_cap / NET_INCOME_TTM", "NEGATIVE_EARNINGS"),
    ("VALUATION", "price_to_sales", "MULTIPLE", "market_cap / REVENUE_TTM", "NON_POSITIVE_REVENUE"),
    ("VALUATION", "price_to_book", "MULTIPLE", "market_cap / COMMON_EQUITY", "NON_POSITIVE_EQUITY"),
    ("VALUATION", "price_to_free_cash_flow", "MULTIPLE", "market_cap / fcf", "NEGATIVE_FREE_CASH_FLOW"),
    ("VALUATION", "ev_to_ebit", "MULTIPLE", "ev / ebit", "NON_POSITIVE_EBIT"),
    ("VALUATION", "free_cash_flow_yield", "PERCENT", "fcf / market_cap"),
    ("VALUATION", "dividend_yield", "PERCENT", "COMMON_DIVIDENDS_TTM / market_cap"),
    ("PROFITABILITY", "gross_margin", "PERCENT", "gross_profit / REVENUE_TTM"),
    ("PROFITABILITY", "operating_margin", "PERCENT", "OPERATING_INCOME_TTM / REVENUE_TTM"),
    ("PROFITABILITY", "net_margin", "PERCENT", "NET_INCOME_TTM / REVENUE_TTM"),
    ("PROFITABILITY", "return_on_assets", "PERCENT", "NET_INCOME_TTM / avg_assets"),
    ("PROFITABILITY", "return_on_equity", "PERCENT", "NET_INCOME_TTM / COMMON_EQUITY"),
    ("FINANCIALS", "revenue", "USD", "REVENUE_TTM"),
    ("FINANCIALS", "gross_profit", "USD", "gross_profit"),
    ("FINANCIALS", "operating_income", "USD", "OPERATING_INCOME_TTM"),
    ("FINANCIALS", "net_income", "USD", "NET_INCOME_TTM"),
    ("FINANCIALS", "operating_cash_flow", "USD", "OPERATING_CASH_FLOW_TTM"),
    ("FINANCIALS", "capex", "USD", "CAPEX_TTM"),
    ("FINANCIALS", "free_cash_flow", "USD", "fcf"),
    ("FINANCIALS", "cash", "USD", "CASH"),
    ("FINANCIALS", "total_debt", "USD", "debt"),
    ("FINANCIALS", "net_debt", "USD", "debt - CASH"),
    ("FINANCIALS", "total_assets", "USD", "TOTAL_ASSETS"),
    ("FINANCIALS", "shares_outstanding", "shares", "SHARES_OUTSTANDING"),
    ("MARKET", "price", "USD", "RAW_CLOSE"),
    ("MARKET", "return_1y", "PERCENT", "ADJUSTED_CLOSE over MOMENTUM_OLD"),
    ("MARKET", "momentum_12m_1m", "PERCENT", "momentum"),
    ("MARKET", "median_dollar_volume_20d", "USD", "MEDIAN_DOLLAR_VOLUME"),
]
#: Fixed values of the sector comparison: metrics by family, the least sample.
SECTOR_METRICS = {"book_market": "value", "cash_earnings": "quality", "ebit_ev": "value", "fcf_yield": "value", "gross_profitability": "quality", "momentum": "momentum", "roic": "quality"}
SMALL_SAMPLE = 20


def filter_ranking(scores: DataFrame, warning: str | None = None, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values; a None filter is off. ``warning``: rows whose warnings hold it."""
    for name, value in equal.items():
        if value is not None:
            scores = scores.filter(F.col(name) == F.lit(value))
    return scores.filter(F.array_contains("warnings", warning)) if warning else scores


def holdings(lots: DataFrame, owner: str, value: object, bought: str, ident: str) -> DataFrame:
    """Lots of one owner, newest purchase first."""
    return lots.filter(F.col(owner) == F.lit(value)).orderBy(F.desc(bought), ident)


def ranking_page(scores: DataFrame, sort: str, descending: bool, ident: str, page: int, size: int) -> DataFrame:
    """One page of a ranking: nulls last either way, ties by id. Spark keeps only the page's rows from each partition."""
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return scores.orderBy(key, ident).offset(page * size).limit(size)


def tokens(query: Column) -> Column:
    """Different lower-case words of a query."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != ""))


def search_points(token: Column) -> Column:
    """Best match of a token in a search document: symbol 10, its start 5; name start 4, word start 3, inside 2; sector inside 2; industry start 2."""
    symbol, name, sector, industry = (F.lower(F.coalesce(c, F.lit(""))) for c in ("symbol", "name", "sector", "industry"))
    word = F.concat(F.lit(" "), token)
    rules = ((symbol == token, 10), (F.startswith(symbol, token), 5), (F.startswith(name, token), 4), (F.contains(name, word), 3), (F.contains(name, token), 2), (F.contains(sector, token), 2), (F.startswith(industry, token), 2))
    return F.greatest(*(F.when(hit, points).otherwise(0) for hit, points in rules))


def search(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query (query_id, query: a small table) against all documents: those where each token matches, with the sum of points."""
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token"))
    n = queries.select("query_id", F.size(tokens(F.col("query"))).alias("_n"))
    scored = documents.join(F.broadcast(asked)).withColumn("points", search_points(F.col("token"))).filter("points > 0")
    hits = scored.groupBy("query_id", "document_id").agg(F.sum("points").alias("relevance"), F.count("*").alias("_k"))
    return hits.join(F.broadcast(n), "query_id").filter("_k = _n").drop("_k", "_n")


def sector_counts(scores: DataFrame) -> DataFrame:
    """Members, eligible and general ones of each sector."""
    return scores.groupBy("sector").agg(F.count("*").alias("members"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("profile") == "GENERAL").alias("general"))


def representatives(scores: DataFrame, run: list[str]) -> DataFrame:
    """The primary classes of each issuer, or its only classes if none is primary."""
    any_primary = F.max(F.col("primary_class").cast("int")).over(Window.partitionBy(*run, "issuer_id")) == 1
    return scores.withColumn("_p", any_primary).filter(~F.col("_p") | F.col("primary_class")).drop("_p")


def latest_publication(runs: DataFrame) -> DataFrame:
    """The newest published run whose counts reconcile and that scored two or more."""
    fit = runs.filter((F.col("state") == "PUBLISHED") & (F.col("scored") + F.col("excluded") == F.col("expected")) & (F.col("scored") >= 2))
    return fit.orderBy(F.desc("as_of"), F.desc("published_at"), "run_id").limit(1)


def freshness(as_of: Column, now: Column, days: int = 35) -> Column:
    """STALE when older than ``days``."""
    return F.when(F.datediff(now, as_of) > days, "STALE").otherwise("FRESH")


def ratio(num: Column, den: Column, offset: float = 0.0) -> Column:
    """num / den + offset where den is positive, else null."""
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0)) + offset)


def first_reason(*terms: tuple[Column, str]) -> Column:
    """The reason of the first missing term."""
    return F.coalesce(*(F.when(value.isNull(), F.lit(reason)) for value, reason in terms))


def linear(*terms: tuple[Column, float]) -> Column:
    """Weighted sum, null if any term is."""
    return reduce(lambda a, b: a + b, (value * weight for value, weight in terms))


def display_metrics(wide: DataFrame, keep: list[str]) -> DataFrame:
    """A row per card (``keep``) and figure of DISPLAYED: section, figure, unit, value, shown (multiples and percentages half-even to two digits), reason.

    ``wide`` has a column per quantity and one for its reason (``scoring.general``). A figure lacks what its first missing term lacks, by name;
    a quotient has no value where its bottom isn't positive. Rows don't meet, so nothing is shuffled here.
    """
    lacks = lambda n: F.when(F.col(n).isNull(), F.concat(F.lit(f"{n}:"), F.coalesce(why(n), F.lit("NOT_REPORTED"))))

    def figure(section: str, name: str, unit: str, rule: str, refused: str | None = None) -> Column:
        top, how, bottom = rule.split() if " " in rule else (rule, None, None)
        a, reason = F.col(top), lacks(top)
        if how is None:
            value = a * 100 if unit == "PERCENT" else a
        else:
            b, reason = F.col(bottom), F.coalesce(reason, lacks(bottom))
            if how == "-":
                value = a - b
            else:
                reason = F.coalesce(reason, F.when(b <= 0, refused or f"NON_POSITIVE_DENOMINATOR:{bottom}"))
                value = F.when(b > 0, {"MULTIPLE": a / b, "PERCENT": (a / b - 1) * 100 if how == "over" else a * 100 / b}[unit])
        value = value.cast("double")
        shown = F.bround(value, 2) if unit in ("MULTIPLE", "PERCENT") else value
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("figure"), F.lit(unit).alias("unit"), value.alias("value"), shown.alias("shown"), reason.alias("reason"))

    return wide.select(*keep, F.explode(F.array(*(figure(*row) for row in DISPLAYED))).alias("_f")).select(*keep, "_f.*")


def sector_members(scores: DataFrame, run: list[str], ident: str = "instrument_id", buckets: int = 1) -> DataFrame:
    """``scores`` (``run``, sector, profile, eligible, composite, rank) with the comparison group and the place within it.

    General profiles and the others, which are scored on momentum alone, are never ranked together. Adds comparison (GENERAL or PRICE_ONLY), group_n (ranked
    members of the sector's group), group_rank and group_percentile; null where the run gave no rank. ``buckets``: as in ``ordinal_rank``.
    """
    grouped = scores.withColumn("comparison", F.when(F.col("profile") == "GENERAL", "GENERAL").otherwise("PRICE_ONLY"))
    by = [*run, "sector", "comparison"]
    placed = grouped.filter(F.col("eligible") & F.col("rank").isNotNull()).select(*by, ident, "composite")
    ranked = tie_percentile(placed, by, ident=ident, buckets=buckets).select(*run, ident, F.col("rank").cast("long").alias("group_rank"), F.round("percentile", 6).alias("group_percentile"))
    size = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("group_n"))
    met = grouped.join(ranked, [*run, ident], "left").join(size, by, "left")
    return met.withColumn("group_n", F.when(F.col("group_rank").isNotNull(), F.col("group_n")))


def sector_metrics(members: DataFrame, rows: DataFrame, run: list[str], ident: str = "instrument_id") -> DataFrame:
    """A row per run, sector and metric: how the sector's general members stand.

    observations and median: raw values of eligible representatives (one row per issuer); standardised, fallback and unplaced: members whose
    cohort is the sector's, another or none; peer_size, fallback_cohort and fallback_size: those cohorts. ``rows``: ``run``, ``ident``, metric, raw, cohort, cohort_n.
    The median of a sector of any size is exact (``selection.quantiles``).
    """
    by = [*run, "sector"]
    general = members.filter("comparison = 'GENERAL'")
    one = representatives(general, by).select(*run, ident, F.lit(True).alias("_one"))
    met = rows.filter(F.col("metric").isin([*SECTOR_METRICS])).join(general.select(*by, ident, "eligible"), [*run, ident]).join(one, [*run, ident], "left")
    near = F.startswith("cohort", F.lit("PRIMARY:"))
    seen = F.col("_one") & F.col("eligible") & F.col("raw").isNotNull()
    sums = met.groupBy(*by, "metric").agg(
        F.count_if(seen).alias("observations"), F.count_if(near).alias("standardised"), F.count_if(~near).alias("fallback"),
        F.max(F.when(near, F.col("cohort_n"))).alias("peer_size"), F.min(F.when(~near, F.col("cohort"))).alias("fallback_cohort"), F.max(F.when(~near, F.col("cohort_n"))).alias("fallback_size"),
    )
    middle = quantiles(met.filter(seen).select(*by, "metric", "raw"), [*by, "metric"], "raw", {"median": 0.5}).select(*by, "metric", "median")
    every = F.explode(F.create_map(*(F.lit(x) for pair in SECTOR_METRICS.items() for x in pair))).alias("metric", "family")
    out = general.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select("*", every).join(sums, [*by, "metric"], "left").join(middle, [*by, "metric"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("observations", "standardised", "fallback")}
    out = out.withColumns(zero).withColumn("unplaced", F.col("_n") - F.col("standardised") - F.col("fallback"))
    return out.withColumn("small_sample", F.col("observations") < SMALL_SAMPLE).drop("_n")


def sector_overview(members: DataFrame, metrics: DataFrame, run: list[str]) -> DataFrame:
    """A row per run and sector: members, eligible, general, price_only and the sorted warnings of the comparison."""
    by = [*run, "sector"]
    general, placed = F.col("comparison") == "GENERAL", F.col("eligible")
    n = members.groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(placed).alias("eligible"), F.count_if(general).alias("general"), F.count_if(~general).alias("price_only"),
        F.count_if(general & placed).alias("_g"), F.count_if(~general & placed).alias("_p"),
    )
    told = F.array_compact(F.array(F.when(F.col("fallback") > 0, F.concat(F.lit("FALLBACK_NORMALIZATION:"), "metric")), F.when(F.col("observations") == 0, F.concat(F.lit("NO_OBSERVATIONS:"), "metric"))))
    of_metrics = metrics.groupBy(*by).agg(F.flatten(F.collect_list(told)).alias("_w"))  # two a metric at most
    g, p = F.col("general") > 0, F.col("price_only") > 0
    own = F.array_compact(F.array(
        F.lit("PUBLISHED_SCORES_NOT_RECALCULATED"), F.when(p, "PEER_GROUP_SMALLER_THAN_SECTOR"), F.when(g & p, "PRICE_ONLY_MEMBERS_RANKED_SEPARATELY"),
        F.when(g & (F.col("_g") < SMALL_SAMPLE), "SMALL_SAMPLE:GENERAL"), F.when(p & (F.col("_p") < SMALL_SAMPLE), "SMALL_SAMPLE:PRICE_ONLY"),
    ))
    warnings = F.array_sort(F.concat(own, F.coalesce("_w", F.array().cast("array<string>"))))
    return n.join(of_metrics, by, "left").select(*by, "members", "eligible", "general", "price_only", warnings.alias("warnings"))
