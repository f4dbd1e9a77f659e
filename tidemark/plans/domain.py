"""Canonical facts, preparation, models, publication, screener, research and ingestion quality on the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import actions, contracts, facts, model, publication, quality, ranking, research, screener, technical
from tidemark.operators import calendar as K
from tidemark.operators import temporal as T
from tidemark.plans.temporal import AS_OF, FACTS_AS_OF, day, last_day
from tidemark.plans.views import Registry, Views

R = Registry()
S_LAST = "s AS (SELECT * FROM b_scores WHERE as_of = DATE '2000-12-31')"


def _known(v: Views) -> DataFrame:
    return facts.facts_as_of(v.b_facts, AS_OF)


@R.add("n01_canonical_facts", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'UNMAPPED' WHEN o_orderkey % 8 = 0 THEN 'INVALID_UNIT' WHEN o_orderstatus = 'P' THEN 'INVALID_SIGN' ELSE 'VALID' END AS state, CASE WHEN o_custkey % 10 = 0 THEN 999 ELSE CAST(o_custkey % 10 AS INT) END AS priority, round(o_totalprice * CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE (o_custkey % 10) END, 2) AS canonical_value FROM orders")
def _n01(v: Views) -> DataFrame:
    mapping = v.orders.sparkSession.range(1, 10).select(F.col("id").alias("concept"), F.col("id").cast("int").alias("priority"), F.col("id").cast("double").alias("multiplier"))
    raw = v.orders.select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 10).alias("concept"), F.col("o_totalprice").alias("value"))
    met = facts.source_priority(raw, mapping, "concept")
    state = facts.quality_state(F.lit(True), F.col("multiplier").isNotNull(), F.col("o_orderkey") % 8 != 0, F.lit(True), F.lit(True), F.col("o_orderstatus") != "P")
    return met.select("o_orderkey", state.alias("state"), "priority", F.round("canonical_value", 2).alias("canonical_value"))


@R.add("n03_common_equity", "SELECT o_custkey AS filing, CASE WHEN bool_and(o_totalprice > 2000) AND count(DISTINCT o_orderstatus) = 1 THEN round(max(o_totalprice), 2) END AS equity FROM orders GROUP BY 1")
def _n03(v: Views) -> DataFrame:
    one = (F.count_distinct("o_orderstatus") == 1) & F.bool_and(F.col("o_totalprice") > 2000)
    return v.orders.groupBy(F.col("o_custkey").alias("filing")).agg(F.when(one, F.round(F.max("o_totalprice"), 2)).alias("equity"))


@R.add("n04_link_shares", "SELECT f.filing_id, i.instrument_id FROM b_facts f JOIN (SELECT issuer_id, min(instrument_id) AS instrument_id FROM b_instruments WHERE valid_to IS NULL GROUP BY 1 HAVING count(*) = 1) i ON f.issuer_id = i.issuer_id WHERE metric = 'TOTAL_ASSETS'")
def _n04(v: Views) -> DataFrame:
    return actions.link_shares(v.b_facts.filter("metric = 'TOTAL_ASSETS'"), v.b_instruments.filter("valid_to IS NULL")).select("filing_id", "instrument_id")


@R.add("n06_profile_observations", "SELECT filing_id, CASE WHEN count(*) FILTER (quality_state = 'VALID') = 0 THEN 'NO_VALID_FACT' ELSE 'OBSERVED' END AS status FROM b_facts GROUP BY 1")
def _n06(v: Views) -> DataFrame:
    return v.b_facts.groupBy("filing_id").agg(F.when(F.count_if(F.col("quality_state") == "VALID") == 0, "NO_VALID_FACT").otherwise("OBSERVED").alias("status"))


@R.add("n07_statements", "SELECT issuer_id, metric, CASE metric WHEN 'TOTAL_ASSETS' THEN 'BALANCE' WHEN 'CAPEX' THEN 'CASH_FLOW' ELSE 'INCOME' END AS statement, count(*) AS n FROM b_facts GROUP BY 1, 2")
def _n07(v: Views) -> DataFrame:
    kinds = v.b_facts.sparkSession.sql("SELECT * FROM VALUES ('TOTAL_ASSETS', 'BALANCE'), ('CAPEX', 'CASH_FLOW'), ('REVENUE', 'INCOME'), ('NET_INCOME', 'INCOME'), ('OPERATING_INCOME', 'INCOME') AS t(metric, statement)")
    return v.b_facts.join(F.broadcast(kinds), "metric", "left").groupBy("issuer_id", "metric", "statement").agg(F.count("*").alias("n"))


@R.add("c01_canonical_actions", "SELECT event_id, event_type AS kind, CASE event_type WHEN 'purchase' THEN value WHEN 'click' THEN 1 / nullif(value, 0) END AS term, CASE WHEN event_type = 'error' THEN 'REVIEW_REQUIRED' WHEN event_type IN ('purchase', 'click') AND value > 0 THEN 'VALID' ELSE 'MALFORMED' END AS state FROM events")
def _c01(v: Views) -> DataFrame:
    return actions.canonical_actions(v.b_events.select("event_id", F.col("event_type").alias("kind"), "value"), cash="purchase", split="click", review=["error"])


@R.add("c02_action_issues", "SELECT instrument_id, count(*) FILTER (event_type = 'error') AS open_issues FROM b_events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0")
def _c02(v: Views) -> DataFrame:
    return v.b_events.groupBy("instrument_id").agg(F.count_if(F.col("event_type") == "error").alias("open_issues")).filter("open_issues > 0")


@R.add("c03_latest_actions", "SELECT instrument_id, event_type, event_id FROM b_events QUALIFY row_number() OVER (PARTITION BY instrument_id, event_type ORDER BY economic_time DESC, event_id DESC) = 1")
def _c03(v: Views) -> DataFrame:
    return T.latest_per(v.b_events, ["instrument_id", "event_type"], [F.desc("economic_time"), F.desc("event_id")]).select("instrument_id", "event_type", "event_id")


@R.add("p01_trailing_year", f"WITH {FACTS_AS_OF}, e AS (SELECT DISTINCT issuer_id, metric, period_end FROM facts WHERE period_start IS NOT NULL), q AS (SELECT a.issuer_id, a.metric, a.period_end, a.value + b.value + c.value + d.value AS total FROM facts a JOIN facts b ON a.issuer_id = b.issuer_id AND a.metric = b.metric AND b.period_end = CAST(a.period_start - INTERVAL 1 DAY AS DATE) JOIN facts c ON a.issuer_id = c.issuer_id AND a.metric = c.metric AND c.period_end = CAST(b.period_start - INTERVAL 1 DAY AS DATE) JOIN facts d ON a.issuer_id = d.issuer_id AND a.metric = d.metric AND d.period_end = CAST(c.period_start - INTERVAL 1 DAY AS DATE) WHERE d.period_start IS NOT NULL) SELECT e.issuer_id, e.metric, CAST(e.period_end AS STRING) AS period_end, CASE WHEN total IS NOT NULL THEN 'QUARTERS' END AS method, round(total, 2) AS value FROM e LEFT JOIN q ON e.issuer_id = q.issuer_id AND e.metric = q.metric AND e.period_end = q.period_end")
def _p01(v: Views) -> DataFrame:
    return facts.trailing_year(_known(v), ["issuer_id", "metric"]).select("issuer_id", "metric", day("period_end"), "method", F.round("value", 2).alias("value"))


@R.add("p02_balances", f"WITH {FACTS_AS_OF} SELECT issuer_id, CAST(period_end AS STRING) AS period_end, metric, round(value, 2) AS value FROM facts WHERE period_start IS NULL AND metric = 'TOTAL_ASSETS' QUALIFY period_end = max(period_end) OVER (PARTITION BY issuer_id)")
def _p02(v: Views) -> DataFrame:
    return facts.balances(_known(v)).select("issuer_id", day("period_end"), "metric", F.round("value", 2).alias("value"))


@R.add("p03_prior_balances", f"WITH {FACTS_AS_OF}, i AS (SELECT issuer_id, period_end, value, max(period_end) OVER (PARTITION BY issuer_id) AS latest FROM facts WHERE period_start IS NULL AND metric = 'TOTAL_ASSETS') SELECT issuer_id, CAST(latest AS STRING) AS latest, CASE WHEN count(DISTINCT period_end) = 1 THEN round(min(value), 2) END AS value FROM i WHERE date_diff('day', period_end, latest) BETWEEN 350 AND 380 GROUP BY issuer_id, i.latest")
def _p03(v: Views) -> DataFrame:
    return facts.prior_balances(_known(v)).select("issuer_id", day("latest"), F.round("value", 2).alias("value"))


@R.add("p04_last_annual", f"WITH {FACTS_AS_OF} SELECT issuer_id, CAST(period_end AS STRING) AS period_end, dense_rank() OVER (PARTITION BY issuer_id ORDER BY facts.period_end DESC) AS back FROM facts WHERE metric = 'NET_INCOME' QUALIFY back <= 3")
def _p04(v: Views) -> DataFrame:
    return facts.last_annual(_known(v), "NET_INCOME").select("issuer_id", day("period_end"), F.col("back").cast("long").alias("back"))


@R.add("p05_market_values", "SELECT instrument_id, CAST(signal_at AS STRING) AS signal_at, 'close' AS key, close AS value FROM b_panel UNION ALL SELECT instrument_id, CAST(signal_at AS STRING), 'volume', volume FROM b_panel")
def _p05(v: Views) -> DataFrame:
    return v.b_panel.unpivot(["instrument_id", "signal_at"], ["close", "volume"], "key", "value").withColumn("signal_at", F.col("signal_at").cast("string"))


@R.add("p07_missing_inputs", f"WITH {FACTS_AS_OF}, e AS (SELECT DISTINCT issuer_id, metric FROM b_facts) SELECT e.issuer_id, e.metric, 'MISSING' AS reason FROM e WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.issuer_id = e.issuer_id AND f.metric = e.metric AND f.period_end = DATE '2000-09-30')")
def _p07(v: Views) -> DataFrame:
    have = _known(v).filter(F.col("period_end") == F.lit("2000-09-30").cast("date"))
    return v.b_facts.select("issuer_id", "metric").distinct().join(have, ["issuer_id", "metric"], "left_anti").withColumn("reason", F.lit("MISSING"))


@R.add("p08_equity_difference", f"WITH {FACTS_AS_OF} SELECT issuer_id, CAST(period_end AS STRING) AS period_end, round(max(value) FILTER (metric = 'REVENUE') - max(value) FILTER (metric = 'OPERATING_INCOME'), 2) AS cost FROM facts WHERE metric IN ('REVENUE', 'OPERATING_INCOME') GROUP BY issuer_id, facts.period_end HAVING count(DISTINCT metric) = 2")
def _p08(v: Views) -> DataFrame:
    return actions.difference(_known(v), "REVENUE", "OPERATING_INCOME").select("issuer_id", day("period_end"), F.round("value", 2).alias("cost"))


@R.add("p09_reviewed_facts", f"WITH {FACTS_AS_OF}, r AS (SELECT issuer_id, metric, period_end, max(value) AS value FROM b_facts WHERE quality_state <> 'VALID' GROUP BY 1, 2, 3) SELECT r.issuer_id, r.metric, CAST(r.period_end AS STRING) AS period_end, round(r.value, 2) AS value FROM r WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.issuer_id = r.issuer_id AND f.metric = r.metric AND f.period_end = r.period_end)")
def _p09(v: Views) -> DataFrame:
    keys = ["issuer_id", "metric", "period_end"]
    reviewed = v.b_facts.filter("quality_state <> 'VALID'").groupBy(*keys).agg(F.max("value").alias("value"))
    return reviewed.join(_known(v).select(*keys), keys, "left_anti").select("issuer_id", "metric", day("period_end"), F.round("value", 2).alias("value"))


@R.add("p10_cross_section", f"WITH {FACTS_AS_OF}, b AS (SELECT instrument_id, count(*) AS bars FROM b_bars WHERE available_at <= TIMESTAMP '{AS_OF}' AND quality_state = 'VALID' GROUP BY 1), f AS (SELECT issuer_id, count(*) AS n FROM facts GROUP BY 1) SELECT i.instrument_id, coalesce(bars, 0) AS bars, coalesce(n, 0) AS facts, concat_ws(',', CASE WHEN i.valid_to IS NOT NULL THEN 'DELISTED' END, CASE WHEN n IS NULL THEN 'NO_FACTS' END, CASE WHEN profile <> 'GENERAL' THEN 'UNSUPPORTED_PROFILE' END) AS reasons FROM b_instruments i LEFT JOIN b ON i.instrument_id = b.instrument_id LEFT JOIN f ON i.issuer_id = f.issuer_id")
def _p10(v: Views) -> DataFrame:
    bars = T.known_as_of(v.b_bars, AS_OF, ("available_at",)).filter("quality_state = 'VALID'").groupBy("instrument_id").agg(F.count("*").alias("_b"))
    known = _known(v).groupBy("issuer_id").agg(F.count("*").alias("_f"))
    met = v.b_instruments.join(bars, "instrument_id", "left").join(known, "issuer_id", "left")
    why = S.reasons((F.col("valid_to").isNotNull(), "DELISTED"), (F.col("_f").isNull(), "NO_FACTS"), (F.col("profile") != "GENERAL", "UNSUPPORTED_PROFILE"))
    return met.select("instrument_id", F.coalesce("_b", F.lit(0)).alias("bars"), F.coalesce("_f", F.lit(0)).alias("facts"), F.array_join(why, ",").alias("reasons"))


@R.add("p11_tax_rate", "SELECT o_custkey AS issuer, CASE WHEN count(*) >= 3 THEN round(greatest(0, least(0.4, list_sort(list(r ORDER BY o_orderkey DESC)[1:3])[2])), 6) ELSE 0.21 END AS rate FROM (SELECT o_custkey, o_orderkey, o_totalprice / 1000000 AS r FROM orders) x GROUP BY 1")
def _p11(v: Views) -> DataFrame:
    rates = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") / 1_000_000).alias("r"))))), 1, 3)
    return v.orders.groupBy(F.col("o_custkey").alias("issuer")).agg(rates.alias("_r")).select("issuer", F.round(model.tax_rate(F.transform("_r", lambda x: x["r"]), F.lit(0.21)), 6).alias("rate"))


@R.add("p13_period_methods", f"WITH {FACTS_AS_OF} SELECT metric, CASE WHEN period_start IS NULL THEN 'INSTANT' ELSE 'QUARTER' END AS kind, count(*) AS n FROM facts GROUP BY 1, 2")
def _p13(v: Views) -> DataFrame:
    return _known(v).groupBy("metric", S.period_kind(F.col("period_start"), F.col("period_end")).alias("kind")).agg(F.count("*").alias("n"))


@R.add("a01_simple_composite", "WITH r AS (SELECT instrument_id, signal_at, score AS a, market_cap AS b, volume AS c FROM b_panel WHERE score IS NOT NULL), z AS (SELECT *, (a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0) AS za, (b - avg(b) OVER w) / nullif(stddev_pop(b) OVER w, 0) AS zb, (c - avg(c) OVER w) / nullif(stddev_pop(c) OVER w, 0) AS zc FROM r WINDOW w AS (PARTITION BY signal_at)) SELECT instrument_id, CAST(signal_at AS STRING) AS signal_at, round((coalesce(za, 0) + coalesce(zb, 0) + coalesce(zc, 0)) / 3, 6) AS composite FROM z")
def _a01(v: Views) -> DataFrame:
    raw = v.b_panel.filter("score IS NOT NULL").select("instrument_id", "signal_at", F.col("score").alias("value_raw"), F.col("market_cap").alias("momentum_raw"), F.col("volume").alias("quality_raw"))
    return model.simple_composite(raw, ["signal_at"]).select("instrument_id", day("signal_at"), F.round("composite", 6).alias("composite"))


@R.add("a02_accept_inputs", "SELECT filing_id, CASE WHEN available_at > TIMESTAMP '2000-12-31 20:00:00' THEN 'FUTURE_INFORMATION' WHEN priority = 3 THEN 'INVALID_UNIT' WHEN date_diff('day', filed_date, DATE '2000-12-31') > 180 THEN 'STALE' END AS reason FROM b_facts")
def _a02(v: Views) -> DataFrame:
    return v.b_facts.select("filing_id", model.accept_input(F.col("value"), F.col("priority") != 3, F.col("available_at"), F.lit(AS_OF).cast("timestamp"), F.datediff(last_day(), "filed_date"), 180).alias("reason"))


@R.add("a03_derived_metrics", f"WITH {FACTS_AS_OF}, w AS (SELECT issuer_id, period_end, max(value) FILTER (metric = 'REVENUE') AS revenue, max(value) FILTER (metric = 'NET_INCOME') AS income, max(value) FILTER (metric = 'TOTAL_ASSETS') AS assets FROM facts GROUP BY 1, 2) SELECT issuer_id, CAST(period_end AS STRING) AS period_end, round(income / revenue, 6) AS margin, round(income / assets, 6) AS roa, CASE WHEN income IS NULL THEN 'NET_INCOME' WHEN assets IS NULL THEN 'TOTAL_ASSETS' END AS missing FROM w")
def _a03(v: Views) -> DataFrame:
    wide = _known(v).groupBy("issuer_id", "period_end").pivot("metric", ["REVENUE", "NET_INCOME", "TOTAL_ASSETS"]).agg(F.max("value"))
    income = F.col("NET_INCOME")
    return wide.select("issuer_id", day("period_end"), F.round(screener.ratio(income, F.col("REVENUE")), 6).alias("margin"), F.round(screener.ratio(income, F.col("TOTAL_ASSETS")), 6).alias("roa"), screener.first_reason((income, "NET_INCOME"), (F.col("TOTAL_ASSETS"), "TOTAL_ASSETS")).alias("missing"))


@R.add("a08_eligibility_gates", "SELECT s.instrument_id, CAST(s.as_of AS STRING) AS as_of, concat_ws(',', CASE WHEN market_cap < 5000000 THEN 'ILLIQUID' END, CASE WHEN NOT primary_class THEN 'SECONDARY_CLASS' END) AS exclusions FROM b_scores s")
def _a08(v: Views) -> DataFrame:
    rows = v.b_scores.select("instrument_id", "as_of", F.lit(10.0).alias("price"), F.col("market_cap").alias("traded_value"), F.lit(300).alias("history"), F.lit(20).alias("liquidity"), F.date_sub("as_of", 30).alias("filed_date"), "primary_class")
    return model.eligibility(rows).select("instrument_id", day("as_of"), F.array_join("exclusions", ",").alias("exclusions"))


NORM = """WITH s AS (SELECT *, bool_or(primary_class) OVER (PARTITION BY as_of, issuer_id) AS any_p FROM b_scores WHERE composite IS NOT NULL),
fit AS (SELECT * FROM s WHERE NOT any_p OR primary_class),
pb AS (SELECT as_of, sector, quantile_cont(composite, 0.025) AS lo, quantile_cont(composite, 0.975) AS hi FROM fit GROUP BY 1, 2), fb AS (SELECT as_of, quantile_cont(composite, 0.025) AS lo, quantile_cont(composite, 0.975) AS hi FROM fit GROUP BY 1),
pm AS (SELECT f.as_of, f.sector, lo, hi, count(*) AS n, avg(greatest(lo, least(hi, composite))) AS m, stddev_pop(greatest(lo, least(hi, composite))) AS sd FROM fit f JOIN pb ON f.as_of = pb.as_of AND f.sector = pb.sector GROUP BY 1, 2, 3, 4),
fm AS (SELECT f.as_of, lo, hi, count(*) AS n, avg(greatest(lo, least(hi, composite))) AS m, stddev_pop(greatest(lo, least(hi, composite))) AS sd FROM fit f JOIN fb ON f.as_of = fb.as_of GROUP BY 1, 2, 3),
j AS (SELECT s.*, CASE WHEN pm.n >= 20 THEN 'PEER' WHEN fm.n >= 40 THEN 'FALLBACK' END AS cohort, CASE WHEN pm.n >= 20 THEN pm.n WHEN fm.n >= 40 THEN fm.n END AS cohort_n,
  CASE WHEN pm.n >= 20 THEN pm.lo ELSE fm.lo END AS lo, CASE WHEN pm.n >= 20 THEN pm.hi ELSE fm.hi END AS hi, CASE WHEN pm.n >= 20 THEN pm.m ELSE fm.m END AS m, CASE WHEN pm.n >= 20 THEN pm.sd ELSE fm.sd END AS sd
  FROM s LEFT JOIN pm ON s.as_of = pm.as_of AND s.sector = pm.sector LEFT JOIN fm ON s.as_of = fm.as_of),
norm AS (SELECT *, CASE WHEN cohort IS NOT NULL THEN greatest(-3, least(3, CASE WHEN sd < 1e-12 THEN 0 ELSE (greatest(lo, least(hi, composite)) - m) / nullif(sd, 0) END)) END AS z FROM j)"""


def _norm(v: Views) -> DataFrame:
    from pyspark.sql.window import Window

    s = v.b_scores.filter("composite IS NOT NULL").withColumn("any_p", F.bool_or("primary_class").over(Window.partitionBy("as_of", "issuer_id")))
    return model.normalize(s, ["as_of"], "sector", None, "composite", ~F.col("any_p") | F.col("primary_class"), 20, 40)


@R.add("a15_normalize_cohorts", NORM + " SELECT instrument_id, CAST(as_of AS STRING) AS as_of, cohort, cohort_n, round(z, 6) AS z FROM norm")
def _a15(v: Views) -> DataFrame:
    return _norm(v).select("instrument_id", day("as_of"), "cohort", "cohort_n", F.round("z", 6).alias("z"))


@R.add("q07_sector_breakdown", NORM + " SELECT sector, 'composite' AS metric, count(composite) AS available, count(*) FILTER (cohort = 'PEER') AS peer, count(*) FILTER (cohort = 'FALLBACK') AS fallback, count(*) FILTER (composite IS NOT NULL AND cohort IS NULL) AS no_cohort, min(cohort_n) AS smallest FROM norm GROUP BY 1")
def _q07(v: Views) -> DataFrame:
    return publication.sector_breakdown(_norm(v).withColumn("metric", F.lit("composite")).withColumn("value", F.col("composite")))


@R.add("q06_cohort_audit", NORM + " SELECT sector, 'composite' AS metric, max(cohort_n) AS recomputed FROM norm WHERE cohort = 'PEER' GROUP BY 1 HAVING max(cohort_n) IS DISTINCT FROM 21")
def _q06(v: Views) -> DataFrame:
    n = _norm(v).withColumn("metric", F.lit("composite"))
    stored = n.select("sector", "metric").distinct().withColumn("stored", F.lit(21).cast("long"))
    return publication.cohort_audit(n, stored).filter("recomputed IS NOT NULL").select("sector", "metric", "recomputed")


LONG = "l AS (SELECT instrument_id, signal_at, 'value' AS family, 'a' AS metric, score AS z FROM b_panel UNION ALL SELECT instrument_id, signal_at, 'value', 'b', total_return FROM b_panel UNION ALL SELECT instrument_id, signal_at, 'quality', 'c', CASE WHEN instrument_id % 3 = 0 THEN NULL ELSE score * 2 END FROM b_panel UNION ALL SELECT instrument_id, signal_at, 'momentum', 'd', total_return FROM b_panel)"


def _long(v: Views) -> DataFrame:
    p = v.b_panel
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(m).alias("metric"), z.alias("z")) for f, m, z in (("value", "a", F.col("score")), ("value", "b", F.col("total_return")), ("quality", "c", F.when(F.col("instrument_id") % 3 != 0, F.col("score") * 2)), ("momentum", "d", F.col("total_return")))))
    return p.select("instrument_id", "signal_at", F.explode(rows).alias("x")).select("instrument_id", "signal_at", "x.*")


@R.add("a11_compose_strict", f"WITH {LONG} SELECT instrument_id, CAST(signal_at AS STRING) AS signal_at, family, CASE WHEN count(z) >= 2 THEN round(sum(coalesce(z, 0)) / 3, 6) END AS score FROM l GROUP BY instrument_id, l.signal_at, family")
def _a11(v: Views) -> DataFrame:
    return model.compose_strict(_long(v), ["instrument_id", "signal_at"]).select("instrument_id", day("signal_at"), "family", F.round("score", 6).alias("score"))


@R.add("a16_compose_flexible", f"WITH {LONG}, w AS (SELECT instrument_id, signal_at, avg(z) FILTER (family = 'value') AS v, avg(z) FILTER (family = 'quality') AS q, avg(z) FILTER (family = 'momentum') AS m FROM l GROUP BY 1, 2), h AS (SELECT *, CASE WHEN v IS NULL THEN 0 ELSE 0.5 END + CASE WHEN q IS NULL THEN 0 ELSE 0.3 END + CASE WHEN m IS NULL THEN 0 ELSE 0.2 END AS have FROM w) SELECT instrument_id, CAST(signal_at AS STRING) AS signal_at, CASE WHEN have > 0 THEN round((coalesce(v, 0) * 0.5 + coalesce(q, 0) * 0.3 + coalesce(m, 0) * 0.2) / CAST(have AS DOUBLE), 6) END AS composite, CASE WHEN v IS NOT NULL AND q IS NOT NULL AND m IS NOT NULL THEN 'COMPLETE' WHEN have > 0 THEN 'PARTIAL' END AS status FROM h")
def _a16(v: Views) -> DataFrame:
    return model.compose_flexible(_long(v), ["instrument_id", "signal_at"]).select("instrument_id", day("signal_at"), F.round("composite", 6).alias("composite"), "status")


@R.add("a13_issuer_capitalization", "SELECT instrument_id, CASE WHEN count(*) OVER (PARTITION BY issuer_id) = 1 THEN instrument_id * 10 END AS shares FROM b_instruments")
def _a13(v: Views) -> DataFrame:
    return model.issuer_capitalization(v.b_instruments.withColumn("shares", F.col("instrument_id") * 10), []).select("instrument_id", "shares")


@R.add("a14_representatives", "SELECT instrument_id, issuer_id FROM (SELECT *, bool_or(primary_class) OVER (PARTITION BY issuer_id) AS p FROM b_instruments) x WHERE NOT p OR primary_class")
def _a14(v: Views) -> DataFrame:
    return screener.representatives(v.b_instruments, []).select("instrument_id", "issuer_id")


@R.add("a17_score_runs", "WITH e AS (SELECT * FROM b_scores WHERE eligible AND composite IS NOT NULL), r AS (SELECT as_of, instrument_id, composite, row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, instrument_id) AS rank, count(*) OVER (PARTITION BY as_of) AS n FROM e) SELECT CAST(as_of AS STRING) AS as_of, instrument_id, rank, CASE WHEN n > 1 THEN round(100.0 * (n - avg(rank) OVER (PARTITION BY as_of, composite)) / (n - 1), 6) END AS percentile, n AS scored, CASE WHEN n >= 2 THEN 'SCORED' ELSE 'FAILED' END AS status FROM r")
def _a17(v: Views) -> DataFrame:
    return model.score_runs(v.b_scores, ["as_of"]).select(day("as_of"), "instrument_id", F.col("rank").cast("long").alias("rank"), F.round("percentile", 6).alias("percentile"), "scored", "status")


@R.add("a18_candidate_weights", "SELECT instrument_id, CAST(signal_at AS STRING) AS signal_at, c.name AS candidate, round(score * c.a + total_return * c.b + score * c.c, 6) AS composite FROM b_panel, (VALUES ('primary', 0.5, 0.3, 0.2), ('balanced', 0.4, 0.4, 0.2), ('value_quality', 0.6, 0.4, 0.0), ('pure_value', 1.0, 0.0, 0.0)) c(name, a, b, c) WHERE score IS NOT NULL AND total_return IS NOT NULL")
def _a18(v: Views) -> DataFrame:
    fam = v.b_panel.filter("score IS NOT NULL AND total_return IS NOT NULL").select("instrument_id", "signal_at", F.col("score").alias("value"), F.col("total_return").alias("quality"), F.col("score").alias("momentum"))
    return model.candidates(fam).select("instrument_id", day("signal_at"), "candidate", F.round("candidate_composite", 6).alias("composite"))


@R.add("a19_simulate", f"WITH {S_LAST}, x AS (SELECT 'base' AS scenario, instrument_id, composite, eligible FROM s UNION ALL SELECT 'raise', instrument_id, CASE WHEN instrument_id = 8 THEN 99.0 ELSE composite END, eligible OR instrument_id = 8 FROM s) SELECT scenario, instrument_id, row_number() OVER (PARTITION BY scenario ORDER BY composite DESC, instrument_id) AS rank FROM x WHERE eligible AND composite IS NOT NULL")
def _a19(v: Views) -> DataFrame:
    what = v.b_scores.sparkSession.sql("SELECT 'base' AS scenario, CAST(NULL AS BIGINT) AS instrument_id, CAST(NULL AS DOUBLE) AS composite UNION ALL SELECT 'raise', 8, 99.0D")
    return model.simulate(v.b_scores.filter(F.col("as_of") == last_day()), what, ["as_of"]).select("scenario", "instrument_id", F.col("rank").cast("long").alias("rank"))


@R.add("r01_result_scores", f"WITH {S_LAST}, r AS (SELECT instrument_id, composite, row_number() OVER (ORDER BY composite DESC, instrument_id) AS rank, count(*) OVER () AS n FROM s WHERE eligible) SELECT 'run-1' AS run_id, instrument_id, rank, CAST(round_even(CAST(composite AS DECIMAL(38,12)), 6) AS DOUBLE) AS composite, CAST(round_even(CAST(100.0 * (n - rank) / CAST(n - 1 AS DOUBLE) AS DECIMAL(38,12)), 6) AS DOUBLE) AS percentile FROM r")
def _r01(v: Views) -> DataFrame:
    scored = model.score_runs(v.b_scores.filter(F.col("as_of") == last_day()), ["as_of"]).withColumn("rank", F.col("rank").cast("long"))
    return publication.result_scores(scored, F.lit("run-1"))


@R.add("r02_run_identity", None)
def _r02(v: Views) -> DataFrame:
    requests = v.b_sessions.select(F.col("session_date").alias("as_of"), F.lit("MONTH_END").alias("policy"))
    return publication.run_identity(requests, "policy", "as_of").select(day("as_of"), "run_key", "supersedes")


@R.add("q01_publication_guard", """WITH u AS (SELECT s.session_date AS as_of, i.instrument_id FROM b_sessions s JOIN b_instruments i ON i.valid_to IS NULL OR i.valid_to > s.session_date),
s AS (SELECT as_of, instrument_id, row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, instrument_id) + CASE WHEN month(as_of) = 3 THEN 1 ELSE 0 END AS rank FROM b_scores WHERE eligible AND sector <> 'ASIA'),
x AS (SELECT as_of, instrument_id, CASE WHEN profile <> 'GENERAL' THEN 'PROFILE' END AS reason FROM b_scores WHERE sector <> 'ASIA' AND (NOT eligible OR composite > 0.5)),
k AS (SELECT as_of, instrument_id FROM u UNION SELECT as_of, instrument_id FROM s UNION SELECT as_of, instrument_id FROM x),
r AS (SELECT k.as_of, 'MISSING' AS rule, count(*) FILTER (s.rank IS NULL AND x.as_of IS NULL) AS n, count(*) FILTER (u.as_of IS NULL) AS un, count(*) FILTER (s.rank IS NOT NULL AND x.as_of IS NOT NULL) AS both_, count(*) FILTER (x.as_of IS NOT NULL AND x.reason IS NULL) AS nr,
  CASE WHEN count(s.rank) = 0 OR (min(s.rank) = 1 AND max(s.rank) = count(s.rank)) THEN 0 ELSE 1 END AS gap
  FROM k LEFT JOIN u ON k.as_of = u.as_of AND k.instrument_id = u.instrument_id LEFT JOIN s ON k.as_of = s.as_of AND k.instrument_id = s.instrument_id LEFT JOIN x ON k.as_of = x.as_of AND k.instrument_id = x.instrument_id GROUP BY 1)
SELECT CAST(as_of AS STRING) AS as_of, n AS missing, un AS unexpected, both_ AS both, nr AS no_reason, CAST(gap AS BIGINT) AS rank_gap FROM r""")
def _q01(v: Views) -> DataFrame:
    known = v.b_scores.filter("sector <> 'ASIA'")
    scored = ranking.ordinal_rank(known.filter("eligible"), ["as_of"]).withColumn("rank", F.col("rank") + (F.month("as_of") == 3).cast("int"))
    excluded = known.filter("NOT eligible OR composite > 0.5").withColumn("reason", F.when(F.col("profile") != "GENERAL", "PROFILE"))
    days = F.broadcast(v.b_sessions.select(F.col("session_date").alias("as_of")))  # a calendar
    dealt = v.b_instruments.select("instrument_id", "valid_to").repartition(4 * v.spark.sparkContext.defaultParallelism, "instrument_id")  # by number: few short rows would be put into one task, which then makes all their days
    universe = dealt.join(days, F.col("valid_to").isNull() | (F.col("valid_to") > F.col("as_of")))
    return publication.guard(scored, excluded, universe, ["as_of"]).withColumn("as_of", F.col("as_of").cast("string"))


@R.add("q02_rank_sequence", f"WITH {S_LAST}, r AS (SELECT instrument_id, row_number() OVER (ORDER BY composite DESC, instrument_id) AS rank, row_number() OVER (ORDER BY market_cap DESC, instrument_id) AS other FROM s WHERE eligible) SELECT instrument_id, rank, other FROM r WHERE rank <> other")
def _q02(v: Views) -> DataFrame:
    s = v.b_scores.filter((F.col("as_of") == last_day()) & F.col("eligible"))
    a, b = ranking.ordinal_rank(s, ["as_of"]), ranking.ordinal_rank(s, ["as_of"], "market_cap").select("instrument_id", F.col("rank").alias("other"))
    return a.join(b, "instrument_id").filter("rank <> other").select("instrument_id", F.col("rank").cast("long").alias("rank"), F.col("other").cast("long").alias("other"))


@R.add("q03_late_lineage", f"SELECT observation_key FROM b_bars WHERE session_date = DATE '2000-12-31' AND available_at > TIMESTAMP '2000-12-20'")
def _q03(v: Views) -> DataFrame:
    used = v.b_bars.filter(F.col("session_date") == last_day()).select("observation_key")
    return publication.late_lineage(used, v.b_bars, "2000-12-20")


@R.add("q04_source_retention", "SELECT i.instrument_id, count(DISTINCT b.observation_key) AS sources FROM b_instruments i LEFT JOIN b_bars b ON i.instrument_id = b.instrument_id AND b.session_date = DATE '2000-12-31' GROUP BY 1")
def _q04(v: Views) -> DataFrame:
    return publication.source_retention(v.b_instruments, v.b_bars.filter(F.col("session_date") == last_day()))


@R.add("v01_record_reviews", "SELECT n.o_orderkey AS review_id, CASE WHEN o_orderstatus <> 'F' THEN 'RECORDED' WHEN o_orderpriority < '3' THEN 'REPEATED' ELSE 'CONFLICT' END AS outcome FROM orders n")
def _v01(v: Views) -> DataFrame:
    held = v.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderpriority") < "3", F.col("o_orderstatus")).otherwise("?").alias("content"))
    new = v.orders.select(F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("content"))
    return quality.record_reviews(held, new, "review_id", "content").select("review_id", "outcome")


@R.add("v03_admissible_reviews", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _v03(v: Views) -> DataFrame:
    return quality.admissible(v.customer.select("c_custkey"), v.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@R.add("v04_triage", "SELECT o_custkey AS k, CASE WHEN bool_or(o_orderpriority LIKE '1-%') THEN 'REVIEW' WHEN bool_or(o_orderpriority LIKE '2-%') THEN 'COLLECT' WHEN bool_or(o_orderpriority LIKE '5-%') THEN 'WAIT' ELSE 'NONE' END AS action FROM orders GROUP BY 1")
def _v04(v: Views) -> DataFrame:
    return quality.triage(v.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("code")), "k")


@R.add("v05_diagnose_missing", f"WITH {FACTS_AS_OF}, e AS (SELECT DISTINCT issuer_id, metric, period_end FROM b_facts) SELECT e.issuer_id, e.metric, CAST(e.period_end AS STRING) AS period_end, 'NOT_YET_KNOWN' AS cause FROM e WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.issuer_id = e.issuer_id AND f.metric = e.metric AND f.period_end = e.period_end)")
def _v05(v: Views) -> DataFrame:
    keys = ["issuer_id", "metric", "period_end"]
    return publication.diagnose(v.b_facts.select(*keys).distinct(), _known(v).select(*keys), v.b_facts, keys).withColumn("period_end", F.col("period_end").cast("string"))


@R.add("e01_ranking_rows", f"WITH {S_LAST} SELECT s.instrument_id, string_agg(CAST(p.signal_at AS STRING), ',' ORDER BY p.signal_at) AS history FROM s LEFT JOIN b_panel p ON p.instrument_id = s.instrument_id AND p.signal_at > DATE '2000-09-30' AND p.signal_at <= DATE '2000-12-31' GROUP BY 1")
def _e01(v: Views) -> DataFrame:
    near = v.b_panel.filter("signal_at > DATE'2000-09-30' AND signal_at <= DATE'2000-12-31'").groupBy("instrument_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("signal_at").cast("string"))), ",").alias("history"))
    return v.b_scores.filter(F.col("as_of") == last_day()).select("instrument_id").join(near, "instrument_id", "left")


@R.add("e02_company_search", "WITH q AS (SELECT * FROM (VALUES (1, 'red'), (2, 'brand#1'), (2, 'ring'), (3, 'eco')) t(query_id, token)), d AS (SELECT document_id, lower(symbol) AS sy, lower(name) AS na, lower(sector) AS se, lower(industry) AS ind FROM b_search), p AS (SELECT q.query_id, d.document_id, greatest(CASE WHEN sy = token THEN 10 ELSE 0 END, CASE WHEN starts_with(sy, token) THEN 5 ELSE 0 END, CASE WHEN starts_with(na, token) THEN 4 ELSE 0 END, CASE WHEN contains(na, ' ' || token) THEN 3 ELSE 0 END, CASE WHEN contains(na, token) THEN 2 ELSE 0 END, CASE WHEN contains(se, token) THEN 2 ELSE 0 END, CASE WHEN starts_with(ind, token) THEN 2 ELSE 0 END) AS points FROM d CROSS JOIN q) SELECT query_id, document_id, CAST(sum(points) AS BIGINT) AS relevance FROM p GROUP BY 1, 2 HAVING bool_and(points > 0)")
def _e02(v: Views) -> DataFrame:
    asked = v.part.sparkSession.sql("SELECT * FROM VALUES (1, 'red'), (2, ' Brand#1  RING '), (3, 'eco eco') AS t(query_id, query)")
    return screener.search(v.b_search, asked)


@R.add("e04_sector_comparison", f"WITH {S_LAST} SELECT sector, count(*) AS members, round(median(composite), 6) AS median_score, concat_ws(',', CASE WHEN count(*) FILTER (eligible) < 25 THEN 'FEW_ELIGIBLE' END, CASE WHEN count(*) < 20 THEN 'SMALL_SECTOR' END) AS warnings FROM s GROUP BY 1")
def _e04(v: Views) -> DataFrame:
    g = v.b_scores.filter(F.col("as_of") == last_day()).groupBy("sector").agg(F.count("*").alias("members"), F.round(F.percentile("composite", F.lit(0.5)), 6).alias("median_score"), F.count_if("eligible").alias("_e"))
    return g.select("sector", "members", "median_score", F.array_join(S.reasons((F.col("_e") < 25, "FEW_ELIGIBLE"), (F.col("members") < 20, "SMALL_SECTOR")), ",").alias("warnings"))


@R.add("e05_input_view", f"WITH {FACTS_AS_OF}, k AS (SELECT DISTINCT issuer_id, metric FROM b_facts) SELECT k.issuer_id, k.metric, CASE WHEN count(f.value) > 0 THEN 'AVAILABLE' ELSE 'MISSING' END AS status FROM k LEFT JOIN facts f ON k.issuer_id = f.issuer_id AND k.metric = f.metric AND f.period_end = DATE '2000-09-30' GROUP BY 1, 2")
def _e05(v: Views) -> DataFrame:
    have = _known(v).filter("period_end = DATE'2000-09-30'").select("issuer_id", "metric").distinct().withColumn("_h", F.lit(True))
    return v.b_facts.select("issuer_id", "metric").distinct().join(have, ["issuer_id", "metric"], "left").select("issuer_id", "metric", F.when(F.col("_h"), "AVAILABLE").otherwise("MISSING").alias("status"))


@R.add("e07_display_metrics", "SELECT instrument_id, CAST(signal_at AS STRING) AS signal_at, CASE WHEN close > 0 THEN round(volume / close, 6) END AS volume_to_price, CASE WHEN score IS NULL THEN 'NO_SCORE' END AS reason FROM b_panel")
def _e07(v: Views) -> DataFrame:
    return v.b_panel.select("instrument_id", day("signal_at"), F.round(screener.ratio(F.col("volume"), F.col("close")), 6).alias("volume_to_price"), screener.first_reason((F.col("score"), "NO_SCORE")).alias("reason"))


@R.add("e08_component_sums", "SELECT l_orderkey AS fact_id, CASE WHEN count(*) IN (1, 3, 4) THEN round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END), 2) END AS total, CASE WHEN count(*) NOT IN (1, 3, 4) THEN 'PERIODS_UNRESOLVED' WHEN sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) < 0 THEN 'NEGATIVE' END AS reason FROM lineitem GROUP BY 1")
def _e08(v: Views) -> DataFrame:
    parts = v.lineitem.select(F.col("l_orderkey").alias("fact_id"), F.col("l_quantity").alias("value"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign"))
    return actions.component_sums(parts).withColumn("total", F.round("total", 2))


@R.add("e10_publication_rsi", None)
def _e10(v: Views) -> DataFrame:
    grid = technical.closes_grid(v.b_instruments, v.b_sessions, T.bars_as_of(v.b_bars, AS_OF, "RAW"), "2000-12-31", 60)
    return technical.rsi(T.contiguous_suffix(grid, "instrument_id", "k", "close"), "instrument_id", "k", "close").select("instrument_id", F.round("rsi", 4).alias("rsi"), "reason", "sessions")


@R.add("b01_partitions", "WITH d AS (SELECT DISTINCT signal_at FROM b_panel), n AS (SELECT signal_at, row_number() OVER (ORDER BY signal_at) AS i, count(*) OVER () AS n FROM d) SELECT CAST(signal_at AS STRING) AS signal_at, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part FROM n")
def _b01(v: Views) -> DataFrame:
    return research.partitions(v.b_panel, "signal_at").select(day("signal_at"), "part")


@R.add("b02_walk_forward", "WITH d AS (SELECT DISTINCT signal_at FROM b_panel), y AS (SELECT DISTINCT year(signal_at) AS year FROM d), t AS (SELECT year FROM y QUALIFY row_number() OVER (ORDER BY year) >= 3) SELECT CAST(t.year AS INT) AS year, count(*) AS training, CAST(max(signal_at) AS STRING) AS until FROM t JOIN d ON signal_at < CAST(make_date(CAST(t.year AS INT), 1, 1) - INTERVAL 6 MONTH AS DATE) GROUP BY 1 HAVING count(*) >= 12")
def _b02(v: Views) -> DataFrame:
    return research.walk_forward(v.b_panel, "signal_at").select("year", "training", day("until"))


@R.add("b05_rank_ic", "WITH p AS (SELECT * FROM b_panel WHERE score IS NOT NULL AND total_return IS NOT NULL), r AS (SELECT signal_at, rank() OVER (PARTITION BY signal_at ORDER BY score) + (count(*) OVER (PARTITION BY signal_at, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY signal_at ORDER BY total_return) + (count(*) OVER (PARTITION BY signal_at, total_return) - 1) / 2.0 AS b FROM p) SELECT CAST(signal_at AS STRING) AS signal_at, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY r.signal_at")
def _b05(v: Views) -> DataFrame:
    return research.rank_ic(v.b_panel, "score", "total_return", "signal_at").select(day("signal_at"), F.round("ic", 6).alias("ic"), "n")


HAC = "WITH s AS (SELECT instrument_id, signal_at, total_return AS x FROM b_panel WHERE total_return IS NOT NULL), m AS (SELECT *, x - avg(x) OVER (PARTITION BY instrument_id) AS e FROM s), l AS (SELECT instrument_id, x, e, e * lag(e, 1) OVER w AS g1, e * lag(e, 2) OVER w AS g2, e * lag(e, 3) OVER w AS g3 FROM m WINDOW w AS (PARTITION BY instrument_id ORDER BY signal_at)) SELECT instrument_id, count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) / (sqrt(sum(e * e) + 2 * (0.75 * coalesce(sum(g1), 0) + 0.5 * coalesce(sum(g2), 0) + 0.25 * coalesce(sum(g3), 0))) / count(*)), 6) AS t FROM l GROUP BY 1"


@R.add("b06_hac_mean", HAC)
def _b06(v: Views) -> DataFrame:
    s = v.b_panel.filter("total_return IS NOT NULL")
    return research.hac_mean(s, "total_return", "signal_at", 3, ["instrument_id"]).select("instrument_id", "n", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"))


@R.add("b04_net_returns", None)
def _b04(v: Views) -> DataFrame:
    w = research.top_weights(v.b_scores.filter("eligible"), 8)
    p = v.b_panel.select(F.col("signal_at").alias("as_of"), "instrument_id", "total_return")
    return research.net_returns(w, p, 25.0).select(day("as_of"), F.round("net", 8).alias("net"), F.round("gross", 8).alias("gross"))


@R.add("b03_turnover", "WITH w AS (SELECT as_of, instrument_id, 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM (SELECT * FROM b_scores WHERE eligible QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, instrument_id) <= 8) x), d AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS i FROM (SELECT DISTINCT as_of FROM w) y), a AS (SELECT i, instrument_id, weight FROM w JOIN d ON w.as_of = d.as_of UNION ALL SELECT i + 1, instrument_id, -weight FROM w JOIN d ON w.as_of = d.as_of), s AS (SELECT i, instrument_id, sum(weight) AS x FROM a GROUP BY 1, 2) SELECT CAST(d.as_of AS STRING) AS as_of, round(sum(abs(x)), 6) AS turnover FROM d JOIN s ON d.i = s.i GROUP BY d.as_of")
def _b03(v: Views) -> DataFrame:
    return research.turnover(research.top_weights(v.b_scores.filter("eligible"), 8), ["as_of"]).select(day("as_of"), F.round("turnover", 6).alias("turnover"))


@R.add("b07_newey_west", None)
def _b07(v: Views) -> DataFrame:
    return research.newey_west(v.b_panel, "total_return", ["score"], "signal_at", ["instrument_id"])


@R.add("b08_factor_diagnostics", None)
def _b08(v: Views) -> DataFrame:
    return research.factor_diagnostics(v.b_panel.filter("score IS NOT NULL AND total_return IS NOT NULL"), ["score", "total_return", "market_cap"], ["signal_at"])


@R.add("b12_drawdown", "WITH s AS (SELECT signal_at, avg(total_return) AS r FROM b_panel WHERE total_return IS NOT NULL GROUP BY 1), w AS (SELECT signal_at, exp(sum(ln(1 + r)) OVER (ORDER BY signal_at)) AS wealth FROM s) SELECT CAST(signal_at AS STRING) AS signal_at, round(wealth / greatest(1, max(wealth) OVER (ORDER BY w.signal_at)) - 1, 6) AS drawdown FROM w")
def _b12(v: Views) -> DataFrame:
    s = v.b_panel.filter("total_return IS NOT NULL").groupBy("signal_at").agg(F.avg("total_return").alias("r"))
    return research.drawdown(s, "r", "signal_at").select(day("signal_at"), F.round("drawdown", 6).alias("drawdown"))


@R.add("b13_market_regimes", None)
def _b13(v: Views) -> DataFrame:
    return research.market_regimes(v.b_panel.filter("total_return IS NOT NULL"), "instrument_id", "signal_at", "total_return")


@R.add("st02_first_deliveries", "WITH d AS (SELECT event_id, event_type, value FROM b_events UNION ALL SELECT event_id, event_type, value FROM b_events WHERE event_type = 'click') SELECT event_id, min(value) AS value, count(*) - 1 AS redeliveries FROM d GROUP BY 1")
def _st02(v: Views) -> DataFrame:
    e = v.b_events.select("event_id", "economic_time", "value")
    again = v.b_events.filter("event_type = 'click'").select("event_id", "economic_time", "value")
    return quality.first_deliveries(e.unionByName(again), "event_id", ["economic_time", "value"]).select("event_id", "value", "redeliveries")


@R.add("st03_identity_conflicts", "SELECT user_id AS instrument_id FROM events GROUP BY 1 HAVING min(event_type) <> max(event_type)")
def _st03(v: Views) -> DataFrame:
    return quality.identity_conflicts(v.b_events, "instrument_id", "event_type")


@R.add("st05_replay", "SELECT event_id FROM events WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE value > 20)")
def _st05(v: Views) -> DataFrame:
    dead = v.b_events.filter("event_type = 'error'")
    return quality.missing(dead, v.b_events.filter("value > 20"), ["event_id"])


@R.add("st07_page_conflicts", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_quantity) AS versions FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) > 1")
def _st07(v: Views) -> DataFrame:
    return quality.page_conflicts(v.lineitem, ["l_orderkey", "l_linenumber"], "l_quantity")


@R.add("st08_session_gaps", "SELECT i.instrument_id, CAST(s.session_date AS STRING) AS session_date FROM b_instruments i CROSS JOIN b_sessions s WHERE NOT EXISTS (SELECT 1 FROM b_bars b WHERE b.instrument_id = i.instrument_id AND b.session_date = s.session_date AND b.mode = 'RAW')")
def _st08(v: Views) -> DataFrame:
    grid = v.b_instruments.select("instrument_id").join(F.broadcast(v.b_sessions.select("session_date")))
    return quality.missing(grid, v.b_bars.filter("mode = 'RAW'"), ["instrument_id", "session_date"]).select("instrument_id", day("session_date"))


@R.add("st09_expected_items", "SELECT sector, CAST(s.session_date AS STRING) AS session_date, count(*) AS items FROM b_instruments i CROSS JOIN b_sessions s GROUP BY 1, 2")
def _st09(v: Views) -> DataFrame:
    grid = v.b_instruments.select("instrument_id", "sector").join(F.broadcast(v.b_sessions.select("session_date")))
    return grid.groupBy("sector", "session_date").agg(F.count("*").alias("items")).withColumn("session_date", F.col("session_date").cast("string"))


@R.add("st10_complete_items", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_nationkey <> 3")
def _st10(v: Views) -> DataFrame:
    events = v.orders.select(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") != "P").alias("accepted"))
    return quality.complete_items(v.customer.select(F.col("c_custkey").alias("k")), events, v.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("k")), "k")


COVER = "c AS (SELECT DISTINCT o_orderstatus AS dataset, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"


@R.add("st12_complete_through", f"WITH {COVER}, k AS (SELECT DISTINCT dataset FROM c), d AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day), g AS (SELECT k.dataset, min(d.day) FILTER (c.day IS NULL) AS gap FROM k CROSS JOIN d LEFT JOIN c ON c.dataset = k.dataset AND c.day = d.day GROUP BY 1) SELECT dataset, CASE WHEN gap IS NULL THEN '1998-12-31' WHEN gap > DATE '1998-01-01' THEN CAST(CAST(gap - INTERVAL 1 DAY AS DATE) AS STRING) END AS complete_through FROM g")
def _st12(v: Views) -> DataFrame:
    c = v.orders.filter("o_orderdate >= TIMESTAMP'1998-01-01'").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderdate").cast("date").alias("day"))
    return K.complete_through(c, "dataset", "1998-01-01", "1998-12-31").select("dataset", day("complete_through"))


@R.add("st13_readiness", "SELECT o_custkey AS run, CASE WHEN f > d THEN 'FAILED' WHEN f > 0 THEN 'DEGRADED' WHEN p > 0 THEN 'SYNCING' ELSE 'READY' END AS readiness FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS d, count(*) FILTER (o_orderstatus = 'P') AS f, count(*) FILTER (o_orderstatus = 'O') AS p FROM orders GROUP BY 1) x")
def _st13(v: Views) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    counts = v.orders.groupBy(F.col("o_custkey").alias("run")).agg(n("F").alias("done"), n("P").alias("failed"), n("O").alias("pending"))
    return quality.readiness(counts).select("run", "readiness")


@R.add("st14_refresh_plan", "SELECT event_id, CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') BETWEEN 0 AND 5 THEN '2024-01-20' END AS refresh_on FROM events")
def _st14(v: Views) -> DataFrame:
    return K.refresh_plan(v.events.withColumn("day", F.col("ts").cast("date")), "2024-01-20", 5).select("event_id", day("refresh_on"))


@R.add("s11_parse_bars", "SELECT l_orderkey AS page, CAST(l_suppkey AS STRING) AS symbol, l_extendedprice AS close, CASE WHEN l_quantity > 5 THEN l_tax END AS vwap FROM lineitem")
def _s11(v: Views) -> DataFrame:
    from tidemark.sources.readers import parse_bars

    n = F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("long")).otherwise(0)
    bar = F.struct(F.lit("2024-01-02T05:00:00Z").alias("t"), *(F.col("l_extendedprice").alias(c) for c in "ohlc"), n.alias("v"), n.alias("n"), F.when(n > 0, F.col("l_tax")).otherwise(0.0).alias("vw"))
    page = F.to_json(F.struct(F.map_from_arrays(F.array(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"))), F.array(F.array(bar))).alias("bars")))
    rows = parse_bars(v.lineitem.select(page.alias("document")))
    return rows.select(F.substring_index("symbol", "/", 1).cast("long").alias("page"), F.substring_index("symbol", "/", -1).alias("symbol"), "close", "vwap")


@R.add("s13_parse_overview", "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN value END AS ratio, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN 'ratio' ELSE '' END AS errors FROM events")
def _s13(v: Views) -> DataFrame:
    from tidemark.sources.readers import parse_overview

    text = F.when(F.col("event_id") % 3 == 0, "None").when(F.col("event_id") % 7 == 0, "abc").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    docs = v.events.select("event_id", F.to_json(F.struct(text.alias("ratio"))).alias("document"))
    return parse_overview(docs, {"ratio": "double"}).select("event_id", "ratio", F.array_join("errors", ",").alias("errors"))


@R.add("f05_event_contract", "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'PAYLOAD_HASH_MISMATCH' ELSE '' END AS violations FROM events")
def _f05(v: Views) -> DataFrame:
    e = v.b_events.withColumn("schema_version", F.lit(2)).withColumn("observation_key", S.framed_hash(F.col("instrument_id"), F.col("event_type"), F.date_format("economic_time", "yyyy-MM-dd'T'HH:mm:ss"))).withColumn("payload_hash", F.when(F.col("event_id") % 97 != 0, F.sha2("payload", 256)).otherwise("x"))
    return contracts.events(e).select("event_id", F.array_join("violations", ",").alias("violations"))


def run_requests(v: Views, n: int | None = None) -> DataFrame:
    """A run for each session (the last ``n``), as known at the end of its day."""
    out = v.b_sessions.select(F.col("session_date").cast("string").alias("run_id"), F.col("session_date").alias("day"), F.expr("CAST(session_date AS TIMESTAMP) + INTERVAL '20' HOUR").alias("cutoff"))
    return out.orderBy(F.desc("day")).limit(n) if n else out


@R.add("many_runs_momentum", """
WITH r AS (SELECT session_date AS day, CAST(session_date AS TIMESTAMP) + INTERVAL '20' HOUR AS cutoff FROM b_sessions),
o AS (SELECT r.day, cutoff, s.session_date, row_number() OVER (PARTITION BY r.day ORDER BY s.session_date DESC) AS n FROM r JOIN b_sessions s ON s.session_date <= r.day QUALIFY n <= 13),
w AS (SELECT o.day, o.n, b.* FROM b_bars b JOIN o ON b.session_date = o.session_date WHERE mode = 'RAW' AND b.available_at <= cutoff AND observed_at <= cutoff QUALIFY row_number() OVER (PARTITION BY o.day, instrument_id, b.session_date ORDER BY b.available_at DESC, observed_at DESC, observation_key) = 1),
m AS (SELECT day, instrument_id, max(close) FILTER (n = 2) / max(close) FILTER (n = 13) - 1 AS momentum FROM w WHERE quality_state = 'VALID' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY momentum DESC, instrument_id) AS rank, count(*) OVER (PARTITION BY day) AS c FROM m WHERE momentum IS NOT NULL)
SELECT CAST(day AS STRING) AS run_id, instrument_id, round(momentum, 6) AS momentum, rank, CASE WHEN c > 1 THEN round(100.0 * (c - avg(rank) OVER (PARTITION BY day, momentum)) / (c - 1), 6) END AS percentile FROM k""")
def many_runs(v: Views) -> DataFrame:
    out = ranking.momentum_runs(v.b_bars, v.b_sessions, run_requests(v))
    return out.select("run_id", "instrument_id", F.round("momentum", 6).alias("momentum"), F.col("rank").cast("long").alias("rank"), F.round("percentile", 6).alias("percentile"))
