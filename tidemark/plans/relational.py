"""Aggregates, top-k, set operations, scalar functions, calendars and reference data on the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark.operators import calendar as K
from tidemark.operators import comparisons as C
from tidemark.operators import contracts, facts, ranking, reference, screener
from tidemark.operators import temporal as T
from tidemark.operators.selection import quantiles
from tidemark.plans.temporal import AS_OF, PICK, day, last_day
from tidemark.plans.views import Registry, Views

R = Registry()


@R.add("g01_universe_union", "SELECT s_suppkey AS instrument_id, bool_or(code = 'A') AS in_a, bool_or(code = 'B') AS in_b, bool_and(s_suppkey % 10 <> 1) AS primary_class FROM (SELECT 'A' AS code, s_suppkey FROM supplier WHERE s_nationkey <= 14 UNION ALL SELECT 'B', s_suppkey FROM supplier WHERE s_acctbal > 0) x GROUP BY 1")
def _g01(v: Views) -> DataFrame:
    a, b = (v.supplier.filter(rule).select(F.lit(c).alias("code"), F.col("s_suppkey").alias("instrument_id"), (F.col("s_suppkey") % 10 != 1).alias("primary_class")) for c, rule in (("A", "s_nationkey <= 14"), ("B", "s_acctbal > 0")))
    return reference.universe_union(a.unionByName(b), ["A", "B"])


@R.add("g02_price_features", f"WITH {PICK}, o AS (SELECT session_date, row_number() OVER (ORDER BY session_date DESC) AS n FROM b_sessions WHERE session_date <= DATE '2000-12-31' AND available_at <= TIMESTAMP '{AS_OF}') SELECT instrument_id, max(close) FILTER (n = 1) AS last_close, max(close) FILTER (n = 2) AS latest_close, max(close) FILTER (n = 13) AS reference_close, count(*) FILTER (n <= 12) AS history, round(quantile_cont(CASE WHEN n <= 20 THEN close * volume END, 0.5), 4) AS median_value FROM pick JOIN o ON pick.session_date = o.session_date GROUP BY 1")
def _g02(v: Views) -> DataFrame:
    o = T.session_ordinals(v.b_sessions, last_day(), 1 << 30, F.lit(AS_OF).cast("timestamp"))
    return ranking.price_features(T.bars_as_of(v.b_bars, AS_OF, "RAW"), o).withColumn("median_value", F.round("median_value", 4))


@R.add("g04_ordered_bundle", "SELECT issuer_id, metric, string_agg(CAST(filing_id AS STRING), ',' ORDER BY filed_date, filing_id) AS lineage FROM b_facts WHERE quality_state = 'VALID' GROUP BY 1, 2")
def _g04(v: Views) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("filed_date", "filing_id")))
    return v.b_facts.filter("quality_state = 'VALID'").groupBy("issuer_id", "metric").agg(F.array_join(F.transform(ordered, lambda x: x["filing_id"].cast("string")), ",").alias("lineage"))


@R.add("g05_recent_metrics", "SELECT issuer_id, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM b_facts WHERE filed_date >= DATE '2000-07-04' AND filed_date <= DATE '2000-12-31' GROUP BY 1")
def _g05(v: Views) -> DataFrame:
    recent = v.b_facts.filter(F.col("filed_date").between(F.date_sub(last_day(), 180), last_day()))
    return recent.groupBy("issuer_id").agg(F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"))


@R.add("g06_filing_recency", "SELECT issuer_id, bool_or(filed_date >= DATE '2001-06-01') AS recent FROM b_facts GROUP BY 1")
def _g06(v: Views) -> DataFrame:
    return v.b_facts.groupBy("issuer_id").agg(F.bool_or(F.col("filed_date") >= F.lit("2001-06-01").cast("date")).alias("recent"))


@R.add("g07_cohort_bounds", "SELECT CAST(as_of AS STRING) AS as_of, sector, count(*) AS n, round(quantile_cont(composite, 0.025), 6) AS low, round(quantile_cont(composite, 0.975), 6) AS high FROM b_scores s WHERE composite IS NOT NULL GROUP BY s.as_of, sector")
def _g07(v: Views) -> DataFrame:
    bounds = quantiles(v.b_scores, ["as_of", "sector"], "composite", {"low": 0.025, "high": 0.975})
    return bounds.select(F.col("as_of").cast("string").alias("as_of"), "sector", "n", *(F.round(c, 6).alias(c) for c in ("low", "high")))


@R.add("g08_cohort_moments", "WITH b AS (SELECT sector, quantile_cont(composite, 0.025) AS lo, quantile_cont(composite, 0.975) AS hi FROM b_scores WHERE composite IS NOT NULL GROUP BY 1) SELECT s.sector, count(*) AS n, round(avg(greatest(lo, least(hi, composite))), 6) AS mean, round(stddev_pop(greatest(lo, least(hi, composite))), 6) AS sd FROM b_scores s JOIN b ON s.sector = b.sector WHERE composite IS NOT NULL GROUP BY 1")
def _g08(v: Views) -> DataFrame:
    from tidemark.operators.model import cohort_moments

    return cohort_moments(v.b_scores.filter("composite IS NOT NULL"), ["sector"], "composite").select("sector", F.col("n"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@R.add("g09_profile_coverage", "SELECT CAST(as_of AS STRING) AS as_of, profile, count(*) AS n, count(*) FILTER (eligible) AS eligible FROM b_scores s GROUP BY s.as_of, profile")
def _g09(v: Views) -> DataFrame:
    return v.b_scores.groupBy(F.col("as_of").cast("string").alias("as_of"), "profile").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible"))


@R.add("g10_sector_counts", "SELECT sector, count(*) AS members, count(*) FILTER (eligible) AS eligible, count(*) FILTER (profile = 'GENERAL') AS \"general\" FROM b_scores WHERE as_of = DATE '2000-12-31' GROUP BY 1")
def _g10(v: Views) -> DataFrame:
    return screener.sector_counts(v.b_scores.filter(F.col("as_of") == last_day()))


@R.add("g11_sector_metric_summary", "SELECT CAST(as_of AS STRING) AS as_of, sector, round(median(market_cap), 6) AS median_cap, count(*) AS n, round(max(composite), 6) AS best FROM (SELECT *, bool_or(primary_class) OVER (PARTITION BY as_of, issuer_id) AS p FROM b_scores) x WHERE NOT p OR primary_class GROUP BY x.as_of, sector")
def _g11(v: Views) -> DataFrame:
    by = ["as_of", "sector"]
    reps = T.settle(screener.representatives(v.b_scores, ["as_of"]).select(*by, "market_cap", "composite"))
    met = reps.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.max("composite"), 6).alias("best")).join(quantiles(reps, by, "market_cap", {"median_cap": 0.5}, settled=True).drop("n"), by)
    return met.select(F.col("as_of").cast("string").alias("as_of"), "sector", F.round("median_cap", 6).alias("median_cap"), "n", "best")


@R.add("g12_latest_evidence", "SELECT issuer_id, CAST(CAST(max(greatest(available_at, CAST(filed_date AS TIMESTAMP))) AS DATE) AS STRING) AS evidence FROM b_facts GROUP BY 1")
def _g12(v: Views) -> DataFrame:
    return v.b_facts.groupBy("issuer_id").agg(F.max(F.greatest("available_at", F.col("filed_date").cast("timestamp"))).cast("date").cast("string").alias("evidence"))


REASONS = "r AS (SELECT o_custkey AS k, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)"


def _reasons(v: Views) -> DataFrame:
    return v.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("code"))


@R.add("g13_exclusion_overlap", f"WITH {REASONS}, s AS (SELECT k, count(*) AS c FROM r GROUP BY 1) SELECT code, count(*) AS n, count(*) FILTER (c = 1) AS sole FROM r JOIN s ON r.k = s.k GROUP BY 1")
def _g13(v: Views) -> DataFrame:
    return C.reason_overlap(_reasons(v), "k")


@R.add("g13_reason_pairs", f"WITH {REASONS} SELECT a.code AS a, b.code AS b, count(*) AS n FROM r a JOIN r b ON a.k = b.k AND a.code < b.code GROUP BY 1, 2")
def _g13b(v: Views) -> DataFrame:
    return C.reason_pairs(_reasons(v), "k")


@R.add("g14_audit_totals", "SELECT 'status' AS kind, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _g14(v: Views) -> DataFrame:
    return C.union_all([v.orders.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "name", "n") for k, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))])


@R.add("g16_run_progress", "SELECT o_custkey % 50 AS run, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 100 THEN 'FAILED' WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'COMPLETE' ELSE 'RUNNING' END AS state FROM orders GROUP BY 1")
def _g16(v: Views) -> DataFrame:
    from tidemark.operators.quality import run_progress

    return run_progress(v.orders.select((F.col("o_custkey") % 50).alias("run"), F.col("o_orderstatus").alias("status")), 100)


@R.add("g17_health_gauges", "SELECT 'pending' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'errors', CAST(count(*) AS DOUBLE) FROM events WHERE event_type = 'error' UNION ALL SELECT 'oldest_days', CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2002-01-01') AS DOUBLE) FROM orders WHERE o_orderstatus = 'O'")
def _g17(v: Views) -> DataFrame:
    from tidemark.operators.quality import gauges

    return gauges(v.orders, v.events, "2002-01-01")


@R.add("g18_alerts", "WITH g AS (SELECT 'pending' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'errors', CAST(count(*) AS DOUBLE) FROM events WHERE event_type = 'error' UNION ALL SELECT 'oldest_days', CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2002-01-01') AS DOUBLE) FROM orders WHERE o_orderstatus = 'O') SELECT name, value FROM g WHERE (name = 'pending' AND value > 100) OR (name = 'errors' AND value > 1000000) OR (name = 'oldest_days' AND value > 35)")
def _g18(v: Views) -> DataFrame:
    from tidemark.operators.quality import alerts, gauges

    return alerts(gauges(v.orders, v.events, "2002-01-01"), {"pending": 100.0, "errors": 1e6, "oldest_days": 35.0})


@R.add("g19_factor_correlation", "SELECT CAST(signal_at AS STRING) AS signal_at, round(corr(score, total_return), 6) AS score_return, round(corr(score, market_cap), 6) AS score_cap, round(corr(total_return, market_cap), 6) AS return_cap FROM b_panel WHERE score IS NOT NULL AND total_return IS NOT NULL GROUP BY 1")
def _g19(v: Views) -> DataFrame:
    long = C.correlation(v.b_panel.filter("score IS NOT NULL AND total_return IS NOT NULL"), ["score", "total_return", "market_cap"], ["signal_at"])
    pick = lambda a, b: F.round(F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("r"))), 6)
    return long.groupBy("signal_at").agg(pick("score", "total_return").alias("score_return"), pick("score", "market_cap").alias("score_cap"), pick("total_return", "market_cap").alias("return_cap")).withColumn("signal_at", F.col("signal_at").cast("string"))


@R.add("g21_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _g21(v: Views) -> DataFrame:
    return contracts.duplicates(v.lineitem, ["l_orderkey", "l_linenumber"])


@R.add("l01_ranking_page", "SELECT instrument_id, round(composite, 6) AS composite FROM b_scores WHERE as_of = DATE '2000-12-31' ORDER BY composite DESC NULLS LAST, instrument_id LIMIT 20 OFFSET 20")
def _l01(v: Views) -> DataFrame:
    return screener.ranking_page(v.b_scores.filter(F.col("as_of") == last_day()), "composite", True, "instrument_id", 1, 20).select("instrument_id", F.round("composite", 6).alias("composite"))


@R.add("l02_top_weights", "SELECT CAST(as_of AS STRING) AS as_of, instrument_id, 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM (SELECT * FROM b_scores WHERE eligible QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, instrument_id) <= 8) x")
def _l02(v: Views) -> DataFrame:
    from tidemark.operators.research import top_weights

    return top_weights(v.b_scores.filter("eligible"), 8).select(day("as_of"), "instrument_id", "weight")


@R.add("l03_quintiles", "SELECT CAST(as_of AS STRING) AS as_of, instrument_id, ntile(5) OVER (PARTITION BY as_of ORDER BY composite DESC, instrument_id) AS quintile FROM b_scores WHERE eligible")
def _l03(v: Views) -> DataFrame:
    from tidemark.operators.research import quintiles

    return quintiles(v.b_scores.filter("eligible"), ["as_of"]).select(day("as_of"), "instrument_id", F.col("quintile").cast("long").alias("quintile"))


@R.add("l04_sector_neutral_targets", "WITH r AS (SELECT as_of, sector, instrument_id, row_number() OVER (PARTITION BY as_of, sector ORDER BY composite DESC, instrument_id) AS k, count(*) OVER (PARTITION BY as_of, sector) AS n, count(*) OVER (PARTITION BY as_of) AS total FROM b_scores WHERE eligible), p AS (SELECT *, count(*) OVER (PARTITION BY as_of, sector) AS m FROM r WHERE k <= greatest(1, ceil(n / 5.0))) SELECT CAST(as_of AS STRING) AS as_of, instrument_id, round(1.0 * n / total / m, 8) AS weight FROM p")
def _l04(v: Views) -> DataFrame:
    from tidemark.operators.research import sector_neutral

    return sector_neutral(v.b_scores.filter("eligible")).select(day("as_of"), "instrument_id", F.round("weight", 8).alias("weight"))


@R.add("l05_latest_publication", "SELECT run_id, CAST(as_of AS STRING) AS as_of, scored FROM (SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS as_of, CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' ELSE 'PENDING' END AS state, o_custkey % 7 AS scored, 2 AS excluded, 6 AS expected FROM orders) r WHERE state = 'PUBLISHED' AND scored + excluded = expected AND scored >= 2 ORDER BY r.as_of DESC, run_id LIMIT 1")
def _l05(v: Views) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    runs = v.orders.select(F.col("o_orderkey").alias("run_id"), d.alias("as_of"), d.alias("published_at"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("PENDING").alias("state"), (F.col("o_custkey") % 7).alias("scored"), F.lit(2).alias("excluded"), F.lit(6).alias("expected"))
    return screener.latest_publication(runs).select("run_id", day("as_of"), "scored")


@R.add("l06_freshness", "SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 35 THEN 'STALE' ELSE 'FRESH' END AS state FROM orders")
def _l06(v: Views) -> DataFrame:
    return v.orders.select("o_orderkey", screener.freshness(F.col("o_orderdate").cast("date"), F.lit("2001-08-01").cast("date")).alias("state"))


@R.add("l07_snapshot_as_of", "SELECT code, filing_id FROM (SELECT metric AS code, filing_id, quality_state FROM b_facts WHERE filed_date <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY metric ORDER BY filed_date DESC, filing_id DESC) = 1) x WHERE quality_state = 'VALID'")
def _l07(v: Views) -> DataFrame:
    known = v.b_facts.filter(F.col("filed_date") <= F.lit("2000-06-30").cast("date"))
    return T.newest_revisions(known, ["metric"], [F.desc("filed_date"), F.desc("filing_id")], F.col("quality_state") == "VALID").select(F.col("metric").alias("code"), "filing_id")


@R.add("u01_union_all", "SELECT instrument_id, close FROM b_bars WHERE session_date = DATE '1999-01-31' UNION ALL SELECT instrument_id, close FROM b_bars WHERE session_date = DATE '1999-01-31' AND mode = 'RAW'")
def _u01(v: Views) -> DataFrame:
    one = v.b_bars.filter(F.col("session_date") == F.lit("1999-01-31").cast("date"))
    return C.union_all([one.select("instrument_id", "close"), one.filter("mode = 'RAW'").select("instrument_id", "close")])


@R.add("u02_union_distinct", "SELECT l_partkey AS part_id, l_suppkey AS instrument_id FROM lineitem WHERE l_quantity > 40 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.08")
def _u02(v: Views) -> DataFrame:
    two = [v.lineitem.filter(c).select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("instrument_id")) for c in ("l_quantity > 40", "l_discount > 0.08")]
    return C.union_all(two).distinct()


MEMBERS = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')"


@R.add("u03_symmetric_difference", f"WITH {MEMBERS} SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)")
def _u03(v: Views) -> DataFrame:
    return C.symmetric_difference(*(v.orders.filter(c).select(F.col("o_custkey").alias("k")) for c in ("o_orderstatus = 'F'", "o_orderpriority = '5-LOW'")))


@R.add("u04_multiset_difference", "SELECT k, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(n) AS BIGINT) AS n FROM (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderpriority = '5-LOW') AS n FROM orders GROUP BY 1) x WHERE n <> 0")
def _u04(v: Views) -> DataFrame:
    return C.multiset_difference(*(v.orders.filter(c).select(F.col("o_custkey").alias("k")) for c in ("o_orderstatus = 'F'", "o_orderpriority = '5-LOW'")))


def _two_runs(v: Views) -> tuple[DataFrame, DataFrame]:
    one = v.b_panel.filter("score IS NOT NULL").select("instrument_id", F.col("signal_at").cast("string").alias("as_of"), F.round("score", 6).alias("score"))
    return one.filter("abs(score) > 0.01"), one.filter("abs(score) < 2").withColumn("score", F.when(F.col("instrument_id") == 7, F.col("score") + 0.001).otherwise(F.col("score")))


TWO = "p AS (SELECT instrument_id, CAST(signal_at AS STRING) AS as_of, round(score, 6) AS score FROM b_panel WHERE score IS NOT NULL), a AS (SELECT * FROM p WHERE abs(score) > 0.01), b AS (SELECT instrument_id, as_of, CASE WHEN instrument_id = 7 THEN score + 0.001 ELSE score END AS score FROM p WHERE abs(score) < 2)"


@R.add("u05_compare_scores", f"WITH {TWO} SELECT count(*) FILTER (a.instrument_id IS NULL) AS missing_left, count(*) FILTER (b.instrument_id IS NULL) AS missing_right, round(max(abs(a.score - b.score)), 6) AS largest, false AS agrees FROM a FULL JOIN b ON a.instrument_id = b.instrument_id AND a.as_of = b.as_of")
def _u05(v: Views) -> DataFrame:
    return C.score_difference(*_two_runs(v), ["instrument_id", "as_of"], ["score"]).withColumn("largest", F.round("largest", 6))


@R.add("u06_different_cells", f"WITH {TWO} SELECT coalesce(a.instrument_id, b.instrument_id) AS instrument_id, coalesce(a.as_of, b.as_of) AS as_of, 'score' AS field FROM a FULL JOIN b ON a.instrument_id = b.instrument_id AND a.as_of = b.as_of WHERE a.instrument_id IS NULL OR b.instrument_id IS NULL OR abs(a.score - b.score) > 1e-9")
def _u06(v: Views) -> DataFrame:
    return C.different_cells(*_two_runs(v), ["instrument_id", "as_of"], ["score"], [])


@R.add("u08_compare_models", "WITH s AS (SELECT * FROM b_scores WHERE as_of = DATE '2000-12-31'), a AS (SELECT instrument_id, row_number() OVER (ORDER BY composite DESC, instrument_id) AS rank FROM s WHERE eligible), b AS (SELECT instrument_id, row_number() OVER (ORDER BY composite DESC, instrument_id) AS rank FROM s WHERE composite IS NOT NULL AND sector <> 'ASIA') SELECT coalesce(a.instrument_id, b.instrument_id) AS instrument_id, a.rank AS rank_before, b.rank AS rank_after, CASE WHEN a.rank IS NULL THEN 'RECOVERED' WHEN b.rank IS NULL THEN 'LOST' WHEN a.rank = b.rank THEN 'SAME' ELSE 'MOVED' END AS change FROM a FULL JOIN b ON a.instrument_id = b.instrument_id")
def _u08(v: Views) -> DataFrame:
    s = v.b_scores.filter(F.col("as_of") == last_day())
    a, b = (ranking.ordinal_rank(s.filter(c), ["as_of"]).withColumn("rank", F.col("rank").cast("long")) for c in ("eligible", "composite IS NOT NULL AND sector <> 'ASIA'"))
    return C.compare_models(a, b, "instrument_id").select("instrument_id", "rank_before", "rank_after", "change")


@R.add("x01_framed_hash", None)
def _x01(v: Views) -> DataFrame:
    return v.b_events.select("event_id", S.framed_hash(F.col("instrument_id"), F.col("event_type"), F.col("payload")).alias("key"))


@R.add("x02_content_hash", "SELECT event_id, sha256(CAST(user_id AS STRING) || chr(10) || event_type || chr(10) || props) AS hash FROM events")
def _x02(v: Views) -> DataFrame:
    return v.b_events.select("event_id", S.content_hash(F.col("instrument_id"), F.col("event_type"), F.col("payload")).alias("hash"))


@R.add("x03_snapshot_checksum", "SELECT r_name AS snapshot, sha256(string_agg(length(n_name) || ':' || n_name || chr(10), '' ORDER BY length(n_name) || ':' || n_name || chr(10))) AS checksum FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _x03(v: Views) -> DataFrame:
    return v.nation.join(F.broadcast(v.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("snapshot")).agg(S.lines_hash(F.col("n_name")).alias("checksum"))


@R.add("x04_period_kind", "SELECT filing_id, CASE WHEN period_start IS NULL THEN 'INSTANT' WHEN n BETWEEN 350 AND 380 THEN 'ANNUAL' WHEN n BETWEEN 70 AND 110 THEN 'QUARTER' WHEN n BETWEEN 111 AND 349 THEN 'YEAR_TO_DATE' ELSE 'OTHER' END AS kind FROM (SELECT *, date_diff('day', period_start, period_end) + 1 AS n FROM b_facts) x")
def _x04(v: Views) -> DataFrame:
    return v.b_facts.select("filing_id", S.period_kind(F.col("period_start"), F.col("period_end")).alias("kind"))


@R.add("x05_clamp", "SELECT instrument_id, CAST(as_of AS STRING) AS as_of, round(greatest(-0.5, least(0.5, composite)), 6) AS clamped FROM b_scores WHERE composite IS NOT NULL")
def _x05(v: Views) -> DataFrame:
    return v.b_scores.filter("composite IS NOT NULL").select("instrument_id", day("as_of"), F.round(S.clamp(F.col("composite"), -0.5, 0.5), 6).alias("clamped"))


@R.add("x06_safe_ratio", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(c_custkey / c_acctbal - 1, 6) END AS ratio, CASE WHEN c_acctbal <= 0 THEN 'NON_POSITIVE_DENOMINATOR' END AS reason FROM customer")
def _x06(v: Views) -> DataFrame:
    bal = F.col("c_acctbal")
    return v.customer.select("c_custkey", F.round(screener.ratio(F.col("c_custkey"), bal, -1.0), 6).alias("ratio"), F.when(bal <= 0, "NON_POSITIVE_DENOMINATOR").alias("reason"))


@R.add("x07_linear_combination", "SELECT instrument_id, CAST(signal_at AS STRING) AS signal_at, round(score * 0.7 + total_return * 0.3, 6) AS mix, CASE WHEN score IS NULL THEN 'NO_SCORE' WHEN total_return IS NULL THEN 'NO_RETURN' END AS reason FROM b_panel")
def _x07(v: Views) -> DataFrame:
    a, b = F.col("score"), F.col("total_return")
    return v.b_panel.select("instrument_id", day("signal_at"), F.round(screener.linear((a, 0.7), (b, 0.3)), 6).alias("mix"), screener.first_reason((a, "NO_SCORE"), (b, "NO_RETURN")).alias("reason"))


@R.add("x08_half_even", "SELECT p_partkey, CAST(round_even(CAST(p_partkey AS DECIMAL(18,3)) / 8, 2) AS DOUBLE) AS eighth FROM part")
def _x08(v: Views) -> DataFrame:
    return v.part.select("p_partkey", S.half_even(F.col("p_partkey") / 8, 2).alias("eighth"))


@R.add("x09_normalize_names", "SELECT s_suppkey, lpad(CAST(s_suppkey AS STRING), 10, '0') AS cik, replace(replace(upper(trim(s_name)), '.', '-'), '#', '#') AS listing, CASE WHEN regexp_extract(upper(s_name || ' class ' || chr(CAST(65 + s_suppkey % 3 AS INT))), '\\b(?:CLASS|CL|SERIES)\\s+([A-Z])\\b', 1) <> '' THEN 'CLASS_' || chr(CAST(65 + s_suppkey % 3 AS INT)) ELSE 'UNSPECIFIED' END AS share_class FROM supplier")
def _x09(v: Views) -> DataFrame:
    return v.supplier.select("s_suppkey", S.padded_cik(F.col("s_suppkey")).alias("cik"), S.listing_name(F.col("s_name")).alias("listing"), S.share_class(F.concat("s_name", F.lit(" class "), F.chr(65 + F.col("s_suppkey") % 3))).alias("share_class"))


@R.add("x13_reason_category", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'FRESHNESS' WHEN 2 THEN 'INPUT' WHEN 3 THEN 'INPUT' ELSE 'OTHER' END AS category FROM part")
def _x13(v: Views) -> DataFrame:
    codes = F.array(*(F.lit(c) for c in ("ILLIQUID", "STALE_FILING:x", "MISSING_PRICE:y", "NOT_REPORTED", "PEER_FALLBACK:z")))
    return v.part.select("p_partkey", S.reason_category(F.get(codes, (F.col("p_partkey") % 5).cast("int"))).alias("category"))


@R.add("x15_accounting_profile", "SELECT p_partkey, CASE WHEN sic = 6798 THEN 'EQUITY_REIT' WHEN sic BETWEEN 6020 AND 6099 THEN 'BANK' WHEN sic BETWEEN 6310 AND 6321 THEN 'LIFE_INSURER' WHEN sic BETWEEN 6322 AND 6399 THEN 'PC_INSURER' WHEN sic BETWEEN 6000 AND 6999 THEN 'FINANCIAL_OTHER' ELSE 'GENERAL' END AS profile FROM (SELECT p_partkey, 5900 + p_partkey % 1000 AS sic FROM part) x")
def _x15(v: Views) -> DataFrame:
    return v.part.select("p_partkey", S.accounting_profile(5900 + F.col("p_partkey") % 1000).alias("profile"))


@R.add("x17_new_york_date", "SELECT event_id, CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS STRING) AS trading_date FROM events")
def _x17(v: Views) -> DataFrame:
    return v.b_events.select("event_id", S.new_york_date(F.col("economic_time")).cast("string").alias("trading_date"))


@R.add("x18_reason_arrays", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'DISCOUNTED' END, CASE WHEN l_quantity < 10 THEN 'SMALL' END, CASE WHEN l_tax = 0 THEN 'UNTAXED' END) AS codes FROM lineitem")
def _x18(v: Views) -> DataFrame:
    codes = S.reasons((F.col("l_tax") == 0, "UNTAXED"), (F.col("l_quantity") < 10, "SMALL"), (F.col("l_discount") > 0.05, "DISCOUNTED"))
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(codes, ",").alias("codes"))


@R.add("x19_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _x19(v: Views) -> DataFrame:
    return v.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@R.add("x20_map_rows", "SELECT event_type, user_id, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _x20(v: Views) -> DataFrame:
    long = v.events.groupBy("event_type", "user_id").agg(F.sum("value").alias("total"))
    wide = long.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "total"))).alias("m"))
    return wide.select("user_id", F.explode("m").alias("event_type", "total")).select("event_type", "user_id", F.round("total", 2).alias("total"))


@R.add("x12_metric_parts", "SELECT issuer_id, metric, lower(metric) AS base, 'TTM' AS kind FROM b_facts GROUP BY 1, 2")
def _x12(v: Views) -> DataFrame:
    base, kind = S.metric_parts(F.concat(F.lower("metric"), F.lit("_ttm")))
    return v.b_facts.select("issuer_id", "metric", base.alias("base"), kind.alias("kind")).distinct()


@R.add("f08_explicit_offset", "SELECT event_id, event_id % 2 = 0 AS stated FROM events")
def _f08(v: Views) -> DataFrame:
    text = F.concat(F.date_format("economic_time", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 4 == 0, "Z").when(F.col("event_id") % 2 == 0, "+02:00").otherwise(""))
    return v.b_events.select("event_id", S.explicit_offset(text).alias("stated"))


@R.add("f01_raw_factors", f"WITH {PICK}, o AS (SELECT session_date, row_number() OVER (ORDER BY session_date DESC) AS n FROM b_sessions WHERE session_date <= DATE '2000-12-31' AND available_at <= TIMESTAMP '{AS_OF}'), c AS (SELECT instrument_id, max(close) FILTER (n = 2) AS latest, max(close) FILTER (n = 13) AS reference FROM pick JOIN o ON pick.session_date = o.session_date GROUP BY 1) SELECT s_suppkey AS instrument_id, round(1000 / s_acctbal, 8) AS value_raw, round(latest / reference - 1, 8) AS momentum_raw, round(s_nationkey / 10.0, 8) AS quality_raw FROM supplier JOIN c ON s_suppkey = instrument_id WHERE s_acctbal > 0 AND latest IS NOT NULL AND reference > 0")
def _f01(v: Views) -> DataFrame:
    from tidemark.operators.model import raw_factors

    ordinals = T.session_ordinals(v.b_sessions, last_day(), 1 << 30, F.lit(AS_OF).cast("timestamp"))
    closes = ranking.price_features(T.bars_as_of(v.b_bars, AS_OF, "RAW"), ordinals).select("instrument_id", "latest_close", "reference_close")
    ratios = v.supplier.select(F.col("s_suppkey").alias("instrument_id"), (F.col("s_acctbal") / 1000).alias("pe_ratio"), (F.col("s_nationkey") / 10.0).alias("return_on_equity_ttm"))
    return raw_factors(ratios.join(closes, "instrument_id")).select("instrument_id", *(F.round(f"{f}_raw", 8).alias(f"{f}_raw") for f in ("value", "momentum", "quality")))


@R.add("f02_bar_contract", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_extendedprice < l_extendedprice * (1 + l_discount) THEN 'HIGH_BELOW' END, CASE WHEN l_quantity - 3 < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN l_returnflag = 'R' THEN 'UNKNOWN_FEED' END) AS violations FROM lineitem")
def _f02(v: Views) -> DataFrame:
    p = F.col("l_extendedprice")
    bars = v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p.alias("open"), p.alias("high"), p.alias("low"), (p * (1 + F.col("l_discount"))).alias("close"), (F.col("l_quantity") - 3).alias("volume"), F.when(F.col("l_returnflag") == "R", "otc").otherwise("sip").alias("feed"), F.lit(None).cast("date").alias("vintage"), F.col("l_shipdate").cast("date").alias("session_date"))
    return contracts.bars(bars).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("violations", ",").alias("violations"))


@R.add("f03_filing_contract", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'AMENDMENT_UNMARKED' END, CASE WHEN o_orderkey % 7 = 0 THEN 'BAD_ACCESSION' END, CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN_FORM' END) AS violations FROM orders")
def _f03(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    filings = v.orders.select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.when(k % 7 != 0, F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-24-000001"))).otherwise("x").alias("accession"), F.when(F.col("o_orderstatus") == "P", "8-K").otherwise("10-K").alias("form"), F.col("o_orderdate").cast("date").alias("filed_date"), F.col("o_orderdate").cast("date").alias("period_end"), F.when(k % 11 == 0, "y").alias("amends"))
    return contracts.filings(filings).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@R.add("f04_regulatory_contract", "SELECT filing_id, concat_ws(',', CASE WHEN available_at <= CAST(period_end AS TIMESTAMP) THEN 'AVAILABLE_EARLY' END, CASE WHEN filing_id % 5 = 0 THEN 'BAD_SCOPE' END) AS violations FROM b_facts")
def _f04(v: Views) -> DataFrame:
    reports = v.b_facts.select("filing_id", F.when(F.col("filing_id") % 5 == 0, "GROUP").otherwise("PARENT").alias("scope"), F.lit("1990-01-01").cast("date").alias("effective_from"), "period_end", "available_at")
    return contracts.regulatory(reports).select("filing_id", F.array_join("violations", ",").alias("violations"))


@R.add("f07_panel_contract", "SELECT 'NULL_VALUE' AS rule, count(*) AS n FROM b_panel WHERE close IS NULL OR market_cap IS NULL UNION ALL SELECT 'DUPLICATE_KEY', count(*) FROM (SELECT 1 FROM b_panel GROUP BY signal_at, instrument_id HAVING count(*) > 1) x UNION ALL SELECT 'BAD_MARKET_CAP', count(*) FROM b_panel WHERE NOT (market_cap > 0) UNION ALL SELECT 'BAD_RETURN', count(*) FROM b_panel WHERE total_return < -1 UNION ALL SELECT 'SMALL_CROSS_SECTION', count(*) FROM (SELECT 1 FROM b_panel GROUP BY signal_at HAVING count(DISTINCT instrument_id) < 100) y")
def _f07(v: Views) -> DataFrame:
    return contracts.panel(v.b_panel)


@R.add("f13_project_inputs", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.flag') = 'true', false) AS flag FROM events")
def _f13(v: Views) -> DataFrame:
    p = F.from_json("props", "k BIGINT, flag BOOLEAN")
    return v.events.select("event_id", F.coalesce(p["k"], F.lit(0)).alias("k"), F.coalesce(p["flag"], F.lit(False)).alias("flag"))


@R.add("f14_review_contract", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'KIND_MISMATCH' END, CASE WHEN o_orderkey % 6 = 0 THEN 'NO_SOURCE' END) AS violations FROM orders")
def _f14(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    reviews = v.orders.select("o_orderkey", F.lit("SHARE_FACT").alias("kind"), F.when(k % 4 == 0, "ISSUE").otherwise("FACT").alias("target_type"), F.lit("reviewer").alias("reviewer"), F.when(k % 6 == 0, "http://x").otherwise("https://x").alias("source"), F.lit("checked against the filing").alias("rationale"))
    return contracts.reviews(reviews).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@R.add("f15_timing_contract", "SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 0 AND event_id % 10 > 5 THEN 'CLOSE_AFTER_MARKET' END, CASE WHEN event_id % 2 = 1 AND (event_id % 10 - 5 <= 0 OR event_id % 10 - 5 > 7) THEN 'DELAY_OUT_OF_RANGE' END) AS violations FROM events")
def _f15(v: Views) -> DataFrame:
    e = v.b_events.select("event_id", F.when(F.col("event_id") % 2 == 0, "CLOSE_V1").otherwise("DELAYED").alias("policy"), F.col("economic_time").alias("market_at"), F.expr("economic_time + make_dt_interval(CAST(event_id % 10 - 5 AS INT))").alias("knowledge_at"))
    return contracts.requests(e).select("event_id", F.array_join("violations", ",").alias("violations"))


@R.add("f16_normalize_members", "SELECT s_suppkey, upper(trim(s_name)) AS symbol, lpad(CAST(s_suppkey AS STRING), 10, '0') AS cik, 'COMMON_STOCK' AS security_type, 'USD' AS currency, concat_ws(',', CASE WHEN s_suppkey % 9 = 0 THEN 'BAD_SIC' END, 'BAD_SYMBOL') AS violations FROM supplier")
def _f16(v: Views) -> DataFrame:
    raw = v.supplier.select("s_suppkey", F.concat(F.lit(" "), "s_name").alias("symbol"), F.col("s_suppkey").cast("string").alias("cik"), F.lit(None).cast("string").alias("figi"), F.lit(" ").alias("security_type"), F.lit(None).cast("string").alias("share_class"), F.lit("").alias("currency"), F.when(F.col("s_suppkey") % 9 == 0, "12").otherwise("1234").alias("sic"))
    return contracts.members(raw).select("s_suppkey", "symbol", "cik", "security_type", "currency", F.array_join("violations", ",").alias("violations"))


@R.add("f17_snapshot_contract", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN 'INCOMPLETE' ELSE '' END AS violations FROM orders")
def _f17(v: Views) -> DataFrame:
    snaps = v.orders.select("o_orderkey", F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("observed_at"), F.lit(10).alias("expected"), F.when(F.col("o_custkey") % 3 == 0, 10).otherwise(9).alias("imported"), F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("PARTIAL").alias("state"))
    return contracts.snapshots(snaps).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


CALENDAR = "d AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day), x AS (SELECT DISTINCT o_orderstatus AS exchange FROM orders), h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS exchange FROM orders WHERE o_orderpriority = '1-URGENT'), cal AS (SELECT d.day, x.exchange, h.day IS NULL AS holiday FROM d CROSS JOIN x LEFT JOIN h ON d.day = h.day AND x.exchange = h.exchange)"


def _calendar(v: Views) -> DataFrame:
    held = v.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("exchange"))
    return K.build_calendar(held, v.orders.select(F.col("o_orderstatus").alias("exchange")).distinct(), "1998-01-01", "1998-12-31")


@R.add("t01_build_calendar", f"WITH {CALENDAR} SELECT CAST(day AS STRING) AS day, exchange, holiday FROM cal")
def _t01(v: Views) -> DataFrame:
    return _calendar(v).select(day("day"), "exchange", "holiday")


@R.add("t02_due_month_ends", f"WITH {CALENDAR} SELECT exchange, CAST(date_trunc('month', day) AS DATE) || '' AS month, CAST(max(day) FILTER (NOT holiday) AS STRING) AS month_end FROM cal GROUP BY 1, 2 HAVING max(day) FILTER (NOT holiday) IS NOT NULL")
def _t02(v: Views) -> DataFrame:
    return K.due_month_ends(_calendar(v)).select("exchange", day("month"), day("month_end"))


@R.add("t03_next_opening", f"WITH {CALENDAR} SELECT a.exchange, CAST(a.day AS STRING) AS day, CAST(min(b.day) FILTER (NOT b.holiday) AS STRING) AS opening FROM cal a JOIN cal b ON a.exchange = b.exchange AND b.day > a.day WHERE day(a.day) = 15 GROUP BY 1, 2")
def _t03(v: Views) -> DataFrame:
    c = _calendar(v)
    return K.next_opening(c, c.filter(F.dayofmonth("day") == 15).select("exchange", "day")).select("exchange", day("day"), day("opening"))


@R.add("t04_sessions_around", f"WITH {CALENDAR} SELECT a.exchange, CAST(a.day AS STRING) AS day, CAST(max(b.day) FILTER (b.day < a.day) AS STRING) AS completed, CAST(min(b.day) FILTER (b.day >= a.day) AS STRING) AS upcoming FROM cal a JOIN cal b ON a.exchange = b.exchange AND NOT b.holiday WHERE day(a.day) = 20 GROUP BY 1, 2")
def _t04(v: Views) -> DataFrame:
    c = _calendar(v)
    return K.sessions_around(c, c.filter(F.dayofmonth("day") == 20).select("exchange", "day")).select("exchange", day("day"), day("completed"), day("upcoming"))


@R.add("t05_run_requests", "WITH r AS (SELECT DISTINCT session_date AS run_day FROM b_sessions WHERE session_date >= DATE '2000-01-31') SELECT CAST(run_day AS STRING) AS run_id, CAST(session_date AS STRING) AS session_date, row_number() OVER (PARTITION BY run_day ORDER BY session_date DESC) AS n FROM r JOIN b_sessions s ON s.session_date <= r.run_day QUALIFY n <= 13")
def _t05(v: Views) -> DataFrame:
    runs = v.b_sessions.filter(F.col("session_date") >= F.lit("2000-01-31").cast("date")).select(F.col("session_date").cast("string").alias("run_id"), F.col("session_date").alias("day"))
    return K.run_ordinals(runs, v.b_sessions, 13).select("run_id", day("session_date"), F.col("n").cast("long").alias("n"))


@R.add("t06_cross_section_errors", "SELECT instrument_id, concat_ws(',', CASE WHEN valid_to IS NOT NULL AND valid_to <= DATE '2000-12-31' THEN 'NOT_LISTED' END, CASE WHEN NOT primary_class THEN 'SECONDARY_CLASS' END) AS errors FROM b_instruments")
def _t06(v: Views) -> DataFrame:
    return v.b_instruments.select("instrument_id", F.array_join(S.reasons((F.col("valid_to") <= last_day(), "NOT_LISTED"), (~F.col("primary_class"), "SECONDARY_CLASS")), ",").alias("errors"))


@R.add("m02_primary_class", "SELECT issuer_id, instrument_id FROM b_instruments QUALIFY row_number() OVER (PARTITION BY issuer_id ORDER BY CASE WHEN primary_class THEN 0 ELSE 1 END, symbol) = 1")
def _m02(v: Views) -> DataFrame:
    return reference.primary_class(v.b_instruments).select("issuer_id", "instrument_id")


@R.add("m03_reconcile_overlap", "SELECT a.s_suppkey AS instrument_id, a.s_nationkey % 2 <> b.s_nationkey % 3 AS conflict FROM supplier a JOIN supplier b ON a.s_suppkey = b.s_suppkey WHERE a.s_nationkey <= 14 AND b.s_acctbal > 0")
def _m03(v: Views) -> DataFrame:
    a = v.supplier.filter("s_nationkey <= 14").select(F.col("s_suppkey").alias("instrument_id"), (F.col("s_nationkey") % 2).alias("share_class"))
    b = v.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("instrument_id"), (F.col("s_nationkey") % 3).alias("share_class"))
    return reference.reconcile_overlap(a, b)


@R.add("m04_validate_snapshot", "SELECT issuer_id, count(*) AS members, count(*) FILTER (primary_class AND instrument_id % 7 <> 0) AS primaries FROM b_instruments GROUP BY 1 HAVING count(*) FILTER (primary_class AND instrument_id % 7 <> 0) <> 1")
def _m04(v: Views) -> DataFrame:
    return reference.without_one_primary(v.b_instruments.withColumn("primary_class", F.expr("primary_class AND instrument_id % 7 <> 0")))


@R.add("m06_scd2_intervals", "SELECT key, symbol, CAST(effective_from AS STRING) AS effective_from, CAST(lead(effective_from) OVER (PARTITION BY key ORDER BY effective_from) AS STRING) AS effective_to FROM (SELECT * FROM b_symbols QUALIFY symbol IS DISTINCT FROM lag(symbol) OVER (PARTITION BY key ORDER BY effective_from)) x")
def _m06(v: Views) -> DataFrame:
    return T.scd2_intervals(v.b_symbols.drop("effective_to"), "key", "effective_from", ["symbol"]).select("key", "symbol", day("effective_from"), day("effective_to"))


@R.add("m07_symbol_renames", "SELECT s.key, p_brand AS symbol FROM b_symbols s JOIN part ON p_partkey = s.key + 200 WHERE s.effective_from <= DATE '1990-07-01' AND (s.effective_to IS NULL OR s.effective_to > DATE '1990-07-01')")
def _m07(v: Views) -> DataFrame:
    current = T.effective_on(v.b_symbols, F.lit("1990-07-01").cast("date")).select("key", "symbol")
    return reference.apply_renames(current, v.part.select((F.col("p_partkey") - 200).alias("key"), F.col("p_brand").alias("new_symbol")))


@R.add("m08_link_identifiers", "SELECT c_custkey AS identifier, c_nationkey AS instrument_id, CASE WHEN o.k IS NULL THEN 'NEW' WHEN o.i = c_nationkey THEN 'SAME' ELSE 'CONFLICT' END AS outcome FROM customer LEFT JOIN (SELECT o_custkey AS k, CAST(max(o_orderkey) % 25 AS INT) AS i FROM orders GROUP BY 1) o ON c_custkey = o.k")
def _m08(v: Views) -> DataFrame:
    held = v.orders.groupBy(F.col("o_custkey").alias("identifier")).agg((F.max("o_orderkey") % 25).cast("int").alias("held"))
    return reference.link_identifiers(held, v.customer.select(F.col("c_custkey").alias("identifier"), F.col("c_nationkey").alias("instrument_id")))


@R.add("m09_import_snapshot", "SELECT o_custkey AS universe, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM orders WHERE o_orderstatus <> 'F' AND (o_custkey, CAST(o_orderdate AS DATE)) NOT IN (SELECT (o_custkey, CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2")
def _m09(v: Views) -> DataFrame:
    rows = v.orders.select("o_orderstatus", F.col("o_custkey").alias("universe"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return reference.only_new(rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus <> 'F'"), ["universe", "day"])
