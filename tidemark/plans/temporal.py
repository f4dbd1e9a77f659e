"""Scans, filters, joins and revision windows on the domain views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import temporal as T
from tidemark.plans.views import Registry, Views

R = Registry()
AS_OF = "2000-12-31 20:00:00"


def day(c: str) -> Column:
    """A date as text under its own name."""
    return F.col(c).cast("string").alias(c)


def last_day() -> Column:
    """The day of the single-run queries."""
    return F.lit("2000-12-31").cast("date")


@R.add("s01_factor_inputs_as_of", f"""
WITH k AS (SELECT * FROM b_bars WHERE available_at <= TIMESTAMP '{AS_OF}' AND quality_state = 'VALID'),
l AS (SELECT instrument_id, arg_max(close, (session_date, observation_key)) AS latest_close, max(session_date) AS latest FROM k GROUP BY 1),
r AS (SELECT instrument_id, arg_max(close, (session_date, observation_key)) AS reference_close, max(session_date) AS reference FROM k WHERE session_date <= DATE '1999-12-31' GROUP BY 1)
SELECT l.instrument_id, latest_close, reference_close, CAST(latest AS STRING) AS latest, CAST(reference AS STRING) AS reference FROM l JOIN r ON l.instrument_id = r.instrument_id WHERE latest > reference""")
def _s01(v: Views) -> DataFrame:
    known = T.known_as_of(v.b_bars, AS_OF, ("available_at",)).filter("quality_state = 'VALID'")
    at, old = F.struct("session_date", "observation_key"), F.col("session_date") <= F.lit("1999-12-31").cast("date")
    one = known.groupBy("instrument_id").agg(F.max_by("close", at).alias("latest_close"), F.max_by("close", F.when(old, at)).alias("reference_close"), F.max("session_date").alias("latest"), F.max(F.when(old, F.col("session_date"))).alias("reference"))
    return one.filter("latest > reference").select("instrument_id", "latest_close", "reference_close", day("latest"), day("reference"))


@R.add("s02_bar_range_scan", f"SELECT observation_key, instrument_id, close FROM b_bars WHERE available_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-03-31' AND instrument_id IN (1, 2, 3, 5, 8)")
def _s02(v: Views) -> DataFrame:
    return T.range_scan(v.b_bars, "available_at", "2000-01-01", "2000-03-31", AS_OF).filter(F.col("instrument_id").isin(1, 2, 3, 5, 8)).select("observation_key", "instrument_id", "close")


@R.add("s03_score_range_scan", "SELECT instrument_id, CAST(as_of AS STRING) AS as_of, round(composite, 6) AS composite FROM b_scores WHERE as_of BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' AND composite IS NOT NULL")
def _s03(v: Views) -> DataFrame:
    return T.range_scan(v.b_scores, "as_of", "1999-01-01", "1999-06-30", AS_OF).filter("composite IS NOT NULL").select("instrument_id", day("as_of"), F.round("composite", 6).alias("composite"))


@R.add("s04_latest_score_batch", "SELECT instrument_id, CAST(as_of AS STRING) AS as_of, round(composite, 6) AS composite FROM b_scores WHERE as_of = (SELECT max(as_of) FROM b_scores WHERE as_of <= DATE '2000-12-15')")
def _s04(v: Views) -> DataFrame:
    upto = v.b_scores.filter(F.col("as_of") <= F.lit("2000-12-15").cast("date"))
    newest = upto.agg(F.max("as_of").alias("as_of"))  # one row
    return upto.join(F.broadcast(newest), "as_of").select("instrument_id", day("as_of"), F.round("composite", 6).alias("composite"))


@R.add("s05_normalize_symbols", "SELECT DISTINCT upper(trim(p_brand)) AS symbol, regexp_matches(upper(trim(p_brand)), '^[A-Z0-9./-]{1,10}$') AS valid FROM part")
def _s05(v: Views) -> DataFrame:
    s = F.upper(F.trim("p_brand"))
    return v.part.select(s.alias("symbol"), s.rlike("^[A-Z0-9./-]{1,10}$").alias("valid")).distinct()


@R.add("s09_amendment_linkage", """
WITH f AS (SELECT filing_id, issuer_id, period_end, filed_date, filing_id % 4 = 0 AS amended FROM b_facts)
SELECT a.filing_id, max(b.filed_date || '/' || lpad(CAST(b.filing_id AS STRING), 12, '0')) AS base
FROM f a LEFT JOIN f b ON NOT b.amended AND a.issuer_id = b.issuer_id AND a.period_end = b.period_end AND b.filed_date < a.filed_date WHERE a.amended GROUP BY 1""")
def _s09(v: Views) -> DataFrame:
    f = v.b_facts.select("filing_id", "issuer_id", "period_end", "filed_date", (F.col("filing_id") % 4 == 0).alias("amended"))
    tag = F.concat(F.col("filed_date").cast("string"), F.lit("/"), F.lpad(F.col("filing_id").cast("string"), 12, "0")).alias("base")
    linked = T.asof_join(f.filter("amended").drop("amended"), f.filter("NOT amended").select("issuer_id", "period_end", F.col("filed_date").alias("base_date"), tag), ["issuer_id", "period_end"], "filed_date", "base_date", ["base"], strict=True)
    return linked.select("filing_id", "base")


@R.add("s15_latest_bar", "SELECT instrument_id, arg_max(close, (available_at, observation_key)) AS close, CAST(CAST(max(available_at) AS DATE) AS STRING) AS seen FROM b_bars GROUP BY 1")
def _s15(v: Views) -> DataFrame:
    return v.b_bars.groupBy("instrument_id").agg(F.max_by("close", F.struct("available_at", "observation_key")).alias("close"), F.max("available_at").cast("date").cast("string").alias("seen"))


@R.add("k01_latest_projection", "SELECT instrument_id, CAST(session_date AS STRING) AS session_date, observation_key, close FROM b_bars QUALIFY row_number() OVER (PARTITION BY instrument_id, session_date ORDER BY available_at DESC, observation_key DESC) = 1")
def _k01(v: Views) -> DataFrame:
    return T.latest_per(v.b_bars, ["instrument_id", "session_date"], [F.desc("available_at"), F.desc("observation_key")]).select("instrument_id", day("session_date"), "observation_key", "close")


@R.add("k05_append_if_absent", "SELECT observation_key, close FROM b_bars b WHERE NOT EXISTS (SELECT 1 FROM b_bars t WHERE t.observation_key = b.observation_key AND t.available_at < TIMESTAMP '1999-01-01')")
def _k05(v: Views) -> DataFrame:
    new, held = v.b_bars, v.b_bars.filter(F.col("available_at") < F.lit("1999-01-01").cast("timestamp"))
    return new.join(held.select("observation_key"), "observation_key", "left_anti").select("observation_key", "close")


@R.add("f09_known_as_of", f"SELECT quality_state, mode, count(*) AS n, round(sum(close), 4) AS total FROM b_bars WHERE available_at <= TIMESTAMP '{AS_OF}' AND observed_at <= TIMESTAMP '{AS_OF}' AND session_date <= DATE '2000-11-30' GROUP BY 1, 2")
def _f09(v: Views) -> DataFrame:
    return T.known_as_of(v.b_bars, AS_OF).filter(F.col("session_date") <= F.lit("2000-11-30").cast("date")).groupBy("quality_state", "mode").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@R.add("f10_effective_on", "SELECT key, symbol, CAST(effective_from AS STRING) AS effective_from FROM b_symbols WHERE effective_from <= DATE '1991-06-30' AND (effective_to IS NULL OR effective_to > DATE '1991-06-30')")
def _f10(v: Views) -> DataFrame:
    return T.effective_on(v.b_symbols, F.lit("1991-06-30").cast("date")).select("key", "symbol", day("effective_from"))


@R.add("f11_ranking_filter", "SELECT instrument_id, CAST(as_of AS STRING) AS as_of, sector FROM b_scores WHERE eligible AND sector = 'ASIA' AND profile = 'GENERAL' AND as_of = DATE '2000-12-31'")
def _f11(v: Views) -> DataFrame:
    from tidemark.operators.screener import filter_ranking

    return filter_ranking(v.b_scores, eligible=True, sector="ASIA", profile="GENERAL", peer_group=None).filter(F.col("as_of") == F.lit("2000-12-31").cast("date")).select("instrument_id", day("as_of"), "sector")


@R.add("f12_holdings", "SELECT o_orderkey AS lot, CAST(CAST(o_orderdate AS DATE) AS STRING) AS bought, o_totalprice AS cost FROM orders WHERE o_custkey = 7")
def _f12(v: Views) -> DataFrame:
    from tidemark.operators.screener import holdings

    return holdings(v.orders.select(F.col("o_orderkey").alias("lot"), "o_custkey", F.col("o_orderdate").cast("date").alias("bought"), F.col("o_totalprice").alias("cost")), "o_custkey", 7, "bought", "lot").select("lot", day("bought"), "cost")


@R.add("j01_asof_backward", """
WITH e AS (SELECT event_id, instrument_id, economic_time FROM b_events WHERE event_type = 'click'),
p AS (SELECT instrument_id, economic_time AS seen_at, max(value) AS value FROM b_events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT event_id, value FROM e ASOF LEFT JOIN p ON e.instrument_id = p.instrument_id AND e.economic_time >= p.seen_at""")
def _j01(v: Views) -> DataFrame:
    e = v.b_events.filter("event_type = 'click'").select("event_id", "instrument_id", "economic_time")
    p = v.b_events.filter("event_type = 'purchase'").select("instrument_id", F.col("economic_time").alias("seen_at"), "value")
    return T.asof_join(e, p, ["instrument_id"], "economic_time", "seen_at", ["value"]).select("event_id", "value")


@R.add("j02_asof_forward", """
WITH e AS (SELECT event_id, instrument_id, economic_time FROM b_events WHERE event_type = 'click'),
p AS (SELECT instrument_id, economic_time AS seen_at, min(value) AS value FROM b_events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT event_id, value FROM e ASOF LEFT JOIN p ON e.instrument_id = p.instrument_id AND e.economic_time < p.seen_at""")
def _j02(v: Views) -> DataFrame:
    e = v.b_events.filter("event_type = 'click'").select("event_id", "instrument_id", "economic_time")
    p = v.b_events.filter("event_type = 'purchase'").select("instrument_id", F.col("economic_time").alias("seen_at"), "value")
    return T.asof_join(e, p, ["instrument_id"], "economic_time", "seen_at", ["value"], "forward", strict=True).select("event_id", "value")


@R.add("j03_effective_join", """
WITH d AS (SELECT DISTINCT p_partkey % 200 AS key, DATE '1991-01-01' + CAST(p_size AS INT) AS day FROM part)
SELECT d.key, CAST(CAST(day AS DATE) AS STRING) AS day, symbol FROM d JOIN b_symbols s ON d.key = s.key AND effective_from <= day AND (effective_to IS NULL OR effective_to > day)
QUALIFY row_number() OVER (PARTITION BY d.key, day ORDER BY effective_from DESC, part_id) = 1""")
def _j03(v: Views) -> DataFrame:
    d = v.part.select((F.col("p_partkey") % 200).alias("key"), F.expr("date_add(DATE'1991-01-01', p_size)").alias("day")).distinct()
    return T.effective_join(d, v.b_symbols, "key", "day", [F.desc("effective_from"), F.asc("part_id")]).filter("symbol IS NOT NULL").select("key", day("day"), "symbol")


@R.add("j04_resolve_symbol", "SELECT symbol, CASE WHEN count(DISTINCT key) = 1 THEN min(key) END AS key FROM b_symbols WHERE effective_from <= DATE '1990-02-15' AND (effective_to IS NULL OR effective_to > DATE '1990-02-15') GROUP BY 1")
def _j04(v: Views) -> DataFrame:
    return T.resolve_unique(T.effective_on(v.b_symbols, F.lit("1990-02-15").cast("date")), "symbol", "key")


@R.add("j05_membership_joins", "SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _j05(v: Views) -> DataFrame:
    return v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"))


@R.add("j06_assemble_cross_section", """
WITH b AS (SELECT instrument_id, count(*) AS bars, max(close) AS high FROM b_bars GROUP BY 1), f AS (SELECT issuer_id, count(*) AS facts FROM b_facts GROUP BY 1)
SELECT i.instrument_id, symbol, bars, high, facts FROM b_instruments i LEFT JOIN b ON i.instrument_id = b.instrument_id LEFT JOIN f ON i.issuer_id = f.issuer_id""")
def _j06(v: Views) -> DataFrame:
    bars = v.b_bars.groupBy("instrument_id").agg(F.count("*").alias("bars"), F.max("close").alias("high"))
    facts = v.b_facts.groupBy("issuer_id").agg(F.count("*").alias("facts"))
    return v.b_instruments.join(bars, "instrument_id", "left").join(facts, "issuer_id", "left").select("instrument_id", "symbol", "bars", "high", "facts")


@R.add("j07_parameter_cross_join", "SELECT c.cutoff AS cutoff, mode, count(*) AS n FROM b_bars, (SELECT '1997-06-30' AS cutoff UNION ALL SELECT '1999-06-30' UNION ALL SELECT '2001-06-30') c WHERE session_date <= CAST(c.cutoff AS DATE) GROUP BY 1, 2")
def _j07(v: Views) -> DataFrame:
    cutoffs = v.b_bars.sparkSession.sql("SELECT explode(array('1997-06-30', '1999-06-30', '2001-06-30')) AS cutoff")
    return v.b_bars.join(F.broadcast(cutoffs), F.col("session_date") <= F.col("cutoff").cast("date")).groupBy("cutoff", "mode").agg(F.count("*").alias("n"))


@R.add("j08_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _j08(v: Views) -> DataFrame:
    return v.customer.join(v.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.add("j09_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _j09(v: Views) -> DataFrame:
    return v.customer.join(v.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@R.add("j10_null_safe_join", """
WITH a AS (SELECT issuer_id, metric, period_start, period_end, count(*) AS n FROM b_facts GROUP BY ALL), b AS (SELECT issuer_id, metric, period_start, period_end, round(max(value), 2) AS top FROM b_facts WHERE quality_state = 'VALID' GROUP BY ALL)
SELECT a.issuer_id, a.metric, CAST(a.period_end AS STRING) AS period_end, n, top FROM a JOIN b ON a.issuer_id = b.issuer_id AND a.metric = b.metric AND a.period_end = b.period_end AND a.period_start IS NOT DISTINCT FROM b.period_start""")
def _j10(v: Views) -> DataFrame:
    keys = ["issuer_id", "metric", "period_start", "period_end"]
    a, b = v.b_facts.groupBy(*keys).agg(F.count("*").alias("n")).alias("a"), v.b_facts.filter("quality_state = 'VALID'").groupBy(*keys).agg(F.round(F.max("value"), 2).alias("top")).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys if k != "period_start"] + [F.col("a.period_start").eqNullSafe(F.col("b.period_start"))]
    return a.join(b, on).select("a.issuer_id", "a.metric", F.col("a.period_end").cast("string").alias("period_end"), "n", "top")


@R.add("j11_scoped_issues", """
WITH s AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE instrument_id END AS instrument_id FROM b_events WHERE event_type = 'error')
SELECT i.instrument_id, count(*) AS issues FROM b_instruments i JOIN s ON s.instrument_id = i.instrument_id OR s.instrument_id IS NULL GROUP BY 1""")
def _j11(v: Views) -> DataFrame:
    issues = v.b_events.filter("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("instrument_id")).alias("instrument_id"))
    own = v.b_instruments.select("instrument_id").join(issues.filter("instrument_id IS NOT NULL"), "instrument_id").groupBy("instrument_id").agg(F.count("*").alias("n"))
    everyone = issues.filter("instrument_id IS NULL").agg(F.count("*").alias("all"))  # one row, counted rather than multiplied out
    return v.b_instruments.select("instrument_id").join(own, "instrument_id", "left").join(F.broadcast(everyone)).select("instrument_id", (F.coalesce("n", F.lit(0)) + F.col("all")).alias("issues")).filter("issues > 0")


@R.add("j12_superseded", "SELECT key, part_id FROM b_symbols WHERE effective_from <= DATE '1992-01-01' QUALIFY row_number() OVER (PARTITION BY key ORDER BY effective_from DESC, part_id DESC) > 1")
def _j12(v: Views) -> DataFrame:
    return T.superseded(v.b_symbols.filter(F.col("effective_from") <= F.lit("1992-01-01").cast("date")), ["key"], [F.desc("effective_from"), F.desc("part_id")]).select("key", "part_id")


@R.add("j13_symbol_successions", "SELECT a.key, a.symbol AS symbol, b.symbol AS successor, CAST(b.effective_from AS STRING) AS since FROM b_symbols a JOIN b_symbols b ON a.key = b.key AND a.effective_to = b.effective_from AND a.symbol <> b.symbol")
def _j13(v: Views) -> DataFrame:
    return T.superseding_symbols(v.b_symbols).select("a.key", "a.symbol", F.col("b.symbol").alias("successor"), F.col("b.effective_from").cast("string").alias("since"))


@R.add("j14_calendar_gaps", """
WITH d AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
SELECT CAST(d.day AS STRING) AS day FROM d LEFT JOIN h ON d.day = h.day WHERE h.day IS NULL""")
def _j14(v: Views) -> DataFrame:
    from tidemark.operators.calendar import day_range

    held = v.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return day_range(v.orders.sparkSession, "1998-01-01", "1998-12-31").join(held, "day", "left_anti").select(day("day"))


PICK = f"""k AS (SELECT * FROM b_bars WHERE available_at <= TIMESTAMP '{AS_OF}' AND mode = 'RAW'),
w AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY instrument_id, session_date, mode ORDER BY available_at DESC, observed_at DESC, observation_key) = 1),
pick AS (SELECT * FROM w WHERE quality_state = 'VALID')"""


@R.add("w01_bars_as_of", f"WITH {PICK} SELECT instrument_id, CAST(session_date AS STRING) AS session_date, close, observation_key FROM pick")
def _w01(v: Views) -> DataFrame:
    return T.bars_as_of(v.b_bars, AS_OF, "RAW").select("instrument_id", day("session_date"), "close", "observation_key")


@R.add("w01_bars_valid_first", f"SELECT instrument_id, CAST(session_date AS STRING) AS session_date, close, observation_key FROM b_bars WHERE available_at <= TIMESTAMP '{AS_OF}' AND mode = 'RAW' AND quality_state = 'VALID' QUALIFY row_number() OVER (PARTITION BY instrument_id, session_date, mode ORDER BY available_at DESC, observed_at DESC, observation_key) = 1")
def _w01b(v: Views) -> DataFrame:
    return T.bars_as_of(v.b_bars, AS_OF, "RAW", valid_first=True).select("instrument_id", day("session_date"), "close", "observation_key")


@R.add("w02_newest_vintage", "SELECT filing_id, metric, round(value, 2) AS value FROM b_facts QUALIFY dense_rank() OVER (PARTITION BY issuer_id, metric, period_end ORDER BY filed_date DESC) = 1")
def _w02(v: Views) -> DataFrame:
    return T.newest_vintage(v.b_facts, ["issuer_id", "metric", "period_end"], [F.desc("filed_date")]).select("filing_id", "metric", F.round("value", 2).alias("value"))


@R.add("w03_fact_revisions", "SELECT filing_id, dense_rank() OVER (PARTITION BY issuer_id, metric, period_start, period_end ORDER BY filed_date DESC, available_at DESC) AS revision FROM b_facts")
def _w03(v: Views) -> DataFrame:
    return T.newest_vintage(v.b_facts, ["issuer_id", "metric", "period_start", "period_end"], [F.desc("filed_date"), F.desc("available_at")], "revision").select("filing_id", F.col("revision").cast("long").alias("revision"))


@R.add("w04_preferred_source", "SELECT filing_id, priority FROM b_facts QUALIFY priority = min(priority) OVER (PARTITION BY issuer_id, metric, period_start, period_end)")
def _w04(v: Views) -> DataFrame:
    from tidemark.operators.facts import preferred

    return preferred(v.b_facts).select("filing_id", "priority")


@R.add("w05_unambiguous", "SELECT issuer_id, metric, CAST(period_end AS STRING) AS period_end, round(min(value), 2) AS value FROM (SELECT * FROM b_facts QUALIFY dense_rank() OVER (PARTITION BY issuer_id, metric, period_start, period_end ORDER BY filed_date DESC) = 1) x GROUP BY issuer_id, metric, period_start, x.period_end HAVING min(value) = max(value) AND bool_and(quality_state = 'VALID')")
def _w05(v: Views) -> DataFrame:
    from tidemark.operators.facts import newest_facts, unambiguous

    return unambiguous(newest_facts(v.b_facts)).select("issuer_id", "metric", day("period_end"), F.round("value", 2).alias("value"))


@R.add("w06_distinct_on", "SELECT issuer_id, metric, filing_id FROM b_facts QUALIFY row_number() OVER (PARTITION BY issuer_id, metric ORDER BY value DESC, filing_id) = 1")
def _w06(v: Views) -> DataFrame:
    return T.latest_per(v.b_facts, ["issuer_id", "metric"], [F.desc("value"), F.asc("filing_id")]).select("issuer_id", "metric", "filing_id")


FACTS_AS_OF = """n AS (SELECT * FROM b_facts WHERE available_at <= TIMESTAMP '2000-12-31 20:00:00' QUALIFY dense_rank() OVER (PARTITION BY issuer_id, metric, period_start, period_end ORDER BY filed_date DESC) = 1),
p AS (SELECT * FROM n QUALIFY priority = min(priority) OVER (PARTITION BY issuer_id, metric, period_start, period_end)),
facts AS (SELECT issuer_id, metric, period_start, period_end, min(value) AS value, max(filed_date) AS filed_date FROM p GROUP BY 1, 2, 3, 4 HAVING min(value) = max(value) AND bool_and(quality_state = 'VALID'))"""


@R.add("w07_facts_as_of", f"WITH {FACTS_AS_OF} SELECT issuer_id, metric, CAST(period_start AS STRING) AS period_start, CAST(period_end AS STRING) AS period_end, round(value, 2) AS value FROM facts")
def _w07(v: Views) -> DataFrame:
    from tidemark.operators.facts import facts_as_of

    return facts_as_of(v.b_facts, AS_OF).select("issuer_id", "metric", day("period_start"), day("period_end"), F.round("value", 2).alias("value"))


@R.add("w08_regulatory_as_of", f"SELECT issuer_id, CAST(period_end AS STRING) AS period_end, filing_id FROM b_facts WHERE metric = 'TOTAL_ASSETS' AND available_at <= TIMESTAMP '{AS_OF}' QUALIFY dense_rank() OVER (PARTITION BY issuer_id, period_end ORDER BY available_at DESC) = 1 AND quality_state = 'VALID'")
def _w08(v: Views) -> DataFrame:
    known = T.known_as_of(v.b_facts.filter("metric = 'TOTAL_ASSETS'"), AS_OF, ("available_at",))
    return T.newest_vintage(known, ["issuer_id", "period_end"], [F.desc("available_at")]).filter("quality_state = 'VALID'").select("issuer_id", day("period_end"), "filing_id")


@R.add("w09_session_ordinals", "SELECT CAST(session_date AS STRING) AS session_date, row_number() OVER (ORDER BY session_date DESC) AS n FROM b_sessions WHERE session_date <= DATE '2000-12-31' AND available_at <= TIMESTAMP '2000-12-15' QUALIFY n <= 24")
def _w09(v: Views) -> DataFrame:
    return T.session_ordinals(v.b_sessions, F.lit("2000-12-31").cast("date"), 24, F.lit("2000-12-15").cast("timestamp")).select(day("session_date"), F.col("n").cast("long").alias("n"))


@R.add("w10_accepted_reviews", "SELECT instrument_id, event_id FROM b_events WHERE event_type IN ('click', 'error') QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY economic_time DESC, event_id DESC) = 1 AND event_type = 'click'")
def _w10(v: Views) -> DataFrame:
    reviews = v.b_events.filter("event_type IN ('click', 'error')")
    return T.newest_revisions(reviews, ["instrument_id"], [F.desc("economic_time"), F.desc("event_id")], F.col("event_type") == "click").select("instrument_id", "event_id")


@R.add("w11_latest_profile", "SELECT issuer_id, filing_id, metric FROM b_facts QUALIFY row_number() OVER (PARTITION BY issuer_id ORDER BY filed_date DESC, filing_id DESC) = 1")
def _w11(v: Views) -> DataFrame:
    return T.latest_per(v.b_facts, ["issuer_id"], [F.desc("filed_date"), F.desc("filing_id")]).select("issuer_id", "filing_id", "metric")


@R.add("w12_primary_ambiguous", "SELECT instrument_id, issuer_id, count(*) FILTER (primary_class) OVER (PARTITION BY sector, issuer_id % 7) > 1 AS ambiguous FROM b_instruments")
def _w12(v: Views) -> DataFrame:
    n = F.sum(F.col("primary_class").cast("int")).over(Window.partitionBy("sector", F.col("issuer_id") % 7))
    return v.b_instruments.select("instrument_id", "issuer_id", (n > 1).alias("ambiguous"))


MOMENTUM = f"""WITH {PICK},
o AS (SELECT session_date, row_number() OVER (ORDER BY session_date DESC) AS n FROM b_sessions WHERE session_date <= DATE '2000-12-31'),
f AS (SELECT instrument_id, max(close) FILTER (n = 1) AS c1, max(close) FILTER (n = 2) AS c2, max(close) FILTER (n = 13) AS c13, count(*) FILTER (n <= 12) AS history FROM pick JOIN o ON pick.session_date = o.session_date GROUP BY 1),
m AS (SELECT instrument_id, c2 / c13 - 1 AS momentum, history FROM f WHERE c2 IS NOT NULL AND c13 IS NOT NULL),
z AS (SELECT *, CASE WHEN stddev_pop(momentum) OVER () = 0 THEN 0 ELSE (momentum - avg(momentum) OVER ()) / stddev_pop(momentum) OVER () END AS z FROM m)"""


@R.add("w13_zscore", MOMENTUM + " SELECT instrument_id, round(z, 6) AS z FROM z")
def _w13(v: Views) -> DataFrame:
    from tidemark.operators.ranking import momentum_zscores

    return momentum_zscores(v.b_bars, v.b_sessions, AS_OF, "2000-12-31").select("instrument_id", F.round("z", 6).alias("z"))


RANKED = MOMENTUM + ", r AS (SELECT *, row_number() OVER (ORDER BY momentum DESC, instrument_id) AS rank, count(*) OVER () AS n FROM z) SELECT instrument_id, round(momentum, 6) AS momentum, round(z, 6) AS z, rank, round(100.0 * (n - avg(rank) OVER (PARTITION BY momentum)) / (n - 1), 6) AS percentile FROM r"


@R.add("flagship_momentum_ranking", RANKED)
def flagship(v: Views) -> DataFrame:
    from tidemark.operators.ranking import momentum_ranking

    out = momentum_ranking(v.b_bars, v.b_sessions, AS_OF, "2000-12-31")
    return out.select("instrument_id", F.round("momentum", 6).alias("momentum"), F.round("z", 6).alias("z"), F.col("rank").cast("long").alias("rank"), F.round("percentile", 6).alias("percentile"))


@R.add("w14_ordinal_rank", "SELECT CAST(as_of AS STRING) AS as_of, instrument_id, row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, instrument_id) AS rank FROM b_scores WHERE eligible")
def _w14(v: Views) -> DataFrame:
    from tidemark.operators.ranking import ordinal_rank

    return ordinal_rank(v.b_scores.filter("eligible"), ["as_of"]).select(day("as_of"), "instrument_id", F.col("rank").cast("long").alias("rank"))


@R.add("w15_tie_percentile", "WITH r AS (SELECT as_of, instrument_id, round(composite, 1) AS c, row_number() OVER (PARTITION BY as_of ORDER BY round(composite, 1) DESC, instrument_id) AS rank, count(*) OVER (PARTITION BY as_of) AS n FROM b_scores WHERE eligible) SELECT CAST(as_of AS STRING) AS as_of, instrument_id, CASE WHEN n > 1 THEN round(100.0 * (n - avg(rank) OVER (PARTITION BY as_of, c)) / (n - 1), 6) END AS percentile FROM r")
def _w15(v: Views) -> DataFrame:
    from tidemark.operators.ranking import tie_percentile

    return tie_percentile(v.b_scores.filter("eligible").withColumn("composite", F.round("composite", 1)), ["as_of"]).select(day("as_of"), "instrument_id", F.round("percentile", 6).alias("percentile"))


@R.add("w16_sector_rank", "WITH r AS (SELECT sector, instrument_id, market_cap, row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC, instrument_id) AS rank, count(*) OVER (PARTITION BY sector) AS n FROM b_scores WHERE as_of = DATE '2000-12-31') SELECT sector, instrument_id, rank, n, CASE WHEN n >= 2 THEN round(100.0 * (n - rank) / (n - 1), 6) END AS percentile FROM r")
def _w16(v: Views) -> DataFrame:
    from tidemark.operators.ranking import ordinal_rank

    r = ordinal_rank(v.b_scores.filter(F.col("as_of") == F.lit("2000-12-31").cast("date")), ["sector"], "market_cap")
    n = F.count("*").over(Window.partitionBy("sector"))
    return r.withColumn("n", n).select("sector", "instrument_id", F.col("rank").cast("long").alias("rank"), "n", F.when(F.col("n") >= 2, F.round(100.0 * (F.col("n") - F.col("rank")) / (F.col("n") - 1), 6)).alias("percentile"))


@R.add("w17_average_rank", "SELECT CAST(signal_at AS STRING) AS signal_at, instrument_id, rank() OVER w + (count(*) OVER (PARTITION BY signal_at, volume) - 1) / 2.0 AS rank FROM b_panel WINDOW w AS (PARTITION BY signal_at ORDER BY volume)")
def _w17(v: Views) -> DataFrame:
    from tidemark.operators.ranking import average_rank

    return average_rank(v.b_panel, "volume", ["signal_at"], "rank").select(day("signal_at"), "instrument_id", "rank")


@R.add("w18_returns", "SELECT instrument_id, CAST(signal_at AS STRING) AS signal_at, round(close / lag(close) OVER (PARTITION BY instrument_id ORDER BY signal_at) - 1, 6) AS change FROM b_panel")
def _w18(v: Views) -> DataFrame:
    from tidemark.operators.technical import returns

    return returns(v.b_panel, "instrument_id", "signal_at").select("instrument_id", day("signal_at"), F.round("change", 6).alias("change"))


GRID = f"""WITH {PICK}, o AS (SELECT session_date, row_number() OVER (ORDER BY session_date DESC) AS n FROM b_sessions WHERE session_date <= DATE '2000-12-31' QUALIFY n <= 60),
g AS (SELECT i.instrument_id, o.session_date, 61 - n AS k, close FROM b_instruments i CROSS JOIN o LEFT JOIN pick p ON p.instrument_id = i.instrument_id AND p.session_date = o.session_date),
run AS (SELECT * FROM g QUALIFY k > coalesce(max(k) FILTER (close IS NULL) OVER (PARTITION BY instrument_id), 0))"""


@R.add("e09_adjusted_closes", GRID + " SELECT instrument_id, CAST(session_date AS STRING) AS session_date, k, close FROM g")
def _e09(v: Views) -> DataFrame:
    from tidemark.operators.technical import closes_grid

    return closes_grid(v.b_instruments, v.b_sessions, T.bars_as_of(v.b_bars, AS_OF, "RAW"), "2000-12-31", 60).select("instrument_id", day("session_date"), F.col("k").cast("long").alias("k"), "close")


@R.add("w19_contiguous_suffix", GRID + " SELECT instrument_id, count(*) AS sessions, CAST(min(session_date) AS STRING) AS since FROM run GROUP BY 1")
def _w19(v: Views) -> DataFrame:
    from tidemark.operators.technical import closes_grid

    g = closes_grid(v.b_instruments, v.b_sessions, T.bars_as_of(v.b_bars, AS_OF, "RAW"), "2000-12-31", 60)
    return T.contiguous_suffix(g, "instrument_id", "k", "close").groupBy("instrument_id").agg(F.count("*").alias("sessions"), F.min("session_date").cast("string").alias("since"))


@R.add("w20_price_range", GRID + " SELECT instrument_id, max(close) AS high, min(close) AS low, round(arg_max(close, k) / max(close) - 1, 6) AS from_high FROM run GROUP BY 1")
def _w20(v: Views) -> DataFrame:
    from tidemark.operators.technical import closes_grid, price_range

    g = closes_grid(v.b_instruments, v.b_sessions, T.bars_as_of(v.b_bars, AS_OF, "RAW"), "2000-12-31", 60)
    return price_range(T.contiguous_suffix(g, "instrument_id", "k", "close")).select("instrument_id", "high", "low", F.round("from_high", 6).alias("from_high"))


@R.add("w21_volatility", GRID + ", l AS (SELECT instrument_id, ln(close / lag(close) OVER (PARTITION BY instrument_id ORDER BY k)) AS x FROM run) SELECT instrument_id, round(stddev_samp(x) * sqrt(252), 6) AS volatility FROM l GROUP BY 1")
def _w21(v: Views) -> DataFrame:
    from tidemark.operators.technical import closes_grid, volatility

    g = closes_grid(v.b_instruments, v.b_sessions, T.bars_as_of(v.b_bars, AS_OF, "RAW"), "2000-12-31", 60)
    return volatility(T.contiguous_suffix(g, "instrument_id", "k", "close")).select("instrument_id", F.round("volatility", 6).alias("volatility"))


RSI = """WITH RECURSIVE s AS (SELECT instrument_id, signal_at, close, row_number() OVER (PARTITION BY instrument_id ORDER BY signal_at) AS n, close - lag(close) OVER (PARTITION BY instrument_id ORDER BY signal_at) AS d FROM b_panel),
seed AS (SELECT instrument_id, sum(greatest(d, 0)) / 14 AS gain, sum(greatest(-d, 0)) / 14 AS loss FROM s WHERE n BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14),
walk AS (SELECT instrument_id, CAST(15 AS BIGINT) AS n, gain, loss FROM seed UNION ALL SELECT w.instrument_id, s.n, (w.gain * 13 + greatest(s.d, 0)) / 14, (w.loss * 13 + greatest(-s.d, 0)) / 14 FROM walk w JOIN s ON s.instrument_id = w.instrument_id AND s.n = w.n + 1)
SELECT instrument_id, round(CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 4) AS rsi FROM walk QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY n DESC) = 1"""


@R.add("w22_wilder_rsi", RSI)
def _w22(v: Views) -> DataFrame:
    from tidemark.operators.technical import rsi

    return rsi(v.b_panel, "instrument_id", "signal_at", "close").filter("rsi IS NOT NULL").select("instrument_id", F.round("rsi", 4).alias("rsi"))


@R.add("w23_quarter_chain", f"WITH {FACTS_AS_OF}, q AS (SELECT * FROM facts WHERE metric = 'REVENUE') SELECT a.issuer_id, CAST(a.period_end AS STRING) AS period_end, round(a.value + b.value + c.value + d.value, 2) AS total FROM q a JOIN q b ON a.issuer_id = b.issuer_id AND b.period_end = CAST(a.period_start - INTERVAL 1 DAY AS DATE) JOIN q c ON a.issuer_id = c.issuer_id AND c.period_end = CAST(b.period_start - INTERVAL 1 DAY AS DATE) JOIN q d ON a.issuer_id = d.issuer_id AND d.period_end = CAST(c.period_start - INTERVAL 1 DAY AS DATE)")
def _w23(v: Views) -> DataFrame:
    from tidemark.operators.facts import facts_as_of, quarter_chain

    return quarter_chain(facts_as_of(v.b_facts, AS_OF).filter("metric = 'REVENUE'"), 4).select("issuer_id", day("period_end"), F.round("total", 2).alias("total"))
