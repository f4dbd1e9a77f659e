"""Sources and sinks over documents and files that are made from the input tables: each is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import framed_hash
from tidemark.operators import comparisons, model, publication, replay
from tidemark.operators import scoring as M
from tidemark.operators import temporal as T
from tidemark.plans import scoring
from tidemark.plans.domain import NORM, _norm
from tidemark.plans.temporal import day
from tidemark.plans.views import Registry, Views
from tidemark.sources import readers, sinks
from tidemark.streaming import observations

R = Registry()


def _place(v: Views, tag: str) -> str:
    return f"{T.shared_folder(v.spark)}/{tag}-{uuid.uuid4().hex}"


@R.add("s06_universe_file", "SELECT s_name AS symbol, n_name AS legal_name, CAST(s_suppkey AS STRING) AS cik, s_acctbal > 0 AS primary_liquid_class FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _s06(v: Views) -> DataFrame:
    path = _place(v, "universe")
    rows = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    blank = F.when(F.col("s_acctbal") > 0, F.when(F.col("s_suppkey") % 2 == 0, "")).otherwise("no")  # blank counts as true
    rows.select(F.col("s_name").alias("symbol"), F.col("n_name").alias("legal_name"), F.col("s_suppkey").cast("string").alias("cik"), F.lit("XNYS").alias("exchange_mic"), blank.alias("primary_liquid_class")).write.option("header", True).csv(path)
    return readers.read_universe(v.spark, path).select("symbol", "legal_name", "cik", "primary_liquid_class")


@R.add("s07_company_facts", "SELECT o_orderkey AS accession, c_custkey AS cik, o_orderpriority AS concept, CAST(CAST(o_orderdate AS DATE) AS STRING) AS filed_date, o_totalprice AS value, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS accepted FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'O' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'")
def _s07(v: Views) -> DataFrame:
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "P", "10-Q").otherwise("8-K")
    fact = F.struct(F.col("o_orderdate").cast("date").cast("string").alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), F.col("o_orderdate").cast("date").cast("string").alias("filed"), form.alias("form"))
    by_concept = v.orders.groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(fact).alias("f"))  # a registrant's own facts: one document
    units = F.struct(F.create_map(F.lit("USD"), F.col("f")).alias("units"))
    documents = by_concept.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", units))).alias("c")).select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.create_map(F.lit("us-gaap"), F.col("c")).alias("facts"))).alias("document"))
    submissions = v.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("accession"), form.alias("form"), F.col("o_orderstatus").alias("accepted"))
    rows = readers.company_facts(documents, submissions, ["1-URGENT", "2-HIGH"], "1996-01-01", "1999-12-31")
    return rows.select(F.col("accession").cast("long").alias("accession"), "cik", "concept", day("filed_date"), "value", "accepted")


@R.add("s08_submissions", "SELECT CAST(o_orderkey AS STRING) AS accession, o_orderstatus AS form, CAST(CAST(o_orderdate AS DATE) AS STRING) AS accepted, CAST(NULL AS STRING) AS error FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 UNION ALL SELECT NULL, NULL, NULL, 'RAGGED_CATALOG' FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def _s08(v: Views) -> DataFrame:
    one = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").cast("date").cast("string").alias("d"))))
    catalog = v.orders.join(v.customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_acctbal").agg(one.alias("r"))
    short = F.when(F.col("c_acctbal") < 0, F.slice(F.col("r.d"), 2, 1 << 20)).otherwise(F.col("r.d"))  # these catalogs lost a cell
    arrays = catalog.select(F.col("r.k").alias("accession"), F.col("r.s").alias("form"), short.alias("accepted"), F.col("r.d").alias("report_date"))
    return readers.zip_submissions(arrays).select("accession", "form", "accepted", "error")


@R.add("s10_call_report", "SELECT s_suppkey AS rssd, 'RCON2170' AS concept, s_acctbal AS value, s_nationkey AS issuer_id FROM supplier WHERE s_nationkey <= 20")
def _s10(v: Views) -> DataFrame:
    path = _place(v, "report")
    described = v.spark.sql("SELECT 'Entity number' AS IDRSSD, 'Total assets' AS RCON2170")
    v.supplier.select(F.col("s_suppkey").cast("string").alias("IDRSSD"), F.col("s_acctbal").cast("string").alias("RCON2170")).unionByName(described).write.option("header", True).option("sep", "\t").csv(path)
    entities = v.supplier.filter("s_nationkey <= 20").select(F.col("s_suppkey").alias("rssd"), F.col("s_nationkey").alias("issuer_id"))
    return readers.read_call_report(v.spark, path, entities, ["RCON2170", "RCON9999"]).select("rssd", "concept", "value", "issuer_id")


@R.add("s12_corporate_actions", "SELECT o_orderkey AS ref, o_orderpriority AS kind, CASE WHEN o_orderstatus = 'F' THEN 'S' || o_custkey WHEN o_orderstatus = 'P' THEN 'O' || o_custkey END AS subject FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'")
def _s12(v: Views) -> DataFrame:
    named = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("symbol"), F.concat(F.lit("S"), "o_custkey"))).when(F.col("o_orderstatus") == "P", F.create_map(F.lit("old_symbol"), F.concat(F.lit("O"), "o_custkey"))).otherwise(F.create_map(F.lit("none"), F.lit("")))
    asked = F.col("o_orderdate").cast("date")
    terms = F.map_concat(named, F.create_map(F.lit("ref"), F.col("o_orderkey").cast("string"), F.lit("process_date"), F.when(asked < F.lit("1998-01-01").cast("date"), asked).otherwise(F.date_add(asked, 1)).cast("string")))
    pages = v.orders.select(asked.alias("request_date"), F.to_json(F.struct(F.create_map(F.col("o_orderpriority"), F.array(terms)).alias("corporate_actions"))).alias("document"))
    return readers.parse_actions(pages).select(F.col("terms")["ref"].cast("long").alias("ref"), "kind", "subject")


@R.add("s14_panel_file", "SELECT CAST(signal_at AS STRING) || 'T20:00:00Z' AS signal_at, CAST(instrument_id AS STRING) AS instrument_id, round(score, 9) AS score, round(total_return, 9) AS total_return FROM b_panel")
def _s14(v: Views) -> DataFrame:
    path, at = _place(v, "panel"), F.concat(F.col("signal_at").cast("string"), F.lit("T20:00:00Z"))
    times = [at.alias(c) for c in ("signal_at", "knowledge_at", "execution_at", "next_session_open", "exit_at", "forward_end")]
    rest = [F.col("instrument_id").cast("string"), F.lit("SECTOR").alias("sector"), F.lit("GENERAL").alias("profile"), F.col("score").cast("string"), F.col("total_return").cast("string"), F.lit("0").alias("forward_6m"), F.col("market_cap").cast("string"), F.lit("100").alias("expected_count")]
    v.b_panel.select(*times, *rest).write.option("header", True).csv(path)
    return readers.read_panel(v.spark, path).select("signal_at", "instrument_id", F.round("score", 9).alias("score"), F.round("total_return", 9).alias("total_return"))


@R.add("s17_publication_archive", "SELECT CAST(c_nationkey AS STRING) AS run, count(*) AS members, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _s17(v: Views) -> DataFrame:
    """A document of each nation's orders (each is a file); the hash of each is stored beside it."""
    path = _place(v, "archive")
    runs = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("members"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    runs.select(F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("run"), "members", "total")).alias("document")).repartition("document").write.option("maxRecordsPerFile", 1).text(path)
    raw = v.spark.read.format("binaryFile").load(path)
    hashes = T.settle(raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256")))
    return readers.read_archive(v.spark, path, "run STRING, members BIGINT, total DOUBLE", hashes).select("document.run", "document.members", "document.total")


@R.add("k02_publication_tables", "WITH r AS (SELECT CAST(as_of AS STRING) AS run, instrument_id, round(composite, 6) AS composite FROM b_scores WHERE eligible AND as_of IN (DATE '2000-11-30', DATE '2000-12-31')) SELECT 'scores' AS table_name, run, count(*) AS n, round(sum(composite), 4) AS total FROM r WHERE run = '2000-12-31' GROUP BY 1, 2")
def _k02(v: Views) -> DataFrame:
    path = _place(v, "publication")
    sound, broken = (v.spark.sql(f"SELECT {n} AS missing, 0 AS unexpected, 0 AS both, 0 AS no_reason, 0 AS rank_gap") for n in (0, 1))
    for run, guard in (("2000-12-31", sound), ("2000-11-30", broken)):
        scores = v.b_scores.filter((F.col("as_of") == F.lit(run).cast("date")) & F.col("eligible")).select("instrument_id", F.round("composite", 6).alias("composite"))
        try:
            sinks.write_publication({"scores": scores}, guard, path, run)
        except ValueError:
            if guard is sound:
                raise
    return sinks.read_publication(v.spark, path, "scores").groupBy(F.lit("scores").alias("table_name"), "run").agg(F.count("*").alias("n"), F.round(F.sum("composite"), 4).alias("total"))


@R.add("k03_universe_export", "SELECT s_suppkey, 3 AS cells, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS empty, sha256(CAST(s_suppkey AS STRING) || chr(10) || s_name || chr(10) || CASE WHEN s_acctbal < 0 THEN '' ELSE CAST(s_nationkey AS STRING) END) AS digest FROM supplier")
def _k03(v: Views) -> DataFrame:
    rows = v.supplier.select("s_suppkey", "s_name", F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey")).alias("s_nationkey"))
    return sinks.export_csv(rows, _place(v, "export"))


@R.add("k04_sector_audit", NORM + " SELECT sector, 'composite' AS metric, count(composite) AS available, count(*) FILTER (cohort = 'PEER') AS peer, count(*) FILTER (cohort = 'FALLBACK') AS fallback, 0 AS no_cohort_issue FROM norm GROUP BY 1 UNION ALL SELECT 'ALL', 'composite', count(composite), count(z), NULL, count(DISTINCT sector) FROM norm")
def _k04(v: Views) -> DataFrame:
    path, norm = _place(v, "audit"), T.settle(_norm(v).withColumn("metric", F.lit("composite")).withColumn("value", F.col("composite")))
    sinks.write_sector_audit(norm, norm.filter("cohort = 'PEER'").groupBy("sector", "metric").agg(F.max("cohort_n").alias("stored")), path)
    back = lambda name: v.spark.read.parquet(f"{path}/{name}")
    wrong = back("issues").filter("recomputed IS NOT NULL").groupBy("sector").agg(F.count("*").alias("_i"))
    each = back("breakdown").join(wrong, "sector", "left").select("sector", "metric", "available", "peer", "fallback", F.coalesce("_i", F.lit(0)).alias("no_cohort_issue"))
    return each.unionByName(back("totals").select(F.lit("ALL").alias("sector"), "metric", "available", F.col("standardised").alias("peer"), F.lit(None).cast("long").alias("fallback"), F.col("sectors").alias("no_cohort_issue")))


@R.add("j15_source_components", "SELECT o_orderkey AS filing_id, o_orderpriority AS part, o_totalprice AS amount FROM orders WHERE o_orderstatus <> 'O'")
def _j15(v: Views) -> DataFrame:
    part = F.struct(F.col("o_orderkey").alias("accn"), F.col("o_orderpriority").alias("part"), F.col("o_totalprice").alias("amount"))
    documents = v.orders.groupBy("o_custkey").agg(F.to_json(F.collect_list(part)).alias("document"))  # one stored document per registrant
    facts = v.orders.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("accn"))
    return readers.source_components(facts, documents, "accn: BIGINT, part: STRING, amount: DOUBLE", ["accn"]).select(F.col("accn").alias("filing_id"), "part", "amount")


@R.add("j16_artifact_origin", "SELECT part_id AS artifact_id, first_value(part_id) OVER (PARTITION BY key ORDER BY effective_from, part_id) AS origin FROM b_symbols")
def _j16(v: Views) -> DataFrame:
    from pyspark.sql.window import Window

    made_from = F.lag("part_id").over(Window.partitionBy("key").orderBy("effective_from", "part_id"))
    return T.origins(v.b_symbols.select(F.col("part_id").alias("artifact_id"), made_from.alias("parent")), "artifact_id", "parent")


@R.add("q05_replay_runs", """WITH e AS (SELECT as_of, instrument_id, composite FROM b_scores WHERE eligible AND composite IS NOT NULL), o AS (SELECT as_of, instrument_id, composite + CASE WHEN month(as_of) = 6 AND instrument_id IN (SELECT instrument_id FROM b_instruments WHERE sector = 'ASIA') THEN 0.25 ELSE 0 END AS composite FROM e),
n AS (SELECT as_of, instrument_id, composite, row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, instrument_id) AS rank FROM e), s AS (SELECT as_of, instrument_id, composite, row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, instrument_id) AS rank FROM o)
SELECT CAST(s.as_of AS STRING) AS as_of, count(*) AS rows, count(*) FILTER (s.rank <> n.rank) AS other_rank, round(max(abs(s.composite - n.composite)), 6) AS largest, count(*) FILTER (s.rank <> n.rank OR abs(s.composite - n.composite) > 1e-9) = 0 AS reproduces FROM s JOIN n ON s.as_of = n.as_of AND s.instrument_id = n.instrument_id GROUP BY s.as_of""")
def _q05(v: Views) -> DataFrame:
    """Stored runs, some of which were changed after they were scored, against the runs rebuilt from their inputs."""
    altered = F.when((F.month("as_of") == 6) & (F.col("sector") == "ASIA"), F.col("composite") + 0.25).otherwise(F.col("composite"))
    stored = model.score_runs(v.b_scores.withColumn("composite", altered), ["as_of"])
    return comparisons.replay(stored, model.score_runs(v.b_scores, ["as_of"]), ["as_of"], "instrument_id").withColumn("as_of", F.col("as_of").cast("string"))


def _strict_tables(inputs: DataFrame, cards: DataFrame, spark) -> dict[str, DataFrame]:  # noqa: ANN001
    """Factors, scores and exclusions of all runs under the strict model."""
    norm, out = M.strict(M.assess(inputs, cards, scoring.ON, spark.sql(scoring.LAW)), ["run"], "instrument_id")
    out = T.settle(out)
    scores = model.score_runs(out, ["run"]).select(*scoring.ON, F.col("rank").cast("long").alias("rank"), F.round("composite", model.DIGITS).alias("composite"))
    factors = norm.filter(F.col("z").isNotNull()).select(*scoring.ON, "metric", "family", "cohort", F.round("z", 9).alias("z"))
    return {"factors": factors, "scores": T.settle(scores), "exclusions": out.filter(~F.col("eligible")).select(*scoring.ON, F.explode("errors").alias("reason"))}


@R.add("k02_result_tables", f"""WITH {scoring.ASSESSED}, {scoring.STRICT}, n AS (SELECT run, 'lineage' AS table_name, count(*) AS rows FROM a WHERE reason IS NULL GROUP BY 1 UNION ALL SELECT run, 'artifacts', count(DISTINCT instrument_id) FROM b_inputs WHERE sources > 0 GROUP BY 1
  UNION ALL SELECT run, 'scores', count(*) FILTER (len(errors) = 0) FROM o GROUP BY 1 UNION ALL SELECT run, 'factors', count(z) FROM z GROUP BY 1 UNION ALL SELECT run, 'exclusions', sum(len(errors)) FROM o GROUP BY 1)
SELECT run, table_name, CAST(rows AS BIGINT) AS rows FROM n WHERE run <> 1996 AND rows > 0""")
def _k02_tables(v: Views) -> DataFrame:
    """All five result tables of all runs; a run that lost its exclusions violates the guard and isn't published."""
    cards = scoring._cards(v)
    made = _strict_tables(v.b_inputs, cards, v.spark)
    lineage = M.accept(v.b_inputs, cards, scoring.ON).filter("reason IS NULL").select(*scoring.ON, "key", "available_at")
    artifacts = v.b_inputs.filter("sources > 0").groupBy(*scoring.ON).agg(F.sum("sources").alias("sources"))
    tables = {"lineage": lineage, "artifacts": artifacts} | made
    tables = {n: T.settle(tables[n].filter("run <> 1996") if n == "exclusions" else tables[n]) for n in sinks.RESULT_TABLES}
    guard = publication.guard(tables["scores"], tables["exclusions"], cards.select(*scoring.ON), ["run"])
    return sinks.write_publications(tables, T.settle(guard), _place(v, "publications")).select("run", "table_name", "rows")


@R.add("q05_replay_publications", f"""WITH {scoring.ASSESSED}, {scoring.STRICT}
SELECT run, CASE run WHEN 1997 THEN 'inputs' WHEN 1999 THEN 'scores' END AS found_at, CASE WHEN run IN (1997, 1999) THEN 'ALTERED' END AS kind, count(*) FILTER (run = 1999 AND len(errors) = 0 AND instrument_id % 7 = 0) AS cells FROM o GROUP BY run HAVING count(*) FILTER (len(errors) = 0) > 0""")
def _q05_publications(v: Views) -> DataFrame:
    """Published runs are rebuilt from their stored inputs. In one a stored input was changed since, in another a score: each is found where it was changed."""
    path, spark = _place(v, "replay"), v.spark
    made = _strict_tables(v.b_inputs, scoring._cards(v), spark)
    inputs = T.settle(v.b_inputs)
    tables = {"inputs": inputs, "cards": T.settle(scoring._cards(v)), "factors": T.settle(made["factors"]), "scores": made["scores"]}
    runs = tables["scores"].select("run").distinct()
    manifest = sinks.write_publications(tables, runs.withColumn("missing", F.lit(0)), path)
    doubled = F.when((F.col("key") == "RAW_CLOSE") & (F.col("instrument_id") % 5 == 0), F.col("value") * 2).otherwise(F.col("value"))
    inputs.filter("run = 1997").withColumn("value", doubled).drop("run").write.mode("overwrite").parquet(f"{path}/inputs/run=1997")
    raised = F.when(F.col("instrument_id") % 7 == 0, F.col("composite") + 0.25).otherwise(F.col("composite"))
    tables["scores"].filter("run = 1999").withColumn("composite", raised).drop("run").write.mode("overwrite").parquet(f"{path}/scores/run=1999")
    stored = {n: spark.read.schema(df.schema).parquet(f"{path}/{n}").select(*df.columns) for n, df in tables.items()}
    again: dict[str, DataFrame] = {}

    def rebuild(given: dict[str, DataFrame]) -> dict[str, DataFrame]:
        again.update({n: T.settle(df) for n, df in _strict_tables(given["inputs"], given["cards"], spark).items() if n != "exclusions"})
        return again

    found = T.settle(replay.first_difference(replay.replay_publications(manifest, stored, ["inputs", "cards"], rebuild)))
    cells = replay.altered_cells(stored["scores"], again["scores"], found.filter("found_at = 'scores'"), scoring.ON, ["composite"], ["rank"])
    return found.join(cells.groupBy("run").agg(F.count("*").alias("cells")), "run", "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


@R.add("k03_verified_export", "SELECT count(*) AS exported, count(*) AS read_back, 0 AS missing, 0 AS unexpected FROM part")
def _k03_verified(v: Views) -> DataFrame:
    path = _place(v, "export")
    rows = v.part.select("p_partkey", F.concat_ws(', "', "p_name", "p_brand").alias("label"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("type"), F.array("p_brand", "p_type").alias("tags"), "p_retailprice")
    sinks.export_csv(rows, path)
    return sinks.verify_export(rows, path).select("exported", "read_back", "missing", "unexpected")


TYPES = {"click": "STOCK_BAR", "purchase": "DAILY_PRICE", "error": "FILING_FACTS", "view": "REGULATORY_FACTS", "signup": "FUNDAMENTAL_SNAPSHOT"}


def _deliveries(v: Views) -> DataFrame:
    """Two halves of envelopes: even events, then odd ones, clicks of the first half once more, and some ids again with another payload. Some have an old schema or a wrong hash."""
    from itertools import chain

    kinds = F.create_map(*(F.lit(x) for x in chain(*TYPES.items())))
    number = F.col("event_id").cast("long")
    base = v.events.select(F.lit(1).alias("half"), number.alias("no"), F.when(F.col("value") < 5, 1).otherwise(2).alias("schema_version"), F.col("user_id").cast("string").alias("instrument_id"), F.coalesce(kinds[F.col("event_type")], F.upper("event_type")).alias("event_type"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("economic_time"), F.col("props").alias("payload"), F.col("event_type").alias("_kind"))
    even, second = base.filter("no % 2 = 0"), F.lit(2).alias("half")
    rest = [c for c in base.columns if c != "half"]
    parts = [even, base.filter("no % 2 = 1").select(second, *rest), even.filter("_kind = 'click'").select(second, *rest), even.filter("no % 97 = 3 OR no % 97 = 40").withColumn("payload", F.lit("{}")).select(second, *rest)]
    rows = comparisons.union_all(parts)
    key = framed_hash(F.col("instrument_id"), F.col("event_type"), F.date_format("economic_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select("half", F.col("no").cast("string").alias("event_id"), "schema_version", key.alias("observation_key"), "instrument_id", "event_type", "economic_time", "payload", F.when(F.col("no") % 50 == 7, "x").otherwise(F.sha2("payload", 256)).alias("payload_hash"))


def _two_starts(v: Views, tag: str, start) -> str:  # noqa: ANN001
    """The deliveries arrive in two halves; the stream is started, stops when it has taken what is there, and is started again. Rows of one key arrive in one file."""
    path, rows = _place(v, tag), T.settle(_deliveries(v))
    for half in (1, 2):
        rows.filter(F.col("half") == half).drop("half").repartition(6, "observation_key").write.json(f"{path}/inbox/half{half}")
        start(observations.read_stream(v.spark, f"{path}/inbox/*", 4), path).awaitTermination()
    return path


DELIVERIES = """k AS (SELECT CAST(event_id AS BIGINT) AS no, CASE WHEN value < 5 THEN 1 ELSE 2 END AS schema_version, user_id, event_type AS kind, CASE event_type WHEN 'click' THEN 'STOCK_BAR' WHEN 'purchase' THEN 'DAILY_PRICE' WHEN 'error' THEN 'FILING_FACTS' WHEN 'view' THEN 'REGULATORY_FACTS' WHEN 'signup' THEN 'FUNDAMENTAL_SNAPSHOT' ELSE upper(event_type) END AS event_type, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS t, props AS payload FROM events),
d AS (SELECT 1 AS half, * FROM k WHERE no % 2 = 0 UNION ALL SELECT 2, * FROM k WHERE no % 2 = 1 UNION ALL SELECT 2, * FROM k WHERE no % 2 = 0 AND kind = 'click' UNION ALL SELECT 2, * REPLACE ('{}' AS payload) FROM k WHERE no % 2 = 0 AND no % 97 IN (3, 40)),
c AS (SELECT *, concat_ws(',', CASE WHEN schema_version <> 2 THEN 'BAD_SCHEMA_VERSION' END, CASE WHEN no % 50 = 7 THEN 'PAYLOAD_HASH_MISMATCH' END, CASE WHEN event_type NOT IN ('STOCK_BAR', 'DAILY_PRICE', 'FILING_FACTS', 'REGULATORY_FACTS', 'FUNDAMENTAL_SNAPSHOT') THEN 'UNSUPPORTED_TYPE' END) AS wrong FROM d),
i AS (SELECT *, first_value(payload) OVER (PARTITION BY no ORDER BY half, sha256(payload)) AS first FROM c WHERE wrong = ''),
j AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, t ORDER BY half, t, CAST(no AS VARCHAR)) AS place FROM i WHERE payload = first)"""


@R.add("st01_stream_tables", f"""WITH {DELIVERIES} SELECT 'journal' AS table_name, CAST(no AS VARCHAR) AS event_id, event_type AS detail, 1 AS n FROM j WHERE place = 1 UNION ALL SELECT 'receipts', CAST(no AS VARCHAR), event_type, count(*) FROM j GROUP BY no, event_type
UNION ALL SELECT 'quarantine', CAST(no AS VARCHAR), wrong, count(*) FROM c WHERE wrong <> '' GROUP BY no, wrong UNION ALL SELECT 'quarantine', CAST(no AS VARCHAR), 'IDENTITY_REUSED', count(*) FROM i WHERE payload <> first GROUP BY no
UNION ALL SELECT 'canonical', CAST(no AS VARCHAR), CASE event_type WHEN 'STOCK_BAR' THEN 'bars' WHEN 'DAILY_PRICE' THEN 'daily_prices' WHEN 'FILING_FACTS' THEN 'filing_facts' WHEN 'REGULATORY_FACTS' THEN 'regulatory_facts' ELSE 'fundamental_snapshots' END, 1 FROM j WHERE place = 1""")
def _st01(v: Views) -> DataFrame:
    """The tables that a stream left after two starts: journal, receipts, quarantine, and the canonical tables it fans out to."""
    path = _two_starts(v, "stream", lambda stream, place: observations.start(stream, place, observations.ROUTES))
    read = lambda name: v.spark.read.parquet(f"{path}/{name}")
    types = read("journal").select("observation_key", "event_type").distinct()
    row = lambda df, name, detail: df.groupBy(F.lit(name).alias("table_name"), "event_id", detail.alias("detail")).agg(F.count("*").alias("n"))
    return comparisons.union_all([
        row(read("journal"), "journal", F.col("event_type")), row(read("receipts").join(types, "observation_key"), "receipts", F.col("event_type")),
        row(read("quarantine"), "quarantine", F.array_join("violations", ",")), row(read("canonical"), "canonical", F.col("target")),
    ])


@R.add("st15_stream_gauges", f"WITH {DELIVERIES} SELECT CAST(CAST(date_trunc('day', t) AS DATE) AS STRING) AS day, event_type, count(*) AS n, CAST(max(t) AS VARCHAR) AS newest FROM d GROUP BY 1, 2")
def _st15(v: Views) -> DataFrame:
    """Deliveries by day and type, kept by a stream through two starts."""
    path = _two_starts(v, "gauges", observations.start_gauges)
    return observations.read_gauges(v.spark, path).select(F.to_date("window_start").cast("string").alias("day"), "event_type", "n", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"))
