"""Sources, sinks and streams on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import framed_hash
from tidemark.operators import replay
from tidemark.sources import readers, sinks
from tidemark.streaming import observations


def test_universe_file(spark, tmp_path):
    (tmp_path / "u.csv").write_text('﻿symbol,legal_name,cik,exchange_mic,primary_liquid_class\nA,"One, Inc",1,XNYS,\nB,Two,2,XNAS,no\n', encoding="utf-8")
    rows = {r["symbol"]: r for r in readers.read_universe(spark, str(tmp_path / "u.csv")).collect()}
    assert rows["A"]["legal_name"] == "One, Inc" and rows["A"]["primary_liquid_class"] and not rows["B"]["primary_liquid_class"]
    (tmp_path / "v.csv").write_text("symbol,cik\nA,1\n")
    with pytest.raises(ValueError, match="legal_name"):
        readers.read_universe(spark, str(tmp_path / "v.csv"))


def test_company_facts(spark):
    doc = {"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2023-01-01", "end": "2023-12-31", "val": 5, "accn": "a", "filed": "2024-02-01", "form": "10-K"}, {"end": "2023-12-31", "val": 6, "accn": "b", "filed": "2024-02-01", "form": "8-K"}]}}}}}
    docs = spark.createDataFrame([(json.dumps(doc),)], "document string")
    subs = spark.createDataFrame([("a", "10-K", "2024-02-01T10:00:00Z")], "accession string, form string, accepted string")
    rows = readers.company_facts(docs, subs, ["Revenues"], "2024-01-01", "2024-12-31").collect()
    assert [(r["cik"], r["value"], r["form"]) for r in rows] == [(7, 5.0, "10-K")]
    with pytest.raises(Exception, match="disagrees with its submission"):
        readers.company_facts(docs, subs.withColumn("form", F.lit("10-Q")), ["Revenues"], "2024-01-01", "2024-12-31").collect()


def test_submission_catalog(spark):
    kind = "accession array<string>, form array<string>, accepted array<string>, report_date array<string>"
    rows = [(["a", "b"], ["10-K", "10-Q"], ["1", "2"], ["x", "y"]), (["b"], ["10-K"], ["2"], ["y"]), (["c"], [], ["1"], ["x"])]
    out = sorted((r["accession"] or "", r["error"] or "") for r in readers.zip_submissions(spark.createDataFrame(rows, kind)).collect())
    assert out == [("", "RAGGED_CATALOG"), ("a", ""), ("b", "CONFLICTING_SUBMISSION")]


def test_call_report(spark, tmp_path):
    (tmp_path / "r.txt").write_text("IDRSSD\tRCOAP793\tRCFAP793\nid\tdescription\tother\n1\t0.12\t\n2\t0.1\t0.2\n")
    entities = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "rssd long, name string")
    out = sorted((r["rssd"], r["concept"], r["value"]) for r in readers.read_call_report(spark, str(tmp_path / "r.txt"), entities, ["RCOAP793", "RCFAP793", "RCOWP793"]).collect())
    assert out == [(1, "RCOAP793", 0.12), (2, "RCFAP793", 0.2), (2, "RCOAP793", 0.1)]
    (tmp_path / "again.txt").write_text("IDRSSD\tRCOAP793\n3\t1\n3\t2\n")
    with pytest.raises(Exception, match="more than once"):
        readers.read_call_report(spark, str(tmp_path / "again.txt"), entities, ["RCOAP793"]).collect()


def test_archive_refuses_changed_bytes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run": "x"}')
    import hashlib

    right = hashlib.sha256(b'{"run": "x"}').hexdigest()
    read = lambda sha: readers.read_archive(spark, str(tmp_path), "run STRING", spark.createDataFrame([("a.json", sha)], "name string, sha256 string"))
    assert read(right).first()["document"]["run"] == "x"
    with pytest.raises(Exception, match="differ from their hash"):
        read("0" * 64).collect()


def test_pages(spark):
    page = {"bars": {"A": [{"t": "2024-01-02T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 0, "n": 0, "vw": 0}, {"t": "2024-01-03T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 5, "n": 1, "vw": 1.5}]}}
    assert [r["vwap"] for r in readers.parse_bars(spark.createDataFrame([(json.dumps(page),)], "document string")).orderBy("time").collect()] == [None, 1.5]
    acts = {"corporate_actions": {"cash_dividends": [{"symbol": "A", "process_date": "2024-01-05", "rate": "0.1"}], "mergers": [{"acquiree_symbol": "B", "process_date": "2024-01-06"}]}}
    df = spark.createDataFrame([(json.dumps(acts), "2024-01-05")], "document string, request_date string").withColumn("request_date", F.to_date("request_date"))
    assert [(r["kind"], r["subject"]) for r in readers.parse_actions(df).collect()] == [("cash_dividends", "A")]


def test_publication_is_all_or_nothing(spark, tmp_path):
    path, scores = str(tmp_path), spark.createDataFrame([(1, 0.5)], "instrument_id int, composite double")
    ok, bad = (spark.createDataFrame([(n, 0)], "missing int, rank_gap int") for n in (0, 2))
    with pytest.raises(ValueError, match="missing"):
        sinks.write_publication({"scores": scores}, bad, path, "r0")
    sinks.write_publication({"scores": scores}, ok, path, "r1")
    scores.write.parquet(f"{path}/scores/run=r2")  # a run that died before its manifest
    assert [r["run"] for r in sinks.read_publication(spark, path, "scores").collect()] == ["r1"]


def test_append_and_export(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    for _ in range(2):
        sinks.append_if_absent(a, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    nested = a.withColumn("n", F.array("v"))
    one, two = (sorted((r["cells"], r["empty"], r["digest"]) for r in sinks.export_csv(d, str(tmp_path / n)).collect()) for d, n in ((nested, "e"), (nested.orderBy(F.desc("k")), "f")))
    assert one == two and [r[:2] for r in one] == [(3, 0)] * 3
    text = b"".join(f.read_bytes() for f in (tmp_path / "e").glob("*.csv"))
    assert text.startswith("\ufeffk".encode()) and b"[" in text


def envelope(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, instrument_id string, payload string, ok boolean").withColumn("schema_version", F.lit(2)).withColumn("event_type", F.lit("BAR")).withColumn("economic_time", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    key = framed_hash(F.col("instrument_id"), F.col("event_type"), F.date_format("economic_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return df.withColumn("observation_key", key).withColumn("payload_hash", F.when(F.col("ok"), F.sha2("payload", 256)).otherwise("?")).drop("ok")


def test_stream_accepts_once_and_quarantines(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    envelope(spark, [("1", "a", "{}", True), ("2", "b", "{}", False)]).write.json(f"{inbox}/x")
    run = lambda: observations.start(observations.read_stream(spark, f"{inbox}/*"), out).awaitTermination()
    run()
    envelope(spark, [("3", "a", "{}", True), ("4", "c", "{}", True)]).write.json(f"{inbox}/y")
    run()
    assert sorted(r["instrument_id"] for r in spark.read.parquet(f"{out}/journal").collect()) == ["a", "c"]
    dead = spark.read.parquet(f"{out}/quarantine")
    assert [(r["event_id"], r["violations"]) for r in dead.collect()] == [("2", ["PAYLOAD_HASH_MISMATCH"])]
    fixes = spark.createDataFrame([("2", "r1", "{}")], "event_id string, replay_id string, payload string")
    again = observations.replay(dead, fixes, None)
    observations.ingest_batch(out)(again.drop("replay_id"), 99)
    observations.ingest_batch(out)(again.drop("replay_id"), 99)
    assert spark.read.parquet(f"{out}/journal").filter("instrument_id = 'b'").count() == 1
    assert observations.replay(dead, fixes, fixes).count() == 0


def test_stream_gauges(spark, tmp_path):
    envelope(spark, [("1", "a", "{}", True), ("2", "b", "{}", True)]).write.json(str(tmp_path / "in/x"))
    stream = observations.dedupe_recent(observations.read_stream(spark, str(tmp_path / "in/*")))
    q = observations.gauges(observations.read_stream(spark, str(tmp_path / "in/*")), "gauge_counts")
    q.processAllAvailable()
    assert spark.table("gauge_counts").first()["n"] == 2 and stream.isStreaming


def test_stream_routes_and_identities(spark, tmp_path):
    """A reused event id and an unknown type are quarantined, a redelivery is received and changes nothing; a repeated batch writes the same tables."""
    out, routes = str(tmp_path / "out"), {"BAR": "bars"}
    run = observations.ingest_batch(out, routes)
    first = envelope(spark, [("1", "a", "{}", True), ("2", "b", "{}", True), ("2", "b", "[]", True)])
    second = envelope(spark, [("1", "a", "{}", True), ("1", "a", "[1]", True), ("3", "c", "{}", True)]).unionByName(envelope(spark, [("4", "d", "{}", True)]).withColumn("event_type", F.lit("ODD")))
    run(first, 0)
    for _ in range(2):
        run(second, 1)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert sorted(r["instrument_id"] for r in read("journal").collect()) == ["a", "b", "c"] == sorted(r["instrument_id"] for r in read("canonical").filter("target = 'bars'").collect())
    assert sorted((r["event_id"], r["n"]) for r in read("receipts").groupBy("event_id").agg(F.count("*").alias("n")).collect()) == [("1", 2), ("2", 1), ("3", 1)]
    dead = sorted((r["event_id"], r["violations"]) for r in read("quarantine").collect())
    assert dead == [("1", ["IDENTITY_REUSED"]), ("2", ["IDENTITY_REUSED"]), ("4", ["KEY_MISMATCH", "UNSUPPORTED_TYPE"])]


def test_durable_gauges_continue_after_a_stop(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, rows in (("x", [("1", "a", "{}", True), ("2", "b", "{}", True)]), ("y", [("3", "a", "{}", True)])):
        envelope(spark, rows).write.json(f"{inbox}/{name}")
        observations.start_gauges(observations.read_stream(spark, f"{inbox}/*"), out).awaitTermination()
    assert [(r["event_type"], r["n"]) for r in observations.read_gauges(spark, out).collect()] == [("BAR", 3)]


def published(spark, path):
    inputs = spark.createDataFrame([(r, i, float(r * i)) for r in (1, 2, 3) for i in range(5)], "run int, id int, x double")
    scores = inputs.select("run", "id", (F.col("x") + 1).alias("y"))
    guards = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "run int, missing int")
    return {"inputs": inputs, "scores": scores}, sinks.write_publications({"inputs": inputs, "scores": scores}, guards, path)


def test_many_publications_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    _, manifest = published(spark, path)
    assert sorted((r["run"], r["table_name"], r["rows"]) for r in manifest.collect()) == [(r, t, 5) for r in (1, 2) for t in ("inputs", "scores")], "run 3 violates its guard"
    assert spark.read.parquet(f"{path}/scores").filter("run = 3").count() == 0
    a = spark.createDataFrame([(1, "x", 0.1), (2, None, None)], "k int, s string, d double")
    one = lambda df: sinks.table_hash(df, []).first()["content_hash"]
    assert one(a) == one(a.orderBy(F.desc("k")).select("d", "k", "s")) and one(a) != one(a.union(a)) and one(a) != one(a.withColumn("s", F.lit("x")))


def test_publication_that_reads_back_otherwise_gets_no_manifest(spark, tmp_path, monkeypatch):
    """What the folder holds is hashed after what was to be written: here it lost a row."""
    calls, real = [], sinks.table_hash

    def lossy(df, by):
        calls.append(1)
        return real(df if len(calls) % 2 else df.limit(2), by)

    monkeypatch.setattr(sinks, "table_hash", lossy)
    guard = spark.createDataFrame([(0,)], "missing int")
    with pytest.raises(ValueError, match="read back with 2 rows instead of 3"):
        sinks.write_publication({"scores": spark.range(3)}, guard, str(tmp_path / "one"), "r")
    assert not (tmp_path / "one/manifest").exists()
    _, manifest = published(spark, str(tmp_path / "many"))
    assert manifest.count() == 0


def test_replay_finds_what_was_altered(spark, tmp_path):
    path = str(tmp_path)
    tables, manifest = published(spark, path)
    rebuild = lambda bump: lambda given: {"scores": given["inputs"].select("run", "id", (F.col("x") + 1 + bump).alias("y"))}

    def found(bump=0.0):
        stored = {n: spark.read.schema(df.schema).parquet(f"{path}/{n}") for n, df in tables.items()}
        return {r["run"]: (r["found_at"], r["kind"]) for r in replay.first_difference(replay.replay_publications(manifest, stored, ["inputs"], rebuild(bump))).collect()}

    assert found() == {1: (None, None), 2: (None, None)}
    assert found(0.5) == {1: ("scores", "NOT_REPRODUCED"), 2: ("scores", "NOT_REPRODUCED")}
    tables["inputs"].filter("run = 1").withColumn("x", F.col("x") * 3).drop("run").write.mode("overwrite").parquet(f"{path}/inputs/run=1")
    tables["scores"].filter("run = 2").withColumn("y", F.when(F.col("id") == 4, 0.0).otherwise(F.col("y"))).drop("run").write.mode("overwrite").parquet(f"{path}/scores/run=2")
    assert found() == {1: ("inputs", "ALTERED"), 2: ("scores", "ALTERED")}
    cells = replay.altered_cells(spark.read.schema(tables["scores"].schema).parquet(f"{path}/scores"), tables["scores"], manifest.filter("run = 2"), ["run", "id"], ["y"], [])
    assert [tuple(r) for r in cells.collect()] == [(2, 4, "y")]


def test_export_is_verified(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", cell', None, ["x"]), (2, "", "line\nbreak", []), (2, "", "line\nbreak", [])], "k int, s string, t string, n array<string>")
    path = str(tmp_path / "e")
    sinks.export_csv(rows.coalesce(1), path)
    told = sinks.verify_export(rows, path).first()
    assert (told["exported"], told["read_back"], told["missing"], told["unexpected"], told["files"]) == (3, 3, 0, 0, 1) and len(told["sha256"]) == 64
    other = sinks.verify_export(rows.filter("k = 1").union(rows.filter("k = 1")), path).first()
    assert (other["missing"], other["unexpected"]) == (1, 2)


def test_stream_batch_of_few_rows_takes_few_tasks(spark, tmp_path):
    """A stream plans its batches without adaptive execution: shuffles are sized by the batch's rows, and what the identity of events says is made once."""
    run, sc = observations.ingest_batch(str(tmp_path / "out"), {"BAR": "bars"}), spark.sparkContext
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        for n in range(2):
            sc.setJobGroup(f"batch-{n}", "")
            run(envelope(spark, [(f"{n}1", "a", "{}", True), (f"{n}2", f"b{n}", "{}", True)]), n)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "150"
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, x in held.items():
            spark.conf.set(k, x)
    status = sc.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("batch-1") for s in status.getJobInfo(job).stageIds}
    assert stages and max(status.getStageInfo(s).numTasks for s in stages if status.getStageInfo(s)) < 150
    assert spark.read.parquet(f"{tmp_path}/out/journal").count() == 3


def test_row_hashes_make_no_json_and_tell_cells_apart(spark):
    df = spark.sql("SELECT 1L AS k, 'a|b' AS s, CAST(NULL AS STRING) AS t, 0.1D AS d, DATE'2001-02-03' AS day, TIMESTAMP'2001-02-03 04:05:06' AS at, array(1, 2) AS l")
    flat = df.drop("l")
    assert "to_json" not in sinks.table_hash(flat, [])._jdf.queryExecution().optimizedPlan().toString(), "JSON took 10 microseconds a row"
    one = lambda d: sinks.table_hash(d, []).first()["content_hash"]
    other = {"k": F.lit(2), "s": F.lit("a"), "t": F.lit("~"), "d": F.lit(0.100000002), "day": F.lit("2001-02-04").cast("date"), "at": F.expr("at + INTERVAL '1' MICROSECOND"), "l": F.array(F.lit(1), F.lit(3))}
    assert len({one(df), *(one(df.withColumn(c, x)) for c, x in other.items())}) == 8
    assert one(df) == one(df.withColumn("d", F.lit(0.1 + 1e-13))) and one(flat.withColumn("d", F.lit(-0.0))) == one(flat.withColumn("d", F.lit(0.0)))
    assert one(flat.select(F.lit("x").alias("s"), F.lit("y|1:z").alias("t"))) != one(flat.select(F.lit("x|5:y").alias("s"), F.lit("z").alias("t")))
    big = [one(spark.createDataFrame([(x,)], "d double")) for x in (1e7, 1e7 + 2e-9, 1e300, 1.1e300, float("inf"), float("-inf"), float("nan"), None, 0.0)]
    assert len(set(big)) == 9
