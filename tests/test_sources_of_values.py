"""EBITDA from source components, and what reviews change between cutoffs."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ebitda, reviews

FIRST, SECOND = ebitda.CONCEPTS
QUARTERS = [("2023-01-01", "2023-03-31"), ("2023-04-01", "2023-06-30"), ("2023-07-01", "2023-09-30"), ("2023-10-01", "2023-12-31")]
ROLLED = [("2022-01-01", "2022-12-31"), ("2023-01-01", "2023-06-30"), ("2022-01-01", "2022-06-30")]


def case(spark, periods, values, total, entries, sources=None, reason=None, artifact="d"):
    """``entries``: (component, concept, val, form, shift of the end)."""
    day = lambda c: F.to_date(c).alias(c)
    parts = spark.createDataFrame([("t", i, s, e, D(v), f"a{i}", artifact) for i, ((s, e), v) in enumerate(zip(periods, values, strict=True))], "t string, fact_id int, period_start string, period_end string, value decimal(18,4), accession string, artifact_id string")
    parts = parts.select("t", "fact_id", day("period_start"), day("period_end"), "value", "accession", "artifact_id")
    rows = [(concept, f"a{i}", *periods[i], form, D(val)) for i, concept, val, form in entries]
    docs = spark.createDataFrame([("d", rows)], "artifact_id string, entries array<struct<concept string, accn string, start string, end string, form string, val decimal(18,4)>>")
    docs = docs.withColumn("entries", F.transform("entries", lambda e: e.withField("start", F.to_date(e["start"])).withField("end", F.to_date(e["end"]))))
    totals = spark.createDataFrame([("t", None if total is None else D(total), reason, len(periods) if sources is None else sources)], "t string, total decimal(18,4), total_reason string, sources int")
    r = ebitda.ebitda(totals, parts, docs, "t").first()
    return r["reason"] or (float(r["depreciation"]), float(r["ebitda"]), r["concept"], str(r["period_end"]))


def all_of(concept, vals, form="10-K"):
    return [(i, concept, v, form) for i, v in enumerate(vals)]


def test_ebitda_takes_the_first_whole_concept(spark):
    four, rolled = ["10", "20", "30", "40"], ["100", "60", "45"]
    assert case(spark, QUARTERS, four, "100", all_of(FIRST, "1234")) == (10.0, 110.0, FIRST, "2023-12-31")
    assert case(spark, ROLLED, rolled, "115", all_of(SECOND, ["9", "5.5", "4"])) == (10.5, 125.5, SECOND, "2023-06-30")
    assert case(spark, ROLLED[:1], ["7"], "7", [*all_of(FIRST, ["3"], "8-K"), *all_of(SECOND, ["2"])]) == (2.0, 9.0, SECOND, "2022-12-31"), "forms that don't count"
    assert case(spark, QUARTERS, four, "100", [*all_of(FIRST, "123"), *all_of(SECOND, "2222")]) == (8.0, 108.0, SECOND, "2023-12-31"), "one component is short"
    assert case(spark, ROLLED[:1], ["7"], "7", [*all_of(FIRST, ["3"]), *all_of(FIRST, ["3"], "10-K/A")]) == (3.0, 10.0, FIRST, "2022-12-31"), "the same value twice is one"


def test_ebitda_reasons(spark):
    four = ["10", "20", "30", "40"]
    assert case(spark, QUARTERS, four, None, []) == ebitda.MISSING
    assert case(spark, QUARTERS, four, None, [], reason="STALE") == "OPERATING_INCOME_TTM:STALE"
    assert case(spark, QUARTERS, four, "100", [], sources=5) == ebitda.FACTS == case(spark, QUARTERS, four, "100", [], sources=0)
    assert case(spark, QUARTERS, four, "100.0001", all_of(FIRST, "1234")) == ebitda.PERIODS, "not the published total"
    assert case(spark, QUARTERS[:2], four[:2], "30", all_of(FIRST, "12")) == ebitda.PERIODS, "two components"
    assert case(spark, [*QUARTERS[:3], ROLLED[0]], four, "100", all_of(FIRST, "1234")) == ebitda.PERIODS, "three quarters and a year"
    assert case(spark, QUARTERS[:1], ["10"], "10", all_of(FIRST, "1")) == ebitda.PERIODS, "one quarter"
    assert case(spark, QUARTERS, four, "100", all_of(FIRST, "1234"), artifact=None) == ebitda.ARTIFACT
    assert case(spark, QUARTERS, four, "100", []) == ebitda.NOT_REPORTED
    assert case(spark, QUARTERS, four, "100", [*all_of(FIRST, "1234"), (0, FIRST, "9", "10-Q")]) == ebitda.AMBIGUOUS
    assert case(spark, QUARTERS, four, "100", [(1, FIRST, "9", "10-Q"), (1, FIRST, "8", "10-Q")]) == ebitda.NOT_REPORTED, "the first component has none, so it stops there"
    assert case(spark, ROLLED, ["100", "60", "45"], "115", all_of(FIRST, ["1", "1", "5"])) == ebitda.NEGATIVE


FACTS, REVIEWS = "k string, available_at string, fact_id int, value double", "k string, recorded_at string, review_id int, decision string, value double"
CUTS = ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]


def test_review_effect_over_cutoffs(spark):
    at = lambda df, c: df.withColumn(c, F.to_timestamp(c))
    facts = at(spark.createDataFrame([("a", "2024-01-15", 1, 10.0), ("a", "2024-02-15", 2, 11.0), ("b", "2024-02-01", 3, 5.0), ("e", "2025-01-01", 4, 1.0)], FACTS), "available_at")
    rows = [("b", "2024-01-01", 1, "ACCEPT", 4.0), ("c", "2024-01-10", 2, "ACCEPT", 7.0), ("c", "2024-02-10", 3, "REJECT", 7.0), ("c", "2024-03-10", 4, "ACCEPT", 8.0), ("d", "2024-01-10", 5, "REJECT", 1.0), ("c", "2024-01-10", 1, "REJECT", 0.0)]
    recorded = at(spark.createDataFrame(rows, REVIEWS), "recorded_at")
    selected = reviews.selections(facts, recorded, ["k"], CUTS)
    got = sorted((r["k"], r["cutoff"][5:7], r["source"], r["value"]) for r in selected.collect())
    assert got == [("a", "02", "DIRECT", 10.0), ("a", "03", "DIRECT", 11.0), ("a", "04", "DIRECT", 11.0), ("b", "01", "REVIEWED", 4.0), ("b", "02", "DIRECT", 5.0), ("b", "03", "DIRECT", 5.0), ("b", "04", "DIRECT", 5.0), ("c", "02", "REVIEWED", 7.0), ("c", "04", "REVIEWED", 8.0)]
    changes = sorted((r["k"], r["cutoff"][5:7], r["change"], r["value"]) for r in reviews.effect(selected, ["k"], CUTS).collect())
    assert changes == [("a", "02", "ENTERED", 10.0), ("a", "03", "CHANGED", 11.0), ("b", "01", "ENTERED", 4.0), ("b", "02", "CHANGED", 5.0), ("c", "02", "ENTERED", 7.0), ("c", "03", "LEFT", 7.0), ("c", "04", "ENTERED", 8.0)]
    assert reviews.selections(facts.limit(0), recorded.limit(0), ["k"], CUTS).count() == 0


@pytest.mark.parametrize("n", [1, 4])
def test_review_selection_matches_one_cutoff_at_a_time(spark, n):
    import random

    rng = random.Random(n)
    day = lambda: f"2024-0{rng.randint(1, 4)}-{rng.randint(10, 28)}"
    facts = [(f"k{rng.randint(0, 30)}", day(), i, float(i)) for i in range(40)]
    recorded = [(f"k{rng.randint(0, 30)}", day(), i, rng.choice(["ACCEPT", "REJECT"]), float(i)) for i in range(80)]
    a = spark.createDataFrame(facts, FACTS).withColumn("available_at", F.to_timestamp("available_at"))
    b = spark.createDataFrame(recorded, REVIEWS).withColumn("recorded_at", F.to_timestamp("recorded_at"))
    cuts = ["2024-01-20", "2024-02-20", "2024-03-20", "2024-04-20"][:n]
    want = set()
    for c in cuts:
        for k in {x[0] for x in facts + recorded}:
            known = [(t, i, v) for key, t, i, v in facts if key == k and t <= c]
            seen = [(t, i, d, v) for key, t, i, d, v in recorded if key == k and t <= c]
            if known:
                want.add((k, c, "DIRECT", max(known)[2]))
            elif seen and max(seen)[2] == "ACCEPT":
                want.add((k, c, "REVIEWED", max(seen)[3]))
    assert {tuple(r) for r in reviews.selections(a, b, ["k"], cuts).collect()} == want
