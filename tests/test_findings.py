"""Small cases of what a review found on larger tables."""

from __future__ import annotations

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import MADE, cells
from tidemark.operators import ebitda, research, scoring, temporal
from tidemark.plans.views import Views


def folder_size(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def test_settled_rows_are_kept_packed(spark):
    base = temporal.shared_folder(spark).removeprefix("file:")
    before = folder_size(base)
    df = spark.range(20_000).select("id", F.lit("the same long text in every row").alias("t"), F.lit(None).alias("none"), *(F.lit(0.5).alias(f"c{i}") for i in range(20)))
    out = temporal.settle(df)
    assert folder_size(base) - before < 500_000, "4 MB as whole rows"
    assert out.columns == df.columns and out.count() == 20_000 and out.filter("none IS NULL AND c3 = 0.5").count() == 20_000


def test_inputs_are_dealt_before_they_are_made(spark, sf_dir):
    v = Views(spark, sf_dir)
    wide = scoring.widen(scoring.accept(v.b_inputs, v.b_cards, ["run", "instrument_id"]), v.b_cards, ["run", "instrument_id"], ["RAW_CLOSE"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    above = [line.split("- ")[0] for line in plan.split("\n") if "BroadcastNestedLoopJoin" in line]
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "BroadcastNestedLoopJoin" in line)
    depth, over = len(above[0]), []
    for line in reversed(lines[:at]):
        if (d := len(line.split("- ")[0])) < depth:
            depth = d
            over.append(line)
    assert not [x for x in over if "Exchange hashpartitioning" in x], "the rows per key are not shuffled"


def risk_codes(spark, pay, before):
    numbers = {"tce": 1.0, "requirement": 0.1, "cet1": 0.2, "rbc": 4.0, "ebitdare": 1.0, "interest_coverage": 3.0, "leverage": 1.0, "combined_ratio": 0.5, "affo_payout": pay, "affo_payout_prior": before}
    row = spark.range(1).select(F.lit("EQUITY_REIT").alias("profile"), F.lit(True).alias("reit_reconciled"), F.lit(True).alias("same_store_pool_consistent"), *(F.lit(x).cast("double").alias(n) for n, x in numbers.items()))
    return row.select(*(scoring.reasons(*rules) for rules in scoring.risks(row))).first()


@pytest.mark.parametrize(("pay", "before", "broken", "warned"), [
    (1.15, None, ["MISSING_RISK_INPUT:affo_payout"], ["REIT_PAYOUT_WARNING"]), (1.3, None, ["MISSING_RISK_INPUT:affo_payout"], []), (None, 1.1, ["MISSING_RISK_INPUT:affo_payout"], []),
    (1.3, 1.1, [], ["REIT_PAYOUT_WARNING"]), (1.3, 1.3, ["REIT_PAYOUT_BREACH"], []), (0.9, 1.3, [], []),
])
def test_payout_warning_without_a_prior_payout(spark, pay, before, broken, warned):
    assert [list(x) for x in risk_codes(spark, pay, before)] == [broken, warned]


def test_event_with_both_violations_names_them_in_the_order_of_the_rules(spark, tmp_path):
    rows = [(1, "error", -1.0), (2, "error", 1.0), (3, "click", 0.0), (4, None, None)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = MADE["f06_market_event_contract"](spark, str(tmp_path)).collect()
    assert cells([r.asDict() for r in got], ["event_id", "violations"]) == [("1", "NO_PAYLOAD,NON_POSITIVE_PRICE"), ("2", "NO_PAYLOAD"), ("3", "NON_POSITIVE_PRICE"), ("4", "")]


@pytest.mark.parametrize(("own", "want"), [(True, [None, None]), (False, [ebitda.FACTS, ebitda.FACTS])])
def test_a_fact_id_of_two_totals(spark, own, want):
    day = datetime.date
    parts = [(t, 7, day(2020, 1, 1), day(2020, 12, 31), 5.0, 1, 9) for t in (1, 2)]
    facts = spark.createDataFrame(parts, "total_id long, fact_id long, period_start date, period_end date, value double, accession long, artifact_id long")
    documents = spark.createDataFrame([(9, [(ebitda.CONCEPTS[0], 1, day(2020, 1, 1), day(2020, 12, 31), "10-K", 2.0)])], "artifact_id long, entries array<struct<concept string, accn long, start date, end date, form string, val double>>")
    totals = spark.createDataFrame([(t, 5.0, None, 1) for t in (1, 2)], "total_id long, total double, total_reason string, sources int")
    assert [r["reason"] for r in ebitda.ebitda(totals, facts, documents, "total_id", own).orderBy("total_id").collect()] == want


def test_moments_do_not_depend_on_the_order_of_rows(spark):
    from tidemark.operators import model

    rows = [(1, 1e15 * (i % 7) + 0.1 * i) for i in range(400)] + [(2, 0.1 * (i % 9)) for i in range(400)] + [(3, 0.3)] * 50 + [(4, 1.7e308), (4, -1.7e308), (4, 1.0)]
    told = []
    for seed in (1, 2, 3):
        shuffled = spark.createDataFrame(rows, "g int, x double").repartition(1).orderBy(F.xxhash64("x", F.lit(seed))).coalesce(1)
        told.append([tuple(r) for r in model.cohort_moments(temporal.settle(shuffled), ["g"], "x", settled=True).orderBy("g").collect()])
    assert told[0] == told[1] == told[2], "to the last bit"
    for g, n, mean, sd, low, high in told[0][:3]:
        held = [min(max(x, low), high) for k, x in rows if k == g]
        plain = sum(held) / n
        assert mean == pytest.approx(plain, rel=1e-12) and sd == pytest.approx((sum((x - plain) ** 2 for x in held) / n) ** 0.5, rel=1e-10, abs=1e-15)


def plain_regimes(x, states=2, rounds=50):
    """States, means and volatilities of one series, step by step."""
    mean = np.quantile(x, (np.arange(states) + 0.5) / states)
    sd, move, first = np.full(states, x.std() + 1e-9), np.full((states, states), 0.1 / max(states - 1, 1)), np.full(states, 1 / states)
    np.fill_diagonal(move, 0.9)
    for _ in range(rounds):
        logs = -0.5 * ((x[:, None] - mean) / sd) ** 2 - np.log(sd)
        like = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-300
        ahead, back, scale = np.zeros_like(like), np.ones_like(like), np.zeros(len(x))
        for t in range(len(x)):
            ahead[t] = (first if t == 0 else ahead[t - 1] @ move) * like[t]
            scale[t] = ahead[t].sum()
            ahead[t] /= scale[t]
        for t in range(len(x) - 2, -1, -1):
            back[t] = move @ (like[t + 1] * back[t + 1]) / scale[t + 1]
        share = ahead * back
        share /= share.sum(axis=1, keepdims=True)
        step = np.einsum("ti,ij,tj->ij", ahead[:-1] / scale[1:, None], move, like[1:] * back[1:])
        first, move = share[0], step / step.sum(axis=1, keepdims=True)
        total = share.sum(axis=0) + 1e-12
        mean = share.T @ x / total
        sd = np.sqrt((share * (x[:, None] - mean) ** 2).sum(axis=0) / total) + 1e-6
    rank, best = np.argsort(np.argsort(mean)), share.argmax(axis=1)
    return rank[best], mean[best], sd[best]


@pytest.mark.parametrize("states", [2, 3])
def test_regimes_of_many_series_are_fitted_together(spark, states):
    draw = np.random.default_rng(5)
    series = {k: np.where(np.arange(n) % 40 < 20, draw.normal(0.02, 0.01, n), draw.normal(-0.03, 0.05, n)) for k, n in enumerate([3, 5, 6, 7, 30, 31, 90, 200, 200, 1])}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [(4, 900, None), (5, 901, float("nan")), (None, 1, 0.5)]
    out = research.market_regimes(spark.createDataFrame(rows, "s long, i int, x double"), "s", "i", "x", states, cells=500)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString(), "no Python call per series"
    got = out.orderBy("s", "i").collect()
    want = [(k, i, *r) for k, x in series.items() if len(x) >= 2 * states for i, r in enumerate(zip(*plain_regimes(x, states), strict=True))]
    assert [(r.s, r.i, r.state) for r in got] == [w[:3] for w in want]
    assert np.allclose([(r.mean, r.volatility) for r in got], [w[3:] for w in want], rtol=1e-6, atol=1e-9)


def test_days_of_the_guard_are_made_in_many_tasks(spark, sf_dir):
    plan = MADE["q01_publication_guard"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: next(i for i, c in enumerate(line) if c.isalpha() or c == "*")
    at = next(i for i, line in enumerate(plan) if "BroadcastNestedLoopJoin" in line)
    assert depth(plan[at]) and any("Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line for line in plan[at + 1 : at + 4]), "instruments are dealt before they meet the days"


def test_inputs_of_cards_are_read_once_and_not_sorted(spark, sf_dir):
    v = Views(spark, sf_dir)
    plan = scoring.gather(v.b_inputs, v.b_cards, ["run", "instrument_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") == 1, "the rows per key are made once"
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan, "neither they nor the wide cards are sorted"


def test_inputs_of_one_key_and_cards_without_inputs(spark):
    keys = [f"K{i}" for i in range(9)]
    rows = [(1, "K0", 2.0, None), (1, "K0", 3.0, None), (1, "K0", None, "STALE"), (1, "K5", None, "INVALID_UNIT"), (1, "K5", None, "NOT_REPORTED"), (1, "K8", 0.5, None), (1, "OTHER", 7.0, None), (2, "OTHER", 8.0, None)]
    accepted = spark.createDataFrame(rows, "c long, key string, value double, reason string")
    cards = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c long, label string")
    got = {r["c"]: r for r in scoring.widen(accepted, cards, ["c"], keys, more={"_sum": F.sum("value")}).collect()}
    assert [got[1][n] for n in ("label", "_sum", "K0", "K0__why", "K5", "K5__why", "K8", "K1__why")] == ["a", 20.5 - 8.0, 3.0, None, None, "NOT_REPORTED", 0.5, "NOT_REPORTED"]
    assert (got[2]["_sum"], got[3]["_sum"]) == (8.0, None) and all(got[c][f"{k}__why"] == "NOT_REPORTED" for c in (2, 3) for k in keys)


def test_reset_finds_the_reasons_of_the_strict_model_without_ordering_values(spark, sf_dir):
    from tidemark.plans import scoring as plans

    v = Views(spark, sf_dir)
    assessed = temporal.settle(plans._assessed(v))
    _, out = scoring.strict(assessed, ["run"], "instrument_id")
    want = {(r.run, r.instrument_id): [e for e in r.errors if e.startswith("INSUFFICIENT_NORMALIZED")] for r in out.collect()}
    short = scoring.insufficient(assessed, ["run"], "instrument_id")
    got = {(r.run, r.instrument_id): list(r._short) for r in short.collect()}
    assert any(got.values()) and {k: got.get(k, []) for k in want} == want
    lone = [(1, c, x) for c, x in enumerate([1.0, 2.0, None, float("nan"), float("inf")])] + [(2, 0, float("inf"))] * 3
    levels = [(F.lit("A"), F.lit("all"), 3)]
    placed = scoring.model.place(spark.createDataFrame(lone, "g int, c int, x double"), ["g"], levels, "x")
    z = scoring.model.standardize(spark.createDataFrame(lone, "g int, c int, x double"), ["g"], levels, "x")
    assert sorted((r.g, r.c, r.placed) for r in placed.collect()) == sorted((r.g, r.c, r.cohort is not None) for r in z.collect())


def test_entries_of_facts_are_shuffled_once_for_their_values(spark, sf_dir):
    v = Views(spark, sf_dir)
    plan = MADE["e08_ebitda_from_source"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan, "two counts of distinct values would repeat each entry three times"
    signs = ebitda.component_signs(v.b_components, "total_id")
    plan = signs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1, "a total's facts stay where they are numbered"
    assert {r["total_id"] for r in signs.select("total_id").collect()} == {r["total_id"] for r in v.b_components.select("total_id").collect()}
