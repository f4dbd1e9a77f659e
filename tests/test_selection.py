"""Exact quantiles in passes, cohorts in levels and the versions of the available-components model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import model, scoring, selection

SHARES = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.975, "e": 1.0, "f": 1 / 3}


def wanted(values):
    return {k: float(np.quantile(np.array(values), p)) for k, p in SHARES.items()}


@pytest.mark.parametrize(("ranges", "cell_rows"), [(64, 50_000), (8, 3)])
def test_quantiles_of_awkward_groups(spark, ranges, cell_rows):
    rng = np.random.default_rng(7)
    groups = {
        "even": rng.normal(size=200), "ties": rng.integers(0, 3, 500).astype(float), "one": [4.5], "two": [1.0, -1.0], "same": [7.25] * 100, None: [3.0, 1.0, 2.0],
        "wide": [2.0**i for i in range(-60, 60)] + [0.0, -(2.0**70)], "huge": [1e308, -1e308, 1.7e308, -1.7e308, 0.0], "near": list(1 + np.arange(50) * 2.0**-50), "zeros": [0.0, -0.0, 0.0, 1e-320, 5e-324],
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("one", None), ("one", float("nan")), ("one", float("inf")), ("none", None)]
    got = {r["k"]: r for r in selection.quantiles(spark.createDataFrame(rows, "k string, x double").repartition(3), ["k"], "x", SHARES, ranges, cell_rows).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k]["n"] == len(v)
        assert {c: got[k][c] for c in SHARES} == pytest.approx(wanted(v), rel=1e-12, abs=0), k
    assert selection.quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", SHARES).collect() == []


def test_quantiles_of_one_large_cohort_are_found_in_small_cells(spark, monkeypatch):
    """A million different values: no range that is ordered holds more than ``cell_rows`` of them."""
    n, seen = 1_000_000, []
    held = selection._held

    def watched(values, cells, by):
        out = held(values, cells, by)
        seen.append(out)
        return out

    monkeypatch.setattr(selection, "_held", watched)
    x = (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 1024.0 + F.col("id") / (1 << 25)).alias("x")
    df = spark.range(n).select(F.lit("k").alias("k"), x)
    got = selection.quantiles(df, ["k"], "x", {"low": 0.025, "high": 0.975}, ranges=64, cell_rows=2000).first()
    values = np.array([r[0] for r in df.select("x").collect()])
    assert len(set(values)) > 0.999 * n
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])), rel=1e-12)
    last = seen[-1].groupBy("k", "_lo", "_hi").count().agg(F.max("count")).first()[0]
    assert last <= 2000, "what is ordered in the end"


def levels_of(spark, rows):
    df = spark.createDataFrame(rows, "run int, id int, peer string, x double, ok boolean")
    out = model.standardize(df, ["run"], [(F.lit("near"), F.col("peer"), 3), (F.lit("all"), F.lit("p"), 5)], "x", F.col("ok"))
    return {(r["run"], r["id"]): r for r in out.collect()}


def test_standardize_takes_the_first_level_with_enough_fitted_rows(spark):
    rows = [(1, i, "a", float(i), True) for i in range(3)] + [(1, 3, "b", 10.0, True), (1, 4, "b", 20.0, False), (1, 5, None, 30.0, True), (1, 6, "a", None, True), (1, 7, "a", 99.0, False)]
    rows += [(2, i, "a", float(i), i < 2) for i in range(4)] + [(3, i, "c", 5.0, True) for i in range(3)]
    got = levels_of(spark, rows)
    assert {k: (v["cohort"], v["cohort_n"], v["reason"]) for k, v in got.items()} == {
        (1, 0): ("near", 3, None), (1, 1): ("near", 3, None), (1, 2): ("near", 3, None), (1, 3): ("all", 5, None), (1, 4): ("all", 5, None), (1, 5): ("all", 5, None), (1, 6): (None, None, "NO_VALUE"), (1, 7): ("near", 3, None),
        **{(2, i): (None, None, "NO_COMPATIBLE_COHORT") for i in range(4)}, **{(3, i): ("near", 3, "NO_DISPERSION") for i in range(3)},
    }
    low, high = np.quantile([0, 1, 2], [0.025, 0.975])
    held = np.clip([0, 1, 2], low, high)
    assert [got[(1, i)]["z"] for i in range(3)] == pytest.approx(list((held - held.mean()) / held.std()))
    assert got[(1, 7)]["z"] == pytest.approx((high - held.mean()) / held.std()), "not fitted, but standardised and held within the bounds"
    assert got[(3, 0)]["z"] == 0.0


ROW = "version string, run int, issuer_id int, primary_class boolean, profile string, peer_group string, family string, metric string, raw double"


def test_versions_pool_momentum_and_count_issuers_once(spark):
    """Twelve industrials and twelve banks: apart they are too few, together 24 prices; two of them are second classes of an issuer."""
    rows = []
    for v in scoring.VERSIONS:
        for i in range(24):
            issuer, primary = (0, False) if i == 1 else (i, i != 23)
            profile = "GENERAL" if i < 12 else "BANK"
            rows.append((v, 1, issuer, primary, profile, None, "momentum", "momentum", float(i)))
            rows.append((v, 1, issuer, primary, profile, "tech" if i < 11 else "", "value", "fcf_yield", float(i)))
    norm = scoring.versioned_cohorts(spark.createDataFrame(rows, ROW), ["run"]).collect()
    sizes = {(r["version"], r["metric"], r["profile"], r["peer_group"]): (r["cohort"], r["cohort_n"]) for r in norm}
    assert sizes[("1.3", "momentum", "BANK", None)] == (None, None)
    assert sizes[("1.4", "momentum", "BANK", None)] == ("PRICE_UNIVERSE", 24) == sizes[("1.4", "momentum", "GENERAL", None)]
    assert sizes[("1.5", "momentum", "GENERAL", None)] == ("PRICE_UNIVERSE", 23), "the second class of issuer 0 isn't fitted, the only class of issuer 23 is"
    assert sizes[("1.4", "fcf_yield", "GENERAL", "tech")] == ("PRIMARY:tech", 11) and sizes[("1.5", "fcf_yield", "GENERAL", "tech")] == ("PRIMARY:tech", 10)
    assert sizes[("1.5", "fcf_yield", "GENERAL", "")] == (None, None)
    second = [r for r in norm if r["version"] == "1.5" and r["issuer_id"] == 0 and not r["primary_class"]]
    assert len(second) == 2 and all(r["z"] is not None for r in second), "standardised all the same"


def test_soft_reasons_by_version(spark):
    codes = ["STALE", "MISSING_SESSION:2020-01-02", "STALE_OR_MISSING_FILING", "NON_PRIMARY_SHARE_CLASS", "ILLIQUID", scoring.MULTI_CLASS]
    df = spark.createDataFrame([(v, c) for v in scoring.VERSIONS for c in codes], "version string, code string")
    got = {v: [r["code"] for r in df.filter((F.col("version") == v) & scoring.soft(F.col("code"), F.col("version"))).collect()] for v in scoring.VERSIONS}
    assert got == {"1.3": codes[:2], "1.4": codes[:3], "1.5": [*codes[:4], codes[5]]}


def test_compose_available_shares_weights_out(spark):
    norm = spark.createDataFrame([(1, 1, "value", "a", "PRIMARY:x", 1.0), (1, 1, "value", "b", "PROFILE:G", 3.0), (1, 1, "momentum", "m", "PRICE_UNIVERSE", -1.0), (1, 2, "value", "a", None, None), (1, 4, "quality", "q", "PRIMARY:x", 0.5)], "run int, id int, family string, metric string, cohort string, z double")
    cards = spark.createDataFrame([(1, 1, [], ["w"]), (1, 2, [], []), (1, 3, ["ILLIQUID"], []), (1, 4, [], [])], "run int, id int, errors array<string>, warnings array<string>")
    got = {r["id"]: r for r in model.compose_available(norm, cards, ["run", "id"], ["run"]).collect()}
    assert got[1]["composite"] == pytest.approx((0.5 * 2.0 - 0.2 * 1.0) / 0.7) and got[1]["weight_value"] == pytest.approx(0.5 / 0.7) and got[1]["weight_quality"] == 0
    assert got[1]["warnings"] == ["PARTIAL_SCORE:AVAILABLE_COMPONENTS_ONLY", "PEER_FALLBACK:b", "PEER_FALLBACK:m", "w"] and got[1]["status"] == "PARTIAL"
    assert (got[2]["errors"], got[2]["status"], got[2]["composite"]) == (["NO_VALID_NORMALIZED_METRICS"], "UNAVAILABLE", None)
    assert (got[3]["errors"], got[3]["rank"]) == (["ILLIQUID"], None)
    assert (got[1]["rank"], got[4]["rank"], got[4]["percentile"]) == (1, 2, 0.0)
    alone = model.compose_available(norm, cards.filter("id = 4"), ["run", "id"], ["run"]).first()
    assert alone["eligible"] and alone["rank"] is None and alone["percentile"] is None
