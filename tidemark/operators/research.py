"""Research validation: portfolios, information coefficients and robust statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranking import average_rank


def quintiles(df: DataFrame, by: list[str]) -> DataFrame:
    """Five buckets by falling composite; the first ones are larger by one where rows don't divide."""
    return df.withColumn("quintile", F.ntile(5).over(Window.partitionBy(*by).orderBy(F.desc("composite"), "instrument_id")))


def top_weights(df: DataFrame, n: int, by: str = "as_of") -> DataFrame:
    """Equal weights of the ``n`` best rows per date."""
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("composite"), "instrument_id"))).filter(F.col("_r") <= n).drop("_r")
    return best.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(by)))


def sector_neutral(df: DataFrame, by: str = "as_of") -> DataFrame:
    """The best fifth of each sector (one at least); a sector weighs its share of rows, shared equally."""
    w = Window.partitionBy(by, "sector")
    r = df.withColumn("_k", F.row_number().over(w.orderBy(F.desc("composite"), "instrument_id"))).withColumn("_n", F.count("*").over(w)).withColumn("_t", F.count("*").over(Window.partitionBy(by)))
    best = r.filter(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_n") / 5.0)))
    return best.withColumn("weight", F.col("_n") / F.col("_t") / F.count("*").over(w)).drop("_k", "_n", "_t")


def partitions(dates: DataFrame, col: str) -> DataFrame:
    """Distinct dates in order, as training, validation and test at 60 and 80 percent."""
    d = dates.select(col).distinct().withColumn("_i", F.row_number().over(Window.orderBy(col))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return d.withColumn("part", F.when(F.col("_i") <= F.floor(F.col("_n") * 0.6), "train").when(F.col("_i") <= F.floor(F.col("_n") * 0.8), "validation").otherwise("test")).drop("_i", "_n")


def walk_forward(dates: DataFrame, col: str, least: int = 12) -> DataFrame:
    """Test years from the third on, with the number of training dates up to half a year before; years with fewer than ``least`` go."""
    d = dates.select(col).distinct()
    years = d.select(F.year(col).alias("year")).distinct().withColumn("_i", F.row_number().over(Window.orderBy("year"))).filter("_i >= 3")
    start = F.make_date("year", F.lit(1), F.lit(1))
    met = years.join(d, F.col(col) < F.add_months(start, -6))
    return met.groupBy("year").agg(F.count("*").alias("training"), F.max(col).alias("until")).filter(F.col("training") >= least)


def rank_ic(panel: DataFrame, score: str, outcome: str, by: str) -> DataFrame:
    """Rank correlation of score and outcome per date."""
    both = panel.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = average_rank(average_rank(both, score, [by], "_a"), outcome, [by], "_b")
    return ranked.groupBy(by).agg(F.corr("_a", "_b").alias("ic"), F.count("*").alias("n"))


def hac_mean(series: DataFrame, value: str, order: str, lags: int = 6, by: list[str] | None = None) -> DataFrame:
    """Mean with a Newey-West t value (Bartlett weights, no small-sample correction) of each series."""
    by = by or []
    mean = series.groupBy(*by).agg(F.avg(value).alias("_m"))
    e = (series.join(F.broadcast(mean), by) if by else series.join(F.broadcast(mean))).withColumn("_e", F.col(value) - F.col("_m"))
    w = Window.partitionBy(*by).orderBy(order)
    for lag in range(1, lags + 1):
        e = e.withColumn(f"_p{lag}", F.col("_e") * F.lag("_e", lag).over(w))
    sums = e.groupBy(*by).agg(F.count("*").alias("n"), F.first("_m").alias("mean"), F.sum(F.col("_e") * F.col("_e")).alias("_g0"), *(F.coalesce(F.sum(f"_p{i}"), F.lit(0.0)).alias(f"_g{i}") for i in range(1, lags + 1)))
    spread = F.col("_g0") + reduce(lambda a, b: a + b, (F.lit(2.0 * (1 - i / (lags + 1))) * F.col(f"_g{i}") for i in range(1, lags + 1)))
    return sums.withColumn("t", F.col("mean") / F.nullif(F.sqrt(spread) / F.col("n"), F.lit(0.0))).select(*by, "n", "mean", "t")


def turnover(weights: DataFrame, dates: list[str], by: str = "as_of") -> DataFrame:
    """Sum of absolute weight changes between neighbouring dates, entries and exits included."""
    order = weights.select(by).distinct().withColumn("_i", F.row_number().over(Window.orderBy(by)))
    w = weights.join(F.broadcast(order), by).select("_i", "instrument_id", "weight")
    now = w.unionByName(w.select((F.col("_i") + 1).alias("_i"), "instrument_id", (-F.col("weight")).alias("weight")))
    moved = now.groupBy("_i", "instrument_id").agg(F.sum("weight").alias("d")).groupBy("_i").agg(F.sum(F.abs("d")).alias("turnover"))
    return order.join(moved, "_i").select(by, "turnover")


def net_returns(weights: DataFrame, panel: DataFrame, bps: float, by: str = "as_of") -> DataFrame:
    """Portfolio return per date after costs on the turnover from the drifted weights of the date before.

    Weights before a date depend on the date before alone, so this is a join on the date's number. The traded share f solves
    f = 1 - c * sum |f w - p|, by fifty steps inside one row per date.
    """
    cost = bps / 10_000
    order = panel.select(by).distinct().withColumn("_i", F.row_number().over(Window.orderBy(by)))
    held = weights.join(F.broadcast(order), by).join(panel.select(by, "instrument_id", "total_return"), [by, "instrument_id"], "left").withColumn("_r", F.coalesce("total_return", F.lit(0.0)))
    gross = held.groupBy("_i").agg(F.sum(F.col("weight") * F.col("_r")).alias("gross"))
    drift = held.join(F.broadcast(gross), "_i").select((F.col("_i") + 1).alias("_i"), "instrument_id", (F.col("weight") * (1 + F.col("_r")) / (1 + F.col("gross"))).alias("p"))
    pairs = held.select("_i", "instrument_id", "weight").join(drift, ["_i", "instrument_id"], "full")
    row = F.struct(F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("p", F.lit(0.0)).alias("p"))
    lists = pairs.groupBy("_i").agg(F.array_sort(F.collect_list(row)).alias("_l"))
    traded = lambda f: F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.abs(f * x["w"] - x["p"]))
    f = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.lit(1.0), lambda a, _: F.lit(1.0) - F.lit(cost) * traded(a))
    out = lists.withColumn("_f", f).join(F.broadcast(gross), "_i").join(F.broadcast(order), "_i")
    return out.select(by, (F.col("_f") * (1 + F.col("gross")) - 1).alias("net"), "gross")


def drawdown(series: DataFrame, value: str, order: str) -> DataFrame:
    """Running wealth of a return series (one row a date), its peak and the fall from it."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wealth = F.exp(F.sum(F.log1p(value)).over(w))
    return series.withColumn("wealth", wealth).withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w))).withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)


def newey_west(df: DataFrame, y: str, xs: list[str], order: str, by: list[str], lags: int | None = None) -> DataFrame:
    """Ordinary least squares with Newey-West errors per group: coefficient, error and t of the constant and each regressor.

    A group is one return series; each is fitted in a task of its own.
    """
    names = ["const", *xs]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y, *xs]).sort_values(order)
        n, k = len(pdf), len(names)
        if n <= k:
            return pd.DataFrame(columns=[*by, "term", "coefficient", "error", "t"])
        x, v = np.column_stack([np.ones(n), *(pdf[c].to_numpy(float) for c in xs)]), pdf[y].to_numpy(float)
        inverse = np.linalg.pinv(x.T @ x)
        beta = inverse @ x.T @ v
        u = x * (v - x @ beta)[:, None]
        most = lags if lags is not None else int(4 * (n / 100) ** (2 / 9))
        s = u.T @ u
        for lag in range(1, most + 1):
            g = u[lag:].T @ u[:-lag]
            s += (1 - lag / (most + 1)) * (g + g.T)
        error = np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))
        out = pd.DataFrame({"term": names, "coefficient": beta, "error": error, "t": np.divide(beta, error, out=np.full(k, np.nan), where=error > 0)})
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[[*by, "term", "coefficient", "error", "t"]]

    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    return df.select(*by, order, y, *xs).groupBy(*by).applyInPandas(fit, f"{kinds}, term string, coefficient double, error double, t double")


def factor_diagnostics(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Largest correlation, condition number and effective rank of factors per group. The correlations are one Spark aggregate; only the small matrix of a group is solved in a task."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    wide = df.groupBy(*by).agg(F.array(*(F.corr(columns[i], columns[j]) for i, j in pairs)).alias("r"))

    @F.pandas_udf("largest double, condition double, effective_rank double")
    def solve(r: pd.Series) -> pd.DataFrame:
        out = []
        for row in r:
            m = np.eye(len(columns))
            for (i, j), x in zip(pairs, row, strict=True):
                m[i, j] = m[j, i] = 0.0 if x is None or np.isnan(x) else x
            e = np.maximum(np.linalg.eigvalsh(m), 1e-12)
            p = e / e.sum()
            out.append((float(np.abs(m - np.eye(len(m))).max()), float(np.sqrt(e.max() / e.min())), float(np.exp(-(p * np.log(p)).sum()))))
        return pd.DataFrame(out, columns=["largest", "condition", "effective_rank"])

    return wide.withColumn("_s", solve("r")).select(*by, "_s.*")


def _regimes(lengths: np.ndarray, x: np.ndarray, states: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States (series, place), means and volatilities (series, state) of several series at once: ``x`` (series, place) is filled with zeros behind a series' end."""
    most = x.shape[1]
    there = np.arange(most) < lengths[:, None]
    mean = np.array([np.quantile(row[:n], (np.arange(states) + 0.5) / states) for n, row in zip(lengths, x, strict=True)])
    sd = np.repeat(np.array([row[:n].std() + 1e-9 for n, row in zip(lengths, x, strict=True)])[:, None], states, axis=1)
    move, first = np.full((len(x), states, states), 0.1 / max(states - 1, 1)), np.full((len(x), states), 1 / states)
    move[:, range(states), range(states)] = 0.9
    each = there[:, :, None]
    for _ in range(rounds):
        logs = -0.5 * ((x[:, :, None] - mean[:, None]) / sd[:, None]) ** 2 - np.log(sd)[:, None]
        like = np.where(each, np.exp(logs - logs.max(axis=2, keepdims=True)) + 1e-300, 1.0)
        ahead, back, scale = np.zeros_like(like), np.ones_like(like), np.ones((len(x), most))
        for t in range(most):
            now = (first if t == 0 else (ahead[:, t - 1, :, None] * move).sum(axis=1)) * like[:, t]
            scale[:, t] = now.sum(axis=1)
            ahead[:, t] = now / scale[:, t, None]
        for t in range(most - 2, -1, -1):  # behind a series' end it stays 1
            now = (move * (like[:, t + 1] * back[:, t + 1])[:, None]).sum(axis=2) / scale[:, t + 1, None]
            back[:, t] = np.where(each[:, t + 1], now, 1.0)
        share = ahead * back
        share /= share.sum(axis=2, keepdims=True)
        onward = np.where(each[:, 1:], like[:, 1:] * back[:, 1:] / scale[:, 1:, None], 0.0)
        step = np.einsum("sti,sij,stj->sij", ahead[:, :-1], move, onward)
        first, move = share[:, 0], step / step.sum(axis=2, keepdims=True)
        held = np.where(each, share, 0.0)
        total = held.sum(axis=1) + 1e-12
        mean = (held * x[:, :, None]).sum(axis=1) / total
        sd = np.sqrt((held * (x[:, :, None] - mean[:, None]) ** 2).sum(axis=1) / total) + 1e-6
    rank = np.argsort(np.argsort(mean, axis=1), axis=1)
    best = share.argmax(axis=2)
    at = np.arange(len(x))[:, None]
    return rank[at, best].astype("int32"), mean[at, best], sd[at, best]


def market_regimes(returns: DataFrame, key: str, order: str, value: str, states: int = 2, rounds: int = 50, cells: int = 1 << 17) -> DataFrame:
    """Hidden regimes of each key's returns: a Gaussian model fitted by expectation maximisation from quantiles, states in order of mean.

    Rows: key, order, state, and the state's mean and volatility. A key's series is a row; the series of a batch that are about as long are fitted together, up to ``cells`` places at a time.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.iloc[np.argsort(pdf["_x"].map(len).to_numpy(), kind="stable")]
            lengths = pdf["_x"].map(len).to_numpy()
            at = 0
            while at < len(pdf):
                upto = at + 1
                while upto < len(pdf) and (upto + 1 - at) * lengths[upto] <= cells and lengths[upto] <= 2 * lengths[at]:
                    upto += 1
                x = np.zeros((upto - at, lengths[upto - 1]))
                for i, series in enumerate(pdf["_x"].iloc[at:upto]):
                    x[i, : len(series)] = series
                found = _regimes(lengths[at:upto], x, states, rounds)
                told = pdf[["_key", "_o"]].iloc[at:upto].copy()
                for name, got in zip(("state", "mean", "volatility"), found, strict=True):
                    told[name] = [row[:n] for row, n in zip(got, lengths[at:upto], strict=True)]
                yield told
                at = upto

    kinds = {c: returns.schema[c].dataType.simpleString() for c in (key, order)}
    sound = returns.select(F.col(key).alias("_key"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_x")).filter("_key IS NOT NULL AND _o IS NOT NULL AND _x IS NOT NULL AND NOT isnan(_x)")
    series = sound.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_o", "_x"))).alias("_s")).filter(F.size("_s") >= 2 * states)
    fitted = series.select("_key", F.col("_s._o").alias("_o"), F.col("_s._x").alias("_x")).mapInPandas(fit, f"_key {kinds[key]}, _o array<{kinds[order]}>, state array<int>, mean array<double>, volatility array<double>")
    rows = fitted.select("_key", F.explode(F.arrays_zip("_o", "state", "mean", "volatility")).alias("_r"))
    return rows.select(F.col("_key").alias(key), F.col("_r._o").alias(order), "_r.state", "_r.mean", "_r.volatility")
