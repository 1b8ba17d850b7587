"""Autoregression, moving averages and seasonal decomposition over an ordered series."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class AR:
    """value after d differences ~ intercept + p lags; the history's end serves forecasting."""

    p: int
    d: int
    intercept: float
    coefficients: list[float]
    tail: list[float] = field(default_factory=list)

    def forecast(self, steps: int) -> list[float]:
        x = np.array(self.tail, float)
        levels = [x]
        for _ in range(self.d):
            levels.append(np.diff(levels[-1]))
        z, out = levels[-1].tolist(), []
        last = [lv[-1] for lv in levels[:-1]]
        for _ in range(steps):
            v = self.intercept + sum(c * z[-1 - i] for i, c in enumerate(self.coefficients))
            z.append(v)
            for i in range(len(last) - 1, -1, -1):
                v = last[i] = last[i] + v
            out.append(float(v))
        return out


def fit_ar(df: DataFrame, time: str, value: str, p: int = 1, d: int = 0, ridge: float = 1e-9) -> AR:
    """Least squares over lags: lags by one window, normal equations by one aggregation. A series is
    ordered as a whole, so its window is one partition; many series go by groups of their own."""
    w = W.orderBy(time)
    s = df.select(F.col(time).alias("t"), F.col(value).cast("double").alias("y")).filter("y IS NOT NULL")
    w = W.orderBy("t")
    for _ in range(d):
        s = s.withColumn("y", F.col("y") - F.lag("y").over(w)).filter("y IS NOT NULL")
    x = s.select("y", *[F.lag("y", i).over(w).alias(f"x{i}") for i in range(1, p + 1)]).dropna()
    cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, p + 1)], F.col("y")]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 2)]
    row = x.agg(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).first()
    a, b = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
    for (i, j), v in zip(pairs, row):
        if j == p + 1:
            b[i] = v or 0
        else:
            a[i, j] = a[j, i] = v or 0
    beta = np.linalg.solve(a + ridge * np.eye(p + 1), b)
    keep = df.filter(F.col(value).isNotNull()).orderBy(F.desc(time)).limit(p + d + 1).select(F.col(value).cast("double")).collect()
    return AR(p, d, float(beta[0]), beta[1:].tolist(), [r[0] for r in reversed(keep)])


def moving_average(df: DataFrame, time: str, value: str, window: int = 7, *, keys: tuple = ()) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(-(window - 1), 0)
    return df.withColumn("moving_average", F.avg(value).over(w))


def seasonal_decompose(df: DataFrame, time: str, value: str, period: int) -> DataFrame:
    """(time, value, trend, seasonal, residual), additive, in order of time. The trend is a centred
    moving average (null at the ends), the season the mean of what remains at its place."""
    w = W.orderBy(time)
    half = period // 2
    s = df.select(F.col(time).alias("time"), F.col(value).cast("double").alias("value"))
    w = W.orderBy("time")
    inner = w.rowsBetween(-half, half)
    if period % 2:
        trend = F.avg("value").over(inner)
    else:  # the two ends count half
        ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
        trend = (F.sum("value").over(inner) - ends / 2) / period
    full = F.count("*").over(inner) == 2 * half + 1
    s = s.withColumn("n", F.row_number().over(w)).withColumn("trend", F.when(full, trend))
    place = F.pmod(F.col("n") - 1, F.lit(period))
    means = s.groupBy(place.alias("place")).agg(F.avg(F.col("value") - F.col("trend")).alias("m"))
    centre = means.agg(F.avg("m").alias("c"))
    season = means.crossJoin(F.broadcast(centre)).select("place", (F.col("m") - F.col("c")).alias("seasonal"))
    out = s.withColumn("place", place).join(F.broadcast(season), "place")
    return out.select("time", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mse, rmse, mae, mape over rows with both."""
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(F.col(actual) != 0, F.abs(e / F.col(actual)))).alias("mape"))
