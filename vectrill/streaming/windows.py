"""Windows, sessions and drift over streams. The same functions serve batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, ts: str, value: str, window: str = "1 hour", *, keys: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """(window_start, keys, n, total, mean); rows later than the watermark are left out of a stream's windows."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", *, late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events without a gap."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_drift(events: DataFrame, key: str, value: str, *, half_life: float = 100.0) -> DataFrame:
    """Custom state of a stream: each batch, a key's smoothed mean and deviation, and how far the
    batch's mean lies from what came before, in deviations. State is three numbers a key."""
    keep = 0.5 ** (1.0 / half_life)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, m, s = state.get if state.exists else (0, 0.0, 0.0)
        x = pd.concat(list(frames))[value].dropna()
        if len(x):
            drift = abs(x.mean() - m) / s**0.5 if n and s > 0 else 0.0
            w = keep ** len(x) if n else 0.0
            old = m
            m = w * m + (1 - w) * x.mean()
            s = w * (s + (m - old) ** 2) + (1 - w) * float(((x - m) ** 2).mean())
            n += len(x)
            state.update((n, float(m), float(s)))
            yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [float(m)], "variance": [float(s)], "drift": [float(drift)]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, mean double, variance double, drift double", "n long, mean double, variance double", "update", GroupStateTimeout.NoTimeout)
