"""Windows over time: tumbling, hopping, session, and rolling aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hop(df: DataFrame, ts: str, slide: str, size: str, offset: str = "0 seconds") -> DataFrame:
    """Each row once for every window it lies in, with window_start and window_end; rows without a time drop out."""
    w = F.window(F.col(ts), size, slide, offset)
    return df.where(F.col(ts).isNotNull()).withColumn("w_", w).withColumns({"window_start": F.col("w_.start"), "window_end": F.col("w_.end")}).drop("w_")


def tumble(df: DataFrame, ts: str, size: str, offset: str = "0 seconds") -> DataFrame:
    return hop(df, ts, size, size, offset)


def session(df: DataFrame, ts: str, gap: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with the bounds of their session: a gap of ``gap`` or more starts a new one, its end is its last time plus the gap."""
    step = F.expr(f"INTERVAL {gap}")
    line = Window.partitionBy(*keys).orderBy(ts)
    rows = df.where(F.col(ts).isNotNull()).withColumn("fresh_", F.when(F.col(ts) < F.lag(ts).over(line) + step, 0).otherwise(1))
    rows = rows.withColumn("session_", F.sum("fresh_").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy(*keys, "session_")
    return rows.withColumns({"window_start": F.min(ts).over(one), "window_end": F.max(ts).over(one) + step}).drop("fresh_", "session_")


def session_aggregate(df: DataFrame, ts: str, gap: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates per session without keeping rows: Spark merges partial sessions before the shuffle."""
    out = df.where(F.col(ts).isNotNull()).groupBy(*keys, F.session_window(ts, gap).alias("w_")).agg(*aggregates)
    return out.withColumns({"window_start": F.col("w_.start"), "window_end": F.col("w_.end")}).drop("w_")


def rolling(df: DataFrame, keys: Sequence[str], ts: str, before_seconds: int, after_seconds: int, **aggregates: Column) -> DataFrame:
    """Aggregates over the rows of a key within a relative range of seconds around each row's time."""
    second = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(second).rangeBetween(-before_seconds * 1_000_000, after_seconds * 1_000_000)
    return df.withColumns({name: a.over(w) for name, a in aggregates.items()})
