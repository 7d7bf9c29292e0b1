"""Top-k and its relatives: all are a ranking window and a filter, which Catalyst turns into a per-task group limit before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, kind: str = "row_number", rank_column: str | None = None) -> DataFrame:
    """Rows that rank up to k within their key."""
    name = rank_column or "rank_"
    out = df.withColumn(name, RANKS[kind]().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank_column else out.drop(name)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return topk(df, keys, order, 1)


def qualify(df: DataFrame, windows: dict[str, Column], condition: Column) -> DataFrame:
    """Filter on window results without keeping them."""
    return df.withColumns(windows).where(condition).drop(*windows)


def neighborhood(df: DataFrame, order: Sequence[Column], anchor: Column, before: int, after: int) -> DataFrame:
    """Rows up to ``before`` places before and ``after`` after the first row for which ``anchor`` (a condition that stays true from there on) holds."""
    left = df.where(~anchor).orderBy(*[_flip(o) for o in order]).limit(before)
    right = df.where(anchor).orderBy(*order).limit(after + 1)
    return left.unionByName(right)


def _flip(order: Column) -> Column:
    """The reverse of a plain ascending column order."""
    return order.desc_nulls_last()


def latest_by_key(df: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The last version of each key of an upsert table: one map-side combined aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("v_"))
    return picked.select(*keys, "v_.*").select(*df.columns)
