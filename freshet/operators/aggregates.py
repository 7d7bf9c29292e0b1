"""Aggregates with the dialect's result types, NULL rules and forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def avg_as(df: DataFrame, column: str) -> Column:
    """AVG in the type of its argument: integers give integers, cut toward zero."""
    kind = df.schema[column].dataType
    if isinstance(kind, INTEGERS):
        return F.expr(f"cast(sum(`{column}`) div count(`{column}`) as {kind.simpleString()})")
    return F.avg(column).cast(kind)


def sum_as(df: DataFrame, column: str) -> Column:
    """SUM in the type of its argument; overflow is an error."""
    return F.sum(column).cast(df.schema[column].dataType)


def array_agg(x: Column, respect_nulls: bool = True, distinct: bool = False, ordered: bool = False) -> Column:
    """ARRAY_AGG; NULLs stay unless told otherwise."""
    collected = F.transform((F.collect_set if distinct else F.collect_list)(F.struct(x.alias("v"))), lambda s: s["v"])
    if not respect_nulls:
        collected = F.filter(collected, lambda v: v.isNotNull())
    return F.sort_array(collected) if ordered else collected


def within_distinct(df: DataFrame, groups: Sequence[str], keys: Sequence[str], value: str, final: str = "sum", name: str = "value") -> DataFrame:
    """An aggregate whose argument counts once for each ``keys`` within a group; differing values of one key are an error."""
    inner = df.groupBy(*groups, *keys).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    checked = inner.withColumn("v_", F.when(F.col("lo_").eqNullSafe(F.col("hi_")), F.col("lo_")).otherwise(F.raise_error(F.lit("more than one value for a key")).cast(df.schema[value].dataType)))
    call = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}[final]
    return checked.groupBy(*groups).agg(call("v_").alias(name))


def map_agg(df: DataFrame, groups: Sequence[str], key: str, value: str, name: str = "m") -> DataFrame:
    """A map of key to its largest value for each group."""
    best = df.groupBy(*groups, key).agg(F.max(value).alias("v_"))
    return best.groupBy(*groups).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col("v_"))))).alias(name))


def bit_binary(df: DataFrame, groups: Sequence[str], column: str, op: str = "xor", name: str = "bits") -> DataFrame:
    """BIT_AND, BIT_OR or BIT_XOR of equally long binaries: byte by byte, aggregated as integers, put together again."""
    call = {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[op]
    byte = F.posexplode(F.sequence(F.lit(1), F.length(column)))
    rows = df.where(F.col(column).isNotNull()).select(*groups, column, byte.alias("pos_", "at_"))
    rows = rows.withColumn("b_", F.conv(F.hex(F.substring(F.col(column), F.col("at_"), F.lit(1))), 16, 10).cast("int"))
    parts = rows.groupBy(*groups, "at_").agg(call("b_").alias("b_"))
    return parts.groupBy(*groups).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at_", "b_"))), lambda s: F.lpad(F.hex(s["b_"]), 2, "0")), "")).alias(name))


def fold(df: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Sequence[str], zero: Column, step, finish=None, name: str = "value") -> DataFrame:
    """A user fold over a group's rows in order, as a higher-order function: ``step(state, row)`` on columns."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *columns)))
    return df.groupBy(*groups).agg(rows.alias("rows_")).select(*groups, F.aggregate("rows_", zero, step, *([finish] if finish else [])).alias(name))


def key_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n keys drawn uniformly without replacement (by hash order, so repeatable)."""
    return df.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def key_quantiles(df: DataFrame, key: str, n: int) -> DataFrame:
    """n - 1 keys that cut the distinct keys into n parts of nearly equal size."""
    cuts = F.array(*[F.lit(i / n) for i in range(1, n)])
    return df.select(key).distinct().agg(F.percentile_approx(key, cuts, 1_000_000).alias("q")).select(F.explode("q").alias(key))
