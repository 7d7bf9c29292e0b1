"""Joins that Spark has no operator for, and thin forms of those it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, bucket_seconds: int | None = None, prefix: str = "right_") -> DataFrame:
    """Each left row with the right row of equal key and the latest time not after its own; NULLs where there is none.

    One union and one window per key. Long histories of one key make one long sort; with ``bucket_seconds`` a key's time line is cut into
    buckets that sort apart, and the last right row of earlier buckets is carried over through a small table of one
    row per key and bucket. Right columns come prefixed; a NULL key or time matches nothing.
    """
    keys = [f"k{i}_" for i in range(len(on))]
    payload = F.struct(*[F.col(c) for c in right.columns])
    a = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("l_"), F.lit(None).cast(right.select(payload.alias("r")).schema[0].dataType).alias("r_"), F.col(left_ts).alias("t_"), F.lit(1).alias("s_"), *[F.col(k).alias(n) for k, n in zip(on, keys)])
    b = right.where(F.col(right_ts).isNotNull()).select(F.lit(None).cast(a.schema["l_"].dataType).alias("l_"), payload.alias("r_"), F.col(right_ts).alias("t_"), F.lit(0).alias("s_"), *[F.col(k).alias(n) for k, n in zip(on, keys)])
    for k in keys:
        b = b.where(F.col(k).isNotNull())
    both = a.union(b)
    if bucket_seconds is None:
        w = Window.partitionBy(*keys).orderBy("t_", "s_").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("m_", F.last("r_", ignorenulls=True).over(w))
    else:
        cut = F.floor(F.unix_timestamp(F.col("t_").cast("timestamp")) / bucket_seconds)
        both = both.withColumn("b_", cut)
        w = Window.partitionBy(*keys, "b_").orderBy("t_", "s_").rowsBetween(Window.unboundedPreceding, 0)
        last = both.where("s_ = 0").groupBy(*keys, "b_").agg(F.max_by("r_", "t_").alias("last_"))
        marks = last.select(*keys, "b_", "last_").unionByName(both.where("s_ = 1").select(*keys, "b_").distinct().withColumn("last_", F.lit(None).cast(last.schema["last_"].dataType)))
        marks = marks.groupBy(*keys, "b_").agg(F.first("last_", ignorenulls=True).alias("last_"))
        before = Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
        carried = marks.withColumn("carried_", F.last("last_", ignorenulls=True).over(before)).drop("last_")
        found = both.withColumn("m_", F.last("r_", ignorenulls=True).over(w)).alias("x").join(carried.alias("c"), [F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "b_"]], "left").select("x.*", "carried_").withColumn("m_", F.coalesce("m_", "carried_"))
    ok = F.col("t_").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    found = found.where("s_ = 1").withColumn("m_", F.when(ok, F.col("m_")))
    return found.select("l_.*", *[F.col(f"m_.{c}").alias(prefix + c) for c in right.columns])


def range_join(points: DataFrame, ranges: DataFrame, key: str, low: str, high: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Rows with low <= key < high (and equal ``on``): an equi join on buckets of ``width``, then the exact condition.

    A range is listed once for each bucket it meets, so ``width`` near the usual length keeps that to one or two. Column names must differ but for ``on``.
    """
    p = points.withColumn("bucket_", F.floor(F.col(key) / width))
    r = ranges.where(F.col(low) < F.col(high)).withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [*on, "bucket_"]).where((F.col(low) <= F.col(key)) & (F.col(key) < F.col(high))).drop("bucket_")


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, before_seconds: int, after_seconds: int) -> DataFrame:
    """Rows of equal keys whose right time lies from ``before`` seconds before to ``after`` seconds after the left one.

    Buckets of the interval's width split hot keys along time."""
    width = max(1, before_seconds + after_seconds)
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    a = left.withColumn("bucket_", F.explode(F.sequence(F.floor((second(left_ts) - before_seconds) / width), F.floor((second(left_ts) + after_seconds) / width))))
    b = right.withColumn("bucket_", F.floor(second(right_ts) / width))
    low, high = F.expr(f"INTERVAL {before_seconds} SECONDS"), F.expr(f"INTERVAL {after_seconds} SECONDS")
    return a.join(b, [*on, "bucket_"]).where((F.col(right_ts) >= F.col(left_ts) - low) & (F.col(right_ts) <= F.col(left_ts) + high)).drop("bucket_")


def star_join(fact: DataFrame, *sides: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Inner joins of one table with several others; on one common key set all share a single partitioning of the fact side."""
    for side, on in sides:
        fact = fact.join(side, list(on))
    return fact


def null_safe_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """A join where NULL keys equal one another (IS NOT DISTINCT FROM)."""
    cond: Column = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return left.join(right, cond, how)


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An inner or left join whose big side is dealt over ``salts`` parts per key; the small side is repeated for each."""
    if how not in ("inner", "left"):
        raise ValueError("only the big side's rows may be kept unmatched")
    # The salt follows the row's content, so a task run again deals the same.
    a = big.withColumn("salt_", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    b = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, [*on, "salt_"], how).drop("salt_")
