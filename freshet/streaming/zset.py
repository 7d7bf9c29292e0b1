"""Z-sets: rows with an integer weight in column ``_w``. A positive weight inserts, a negative one deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "_w"


def columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != W]


def weighted(df: DataFrame, w: int = 1) -> DataFrame:
    return df.withColumn(W, F.lit(w).cast("long"))


def weigh(z: DataFrame, weight) -> DataFrame:
    """Multiply weights by a column of the row."""
    return z.withColumn(W, F.col(W) * weight)


def plus(*zs: DataFrame) -> DataFrame:
    out = zs[0]
    for z in zs[1:]:
        out = out.unionAll(z.select(*out.columns))
    return out


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def consolidate(z: DataFrame) -> DataFrame:
    """Equal rows merged, zero weights dropped."""
    return z.groupBy(*columns(z)).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def integrate(*changes: DataFrame) -> DataFrame:
    """The relation that changes add up to."""
    return consolidate(plus(*changes))


def differentiate(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change from one plain relation to another: one grouped pass over both, not two set differences."""
    return consolidate(plus(weighted(new), weighted(old, -1)))


def positive(z: DataFrame) -> DataFrame:
    return z.where(F.col(W) > 0)


def distinct(z: DataFrame) -> DataFrame:
    """The set of rows with positive weight."""
    return consolidate(z).where(F.col(W) > 0).withColumn(W, F.lit(1).cast("long"))


def expanded(z: DataFrame) -> DataFrame:
    """A plain relation: each row as often as it weighs. Negative weights are an error."""
    times = F.when(F.col(W) >= 0, F.col(W).cast("int")).otherwise(F.raise_error(F.lit("a row with negative weight")).cast("int"))
    return z.where(F.col(W) != 0).withColumn("n_", F.explode(F.array_repeat(F.lit(1), times))).drop("n_", W)


def split(z: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserted, deleted) plain relations of a change."""
    return expanded(z.where(F.col(W) > 0)), expanded(negate(z.where(F.col(W) < 0)))


def distinct_delta(old: DataFrame, change: DataFrame) -> DataFrame:
    """The change of a distinct relation: rows whose count crosses zero. ``old``: consolidated counts."""
    cols = columns(change)
    d = consolidate(change).withColumnRenamed(W, "d_")
    o = old.withColumnRenamed(W, "o_")
    cond = F.lit(True)
    for c in cols:
        cond = cond & d[c].eqNullSafe(o[c])
    both = d.join(o, cond, "left").select(*[d[c] for c in cols], "d_", F.coalesce("o_", F.lit(0)).alias("o_"))
    before, after = (F.col("o_") > 0).cast("long"), (F.col("o_") + F.col("d_") > 0).cast("long")
    return both.withColumn(W, after - before).where(F.col(W) != 0).select(*cols, W)


def linear_delta(state: DataFrame | None, change: DataFrame, keys: list[str], sums: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(change of the output, new state) of COUNT(*) and SUMs per key, from the state of touched keys and the change alone.

    ``sums``: output name to an integer or decimal column. The state has ``n_`` (rows) and the sums; groups without rows vanish.
    """
    part = change.groupBy(*keys).agg(F.sum(W).alias("n_"), *[F.sum(F.col(W) * F.col(c)).alias(o) for o, c in sums.items()])
    names = ["n_", *sums]
    if state is None:
        old = part.limit(0)
    else:
        old = state.join(part.select(*keys), keys, "left_semi")
    merged = plus_states(old, part, keys, names)
    out = lambda s: weighted(s.where("n_ > 0").select(*keys, *names))
    delta = consolidate(plus(out(merged), negate(out(old))))
    kept = merged if state is None else state.join(part.select(*keys), keys, "left_anti").unionByName(merged)
    return delta, kept.where("n_ != 0")


def plus_states(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return a.select(*keys, *names).unionAll(b.select(*keys, *names)).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
