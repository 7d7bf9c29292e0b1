"""Operator state: a relation kept as a log of weighted segments in the shared folder.

A step appends one segment; nothing is rewritten until a compaction merges the log. With keys, segments are partitioned by a
hash bucket of the key, so a step that touches few keys reads few directories. Segment names hold the step, so a step run again replaces its own.
The least and greatest weight of a segment are known from its write: a log of insertions alone is read without grouping.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.shared import delete, saved, shared_dir
from freshet.streaming import zset
from freshet.streaming.zset import W


class StateLog:
    def __init__(self, spark: SparkSession, name: str, schema: T.StructType, keys: Sequence[str] = (), buckets: int = 16, compact_after: int = 8, path: str | None = None, fold: Callable[[DataFrame], DataFrame] = zset.consolidate):
        """``fold`` is what a compaction makes of the log."""
        self.fold = fold
        self.spark, self.schema, self.keys, self.buckets, self.compact_after = spark, schema, list(keys), buckets, compact_after
        self.path = path or f"{shared_dir(spark)}/state-{name}-{uuid.uuid4().hex}"
        self.segments: list[str] = []
        self.weights: dict[str, tuple[int, int]] = {}  # least and greatest of a segment, where known
        self.pinned: dict[str, list[str]] = {}  # segments that a checkpoint names, by its path
        self.doomed: list[str] = []  # replaced, but a reader of the last step may still be at them

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _full(self) -> T.StructType:
        fields = [*[T.StructField(f.name, f.dataType, True) for f in self.schema], T.StructField(W, T.LongType())]
        return T.StructType([*fields, T.StructField("bucket_", T.IntegerType())] if self.keys else fields)

    def _write(self, z: DataFrame, segment: str) -> int:
        """One file for each bucket, or a few for a large one (Spark splits what a rebalance finds too large); the number of rows."""
        seen = Observation()
        z = z.observe(seen, F.count(F.lit(1)).alias("n"), F.min(W).alias("lo"), F.max(W).alias("hi"))
        if self.keys:
            z.withColumn("bucket_", self._bucket()).hint("rebalance", "bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(segment)
        else:
            z.write.mode("overwrite").parquet(segment)
        try:
            found = seen.get
        except Py4JJavaError:  # PySpark can't read the empty row that stands for figures that got lost
            found = {}
        if "n" not in found:
            self.weights.pop(segment, None)  # those of the same step's earlier write
            return 1  # not told: as if there were some, of any weight
        self.weights[segment] = (found["lo"] or 0, found["hi"] or 0)
        return found["n"]

    def append(self, change: DataFrame, step: int | str) -> DataFrame:
        """Add a change to the log; the change as written."""
        segment = f"{self.path}/step={step}"
        n = self._write(change.select(*[f.name for f in self.schema], W), segment)
        out = self._read([segment])
        if not n:
            if segment in self.segments:
                self.segments.remove(segment)
            return out
        if segment not in self.segments:
            self.segments.append(segment)
        if len(self.segments) > self.compact_after:
            out = saved(out, "delta")
            self.compact(step)
        return out

    def _read(self, segments: list[str], buckets: list[int] | None = None) -> DataFrame:
        parts = [self.spark.read.schema(self._full()).option("basePath", s).parquet(s) for s in segments]
        if not parts:
            return self.spark.createDataFrame([], self._full()).drop("bucket_")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        if buckets is not None:
            out = out.where(F.col("bucket_").isin(buckets))
        return out.drop("bucket_")

    def log(self, touched: DataFrame | None = None) -> DataFrame:
        """All segments as one Z-set log; with ``touched`` (the key columns) only buckets that hold such keys."""
        hot = None
        if touched is not None and self.keys:
            hot = [r[0] for r in touched.select(self._bucket().alias("b")).distinct().collect()]  # no more than ``buckets`` numbers
        return self._read(self.segments, hot)

    def zset(self, touched: DataFrame | None = None) -> DataFrame:
        return zset.consolidate(self.log(touched))

    def relation(self) -> DataFrame:
        """The plain relation; only a log with deletions has to be added up."""
        known = [self.weights.get(s, (-1, 0)) for s in self.segments]
        if all(w == (1, 1) for w in known):
            return self.log().drop(W)
        return zset.expanded(self.log() if all(lo > 0 for lo, _ in known) else self.zset())

    def compact(self, step: int | str) -> None:
        """Merge the log to one segment. Segments that a checkpoint names stay."""
        segment = f"{self.path}/base={step}"
        old = list(self.segments)
        n = self._write(self.fold(self.log()), segment)
        self.segments = [segment] if n else []
        self.doomed += [s for s in old if s != segment]

    def sweep(self, older: list[str]) -> list[str]:
        """Delete those of ``older`` that nothing names any more; what the next sweep may delete."""
        kept = {*self.segments, *(s for pins in self.pinned.values() for s in pins)}
        for s in older:
            if s not in kept:
                delete(self.spark, s)
                self.weights.pop(s, None)
        out, self.doomed = self.doomed, []
        return out

    def pin(self, checkpoint: str) -> None:
        """The current segments belong to a checkpoint from now on; what an earlier one at the same path alone held goes."""
        before = self.pinned.get(checkpoint, [])
        self.pinned[checkpoint] = list(self.segments)
        self.doomed += before

    def retain(self, condition: Column, step: int | str) -> None:
        """Drop rows that can't matter any more (below a waterline, say)."""
        segment = f"{self.path}/kept={step}"
        old = list(self.segments)
        n = self._write(self.fold(self.log()).where(condition), segment)
        self.segments = [segment] if n else []
        self.doomed += [s for s in old if s != segment]
