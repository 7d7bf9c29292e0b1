"""Two-pass external shuffle of a corpus into shards.

Pass one scatters whole records uniformly into buckets that fit in memory, by a seeded hash of the whole record. Pass two
puts each bucket into a fixed order, Fisher-Yates shuffles it with a generator seeded by (seed, bucket), and the
result is written. Buckets laid end to end give every record a place in one global permutation, and places are
dealt to shards in turn: the law is ``rows`` (shard sizes in rows differ by one at most).

Records repeated in full have one hash. Where there are more than HOT_ROWS of them they are counted first (Spark adds up within each partition) and
written out again with a number each, which scatters them like any others; so no bucket holds more than its share.

Defined cases: null text counts as no bytes; equal rows are dealt apart like any others; an empty table gives no
rows; columns of the input are kept; an added column whose name is taken gets underscores before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm._stage import free_name, table, written

#: A bucket's records in memory: most bytes of text aimed at. Buckets grow in number with the input, not in size, and are no
#: fewer than the session's shuffle partitions.
BUCKET_BYTES = 16 << 20
#: Bytes of text that a task of pass two takes, in whole buckets.
TASK_BYTES = 64 << 20
#: Copies of a record that may stay together.
HOT_ROWS = 256
#: Buckets whose first places (16 bytes each) are broadcast; more are joined.
BROADCAST_BUCKETS = 1 << 20


def _bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0


def _apart(plain: DataFrame, whole: list[str], seed: int) -> DataFrame:
    """``plain`` with ``_h``, a hash of the record, in which copies of a record beyond HOT_ROWS differ."""
    hashed = plain.withColumn("_h", F.xxhash64(F.lit(seed), *whole))
    if len(whole) < len(plain.columns):
        return hashed  # maps can't be grouped
    hot = hashed.groupBy("_h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
    many = written(hot, "hot")
    if many.isEmpty():
        return hashed
    few = hashed.join(many.select("_h"), "_h", "left_anti").select(*plain.columns, "_h")
    copies = hashed.join(many.select("_h"), "_h", "left_semi").groupBy(*plain.columns, "_h").agg(F.count("*").alias("n"))
    # In two steps, so that no task writes all copies of a record.
    groups = copies.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / HOT_ROWS)))).repartition(F.xxhash64("_h", "g"))
    each = groups.withColumn("i", F.explode(F.sequence(F.col("g") * HOT_ROWS, F.least(F.col("n"), (F.col("g") + 1) * HOT_ROWS) - 1)))
    return few.unionByName(each.select(*plain.columns, F.xxhash64("_h", "i").alias("_h")))


def _first_places(out: DataFrame) -> DataFrame:
    """(_bucket, _first): the place of each bucket's first record, by sums over groups of buckets."""
    sizes = out.groupBy("_bucket").agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col("_bucket") / 1024))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(groups, "g").select("_bucket", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("_first"))


def external_shuffle(docs: DataFrame, shards: int, seed: int = 17, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``_place`` (rank in the permutation), ``_shard`` and ``_slot``, from a table written between the passes."""
    total = _bytes(docs, text)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-total // BUCKET_BYTES))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    whole = [f.name for f in plain.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    apart = _apart(plain, whole, seed)
    scattered = apart.select(F.pmod("_h", F.lit(n)).cast("int").alias("_bucket"), "_h", *names)
    schema = T.StructType([*[f for f in scattered.schema if f.name != "_h"], T.StructField("_at", T.LongType(), False)])

    def permuted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_h").drop_columns(["_h"])  # arrival order differs from run to run; this one doesn't
        order = np.arange(rows.num_rows)
        if rows.num_rows:
            np.random.Generator(np.random.PCG64([seed, rows["_bucket"][0].as_py()])).shuffle(order)  # Fisher-Yates
        return rows.take(pa.array(order)).append_column("_at", pa.array(np.arange(rows.num_rows)))

    tasks = max(least, -(-total // TASK_BYTES))
    out = written(scattered.repartition(tasks, "_bucket").groupBy("_bucket").applyInArrow(permuted, schema), "shuffled")
    first = _first_places(out)
    placed = out.join(F.broadcast(first) if n <= BROADCAST_BUCKETS else first, "_bucket").withColumn("_place", F.col("_first") + F.col("_at"))
    place, shard, slot = (free_name(c, docs.columns) for c in ("_place", "_shard", "_slot"))
    return placed.select(*names, "_place", F.pmod("_place", F.lit(shards)).cast("int"), F.floor(F.col("_place") / shards).cast("long")).toDF(*docs.columns, place, shard, slot)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 17) -> None:
    """Write the shuffled records under ``path/_shard=<n>/``, in slot order; a large shard in several files, whose names order them."""
    placed = external_shuffle(docs, shards, seed)
    shard, slot = placed.columns[-2:]
    files = max(shards, -(-_bytes(docs, "text") // TASK_BYTES))
    placed.repartitionByRange(files, shard, slot).sortWithinPartitions(shard, slot).drop(placed.columns[-3]).write.partitionBy(shard).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = external_shuffle(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
