"""Connectors by name. Those that need a service or a jar say so when they are opened, not when this module is imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.sources import datagen, formats, nexmark
from freshet.streaming.zset import W

Reader = Callable[..., DataFrame]
Writer = Callable[..., None]
READERS: dict[str, Reader] = {}
WRITERS: dict[str, Writer] = {}


def reader(name: str) -> Callable[[Reader], Reader]:
    return lambda f: READERS.setdefault(name, f)


def writer(name: str) -> Callable[[Writer], Writer]:
    return lambda f: WRITERS.setdefault(name, f)


@reader("file_input")
@reader("s3_input")
@reader("url_input")
def file_input(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any path Spark can read: local, s3a:// with its jar, or an http(s) URL fetched by Spark's file server."""
    if path.startswith(("http://", "https://")):
        from pyspark import SparkFiles

        spark.sparkContext.addFile(path)
        path = "file://" + SparkFiles.get(path.rsplit("/", 1)[-1])
    return {
        "csv": lambda: formats.read_csv(spark, path, schema, **options),
        "json": lambda: formats.read_json(spark, path, schema, **options),
        "parquet": lambda: formats.read_parquet(spark, path, schema),
        "raw": lambda: formats.read_raw(spark, path, **options),
        "avro": lambda: spark.read.format("avro").load(path),
    }[format]()


@reader("kafka_input")
def kafka_input(spark: SparkSession, topics: str, servers: str, schema: str, update: str = "insert_delete", **options) -> DataFrame:
    """A topic of JSON changes as a stream (needs the Kafka jar)."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load()
    return formats.parse_changes(stream.select(F.col("value").cast("string").alias("value")), "value", schema, update)


@reader("debezium_input")
def debezium_input(spark: SparkSession, topics: str, servers: str, schema: str, **options) -> DataFrame:
    return kafka_input(spark, topics, servers, schema, "debezium", **options)


@reader("delta_table_input")
def delta_input(spark: SparkSession, uri: str, mode: str = "snapshot", version: int | None = None, **options) -> DataFrame:
    """A Delta table (needs the Delta jar): snapshot, follow, or its change feed."""
    if mode == "snapshot":
        r = spark.read.format("delta").options(**options)
        return (r.option("versionAsOf", version) if version is not None else r).load(uri)
    stream = spark.readStream.format("delta").options(**options)
    return (stream.option("readChangeFeed", "true") if mode == "cdc" else stream).load(uri)


@reader("iceberg_input")
def iceberg_input(spark: SparkSession, table: str, snapshot_id: int | None = None, **options) -> DataFrame:
    r = spark.read.format("iceberg").options(**options)
    return (r.option("snapshot-id", snapshot_id) if snapshot_id is not None else r).load(table)


@reader("postgres_input")
def jdbc_input(spark: SparkSession, uri: str, query: str, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **options) -> DataFrame:
    """A query's result over JDBC; with a partition column it is read in ranges by many tasks."""
    r = spark.read.format("jdbc").option("url", uri).options(**options)
    if partition_column:
        r = r.option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
        return r.option("dbtable", f"({query}) q").load()
    return r.option("query", query).load()


@reader("pubsub_input")
@reader("nats_input")
def service_input(spark: SparkSession, **options) -> DataFrame:
    raise RuntimeError("this source needs a client of its service; register a Python data source and use spark.readStream.format")


@reader("datagen")
def datagen_input(spark: SparkSession, **options) -> DataFrame:
    return datagen.generate(spark, **options)


@reader("nexmark")
def nexmark_input(spark: SparkSession, events: int = 100_000, table: str = "bid", **options) -> DataFrame:
    return nexmark.generate(spark, events, **options)[table]


@reader("empty")
def empty_input(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


@writer("file_output")
def file_output(change: DataFrame, path: str, format: str = "json", update: str = "insert_delete", mode: str = "append") -> None:
    """A change as JSON, CSV (with its weight) or Parquet (a log with the weight)."""
    if format == "json":
        formats.encode_changes(change, update).write.mode(mode).text(path)
    elif format == "csv":
        change.write.mode(mode).option("header", "true").csv(path)
    else:
        change.write.mode(mode).parquet(path)


@writer("delta_table_output")
def delta_output(change: DataFrame, uri: str, step: int = 0, format: str = "delta", mode: str = "append") -> None:
    """A change log: each row with op (i or d) and ts (the step)."""
    log = change.withColumn("op", F.when(F.col(W) > 0, "i").otherwise("d")).withColumn("ts", F.lit(step))
    log.withColumn("n_", F.explode(F.sequence(F.lit(1), F.abs(F.col(W))))).drop("n_", W).write.format(format).mode(mode).save(uri)


@writer("jdbc_output")
def jdbc_output(change: DataFrame, uri: str, table: str, keys: list[str], **options) -> None:
    """Keyed operations into a staging table (needs a JDBC driver); the database merges it by ``op``."""
    formats.upserts(change, keys).write.format("jdbc").option("url", uri).option("dbtable", table).options(**options).mode("append").save()


@writer("kafka_output")
def kafka_output(change: DataFrame, topic: str, servers: str, update: str = "insert_delete", **options) -> None:
    formats.encode_changes(change, update).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()


@writer("keyed_output")
def keyed_output(change: DataFrame, keys: list[str], put: Callable[[list], None], batch: int = 500) -> None:
    """Keyed operations handed to a function on the executors in batches; the way to Redis, DynamoDB and the like."""

    def send(rows) -> None:
        part = []
        for r in rows:
            part.append(r.asDict(True))
            if len(part) == batch:
                put(part)
                part = []
        if part:
            put(part)

    formats.upserts(change, keys).foreachPartition(send)


@writer("null_output")
def null_output(change: DataFrame) -> None:
    change.write.format("noop").mode("overwrite").save()


def ordered(connectors: list[dict]) -> list[dict]:
    """Connectors in an order that starts each after those whose labels it names in ``start_after``; a cycle is an error."""
    done: set[str] = set()
    left, out = list(connectors), []
    all_labels = {x for c in connectors for x in c.get("labels", [])}
    while left:
        ready = [c for c in left if all(label not in all_labels or all(label not in d.get("labels", []) for d in left if d is not c) for label in c.get("start_after", []))]
        if not ready:
            raise ValueError("connectors wait for one another")
        out += ready
        left = [c for c in left if c not in ready]
        done |= {x for c in ready for x in c.get("labels", [])}
    return out
