"""Formats and file connectors: rows in and out, and change logs in the usual envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.streaming.zset import W


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",", headers: bool = False, trim: bool = False, stream: bool = False) -> DataFrame:
    r = (spark.readStream if stream else spark.read).schema(schema).option("sep", delimiter).option("header", headers)
    return r.option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None, stream: bool = False) -> DataFrame:
    r = spark.readStream if stream else spark.read
    return (r.schema(schema) if schema else r).parquet(path)


def read_raw(spark: SparkSession, path: str, mode: str = "lines", column: str = "data") -> DataFrame:
    """Whole blobs or lines in one binary or text column."""
    if mode == "lines":
        return spark.read.text(path).withColumnRenamed("value", column)
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias(column))


def read_json(spark: SparkSession, path: str, schema: str, update: str = "raw", array: bool = False, soft_delete: bool = False) -> DataFrame:
    """JSON lines (or lines of arrays) with an update format, as a change log."""
    lines = spark.read.text(path)
    if array:
        lines = lines.select(F.explode(F.from_json("value", "array<string>")).alias("value")) if update == "raw" else lines.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    return parse_changes(lines, "value", schema, update, soft_delete)


def parse_changes(lines: DataFrame, column: str, schema: str, update: str = "raw", soft_delete: bool = False) -> DataFrame:
    """Rows with weight ``_w`` from a column of JSON texts.

    ``raw``: each text a row. ``insert_delete``: {"insert": row} or {"delete": row}. ``weighted``: {"weight": n, "data": row}.
    ``debezium``: {"payload": {"op": c|u|d|r, "before": row, "after": row}}. With ``soft_delete`` deletes stay as rows, told by column ``is_delete``.
    """
    if update == "raw":
        out = lines.select(F.from_json(column, schema).alias("r")).select("r.*").withColumn(W, F.lit(1).cast("long"))
    elif update == "insert_delete":
        z = lines.select(F.from_json(column, f"insert struct<{_fields(schema)}>, delete struct<{_fields(schema)}>, update struct<{_fields(schema)}>").alias("e")).select("e.*")
        both = F.array(F.struct(F.col("insert").alias("r"), F.lit(1).cast("long").alias(W)), F.struct(F.col("update").alias("r"), F.lit(1).cast("long").alias(W)), F.struct(F.col("delete").alias("r"), F.lit(-1).cast("long").alias(W)))
        out = z.select(F.explode(F.filter(both, lambda x: x["r"].isNotNull())).alias("c")).select("c.r.*", f"c.{W}")
    elif update == "weighted":
        out = lines.select(F.from_json(column, f"weight long, data struct<{_fields(schema)}>").alias("e")).select("e.data.*", F.col("e.weight").alias(W))
    elif update == "debezium":
        row = f"struct<{_fields(schema)}>"
        p = lines.select(F.from_json(column, f"payload struct<op: string, before: {row}, after: {row}>").alias("e")).select("e.payload.*")
        both = F.array(F.struct(F.when(F.col("op").isin("u", "d"), F.col("before")).alias("r"), F.lit(-1).cast("long").alias(W)), F.struct(F.when(F.col("op").isin("c", "r", "u"), F.col("after")).alias("r"), F.lit(1).cast("long").alias(W)))
        out = p.select(F.explode(F.filter(both, lambda x: x["r"].isNotNull())).alias("c")).select("c.r.*", f"c.{W}")
    else:
        raise ValueError(f"no such update format: {update}")
    if soft_delete:
        return out.withColumn("is_delete", F.col(W) < 0).withColumn(W, F.abs(F.col(W)))
    return out


def _fields(schema: str) -> str:
    parsed = T._parse_datatype_string(schema)
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in parsed.fields)


def with_metadata(df: DataFrame, name: str = "connector_metadata") -> DataFrame:
    """CONNECTOR_METADATA(): where each row of a file source came from, as a VARIANT."""
    return df.withColumn(name, F.expr("parse_json(to_json(struct(_metadata.file_path AS file, _metadata.file_modification_time AS modified)))"))


def preprocess(lines: DataFrame, column: str, f: Callable[[bytes], bytes]) -> DataFrame:
    """User code on raw bytes before they are parsed, in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f(bytes(b)))

    return lines.withColumn(column, run(F.col(column).cast("binary")).cast("string"))


def encode_changes(z: DataFrame, update: str = "insert_delete") -> DataFrame:
    """A Z-set as JSON texts in column ``value``."""
    row = F.struct(*[c for c in z.columns if c != W])
    many = F.explode(F.sequence(F.lit(1), F.abs(F.col(W)))) if update != "weighted" else F.lit(1)
    texts = {
        "raw": F.to_json(row),
        "insert_delete": F.when(F.col(W) > 0, F.to_json(F.struct(row.alias("insert")))).otherwise(F.to_json(F.struct(row.alias("delete")))),
        "weighted": F.to_json(F.struct(F.col(W).alias("weight"), row.alias("data"))),
        "debezium": F.to_json(F.struct(F.struct(F.when(F.col(W) > 0, "c").otherwise("d").alias("op"), F.when(F.col(W) < 0, row).alias("before"), F.when(F.col(W) > 0, row).alias("after")).alias("payload"))),
    }
    return z.where(F.col(W) != 0).withColumn("n_", many).select(texts[update].alias("value"))


def upserts(z: DataFrame, keys: list[str]) -> DataFrame:
    """A change as keyed operations for a sink with a unique key: a delete and an insert of one key become an update (column ``op``)."""
    rest = [c for c in z.columns if c not in (*keys, W)]
    grouped = z.groupBy(*keys).agg(F.max(F.when(F.col(W) > 0, F.struct(*rest, F.lit(1).alias("in_")))).alias("new_"), F.max((F.col(W) < 0).cast("int")).alias("old_"))
    op = F.when(F.col("new_").isNull(), "delete").when(F.col("old_") == 1, "update").otherwise("insert")
    return grouped.select(op.alias("op"), *keys, *[F.col(f"new_.{c}").alias(c) for c in rest])
