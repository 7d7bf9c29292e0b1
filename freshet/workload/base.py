"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.functions import udf
from freshet.plans.ddl import mentions
from freshet.plans import typed

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations", "pages", "benchmark")


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def bind(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views for the tables that a query names."""
    for name in TABLES:
        if mentions(sql, name):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def dialect(sql: str) -> Query:
    """A query in the engine's dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        udf.register(spark)
        bind(spark, sf_dir, sql)
        return typed.run(spark, sql)

    return run


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, ours: str, oracle: str | None = "") -> None:
        """A dialect query; its DuckDB text is the same unless given, None if there is none."""
        self.queries[name] = dialect(ours)
        if oracle is not None:
            self.oracles[name] = oracle or ours

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return put
