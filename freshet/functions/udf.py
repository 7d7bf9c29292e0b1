"""User functions, and the few functions that no built-in expression covers: Arrow-batched Python."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """Make the functions that translated SQL may call known to the session."""

    @F.pandas_udf("long")
    def xxhash(data: pd.Series, seed: pd.Series) -> pd.Series:
        import xxhash as x

        signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
        return pd.Series([None if d is None else signed(x.xxh64_intdigest(bytes(d), int(s))) for d, s in zip(data, seed)], dtype="Int64")

    @F.pandas_udf("binary")
    def gunzip(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else gzip.decompress(bytes(d)))

    spark.udf.register("freshet_xxhash", xxhash)
    spark.udf.register("freshet_gunzip", gunzip)


def _leaves(value: Any, f: Callable[[Any], Any]) -> Any:
    if isinstance(value, dict):
        return {k: _leaves(v, f) for k, v in value.items()}
    if isinstance(value, list):
        return [_leaves(v, f) for v in value]
    return f(value)


def _kept(value: Any, keep: Callable[[Any], bool]) -> Any:
    if isinstance(value, dict):
        return {k: _kept(v, keep) for k, v in value.items() if isinstance(v, (dict, list)) or keep(v)}
    if isinstance(value, list):
        return [_kept(v, keep) for v in value if isinstance(v, (dict, list)) or keep(v)]
    return value


def register_variant(spark: SparkSession, name: str, f: Callable[[Any], Any]) -> None:
    """``VARIANT_DEEP_MAP(v, name)`` and ``VARIANT_DEEP_FILTER(v, name)`` with a Python function of a leaf."""

    def over(change: Callable[[Any], Any]):
        @F.pandas_udf("string")
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in texts:
                yield s.map(lambda t: None if t is None else json.dumps(change(json.loads(t))))

        return run

    spark.udf.register(f"freshet_deep_map_{name}", over(lambda v: _leaves(v, f)))
    spark.udf.register(f"freshet_deep_filter_{name}", over(lambda v: _kept(v, f)))


def create_function(spark: SparkSession, name: str, f: Callable, returns: str, deterministic: bool = True) -> None:
    """An external scalar function (a function of pandas Series); views may only use deterministic ones."""
    if not deterministic:
        raise ValueError(f"{name}: functions of maintained views must be deterministic")
    spark.udf.register(name, F.pandas_udf(f, returns))


def create_aggregate(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """A user aggregate: a function of a group's Series to one value."""
    run: Any = f
    run.__annotations__ = {"x": pd.Series, "return": float if returns == "double" else int if returns in ("long", "int", "bigint") else str}
    spark.udf.register(name, F.pandas_udf(run, returns))
