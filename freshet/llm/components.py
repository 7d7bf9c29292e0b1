"""Connected components of an edge table, distributed.

Each partition first contracts its edges by union-find to a forest of stars. The forests are then merged by rounds of
large-star and small-star steps (grouped minima and joins, never a list of neighbours in one place) until nothing
changes; the number of rounds grows with the logarithm of the size. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm._stage import dropped, written


class UnionFind:
    """Sets of longs with path halving; the root is always the least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = g = up.get(p, p)
            x = g
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:  # a batch at a time bounds memory; what one batch can't see the star rounds merge
        sets = UnionFind()
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            sets.union(a, b)
        nodes = list(sets.up)
        yield pd.DataFrame({"a": nodes, "b": [sets.find(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long) but the least of each component, which stands for itself."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    now = written(pairs.mapInPandas(_contract, "a long, b long").distinct(), "stars")
    seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while seen[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every node hands its least neighbour to its larger neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every node hands its least smaller neighbour to itself and to its other smaller neighbours.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        nxt = written(small.distinct(), "stars")
        dropped(now)
        now = nxt
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
