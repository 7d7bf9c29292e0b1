"""Operators and sources on small tables with hand-made edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.operators import aggregates, joins, ranking, timewindows
from freshet.sources import connectors, formats, nexmark
from freshet.streaming import zset


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("bucket", [None, 600])
def test_asof(spark, bucket):
    left = spark.createDataFrame([(1, at(5)), (1, at(25)), (2, at(5)), (None, at(5)), (1, None), (1, at(1))], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(5), "a"), (1, at(3), "b"), (2, at(6), "c"), (None, at(1), "d"), (1, None, "e")], "k int, t timestamp_ntz, v string")
    got = {(r.k, r.t): r.right_v for r in joins.asof_join(left, right, ["k"], "t", "t", bucket_seconds=bucket).collect()}
    assert got == {(1, at(5)): "a", (1, at(25)): "a", (2, at(5)): None, (None, at(5)): None, (1, None): None, (1, at(1)): None}


def test_range_and_interval(spark):
    points = spark.createDataFrame([(0,), (5,), (9,), (10,)], "x int")
    ranges = spark.createDataFrame([(0, 10), (5, 6), (7, 7), (-20, 100)], "lo int, hi int")
    got = sorted(map(tuple, joins.range_join(points, ranges, "x", "lo", "hi", 3).select("x", "lo").collect()))
    assert got == sorted((x, lo) for x in (0, 5, 9, 10) for lo, hi in ((0, 10), (5, 6), (7, 7), (-20, 100)) if lo <= x < hi)
    a = spark.createDataFrame([(1, at(0)), (1, at(60))], "k int, ta timestamp_ntz")
    b = spark.createDataFrame([(1, at(10)), (1, at(59)), (2, at(0))], "k int, tb timestamp_ntz")
    got = sorted((r.ta, r.tb) for r in joins.interval_join(a, b, ["k"], "ta", "tb", 60, 600).collect())
    assert got == [(at(0), at(10)), (at(60), at(59))]


def test_salted_join_keeps_unmatched(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(9, 0)], "k int, v int")
    small = spark.createDataFrame([(1, "a")], "k int, n string")
    assert joins.salted_join(big, small, ["k"], 4, "left").count() == 51
    with pytest.raises(ValueError, match="unmatched"):
        joins.salted_join(big, small, ["k"], 4, "full")


def test_sessions(spark):
    rows = spark.createDataFrame([(1, at(0)), (1, at(4)), (1, at(9)), (2, at(9)), (None, at(1)), (1, None)], "k int, t timestamp_ntz")
    got = sorted(((r.k, r.t, r.window_start, r.window_end) for r in timewindows.session(rows, "t", "5 minutes", ["k"]).collect()), key=str)
    assert got == sorted([(1, at(0), at(0), at(9)), (1, at(4), at(0), at(9)), (1, at(9), at(9), at(14)), (2, at(9), at(9), at(14)), (None, at(1), at(1), at(6))], key=str)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 3, 5), (2, None, 1)], "g int, v int, w int")
    assert {r.g: r.a for r in df.groupBy("g").agg(aggregates.avg_as(df, "v").alias("a")).collect()} == {1: 2, 2: None}
    assert {r.g: r.a for r in df.groupBy("g").agg(aggregates.array_agg(F.col("w"), ordered=True).alias("a")).collect()} == {1: [None, 5], 2: [1]}
    bits = spark.createDataFrame([(1, bytearray(b"\x0f\xf0")), (1, bytearray(b"\xff\x00")), (2, None)], "g int, b binary")
    assert {r.g: bytes(r.bits) for r in aggregates.bit_binary(bits, ["g"], "b", "xor").collect()} == {1: b"\xf0\xf0"}
    with pytest.raises(Exception, match="more than one value"):
        aggregates.within_distinct(spark.createDataFrame([(1, 1, 5), (1, 1, 6)], "g int, k int, v int"), ["g"], ["k"], "v").collect()


def test_ranking(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, v int, n string")
    assert {r.k: r.n for r in ranking.latest_by_key(df, ["k"], [F.col("v")]).collect()} == {1: "b", 2: "c"}
    w = {"m": F.max("v").over(ranking.Window.partitionBy("k"))}
    assert sorted(r.n for r in ranking.qualify(df, w, F.col("v") == F.col("m")).collect()) == ["b", "c"]


def test_zset_errors(spark):
    with pytest.raises(Exception, match="negative weight"):
        zset.expanded(zset.weighted(spark.range(1), -1)).collect()


def test_formats(spark, tmp_path):
    lines = spark.createDataFrame([('{"insert": {"a": 1}}',), ('{"delete": {"a": 2}}',)], "value string")
    assert sorted(map(tuple, formats.parse_changes(lines, "value", "a int", "insert_delete").collect())) == [(1, 1), (2, -1)]
    assert sorted(map(tuple, formats.parse_changes(lines, "value", "a int", "insert_delete", soft_delete=True).select("a", "is_delete").collect())) == [(1, False), (2, True)]
    update = spark.createDataFrame([('{"payload": {"op": "u", "before": {"a": 1}, "after": {"a": 2}}}',)], "value string")
    assert sorted(map(tuple, formats.parse_changes(update, "value", "a int", "debezium").collect())) == [(1, -1), (2, 1)]
    (tmp_path / "x.txt").write_text("one\ntwo\n")
    assert [r.data for r in formats.read_raw(spark, str(tmp_path / "x.txt")).collect()] == ["one", "two"]
    with pytest.raises(ValueError, match="update format"):
        formats.parse_changes(lines, "value", "a int", "other")


def test_connectors(spark, tmp_path):
    order = [c["name"] for c in connectors.ordered([{"name": "b", "start_after": ["x"]}, {"name": "a", "labels": ["x"]}])]
    assert order == ["a", "b"]
    with pytest.raises(ValueError, match="wait"):
        connectors.ordered([{"name": "a", "labels": ["x"], "start_after": ["y"]}, {"name": "b", "labels": ["y"], "start_after": ["x"]}])
    change = zset.weighted(spark.range(3))
    connectors.WRITERS["file_output"](change, str(tmp_path / "out"))
    back = connectors.READERS["file_input"](spark, str(tmp_path / "out"), "json", "id long", update="insert_delete")
    assert sorted(map(tuple, back.collect())) == [(0, 1), (1, 1), (2, 1)]
    connectors.WRITERS["null_output"](change)
    with pytest.raises(RuntimeError, match="client"):
        connectors.READERS["nats_input"](spark)


def test_nexmark(spark):
    made = nexmark.generate(spark, 5000)
    assert [made[t].count() for t in ("person", "auction", "bid")] == [100, 300, 4600]
    assert made["bid"].join(made["auction"], made["bid"].auction == made["auction"].id, "left_anti").isEmpty()
    assert made["auction"].join(made["person"], made["auction"].seller == made["person"].id, "left_anti").isEmpty()
