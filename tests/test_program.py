"""Programs: the sum of a view's changes equals its query over the tables, whatever the way it is kept up."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import types as T

from freshet.streaming import zset
from freshet.streaming.program import Program
from freshet.streaming.state import StateLog

SQL = """
CREATE TABLE emp (id INT, dept INT, sal BIGINT);
CREATE TABLE dept (d INT, name VARCHAR);
CREATE LOCAL VIEW rich AS SELECT id, dept, sal FROM emp WHERE sal > 3;
CREATE VIEW joined AS SELECT r.id, name FROM rich r JOIN dept ON r.dept = dept.d;
CREATE VIEW grouped AS SELECT dept, COUNT(*) AS n, MAX(sal) AS top FROM emp GROUP BY dept;
CREATE VIEW kinds AS SELECT DISTINCT dept FROM emp;
CREATE VIEW ranked AS SELECT id, dept, ROW_NUMBER() OVER (PARTITION BY dept ORDER BY sal DESC, id) AS rn FROM emp;
CREATE VIEW outer_ AS SELECT name, COUNT(id) AS n FROM dept LEFT JOIN emp ON d = dept GROUP BY name;
CREATE VIEW pairs AS SELECT a.id AS x, b.id AS y FROM emp a JOIN emp b ON a.dept = b.dept AND a.id < b.id;
CREATE VIEW totals AS SELECT e.dept, COUNT(*) AS n, COUNT(sal) AS known, SUM(sal) AS s, AVG(sal) AS mean FROM emp e JOIN dept d ON e.dept = d.d GROUP BY e.dept;
CREATE VIEW all_ AS SELECT COUNT(*) AS n, SUM(sal) AS s FROM emp WHERE sal <> 2;
"""


def values(spark, cols, rows, types):
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(cols, types)))


def test_random_changes(spark):
    rng = random.Random(5)
    p = Program(spark, SQL)
    assert {n: v.strategy for n, v in p.views.items()} == {"rich": "linear", "joined": "linear", "grouped": "keyed", "kinds": "keyed", "ranked": "keyed", "outer_": "recompute", "pairs": "linear", "totals": "groups", "all_": "groups"}
    emp, totals = [], {n: [] for n, v in p.views.items() if not v.local}
    p.push("dept", values(spark, ["d", "name"], [(1, "a"), (2, "b"), (2, "bb"), (None, "n")], ["int", "string"]))
    for _ in range(3):
        new = [(rng.randrange(40), rng.choice([1, 2, 3, None]), rng.choice([None, *range(9)])) for _ in range(6)]
        gone = rng.sample(emp, min(3, len(emp)))
        for g in gone:
            emp.remove(g)
        emp += new
        shape = lambda rows: values(spark, ["id", "dept", "sal"], rows, ["int", "int", "long"])
        p.push("emp", shape(new), shape(gone) if gone else None)
        for name, d in p.step().items():
            totals[name].append(d)
    for name, parts in totals.items():
        got = sorted(map(tuple, zset.expanded(zset.integrate(*parts)).collect()), key=str)
        want = sorted(map(tuple, p.query(p.views[name].query).collect()), key=str)
        assert got == want, name


def test_transactions_sinks_and_defaults(spark):
    p = Program(spark, "CREATE TABLE t (k INT NOT NULL PRIMARY KEY, v INT DEFAULT 7); CREATE VIEW w AS SELECT k, v FROM t;")
    seen = []
    p.listen("w", lambda step, d: seen.append((step, sorted(map(tuple, d.collect())))))
    p.begin()
    p.push("t", values(spark, ["k"], [(1,), (2,)], ["int"]))
    p.push("t", values(spark, ["k", "v"], [(1, 5)], ["int", "int"]))
    p.commit()
    p.push("t", deletes=values(spark, ["k"], [(2,)], ["int"]))
    p.execute("INSERT INTO t SELECT 1 AS k, 6 AS v")
    p.step()
    assert seen == [(1, [(1, 5, 1), (2, 7, 1)]), (2, [(1, 5, -1), (1, 6, 1), (2, 7, -1)])]


def test_lateness_and_clock(spark):
    p = Program(spark, "CREATE TABLE t (id INT, ts TIMESTAMP LATENESS INTERVAL '1' HOUR); CREATE VIEW v AS SELECT id FROM t WHERE ts > NOW() - INTERVAL '1' DAY;")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = lambda *r: values(spark, ["id", "ts"], list(r), ["int", "timestamp_ntz"])
    p.push("t", rows((1, at(10)), (2, at(3))))  # nothing is late in the first step
    p.step(at(12))
    p.push("t", rows((3, at(8)), (4, at(9))))
    p.step(at(12))
    assert sorted(r[0] for r in p.snapshot("v").collect()) == [1, 2, 4]
    assert [r[0] for r in p.error_view().collect()] == ["t"]
    out = p.step(dt.datetime(2024, 1, 2, 9, 30))
    assert sorted(map(tuple, out["v"].collect())) == [(2, -1), (4, -1)]
    with pytest.raises(ValueError, match="clock"):
        p.step(at(1))


def test_recursion_with_deletes(spark):
    p = Program(spark, "CREATE TABLE e (s INT, d INT); DECLARE RECURSIVE VIEW r (s INT, d INT); CREATE VIEW r AS SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s;")
    edges = lambda *r: values(spark, ["s", "d"], list(r), ["int", "int"])
    p.push("e", edges((1, 2), (2, 3), (3, 1)))
    assert p.step()["r"].count() == 9
    p.push("e", deletes=edges((3, 1)))
    assert sorted(map(tuple, zset.columns and p.step()["r"].select("s", "d", "_w").collect())) == [(1, 1, -1), (2, 1, -1), (2, 2, -1), (3, 1, -1), (3, 2, -1), (3, 3, -1)]


def test_types_functions_and_compaction(spark):
    p = Program(spark, "CREATE TYPE pair AS (a INT, b VARCHAR); CREATE TABLE t (x INT, p pair); CREATE FUNCTION twice(n INT) RETURNS INT AS n * 2; CREATE VIEW v AS SELECT twice(x) AS y FROM t;")
    p.tables["t"].state.compact_after = 2
    for i in range(5):
        p.push("t", spark.sql(f"SELECT {i} AS x, named_struct('a', 1, 'b', 'q') AS p"))
        p.step()
    assert len(p.tables["t"].state.segments) <= 3
    assert sorted(r[0] for r in p.snapshot("v").collect()) == [0, 2, 4, 6, 8]


def test_append_only_and_unsigned(spark):
    p = Program(spark, "CREATE TABLE t (a TINYINT UNSIGNED) WITH ('append_only' = 'true'); CREATE VIEW v AS SELECT a FROM t;")
    p.push("t", values(spark, ["a"], [(255,), (None,)], ["int"]))
    p.step()
    with pytest.raises(ValueError, match="only takes inserts"):
        p.push("t", deletes=values(spark, ["a"], [(1,)], ["int"]))
    p.push("t", values(spark, ["a"], [(256,)], ["int"]))
    with pytest.raises(Exception, match="out of range"):
        p.step()


def test_buffered_sink_and_resume(spark, tmp_path):
    sql = "CREATE TABLE t (k INT, ts TIMESTAMP LATENESS INTERVAL '1' HOUR); CREATE VIEW v AS SELECT k, COUNT(*) AS n FROM t GROUP BY k;"
    p = Program(spark, sql)
    seen = []
    p.listen("v", lambda step, d: seen.append((step, sorted(map(tuple, d.collect())))), buffer_steps=2)
    rows = lambda *r: values(spark, ["k", "ts"], list(r), ["int", "timestamp_ntz"])
    p.push("t", rows((1, dt.datetime(2024, 1, 1, 10))))
    p.step()
    p.push("t", rows((1, dt.datetime(2024, 1, 1, 11))))
    p.step()
    assert seen == [(2, [(1, 2, 1)])]
    p.checkpoint(str(tmp_path / "c"))
    q = Program.resume(spark, sql, str(tmp_path / "c"))
    assert q.steps == 2 and list(map(tuple, q.snapshot("v").collect())) == [(1, 2)]
    q.push("t", rows((1, dt.datetime(2024, 1, 1, 9)), (2, dt.datetime(2024, 1, 1, 12))))  # the first is late
    assert sorted(map(tuple, q.step()["v"].collect())) == [(2, 1, 1)]
    assert q.error_view().count() == 1


def test_changes_read_what_they_touch(spark):
    """A step of counts and sums reads the buckets of its groups alone, and rows are only added up again where there were deletions."""
    p = Program(spark, "CREATE TABLE t (k INT, v BIGINT); CREATE VIEW s AS SELECT k, COUNT(*) AS n, SUM(v) AS total FROM t GROUP BY k;")
    p.push("t", spark.range(2000).selectExpr("cast(id % 500 AS int) AS k", "id AS v"))
    p.step()
    log = p.views["s"].groups
    assert p.views["s"].strategy == "groups" and "Aggregate" not in p.tables["t"].state.relation()._jdf.queryExecution().optimizedPlan().toString()
    one = spark.createDataFrame([(7,)], "k0_ int")
    assert 0 < len(log.log(one).inputFiles()) <= len(log.log().inputFiles())
    plan = log.log(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket_" in plan or "bucket_#" in plan.partition("PartitionFilters")[2][:80]
    p.push("t", values(spark, ["k", "v"], [(7, 1)], ["int", "long"]), values(spark, ["k", "v"], [(8, 8)], ["int", "long"]))
    d = sorted(map(tuple, p.step()["s"].collect()))
    assert d == [(7, 4, 3028, -1), (7, 5, 3029, 1), (8, 3, 3024, 1), (8, 4, 3032, -1)]
    assert p.snapshot("s").count() == 500


def test_resume_after_many_steps(spark, tmp_path):
    """A checkpoint outlives compactions; a program resumed from it gives what the first goes on to give, INSERT statements and held-back rows counted once."""
    sql = """CREATE TABLE t (k INT, ts TIMESTAMP LATENESS INTERVAL '1' HOUR); INSERT INTO t SELECT 1 AS k, TIMESTAMP_NTZ '2024-01-01 00:30:00' AS ts;
    CREATE VIEW c AS SELECT k, COUNT(*) AS n FROM t GROUP BY k; CREATE VIEW m AS SELECT k, MAX(ts) AS last FROM t GROUP BY k;
    CREATE VIEW f AS SELECT k, ts FROM t WITH ('emit_final' = 'ts'); CREATE VIEW o AS SELECT a.k, b.k AS k2 FROM t a LEFT JOIN t b ON a.k = b.k + 1;"""
    sql = sql.replace("CREATE VIEW f AS SELECT k, ts FROM t WITH ('emit_final' = 'ts')", "CREATE VIEW f WITH ('emit_final' = 'ts') AS SELECT k, ts FROM t")
    p = Program(spark, sql)
    rows = lambda *r: values(spark, ["k", "ts"], list(r), ["int", "timestamp_ntz"])
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for t in p.tables.values():
        t.state.compact_after = 2
    for i in range(1, 4):
        p.push("t", rows((i, hour(i))))
        p.step()
    p.checkpoint(str(tmp_path / "c"))
    q = Program.resume(spark, sql, str(tmp_path / "c"))
    for i in range(4, 9):
        p.push("t", rows((i, hour(i)), (1, hour(0))))  # the second is late
        mine = p.step()
    for i in range(4, 9):
        q.push("t", rows((i, hour(i)), (1, hour(0))))
        theirs = q.step()
    for name in ("c", "m", "f", "o"):
        assert sorted(map(tuple, mine[name].collect()), key=str) == sorted(map(tuple, theirs[name].collect()), key=str), name
    for name in ("c", "m", "o"):
        got = sorted(map(tuple, q.snapshot(name).collect()), key=str)
        assert got == sorted(map(tuple, q.query(q.views[name].query).collect()), key=str), name
    assert {r.k: r.n for r in q.snapshot("c").collect()}[1] == 2
    assert q.error_view().count() == p.error_view().count() == 5


def test_streams_apply_a_batch_once(spark, tmp_path):
    p = Program(spark, "CREATE TABLE t (k INT); CREATE VIEW v AS SELECT COUNT(*) AS n FROM t;")
    folder = str(tmp_path / "in")
    spark.range(10).selectExpr("cast(id AS int) AS k").write.parquet(folder)
    stream = spark.readStream.schema("k int").parquet(folder)
    for _ in range(2):  # the second has no offsets of the first: its batch 0 comes again
        for q in p.run({"t": stream}, str(tmp_path / f"offsets{_}"), state=str(tmp_path / "state")):
            q.awaitTermination()
    assert p.snapshot("v").first()[0] == 10
    again = Program.resume(spark, "CREATE TABLE t (k INT); CREATE VIEW v AS SELECT COUNT(*) AS n FROM t;", str(tmp_path / "state"))
    assert again.snapshot("v").first()[0] == 10 and again.applied == {"t": 0}


def test_index_sink_and_push_order(spark):
    p = Program(spark, "CREATE TABLE t (k INT NOT NULL PRIMARY KEY, v INT); CREATE VIEW w AS SELECT k, v FROM t; CREATE INDEX by_k ON w (k);")
    seen = []
    p.listen("w", lambda step, d: seen.append(sorted(map(tuple, d.select("op", "k", "v").collect()))), index="by_k")
    row = lambda *r: values(spark, ["k", "v"], list(r), ["int", "int"])
    p.push("t", row((1, 1), (2, 2)).repartition(2))
    p.push("t", row((1, 10)).repartition(3))
    p.step()
    p.push("t", inserts=row((1, 11)), deletes=row((1, 10)))
    p.push("t", deletes=row((2, 2)))
    p.step()
    assert seen == [[("insert", 1, 10), ("insert", 2, 2)], [("delete", 2, None), ("update", 1, 11)]]


def test_lost_figures_of_a_write(spark, monkeypatch):
    """Spark may lose the figures of a write, and PySpark then fails to read the empty row: the log goes on, and is added up."""
    jvm = spark._jvm
    monkeypatch.setattr(Observation, "get", property(lambda self: jvm.org.apache.spark.sql.api.python.PythonSQLUtils.toPyRow(jvm.org.apache.spark.sql.Row.empty())))
    log = StateLog(spark, "lost", T.StructType([T.StructField("k", T.IntegerType())]), ["k"])
    log.weights[f"{log.path}/step=0"] = (1, 1)  # of an earlier write of the step
    log.append(spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "k int, w long").toDF("k", zset.W), 0)
    log.append(spark.createDataFrame([(1, -1)], "k int, w long").toDF("k", zset.W), 1)
    assert sorted(r.k for r in log.relation().collect()) == [2, 2]
