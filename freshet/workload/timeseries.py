"""Windows over time, recursion, sources, change streams and incremental views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import udf
from freshet.operators import aggregates, recursion, timewindows
from freshet.plans.dialect import translate
from freshet.shared import fresh_path, saved
from freshet.sources import datagen, formats
from freshet.streaming import zset
from freshet.streaming.program import Program
from freshet.streaming.zset import W
from freshet.workload.base import Registry, load

R = Registry()

R.sql("ts_tumble", "SELECT window_start, event_type, COUNT(*) AS n FROM TABLE(TUMBLE(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR)) GROUP BY window_start, event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
R.sql("ts_tumble_offset", "SELECT window_start, window_end, COUNT(*) AS n FROM TABLE(TUMBLE(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR, INTERVAL '10' MINUTE)) GROUP BY window_start, window_end", "SELECT time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 10 MINUTE) + INTERVAL 10 MINUTE AS window_start, time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 10 MINUTE) + INTERVAL 70 MINUTE AS window_end, COUNT(*) AS n FROM events GROUP BY ALL")
R.sql("ts_tumble_group", "SELECT TUMBLE_START(ts, INTERVAL '30' MINUTE) AS s, TUMBLE_END(ts, INTERVAL '30' MINUTE) AS e, COUNT(*) AS n FROM events GROUP BY TUMBLE(ts, INTERVAL '30' MINUTE)", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS s, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS e, COUNT(*) AS n FROM events GROUP BY ALL")
R.sql("ts_hop", "SELECT window_start, window_end, COUNT(*) AS n FROM TABLE(HOP(TABLE events, DESCRIPTOR(ts), INTERVAL '30' MINUTE, INTERVAL '1' HOUR)) GROUP BY window_start, window_end", "SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, COUNT(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * unnest([0, 1]) AS s FROM events) GROUP BY ALL")
_SESSIONS = """WITH f AS (SELECT event_id, user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM f)
SELECT event_id, MIN(ts) OVER (PARTITION BY user_id, session) AS window_start, MAX(ts) OVER (PARTITION BY user_id, session) + INTERVAL 30 MINUTE AS window_end FROM s"""
R.sql("ts_session", "SELECT event_id, window_start, window_end FROM TABLE(SESSION(TABLE events, DESCRIPTOR(ts), DESCRIPTOR(user_id), INTERVAL '30' MINUTE))", _SESSIONS)
R.sql("ts_rolling_interval", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")


@R.query("ts_session_aggregate", f"SELECT user_id, window_start, window_end, COUNT(*) AS n FROM ({_SESSIONS}) JOIN events USING (event_id) GROUP BY ALL")
def ts_session_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    return timewindows.session_aggregate(e, "ts", "30 minutes", ["user_id"], F.count("*").alias("n"))


@R.query("ts_session_rows", _SESSIONS)
def ts_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    return timewindows.session(e, "ts", "30 minutes", ["user_id"]).select("event_id", "window_start", "window_end")


@R.query("ts_hop_api", R.oracles["ts_hop"])
def ts_hop_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    return timewindows.hop(e, "ts", "30 minutes", "1 hour").groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@R.query("ts_rolling", "SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND INTERVAL 5 MINUTE FOLLOWING) AS n, MAX(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND INTERVAL 5 MINUTE FOLLOWING) AS most FROM events")
def ts_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    return timewindows.rolling(e, ["event_type"], "ts", 600, 300, n=F.count("*"), most=F.max("value")).select("event_id", "n", "most")


# Recursion over all orders: an order leads to the one of three times its key
_EDGES = "SELECT o_orderkey AS src, o_orderkey * 3 AS dst FROM orders WHERE o_orderkey > 0 AND o_orderkey * 3 IN (SELECT o_orderkey FROM orders)"


@R.query("rec_closure", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT * FROM r")
def rec_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = load(spark, sf_dir, "orders")
    o.createOrReplaceTempView("orders")
    return recursion.transitive_closure(spark.sql(_EDGES))


@R.query("rec_mutual", "SELECT CAST(o_orderkey AS BIGINT) AS n FROM orders WHERE o_orderkey > 0 AND length(bin(o_orderkey)) % 2 = 1")
def rec_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys at even depth of the tree n -> 2n, 2n + 1 by two views that call each other: n is at even depth if its parent is at odd depth, and the other way round."""
    (o,) = load(spark, sf_dir, "orders")
    keys = o.select(F.col("o_orderkey").alias("n"))
    root = spark.createDataFrame([(1,)], "n long")
    rule = lambda other: lambda total, fresh: fresh[other].select(F.explode(F.array(F.col("n") * 2, F.col("n") * 2 + 1)).alias("n")).join(keys, "n", "left_semi")
    return recursion.fixed_point({"even": root, "odd": root.limit(0)}, {"even": rule("odd"), "odd": rule("even")})["even"]


@R.query("rec_view", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT * FROM r")
def rec_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure as a recursive view, after a change that deletes what another inserted."""
    p = Program(
        spark,
        """CREATE TABLE edge (src BIGINT, dst BIGINT);
        DECLARE RECURSIVE VIEW reach (src BIGINT, dst BIGINT);
        CREATE VIEW reach AS SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src;""",
    )
    load(spark, sf_dir, "orders")[0].createOrReplaceTempView("orders")
    extra = spark.createDataFrame([(-3, 1)], "src long, dst long")
    p.push("edge", spark.sql(_EDGES).unionAll(extra))
    p.step()
    p.push("edge", deletes=extra)
    p.step()
    return p.snapshot("reach")


# Change streams: every seventh event is deleted again by a later change
_LEFT = "SELECT * FROM events WHERE event_id % 7 <> 0"


def _changes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    (e,) = load(spark, sf_dir, "events")
    e = e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return [zset.weighted(e.where("event_id % 2 = 0")), zset.plus(zset.weighted(e.where("event_id % 2 = 1")), zset.weighted(e.where("event_id % 14 = 0"), -1)), zset.weighted(e.where("event_id % 7 = 0 AND event_id % 2 = 1"), -1)]


_CENTS = "CAST(round(value * 100) AS BIGINT)"


@R.query("zset_integrate", f"SELECT event_id, user_id, event_type, {_CENTS} AS cents, CAST(1 AS BIGINT) AS _w FROM ({_LEFT})")
def zset_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zset.integrate(*_changes(spark, sf_dir))


@R.query("zset_differentiate", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS _w FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 OR event_id % 2 <> 0 AND event_id % 3 = 0")
def zset_differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    return zset.differentiate(e.where("event_id % 3 = 0").select("event_id"), e.where("event_id % 2 = 0").select("event_id"))


@R.query("zset_distinct", f"SELECT DISTINCT user_id, event_type, CAST(1 AS BIGINT) AS _w FROM ({_LEFT})")
def zset_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zset.distinct(zset.plus(*[c.select("user_id", "event_type", W) for c in _changes(spark, sf_dir)]))


@R.query("zset_distinct_delta", f"SELECT DISTINCT user_id, event_type FROM ({_LEFT})")
def zset_distinct_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the changes of a distinct relation."""
    counts, out = None, []
    for c in _changes(spark, sf_dir):
        c = saved(c.select("user_id", "event_type", W), "change")
        counts = counts if counts is not None else c.limit(0)
        out.append(zset.distinct_delta(counts, c))
        counts = saved(zset.integrate(counts, c), "counts")
    return zset.integrate(*out).select("user_id", "event_type")


@R.query("zset_linear_aggregate", f"SELECT user_id, COUNT(*) AS n_, CAST(SUM({_CENTS}) AS BIGINT) AS total FROM ({_LEFT}) GROUP BY user_id")
def zset_linear_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums kept from changes alone."""
    state, out = None, []
    for c in _changes(spark, sf_dir):
        delta, state = zset.linear_delta(state, saved(c, "change"), ["user_id"], {"total": "cents"})
        state = saved(state, "groups")
        out.append(saved(delta, "delta"))
    return zset.integrate(*out).select("user_id", "n_", "total")


@R.query("zset_negate_positive", "SELECT event_id, CAST(1 AS BIGINT) AS _w FROM events WHERE event_id % 7 = 0")
def zset_negate_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zset.positive(zset.negate(zset.plus(*_changes(spark, sf_dir)[1:]).select("event_id", W)))


_VIEWS = {
    "ivm_filter": ("SELECT event_id, cents FROM ev WHERE cents > 2000", f"SELECT event_id, {_CENTS} AS cents FROM ({_LEFT}) WHERE {_CENTS} > 2000"),
    "ivm_join": ("SELECT a.event_id AS e1, b.event_id AS e2 FROM ev a JOIN kinds k ON a.event_type = k.kind JOIN ev b ON a.user_id = b.user_id AND b.event_id = a.event_id + 150", f"WITH l AS ({_LEFT}) SELECT a.event_id AS e1, b.event_id AS e2 FROM l a JOIN l b ON a.user_id = b.user_id AND b.event_id = a.event_id + 150 WHERE a.event_type IN ('click', 'view')"),
    "ivm_group": ("SELECT event_type, COUNT(*) AS n, SUM(cents) AS s, MAX(cents) AS m FROM ev GROUP BY event_type", f"SELECT event_type, COUNT(*) AS n, CAST(SUM({_CENTS}) AS BIGINT) AS s, MAX({_CENTS}) AS m FROM ({_LEFT}) GROUP BY event_type"),
    "ivm_totals": ("SELECT event_type, COUNT(*) AS n, COUNT(cents) AS known, SUM(cents) AS s, AVG(cents) AS mean FROM ev GROUP BY event_type", f"SELECT event_type, COUNT(*) AS n, COUNT({_CENTS}) AS known, CAST(SUM({_CENTS}) AS BIGINT) AS s, CAST(trunc(AVG({_CENTS})) AS BIGINT) AS mean FROM ({_LEFT}) GROUP BY event_type"),
    "ivm_everything": ("SELECT COUNT(*) AS n, SUM(cents) AS s FROM ev WHERE event_type <> 'error'", f"SELECT COUNT(*) AS n, CAST(SUM({_CENTS}) AS BIGINT) AS s FROM ({_LEFT}) WHERE event_type <> 'error'"),
    "ivm_join_totals": ("SELECT k.kind, COUNT(*) AS n, SUM(cents) AS s FROM ev JOIN kinds k ON event_type = k.kind GROUP BY k.kind", f"SELECT event_type AS kind, COUNT(*) AS n, CAST(SUM({_CENTS}) AS BIGINT) AS s FROM ({_LEFT}) WHERE event_type IN ('click', 'view') GROUP BY event_type"),
    "ivm_distinct": ("SELECT DISTINCT user_id, event_type FROM ev", f"SELECT DISTINCT user_id, event_type FROM ({_LEFT})"),
    "ivm_window": ("SELECT event_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) AS rn FROM ev", f"SELECT event_id, user_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY {_CENTS} DESC, event_id) AS INTEGER) AS rn FROM ({_LEFT})"),
    "ivm_topk": ("SELECT user_id, event_id FROM ev QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) <= 2", f"SELECT user_id, event_id FROM ({_LEFT}) QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY {_CENTS} DESC, event_id) <= 2"),
    "ivm_outer_join": ("SELECT kind, COUNT(event_id) AS n FROM kinds LEFT JOIN ev ON kind = event_type AND cents > 4000 GROUP BY kind", f"SELECT kind, COUNT(event_id) AS n FROM (VALUES ('click'), ('view'), ('none')) k(kind) LEFT JOIN (SELECT * FROM ({_LEFT}) WHERE {_CENTS} > 4000) ON kind = event_type GROUP BY kind"),
    "ivm_union": ("SELECT event_id FROM ev WHERE cents < 100 UNION ALL SELECT event_id FROM ev WHERE event_type = 'error'", f"SELECT event_id FROM ({_LEFT}) WHERE {_CENTS} < 100 UNION ALL SELECT event_id FROM ({_LEFT}) WHERE event_type = 'error'"),
    "ivm_chain": ("SELECT user_id, COUNT(*) AS n FROM big GROUP BY user_id", f"SELECT user_id, COUNT(*) AS n FROM ({_LEFT}) WHERE {_CENTS} > 1000 GROUP BY user_id"),
}


def _ivm(view: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The sum of all changes that a maintained view reported."""
        p = Program(spark, f"CREATE TABLE ev (event_id BIGINT, user_id BIGINT, event_type VARCHAR, cents BIGINT); CREATE TABLE kinds (kind VARCHAR); CREATE LOCAL VIEW big AS SELECT user_id, event_id FROM ev WHERE cents > 1000; CREATE VIEW v AS {view};")
        p.push("kinds", spark.createDataFrame([("click",), ("view",), ("none",)], "kind string"))
        out = []
        for c in _changes(spark, sf_dir):
            p.push("ev", change=c)
            out += [d for n, d in p.step().items() if n == "v"]
        total = zset.integrate(*out)
        return zset.expanded(total)

    return run


for _name, (_view, _oracle) in _VIEWS.items():
    R.query(_name, _oracle)(_ivm(_view))


@R.query("stream_upsert_table", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def stream_upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a primary key keeps the last row of each key."""
    (e,) = load(spark, sf_dir, "events")
    last = lambda df: df.where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))
    p = Program(spark, "CREATE TABLE t (user_id BIGINT NOT NULL PRIMARY KEY, event_id BIGINT); CREATE VIEW v AS SELECT user_id, event_id FROM t;")
    half = e.where("event_id < 5000")
    p.push("t", last(half))
    p.step()
    p.push("t", last(e))
    p.step()
    return p.snapshot("v")


@R.query("stream_lateness", "SELECT event_id FROM events WHERE event_id < 5000 OR ts >= (SELECT max(ts) FROM events WHERE event_id < 5000) - INTERVAL 1 DAY")
def stream_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows older than the waterline of earlier steps drop out."""
    (e,) = load(spark, sf_dir, "events")
    e = e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    p = Program(spark, "CREATE TABLE t (event_id BIGINT, ts TIMESTAMP LATENESS INTERVAL '1' DAY); CREATE VIEW v AS SELECT event_id FROM t;")
    p.push("t", e.where("event_id < 5000"))
    p.step()
    p.push("t", e.where("event_id >= 5000"))
    p.step()
    return p.snapshot("v")


@R.query("stream_temporal_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 2 DAY AND ts <= TIMESTAMP '2024-01-10 00:00:00'")
def stream_temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on NOW() follows the clock: the sum of changes is what the last clock value shows."""
    import datetime as dt

    (e,) = load(spark, sf_dir, "events")
    p = Program(spark, "CREATE TABLE t (event_id BIGINT, ts TIMESTAMP); CREATE VIEW v AS SELECT event_id FROM t WHERE ts >= NOW() - INTERVAL '2' DAY AND ts <= NOW();")
    p.push("t", e.select("event_id", "ts"))
    out = [p.step(dt.datetime(2024, 1, 5))["v"], p.step(dt.datetime(2024, 1, 10))["v"]]
    return zset.expanded(zset.integrate(*out))


@R.query("stream_emit_final", "SELECT user_id, h, n FROM (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS h, COUNT(*) AS n FROM events GROUP BY ALL) WHERE h < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_emit_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only groups below the waterline, which can't change any more."""
    (e,) = load(spark, sf_dir, "events")
    p = Program(
        spark,
        """CREATE TABLE t (user_id BIGINT, ts TIMESTAMP LATENESS INTERVAL '1' HOUR);
        CREATE VIEW v WITH ('emit_final' = 'h') AS SELECT user_id, h, COUNT(*) AS n FROM (SELECT user_id, DATE_TRUNC_HOUR AS h FROM (SELECT user_id, TIMESTAMP_TRUNC(ts, HOUR) AS DATE_TRUNC_HOUR FROM t)) GROUP BY user_id, h;""",
    )
    p.push("t", e.select("user_id", "ts"))
    final = p.step()["v"]
    return zset.expanded(final).select("user_id", F.col("h").cast("timestamp_ntz").alias("h"), "n")


@R.query("stream_structured", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream through Structured Streaming into a program, until it is used up."""
    (e,) = load(spark, sf_dir, "events")
    folder = fresh_path(spark, "stream-in")
    e.select("event_id", "event_type").repartition(3).write.parquet(folder)
    p = Program(spark, "CREATE TABLE t (event_id BIGINT, event_type VARCHAR); CREATE VIEW v AS SELECT event_type, COUNT(*) AS n FROM t GROUP BY event_type;")
    stream = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 2).parquet(folder)
    for q in p.run({"t": stream}, folder.replace("stream-in", "stream-checkpoint")):
        q.awaitTermination()
    return p.snapshot("v")


@R.query("stream_watermark_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, COUNT(*) AS n FROM events GROUP BY ALL")
def stream_watermark_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A windowed count by Spark's own state store, with a watermark."""
    (e,) = load(spark, sf_dir, "events")
    folder = fresh_path(spark, "stream-in")
    e.select(F.col("ts").cast("timestamp").alias("ts")).write.parquet(folder)
    name = f"watermarked_{uuid.uuid4().hex}"
    counts = spark.readStream.schema("ts timestamp").parquet(folder).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@R.query("stream_transaction", "SELECT CAST(1 AS BIGINT) AS steps, COUNT(*) AS n FROM events")
def stream_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several pushes within a transaction are one step."""
    (e,) = load(spark, sf_dir, "events")
    p = Program(spark, "CREATE TABLE t (event_id BIGINT); CREATE VIEW v AS SELECT COUNT(*) AS n FROM t;")
    p.begin()
    for i in range(3):
        p.push("t", e.where(F.col("event_id") % 3 == i).select("event_id"))
    p.commit()
    return p.snapshot("v").select(F.lit(p.steps).cast("long").alias("steps"), "n")


@R.query("stream_error_view", "SELECT COUNT(*) AS late FROM events WHERE event_id >= 5000 AND ts < (SELECT max(ts) FROM events WHERE event_id < 5000) + INTERVAL 1 DAY")
def stream_error_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows are reported; here the waterline runs a day ahead."""
    (e,) = load(spark, sf_dir, "events")
    p = Program(spark, "CREATE TABLE t (event_id BIGINT, ts TIMESTAMP LATENESS INTERVAL '-1' DAY); CREATE VIEW v AS SELECT event_id FROM t;")
    for half in ("event_id < 5000", "event_id >= 5000"):
        p.push("t", e.where(half).select("event_id", "ts"))
        p.step()
    return p.error_view().agg(F.count("*").alias("late"))


@R.query("stream_checkpoint", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that stops half way and goes on from its checkpoint."""
    (e,) = load(spark, sf_dir, "events")
    sql = "CREATE TABLE t (event_id BIGINT, event_type VARCHAR); CREATE VIEW v AS SELECT event_type, COUNT(*) AS n FROM t GROUP BY event_type;"
    path = fresh_path(spark, "checkpoint")
    p = Program(spark, sql)
    p.push("t", e.where("event_id < 5000").select("event_id", "event_type"))
    p.step()
    p.checkpoint(path)
    q = Program.resume(spark, sql, path)
    q.push("t", e.where("event_id >= 5000").select("event_id", "event_type"))
    q.step()
    return q.snapshot("v")


@R.query("stream_resume", "SELECT event_type, COUNT(*) AS n, MAX(user_id) AS top FROM events GROUP BY event_type")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program resumed after steps enough for its logs to have been compacted, from a checkpoint before them."""
    (e,) = load(spark, sf_dir, "events")
    sql = "CREATE TABLE t (event_id BIGINT, user_id BIGINT, event_type VARCHAR); CREATE VIEW v AS SELECT event_type, COUNT(*) AS n, MAX(user_id) AS top FROM t GROUP BY event_type;"
    part = lambda i: e.where(F.col("event_id") % 5 == i).select("event_id", "user_id", "event_type")
    path = fresh_path(spark, "checkpoint")
    p = Program(spark, sql)
    p.tables["t"].state.compact_after = 2
    for i in range(5):
        if i == 2:
            p.checkpoint(path)
        p.push("t", part(i))
        p.step()
    q = Program.resume(spark, sql, path)
    for i in range(2, 5):
        q.push("t", part(i))
        q.step()
    return q.snapshot("v")


@R.query("sink_index", "SELECT 'update' AS op, event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def sink_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that takes a view's changes as upserts by an index of it."""
    (e,) = load(spark, sf_dir, "events")
    p = Program(spark, "CREATE TABLE t (event_id BIGINT, event_type VARCHAR); CREATE VIEW v AS SELECT event_type, COUNT(*) AS n FROM t GROUP BY event_type; CREATE INDEX by_type ON v (event_type);")
    got = []
    p.listen("v", lambda step, change: got.append(change), index="by_type")
    for i in range(2):
        p.push("t", e.where(F.col("event_id") % 2 == i).select("event_id", "event_type"))
        p.step()
    return got[-1]


@R.query("table_defaults", "SELECT n_nationkey AS k, 7 AS v, 'none' AS s FROM nation")
def table_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    (n,) = load(spark, sf_dir, "nation")
    p = Program(spark, "CREATE TABLE t (k INT, v INT DEFAULT 7, s VARCHAR DEFAULT 'none'); CREATE VIEW w AS SELECT k, v, s FROM t;")
    p.push("t", n.select(F.col("n_nationkey").alias("k")))
    return zset.expanded(p.step()["w"])


@R.query("table_types", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")
def table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of a user's type."""
    (n,) = load(spark, sf_dir, "nation")
    p = Program(spark, "CREATE TYPE place AS (name VARCHAR, r INT); CREATE TABLE t (k INT, p place); CREATE VIEW w AS SELECT k, t.p.name AS name, t.p.r AS r FROM t;")
    p.push("t", n.select(F.col("n_nationkey").alias("k"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("r")).alias("p")))
    return zset.expanded(p.step()["w"])


@R.query("table_append_only", "SELECT n_regionkey AS r, MAX(n_nationkey) AS top, TRUE AS refused FROM nation GROUP BY n_regionkey")
def table_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrema of a table that takes insertions only."""
    (n,) = load(spark, sf_dir, "nation")
    p = Program(spark, "CREATE TABLE t (k INT, r INT) WITH ('append_only' = 'true'); CREATE VIEW v AS SELECT r, MAX(k) AS top FROM t GROUP BY r;")
    rows = n.select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_regionkey").cast("int").alias("r"))
    for i in range(2):
        p.push("t", rows.where(F.col("k") % 2 == i))
        p.step()
    try:
        p.push("t", deletes=rows)
        refused = False
    except ValueError:
        refused = True
    return p.snapshot("v").withColumn("refused", F.lit(refused))


@R.query("adhoc_insert", "SELECT n_regionkey AS r, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def adhoc_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "nation")[0].createOrReplaceTempView("nation")
    p = Program(spark, "CREATE TABLE t (k INT, r INT); CREATE MATERIALIZED VIEW v AS SELECT r, COUNT(*) AS n FROM t GROUP BY r; INSERT INTO t (r, k) SELECT n_regionkey, n_nationkey FROM nation;")
    p.step()
    return p.query("SELECT r, n FROM v")


@R.query("udf_sql", "SELECT n_nationkey, n_nationkey * 2 + 1 AS v FROM nation")
def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "nation")[0].createOrReplaceTempView("nation")
    return Program(spark, "CREATE FUNCTION twice_plus(a INT, b INT) RETURNS INT AS a * 2 + b;").query("SELECT n_nationkey, twice_plus(n_nationkey, 1) AS v FROM nation")


@R.query("udf_external", "SELECT n_nationkey, upper(n_name) || '!' AS v FROM nation")
def udf_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "nation")[0].createOrReplaceTempView("nation")
    udf.create_function(spark, "shout", lambda s: s.str.upper() + "!", "string")
    return spark.sql("SELECT n_nationkey, shout(n_name) AS v FROM nation")


@R.query("udf_aggregate", "SELECT n_regionkey, CAST(SUM(n_nationkey * n_nationkey) AS DOUBLE) AS v FROM nation GROUP BY n_regionkey")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "nation")[0].createOrReplaceTempView("nation")

    def squares(x):
        return float((x.astype("float64") ** 2).sum())

    udf.create_aggregate(spark, "sum_of_squares", squares, "double")
    return spark.sql("SELECT n_regionkey, sum_of_squares(n_nationkey) AS v FROM nation GROUP BY n_regionkey")


@R.query("variant_deep_map", "SELECT event_id, CAST(props->>'k' AS BIGINT) + 1 AS v FROM events")
def variant_deep_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "events")[0].createOrReplaceTempView("events")
    udf.register_variant(spark, "plus_one", lambda x: x + 1)
    return spark.sql(translate("SELECT event_id, CAST(VARIANT_INDEX(VARIANT_DEEP_MAP(PARSE_JSON(props), 'plus_one'), 'k') AS BIGINT) AS v FROM events"))


# Sources, formats, sampling


@R.query("format_json_changes", "SELECT event_id, CAST(1 AS BIGINT) AS _w FROM events WHERE event_id % 7 <> 0")
def format_json_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes out as JSON envelopes and in again."""
    change = zset.plus(*_changes(spark, sf_dir)).select("event_id", W)
    texts = formats.encode_changes(change, "insert_delete")
    return zset.consolidate(formats.parse_changes(texts, "value", "event_id long", "insert_delete"))


@R.query("format_debezium", "SELECT event_id, user_id, CAST(1 AS BIGINT) AS _w FROM events WHERE event_id % 7 <> 0")
def format_debezium(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = zset.plus(*_changes(spark, sf_dir)).select("event_id", "user_id", W)
    return zset.consolidate(formats.parse_changes(formats.encode_changes(change, "debezium"), "value", "event_id long, user_id long", "debezium"))


@R.query("format_csv_roundtrip", "SELECT p_partkey, p_name, p_size FROM part")
def format_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = load(spark, sf_dir, "part")
    path = fresh_path(spark, "csv")
    p.select("p_partkey", "p_name", "p_size").write.option("header", "true").csv(path)
    return formats.read_csv(spark, path, "p_partkey long, p_name string, p_size int", headers=True)


@R.query("sink_upserts", "SELECT CASE WHEN p_size < 25 THEN 'update' ELSE 'delete' END AS op, p_partkey, CASE WHEN p_size < 25 THEN p_size + 1 END AS p_size FROM part")
def sink_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = load(spark, sf_dir, "part")
    old = p.select("p_partkey", "p_size")
    new = old.where("p_size < 25").select("p_partkey", (F.col("p_size") + 1).alias("p_size"))
    return formats.upserts(zset.differentiate(old, new), ["p_partkey"])


@R.query("source_datagen", "SELECT CAST(1000 AS BIGINT) AS n, TRUE AS in_range, TRUE AS skewed, CAST(1000 AS BIGINT) AS ids")
def source_datagen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datagen.generate(spark, {"id": {}, "u": {"strategy": "uniform", "range": [10, 20]}, "z": {"strategy": "zipf", "range": [0, 1000], "s": 1.3}, "name": {"strategy": "name"}, "key": {"strategy": "uuid"}}, 1000)
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.col("u").between(10, 19) & F.col("z").between(0, 999)).alias("in_range"), (F.count_if(F.col("z") == 0) > 100).alias("skewed"), F.countDistinct("key").alias("ids"))


@R.query("key_sample", "SELECT CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS known, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS keys FROM events")
def key_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten different keys, all of them of the table; and all keys, if more are asked for than there are."""
    (e,) = load(spark, sf_dir, "events")
    drawn = aggregates.key_sample(e, "user_id", 10).select("user_id").distinct()
    known = drawn.join(e.select("user_id"), "user_id", "left_semi").agg(F.count("*").alias("known"))
    every = aggregates.key_sample(e, "user_id", 1 << 30).agg(F.countDistinct("user_id").alias("keys"))
    return drawn.agg(F.count("*").alias("n")).crossJoin(known).crossJoin(every)


@R.query("key_quantiles", "SELECT unnest(quantile_disc(user_id, [0.25, 0.5, 0.75])) AS user_id FROM (SELECT DISTINCT user_id FROM events)")
def key_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    return aggregates.key_quantiles(e, "user_id", 4)
