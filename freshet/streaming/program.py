"""Programs: tables, views over them, and steps that turn changes of tables into changes of views.

A view's query is one SQL text. A step evaluates that text with its tables bound to different relations, so Catalyst plans
every delta like any other query:

* ``linear``: only projections, filters, UNION ALL and inner joins. The query is linear in each table, so
  its change is the sum over tables of the query with that table bound to the change, tables before it to their new and after it to their old state.
  A table that is joined with itself counts as several, one for each mention.
* ``groups``: COUNT, SUM and AVG over such an input, by columns or over all of it. They are linear too: the counts and sums of the change alone, added to
  the stored counts and sums of the groups it touches, give the new rows. Nothing else is read.
* ``keyed``: a GROUP BY, DISTINCT or window whose keys are output columns. The changes give the touched keys; the query runs over old and new
  state for those keys alone (a semi join that Catalyst pushes below the aggregate or window) and the results are subtracted.
* ``recompute``: everything else. The query runs over the new state, and the difference from the last result is the change.

Whatever the way, the sum of a view's changes equals its query over the current tables.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions import udf
from freshet.operators.recursion import fixed_point
from freshet.plans import ddl, typed, types
from freshet.plans.dialect import translate
from freshet.plans.shape import Sums, apart, sums_of
from freshet.session import configure
from freshet.shared import delete, saved
from freshet.sources import formats
from freshet.streaming import zset
from freshet.streaming.state import StateLog
from freshet.streaming.zset import W

LINEAR = {"Project", "Filter", "SubqueryAlias", "View", "Union", "Join", "LogicalRDD", "LogicalRelation", "LocalRelation", "Range", "Generate", "ResolvedHint"}
#: A change's place among the pushes of a step.
ORDER = "order_"
ERROR_COLUMNS = "table_or_view_name string, message string, metadata string"


@dataclass
class Table:
    name: str
    schema: T.StructType
    key: list[str]
    lateness: dict[str, str]
    options: dict[str, str]
    defaults: dict[str, str]
    state: StateLog
    limits: dict[str, int] = field(default_factory=dict)
    waterline: dict[str, object] = field(default_factory=dict)
    seen: dict[str, object] = field(default_factory=dict)


@dataclass
class View:
    name: str
    query: str
    local: bool = False
    materialized: bool = False
    emit_final: str | None = None
    strategy: str = ""
    keys: list[str] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    text: str = ""
    inputs: list[tuple[str, str]] = field(default_factory=list)
    sums: Sums | None = None
    groups: StateLog | None = None
    shown: bool = False
    last: DataFrame | None = None
    pending: DataFrame | None = None
    rules: list[str] = field(default_factory=list)


class Program:
    """A set of CREATE statements and the state behind them."""

    def __init__(self, spark: SparkSession, sql: str = "", now: dt.datetime | None = None):
        self.spark = configure(spark)
        udf.register(spark)
        self.tables: dict[str, Table] = {}
        self.views: dict[str, View] = {}
        self.indexes: dict[str, tuple[str, list[str]]] = {}
        self.options: dict[str, str] = {}
        self.recursive: dict[str, T.StructType] = {}
        self.queue: dict[str, list[DataFrame]] = {}
        self.sinks: dict[str, list[Callable[[int, DataFrame], None]]] = {}
        self.errors: list[DataFrame] = []
        self.applied: dict[str, int] = {}
        self.now, self.steps, self.open = now or dt.datetime(1970, 1, 1), 0, False
        self._serial = 0
        self._lock = threading.RLock()
        self._spent: list[tuple[int, str]] = []
        self._swept: dict[str, list[str]] = {}
        if sql:
            self.execute(sql)

    # Statements

    def execute(self, sql: str) -> None:
        for s in ddl.statements(sql):
            getattr(self, f"_{s.kind}")(s)

    def _create_table(self, s: ddl.Statement) -> None:
        schema = T.StructType([T.StructField(c.name, self.spark.createDataFrame([], f"c {c.type}").schema[0].dataType, c.nullable) for c in s.columns])
        lateness = {c.name: c.lateness for c in s.columns if c.lateness}
        defaults = {c.name: c.default for c in s.columns if c.default}
        limits = {c.name: c.limit for c in s.columns if c.limit is not None}
        self.tables[s.name] = Table(s.name, schema, s.key, lateness, s.options, defaults, StateLog(self.spark, s.name, schema, s.key), limits)
        self._bind(s.name, self.tables[s.name].state.relation())

    def _create_view(self, s: ddl.Statement) -> None:
        v = View(s.name, s.query, s.local, s.materialized or s.name in self.recursive, s.options.get("emit_final"))
        if s.name in self.recursive:
            v.strategy = "recursive"
            v.uses = list(self.tables)
            v.last = self.spark.createDataFrame([], self.recursive[s.name])
            self._bind(s.name, v.last)
        else:
            df = self._sql(s.query)
            v.uses = [n for n in (*self.tables, *self.views) if ddl.mentions(s.query, n)]
            v.text, v.inputs = apart(s.query, v.uses)
            v.strategy, v.keys = self._strategy(v)
            if v.strategy == "groups":
                v.groups = StateLog(self.spark, f"{s.name}-groups", v.sums.schema, v.sums.keys, fold=lambda log, v=v: zset.weighted(self._totals(v, log)))
                df = self._shown(v)
            self._bind(s.name, df)
            v.last = saved(df, "view") if v.strategy == "recompute" else None
        self.views[s.name] = v

    def _declare_recursive(self, s: ddl.Statement) -> None:
        self.recursive[s.name] = T.StructType([T.StructField(c.name, self.spark.createDataFrame([], f"c {c.type}").schema[0].dataType) for c in s.columns])
        self._bind(s.name, self.spark.createDataFrame([], self.recursive[s.name]))

    def _create_type(self, s: ddl.Statement) -> None:
        types.define(s.name, s.type)

    def _create_function(self, s: ddl.Statement) -> None:
        args = ", ".join(f"{c.name} {c.type}" for c in s.columns)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {s.name}({args}) RETURNS {s.type} RETURN {translate(s.query, self._now_text())}")

    def _create_index(self, s: ddl.Statement) -> None:
        self.indexes[s.name] = (s.target, s.key)

    def _set(self, s: ddl.Statement) -> None:
        self.options[s.name] = s.query

    def _lateness(self, s: ddl.Statement) -> None:
        self.tables[s.target].lateness[s.key[0]] = s.query

    def _insert(self, s: ddl.Statement) -> None:
        names = s.key or self.tables[s.target].schema.fieldNames()
        self.push(s.target, self._sql(s.query).toDF(*names))

    def _select(self, s: ddl.Statement) -> None:
        raise ValueError("a program holds no bare SELECT; use query()")

    # Strategy

    def _strategy(self, v: View) -> tuple[str, list[str]]:
        """How to maintain a view, from the plan of its query over bare relations in place of tables and other views."""
        if ddl.mentions(v.query, "NOW"):
            return "recompute", []
        bound = {u: self.spark.table(u) for u in v.uses}
        empty = {u: self.spark.createDataFrame([], t.schema) for u, t in bound.items()}
        try:
            df = self._with({name: empty[u] for name, u in v.inputs}, v.text)
            plan = df._jdf.queryExecution().analyzed()
            nodes = self._nodes(plan)
            names = [p.alias().lower() for p in nodes if p.nodeName() == "SubqueryAlias"]
            if any(names.count(name.lower()) > 1 for name, _ in v.inputs) and any(p.nodeName() == "Join" for p in nodes):
                return "recompute", []  # a table joined with itself in a way that can't be told apart: the query isn't linear in it
            if self._linear(plan):
                return "linear", []
            if self._sums(v, plan, empty, df.schema):
                return "groups", v.sums.keys
            keys = self._keys(plan, df.columns)
            return ("keyed", keys) if keys else ("recompute", [])
        finally:
            for u, t in bound.items():
                self._bind(u, t)

    def _sums(self, v: View, plan, empty: dict[str, DataFrame], schema: T.StructType) -> bool:
        """Whether the view is counts and sums of whole or decimal numbers over a linear input; then its partial query and the state's schema are known."""
        while plan.nodeName() == "SubqueryAlias":
            plan = plan.children().apply(0)
        if plan.nodeName() == "Project" and plan.children().apply(0).nodeName() == "Aggregate":
            plan = plan.children().apply(0)
        if plan.nodeName() != "Aggregate" or not self._linear(plan.children().apply(0)):
            return False
        sums = sums_of(v.text, schema)
        if sums is None:
            return False
        part = self._with({name: empty[u] for name, u in v.inputs}, sums.partial).schema
        if any(not isinstance(part[c].dataType, (T.IntegralType, T.DecimalType)) for c in sums.added):
            return False  # sums of doubles don't subtract exactly
        wide = lambda t: T.DecimalType(38, t.scale) if isinstance(t, T.DecimalType) else T.LongType()
        sums.schema = T.StructType([*[part[k] for k in sums.keys], *[T.StructField(c, wide(part[c].dataType)) for c in sums.added]])
        v.sums = sums
        return True

    def _nodes(self, plan) -> list:
        out, todo = [], [plan]
        while todo:
            p = todo.pop()
            out.append(p)
            kids = p.children()
            todo += [kids.apply(i) for i in range(kids.size())]
        return out

    def _linear(self, plan) -> bool:
        for p in self._nodes(plan):
            name = p.nodeName().split(" ")[0]
            if name not in LINEAR or name == "Join" and p.joinType().toString() not in ("Inner", "Cross") or "SubqueryExpression" in str(p.getClass()) or "-subquery" in p.expressions().toString() or "exists#" in p.expressions().toString() or "list#" in p.expressions().toString():
                return False
        return True

    def _keys(self, plan, names: list[str]) -> list[str]:
        """Output columns that hold the keys of the topmost aggregate, distinct or window; none if its input isn't linear or they aren't all there."""
        while plan.nodeName() in ("SubqueryAlias", "Project") and plan.children().size() == 1 and plan.children().apply(0).nodeName() != "Aggregate" and plan.nodeName() == "SubqueryAlias":
            plan = plan.children().apply(0)
        kind = plan.nodeName()
        if kind == "Distinct":
            return names if self._linear(plan.children().apply(0)) else []
        if kind == "Aggregate" and self._linear(plan.children().apply(0)):
            groups, outs, found, hit = plan.groupingExpressions(), plan.aggregateExpressions(), [], set()
            for i in range(outs.size()):
                e = outs.apply(i)
                child = e.children().apply(0) if e.getClass().getSimpleName() == "Alias" else e
                for j in range(groups.size()):
                    if groups.apply(j).semanticEquals(child):
                        found.append(e.name())
                        hit.add(j)
            return found if groups.size() and len(hit) == groups.size() else []
        if kind == "Project":
            below = plan.children().apply(0)
            while below.nodeName() == "Project":
                below = below.children().apply(0)
            if below.nodeName() == "Window" and self._linear(below.children().apply(0)):
                parts = below.partitionSpec()
                ids = {parts.apply(i).exprId().toString() if hasattr(parts.apply(i), "exprId") else "" for i in range(parts.size())}
                outs = plan.projectList()
                found = [outs.apply(i).name() for i in range(outs.size()) if outs.apply(i).getClass().getSimpleName() == "AttributeReference" and outs.apply(i).exprId().toString() in ids]
                return found if parts.size() and len(found) == parts.size() else []
        return []

    # Changes

    def push(self, table: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, change: DataFrame | None = None) -> None:
        """Queue changes of a table for the next step: inserted and deleted rows, or a Z-set."""
        if deletes is not None and self.tables[table].options.get("append_only") == "true":
            raise ValueError(f"{table} only takes inserts")
        with self._lock:
            for df, w in ((deletes, -1), (inserts, 1)):  # an update may come as both
                if df is not None:
                    self._queue(table, zset.weighted(self._shaped(table, df), w))
            if change is not None:
                self._queue(table, self._shaped(table, change, keep=[W]))
        if not self.open and self.options.get("autostep") == "true":
            self.step()

    def _queue(self, table: str, z: DataFrame) -> None:
        self._serial += 1
        self.queue.setdefault(table, []).append(z.withColumn(ORDER, F.lit(self._serial)))

    def _shaped(self, table: str, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        t = self.tables[table]
        if t.options.get("append_only") == "true" and W in df.columns:
            df = df.withColumn(W, F.when(F.col(W) > 0, F.col(W)).otherwise(F.raise_error(F.lit(f"{table} only takes inserts")).cast("long")))
        for column, limit in t.limits.items():
            if column in df.columns:
                inside = F.col(column).isNull() | F.col(column).between(0, limit)
                df = df.withColumn(column, F.when(inside, F.col(column)).otherwise(F.raise_error(F.lit(f"{column} is out of range")).cast("long")))
        cols = [
            (F.col(f"`{f.name}`") if f.name in df.columns else F.expr(translate(t.defaults[f.name])) if f.name in t.defaults else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in t.schema
        ]
        return df.select(*cols, *(keep or []))

    def begin(self) -> None:
        """Start a transaction: pushes count as one change until commit()."""
        self.open = True

    def commit(self) -> dict[str, DataFrame]:
        self.open = False
        return self.step()

    def listen(self, view: str, sink: Callable[[int, DataFrame], None], send_snapshot: bool = False, buffer_steps: int = 1, index: str | None = None) -> None:
        """Call ``sink(step, change)`` with every change of a view, or with the sum of ``buffer_steps`` of them; first with all of it, if asked.

        With ``index``, made by CREATE INDEX on the view, changes come as upserts by its key: (op, columns). A step that is run again after a failure has the same number, so a sink can tell."""
        if index is not None:
            target, key = self.indexes[index]
            if target != view:
                raise ValueError(f"{index} is an index of {target}")
            keyed = sink

            def sink(step: int, change: DataFrame) -> None:
                keyed(step, formats.upserts(change, key))

        if send_snapshot:
            sink(self.steps, zset.consolidate(zset.weighted(self.spark.table(view))))
        if buffer_steps > 1:
            held: list[DataFrame] = []
            direct = sink

            def sink(step: int, change: DataFrame) -> None:
                held.append(change)
                if len(held) == buffer_steps:
                    direct(step, zset.integrate(*held))
                    held.clear()

        self.sinks.setdefault(view, []).append(sink)

    def step(self, now: dt.datetime | None = None) -> dict[str, DataFrame]:
        """Apply what is queued; the changes of all views that are not local, as Z-sets."""
        if now is not None:
            if now < self.now:
                raise ValueError("the clock never goes back")
            self.now = now
        with self._lock:
            return self._step()

    def _step(self) -> dict[str, DataFrame]:
        self.steps += 1
        old = {n: self.spark.table(n) for n in (*self.tables, *self.views)}
        deltas: dict[str, DataFrame] = {}
        for name, parts in self.queue.items():
            t = self.tables[name]
            d = self._upserted(t, self._accepted(t, zset.plus(*parts)))
            deltas[name] = t.state.append(zset.consolidate(d), self.steps)
        self.queue = {}
        new = dict(old)
        for name in deltas:
            new[name] = self.tables[name].state.relation()
            self._bind(name, new[name])
        out = {}
        for v in self.views.values():
            if v.local and v.strategy in ("linear", "keyed") and not any(v.name in w.uses for w in self.views.values()):
                if any(u in deltas for u in v.uses):  # nobody asks for its changes
                    self._bind(v.name, self._sql(v.query))
                    new[v.name] = self.spark.table(v.name)
                continue
            d = self._view_delta(v, old, new, deltas)
            if d is None:
                continue
            if v.strategy != "groups":
                d = saved(d, "change")
            deltas[v.name] = d
            shown = self._final(v, d)
            if not v.local:
                out[v.name] = shown
                for sink in self.sinks.get(v.name, []):
                    sink(self.steps, shown)
        for t in self.tables.values():  # what this step has seen bounds the next
            t.waterline.update(t.seen)
        # What a step has written for itself alone goes when the next one is done: a reader of the last snapshot may still be at it.
        for _, path in [x for x in self._spent if x[0] < self.steps]:
            delete(self.spark, path)
        self._spent = [x for x in self._spent if x[0] >= self.steps]
        self._swept = {log.path: log.sweep(self._swept.get(log.path, [])) for log in self._logs()}
        return out

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """saved(), for this step's use."""
        out = saved(df, name)
        self._spent.append((self.steps, out.saved_path))
        return out

    def _view_delta(self, v: View, old: dict[str, DataFrame], new: dict[str, DataFrame], deltas: dict[str, DataFrame]) -> DataFrame | None:
        changed = [u for u in v.uses if u in deltas]
        if not changed and not (v.strategy == "recompute" and ddl.mentions(v.query, "NOW")):
            return None
        if v.strategy == "recursive":
            return self._recursive_delta(v, old, new)
        run = lambda binding, text=v.text: self._with({name: binding.get(name, binding.get(u)) for name, u in v.inputs}, text)
        try:
            if v.strategy == "linear":
                parts = []
                for ins, del_ in self._bindings(v, old, new, deltas):
                    parts += [zset.weighted(run(ins)), zset.weighted(run(del_), -1)]
                return zset.consolidate(zset.plus(*parts))
            if v.strategy == "groups":
                return self._groups_delta(v, [z for pair in self._bindings(v, old, new, deltas) for z in zip((run(b, v.sums.partial) for b in pair), (1, -1))])
            if v.strategy == "keyed":
                touched = None
                for name, u in v.inputs:
                    if u in deltas:
                        both = {x: new[x] if x not in deltas else new[x].unionAll(old[x]) for x in v.uses}
                        rows = run({**both, name: deltas[u].drop(W)}).select(*v.keys)
                        touched = rows if touched is None else touched.unionAll(rows)
                touched = self._kept(touched.distinct(), "touched")
                some = lambda df: df.join(touched.toDF(*[f"t{i}_" for i in range(len(v.keys))]), [df[k].eqNullSafe(F.col(f"t{i}_")) for i, k in enumerate(v.keys)], "left_semi")
                return zset.differentiate(some(run(old)), some(run(new)))
            after = saved(run(new), "view")
            before, v.last = v.last, after
            if hasattr(before, "saved_path"):
                self._spent.append((self.steps, before.saved_path))
            return zset.differentiate(before, after)
        finally:
            for u in v.uses:
                self._bind(u, new[u])
            new[v.name] = v.last if v.strategy == "recompute" else self._shown(v) if v.strategy == "groups" else self._sql(v.query)
            self._bind(v.name, new[v.name])

    def _bindings(self, v: View, old: dict[str, DataFrame], new: dict[str, DataFrame], deltas: dict[str, DataFrame]) -> list[tuple[dict[str, DataFrame], dict[str, DataFrame]]]:
        """For each changed input: what all inputs are bound to for its insertions, and for its deletions."""
        out = []
        for i, (name, u) in enumerate(v.inputs):
            if u in deltas:
                rest = {n: (new if k < i else old)[x] for k, (n, x) in enumerate(v.inputs)}
                ins, del_ = zset.split(deltas[u])
                out.append(({**rest, name: ins}, {**rest, name: del_}))
        return out

    def _groups_delta(self, v: View, partials: list[tuple[DataFrame, int]]) -> DataFrame:
        """The change of counts and sums: the stored ones of the touched groups go, with the change's added they come again."""
        keys, added = v.sums.keys, v.sums.added
        parts = [p.select(*keys, *[(F.coalesce(F.col(c), F.lit(0)) * sign).cast(v.sums.schema[c].dataType).alias(c) for c in added], F.lit(1).cast("long").alias(W)) for p, sign in partials]
        change = self._kept(zset.weighted(self._totals(v, zset.plus(*parts))), "partial")
        held = v.groups.log(change.select(*keys) if keys else None)
        if keys:
            t = change.select(*[F.col(k).alias(f"t{i}_") for i, k in enumerate(keys)])
            held = held.join(t, [held[k].eqNullSafe(F.col(f"t{i}_")) for i, k in enumerate(keys)], "left_semi")
        rows = lambda z: self._rows(v, self._totals(v, z))
        before, after = rows(held), rows(held.select(*keys, *added).unionAll(change.select(*keys, *added)))
        if not keys and not v.shown:
            before = before.limit(0)  # an aggregate of everything has a row from its first change on
        v.shown = True
        out = saved(zset.differentiate(before, after), "change")
        v.groups.append(change, self.steps)
        return out

    def _totals(self, v: View, z: DataFrame) -> DataFrame:
        """Counts and sums added up by group; groups without any are left out."""
        some = F.lit(False)
        for c in v.sums.added:
            some = some | (F.col(c) != 0)
        return z.groupBy(*v.sums.keys).agg(*[F.sum(c).cast(v.sums.schema[c].dataType).alias(c) for c in v.sums.added]).where(some)

    def _rows(self, v: View, totals: DataFrame) -> DataFrame:
        """The view's rows of added up counts and sums."""
        if v.sums.keys:
            return totals.where(F.col(v.sums.rows) > 0).selectExpr(*v.sums.outputs)
        return totals.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in v.sums.added]).selectExpr(*v.sums.outputs)

    def _shown(self, v: View) -> DataFrame:
        return self._rows(v, self._totals(v, v.groups.log()))

    def _recursive_delta(self, v: View, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame | None:
        """Recursive views change together: the first of them recomputes all, each then gives its difference."""
        group = [x for x in self.views.values() if x.strategy == "recursive"]
        if v is group[0]:
            empty = {x.name: self.spark.createDataFrame([], self.recursive[x.name]) for x in group}

            def rule(x: View):
                def apply(total: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> DataFrame:
                    return self._with({**{u: new[u] for u in self.tables}, **total}, x.query).toDF(*self.recursive[x.name].fieldNames())

                return apply

            self._solved = fixed_point(empty, {x.name: rule(x) for x in group})
        before, after = v.last, self._solved[v.name]
        v.last = after
        new[v.name] = after
        self._bind(v.name, after)
        return zset.differentiate(before, after)

    def _with(self, binding: dict[str, DataFrame], query: str) -> DataFrame:
        for name, df in binding.items():
            self._bind(name, df)
        return self._sql(query)

    def _sql(self, query: str) -> DataFrame:
        return typed.run(self.spark, query, self._now_text())

    def _bind(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def _now_text(self) -> str:
        return f"TIMESTAMP_NTZ '{self.now:%Y-%m-%d %H:%M:%S.%f}'"

    # Tables

    def _upserted(self, t: Table, d: DataFrame) -> DataFrame:
        """Changes of a table with a key: an insert replaces the row of its key, a delete needs the key only."""
        if not t.key:
            return d.drop(ORDER)
        rest = [f.name for f in t.schema if f.name not in t.key]
        # Later pushes win, and within one an insertion; of several the greatest by a hash: any, but the same when a task runs again.
        plain = [f.name for f in t.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
        order = F.struct(ORDER, W, F.xxhash64(*plain))
        last = d.groupBy(*t.key).agg(F.max_by(F.struct(*rest, W) if rest else F.struct(W), order).alias("v_"))
        last = self._kept(last, "upserts")
        present = t.state.zset(last.select(*t.key)).join(last.select(*t.key), t.key, "left_semi")
        fresh = last.select(*t.key, "v_.*").where(F.col(W) > 0).select(*[f.name for f in t.schema], F.lit(1).cast("long").alias(W))
        return zset.plus(fresh, zset.negate(present))

    def _accepted(self, t: Table, d: DataFrame) -> DataFrame:
        """Rows not older than the waterline that earlier steps set; the others go to the error view."""
        if not t.lateness:
            return d
        d = self._kept(d, "arrived")
        late = F.lit(False)
        for column in t.lateness:
            if t.waterline.get(column) is not None:
                late = late | F.coalesce(F.col(column) < F.lit(t.waterline[column]), F.lit(False))
        bounds = d.where(F.col(W) > 0).agg(*[(F.max(c) - F.expr(translate(how))).alias(c) for c, how in t.lateness.items()]).first()
        for c in t.lateness:
            if bounds[c] is not None and (t.seen.get(c) is None or bounds[c] > t.seen[c]):
                t.seen[c] = bounds[c]
        rejected = d.where(late)
        message = F.lit(f"late row in {t.name}")
        found = saved(rejected.select(F.lit(t.name).alias("table_or_view_name"), message.alias("message"), F.to_json(F.struct(*[f.name for f in t.schema])).alias("metadata")), "errors")
        if not found.isEmpty():
            self.errors.append(found)
        return d.where(~late)

    def _final(self, v: View, d: DataFrame) -> DataFrame:
        """With emit_final on a column: only rows below the least waterline, held back until then."""
        if not v.emit_final:
            return d
        lines = [w for t in self.tables.values() for w in t.seen.values() if w is not None]
        held = d if v.pending is None else zset.integrate(v.pending, d)
        if not lines:
            v.pending = saved(held, "pending")
            return d.limit(0)
        done = F.col(v.emit_final) < F.lit(min(lines))
        v.pending = saved(held.where(~F.coalesce(done, F.lit(False))), "pending")
        return held.where(done)

    # Reading

    def query(self, sql: str) -> DataFrame:
        """An ad-hoc query over the current tables and views."""
        return self._sql(sql)

    def snapshot(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def error_view(self) -> DataFrame:
        out = self.spark.createDataFrame([], ERROR_COLUMNS)
        for part in self.errors:
            out = out.unionAll(part)
        return out

    # Checkpoints

    def checkpoint(self, path: str) -> None:
        """Write what is needed to go on from here. Tables' and groups' segments are in the shared folder and stay there as long as a checkpoint names them;
        results of recomputed views, held-back rows and errors are copied beside ``path``."""
        with self._lock:
            stamp = lambda x: {k: str(v) for k, v in x.items() if v is not None}
            beside = f"{path.rstrip('/')}-rows/step={self.steps}"

            def copied(df: DataFrame | None, name: str) -> str | None:
                if df is None:
                    return None
                df.write.mode("overwrite").parquet(f"{beside}/{name}")
                return f"{beside}/{name}"

            log = lambda s: {"segments": s.segments, "weights": {k: s.weights[k] for k in s.segments if k in s.weights}}
            note = {
                "steps": self.steps,
                "now": self.now.isoformat(),
                "applied": self.applied,
                "tables": {n: {**log(t.state), "waterline": stamp(t.waterline), "seen": stamp(t.seen)} for n, t in self.tables.items()},
                "views": {n: {"last": copied(v.last, f"last-{n}"), "pending": copied(v.pending, f"pending-{n}"), "groups": v.groups and log(v.groups), "shown": v.shown} for n, v in self.views.items()},
                "errors": copied(self.error_view() if self.errors else None, "errors"),
            }
            self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(path)
            for s in self._logs():
                s.pin(path)

    def _logs(self) -> list[StateLog]:
        return [*[t.state for t in self.tables.values()], *[v.groups for v in self.views.values() if v.groups is not None]]

    @classmethod
    def resume(cls, spark: SparkSession, sql: str, path: str) -> Program:
        """The program of ``sql`` in the state of a checkpoint. The last step's views are as they were; queued changes, INSERT statements of ``sql`` among them, are not kept."""
        note = json.loads(spark.read.text(path).first()[0])
        p = cls(spark, sql, dt.datetime.fromisoformat(note["now"]))
        p.queue.clear()
        p.steps, p.applied = note["steps"], note["applied"]

        def restore(log: StateLog, was: dict) -> None:
            log.segments = was["segments"]  # what comes is written elsewhere, should the first program go on too
            log.weights = {k: tuple(w) for k, w in was["weights"].items()}
            log.pinned = {path: list(log.segments)}

        for n, was in note["tables"].items():
            t = p.tables[n]
            restore(t.state, was)
            kind = {f.name: f.dataType for f in t.schema}
            for mine, theirs in ((t.waterline, was["waterline"]), (t.seen, was["seen"])):
                for c, text in theirs.items():
                    mine[c] = spark.createDataFrame([(text,)], "v string").select(F.col("v").cast(kind[c])).first()[0]
            p._bind(n, t.state.relation())
        for v in p.views.values():
            was = note["views"][v.name]
            schema = spark.table(v.name).schema
            v.shown = was["shown"]
            if was["groups"]:
                restore(v.groups, was["groups"])
                p._bind(v.name, p._shown(v))
            elif was["last"]:
                v.last = spark.read.schema(schema).parquet(was["last"])
                p._bind(v.name, v.last)
            else:
                p._bind(v.name, p._sql(v.query))
            if was["pending"]:
                v.pending = spark.read.schema(T.StructType([*schema, T.StructField(W, T.LongType())])).parquet(was["pending"])
        if note["errors"]:
            p.errors = [spark.read.schema(ERROR_COLUMNS).parquet(note["errors"])]
        return p

    # Streams

    def run(self, sources: dict[str, DataFrame], checkpoint: str, available_now: bool = True, state: str | None = None):
        """Feed streaming DataFrames (each of a table's columns) into the program, a step for every micro-batch of each.

        A micro-batch that comes again has no second effect. With ``state`` the program is checkpointed there within each batch, before the stream
        notes it as done; a program resumed from there goes on where the streams do.
        """
        queries = []
        for table, stream in sources.items():

            def batch(df: DataFrame, batch_id: int, table: str = table) -> None:
                with self._lock:
                    if batch_id <= self.applied.get(table, -1):
                        return
                    self.push(table, **({"change": df} if W in df.columns else {"inserts": df}))
                    self.step()
                    self.applied[table] = batch_id
                    if state is not None:
                        self.checkpoint(state)

            writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{table}")
            queries.append((writer.trigger(availableNow=True) if available_now else writer).start())
        return queries
