"""Queries of the dialect whose meaning hangs on types: whole numbers divide to whole numbers, and have a whole average.

Text alone doesn't tell. Spark analyses the translated text, and its plan tells the types of each division and average together with their place in
the text; those of whole numbers are then written as ``div`` and as a cast of the average, both of which cut toward zero.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from freshet.plans.dialect import translate
from freshet.plans.lexer import _TOKEN

WHOLE = {"tinyint", "smallint", "int", "bigint"}
#: Before an average that has its cast.
MARK = "/*whole*/"
_MAYBE = re.compile(r"/(?!\*)|\bavg\s*\(", re.I)


def run(spark: SparkSession, query: str, now: str | None = None) -> DataFrame:
    """The result of a query in the dialect."""
    text = translate(query, now)
    df = spark.sql(text)
    while _MAYBE.search(text) and (edits := _edits(spark, df, text)):
        for start, end, new in sorted(edits, reverse=True):
            text = text[:start] + new + text[end:]
        df = spark.sql(text)
    return df


def _edits(spark: SparkSession, df: DataFrame, text: str) -> list[tuple[int, int, str]]:
    """What to replace next: innermost first, since a whole quotient may be divided again."""
    user_cast = getattr(spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast, "USER_SPECIFIED_CAST")()
    found: dict[tuple[int, int], str] = {}
    for e in _expressions(df._jdf.queryExecution().analyzed()):
        kind = e.getClass().getSimpleName()
        if kind not in ("Divide", "Average"):
            continue
        origin = e.origin()
        if origin.sqlText().isEmpty() or origin.sqlText().get() != text or origin.startIndex().isEmpty() or origin.stopIndex().isEmpty():
            continue
        start, end = origin.startIndex().get(), origin.stopIndex().get() + 1
        if kind == "Average":
            whole = e.child().dataType().simpleString()
            if whole in WHOLE and not text[:start].endswith(MARK):
                found[start, end] = f"cast({MARK}{text[start:end]} AS {whole})"
        elif all(_type(x, user_cast) in WHOLE for x in (e.left(), e.right())):
            at = _last_division(text, start, end)
            if at is not None:
                found[at, at + 1] = "div"
    # An edit within another's range waits for the next round.
    return [(a, b, new) for (a, b), new in found.items() if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]


def _type(e, user_cast) -> str:
    """The type of an operand before Spark made it a double."""
    if e.getClass().getSimpleName() == "Cast" and e.getTagValue(user_cast).isEmpty():
        e = e.child()
    return e.dataType().simpleString()


def _expressions(plan) -> list:
    out, plans = [], [plan]
    while plans:
        p = plans.pop()
        plans += _all(p.children())
        todo = _all(p.expressions())
        while todo:
            e = todo.pop()
            out.append(e)
            todo += _all(e.children())
            if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                plans.append(e.plan())
    return out


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _last_division(text: str, start: int, end: int) -> int | None:
    """The last ``/`` of a range outside brackets: the operator of the division that fills it."""
    at, depth, found = start, 0, None
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            return None
        if m.lastgroup == "open":
            depth += 1
        elif m.lastgroup == "close":
            depth -= 1
        elif m[0] == "/" and depth == 0:
            found = at
        at = m.end()
    return found
