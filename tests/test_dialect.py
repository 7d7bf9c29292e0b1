"""Parsing, translation and the function library's edge cases."""

import pytest

from freshet.functions import udf
from freshet.functions.datetimes import java_pattern
from freshet.plans import ddl, typed, types
from freshet.plans.dialect import translate
from freshet.plans.lexer import tree


def value(spark, expression):
    udf.register(spark)
    return spark.sql(translate(f"SELECT {expression} AS v")).first()[0]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("SUBSTRING('abc' FROM 0 FOR 2)", "a"), ("SUBSTRING('abc', -1)", "abc"), ("SUBSTRING('abc', -5, 2)", ""), ("SPLIT('', ',')", []), ("SPLIT('abc', '')", ["abc"]), ("SPLIT('a.b', '.')", ["a", "b"]), ("SPLIT_PART('a,b', ',', -1)", "b"),
        ("CHR(-1)", ""), ("CHR(8364)", "€"), ("INITCAP('a-b c9d')", "A-B C9d"), ("LOG(8, 2)", 3.0), ("LOG(0, 2)", float("-inf")), ("LN(0)", float("-inf")), ("LOG(5, 0)", 0.0), ("GREATEST(1, NULL)", None), ("GREATEST_IGNORE_NULLS(1, NULL)", 1), ("LEAST(1, NULL)", None),
        ("SEQUENCE(3, 1)", []), ("ARRAY[1, 2][3]", None), ("ARRAY[1, 2][1]", 1), ("ARRAY_EXCEPT(ARRAY[3, 1, 2], ARRAY[2])", [1, 3]), ("MAP_KEYS(MAP['b', 1, 'a', 2])", ["a", "b"]), ("MAP_VALUES(MAP['b', 1, 'a', 2])", [2, 1]), ("ELEMENT(ARRAY[7])", 7),
        ("REGEXP_REPLACE('abcb', 'b')", "ac"), ("XXHASH('abc', 0)", 0x44BC2CF5AD770999), ("XXHASH('abc', 42) = XXHASH('abc', 42)", True), ("TO_HEX(X'0aFF')", "0aff"), ("TO_INT(X'ffffffff')", -1), ("FDIV(1, 0)", float("inf")), ("IDIV(-7, 2)", -3), ("DIV_NULL(1, 0)", None),
        ("TRUNC(-1.59D, 1)", -1.5), ("FINITE_OR_NULL(FDIV(1, 0))", None), ("5 BETWEEN SYMMETRIC 9 AND 1", True), ("NULL IS UNKNOWN", True), ("SAFE_CAST('x' AS INT)", None), ("CAST('ab' AS CHAR(4))", "ab  "), ("CAST('abcd' AS VARCHAR(2))", "ab"), ("str(CAST(1.239D AS DECIMAL(5,2)))", None),
        ("UUID('{A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11}')", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"), ("FORMAT_DATE('%d.%m.%Y', DATE '2024-02-03')", "03.02.2024"), ("DOW(DATE '2020-08-11')", 3), ("ARRAYS_OVERLAP(ARRAY[1, NULL], ARRAY[NULL, 2])", True), ("TYPEOF(PARSE_JSON('[1]'))", "ARRAY"), ("TYPEOF(PARSE_JSON('{}'))", "MAP"),
        ("'it''s'", "it's"), ("VARIANT_INDEX(PARSE_JSON('[1, 2]'), 2)::INT", 2), ("ARRAY_INSERT(ARRAY[1, 2], -1, 3)", [1, 2, 3]), ("IS_INF(FDIV(-1, 0))", True),
    ],
)
def test_values(spark, expression, expected):
    if expression.startswith("str("):
        assert str(value(spark, expression[4:-1])) == "1.23"
    else:
        assert value(spark, expression) == expected


@pytest.mark.parametrize("expression", ["LN(-1)", "ELEMENT(ARRAY[1, 2])", "UUID('nonsense')", "CAST('x' AS INT)"])
def test_errors(spark, expression):
    with pytest.raises(Exception, match=r"(?i)negative|more than one|UUID|cast"):
        value(spark, expression)


def test_types():
    assert types.spark_type("DECIMAL(10, 2)") == "decimal(10,2)"
    assert types.spark_type("INT ARRAY") == "array<int>"
    assert types.spark_type("MAP<VARCHAR, BIGINT>") == "map<string, bigint>"
    assert types.spark_type("ROW(a INT, b VARCHAR NULL)") == "struct<a: int, b: string>"
    assert types.spark_type("BIGINT UNSIGNED") == "decimal(20,0)"
    assert types.spark_type("TIMESTAMP WITH TIME ZONE") == "timestamp"
    assert types.unsigned_limit(tree("SMALLINT UNSIGNED")) == 65535
    with pytest.raises(ValueError, match="FLOAT"):
        types.spark_type("FLOAT")
    with pytest.raises(ValueError, match="no such type"):
        types.spark_type("MULTISET")


def test_statements():
    table, view, index, late, option = ddl.statements(
        """CREATE TABLE "T" (Id INT NOT NULL PRIMARY KEY, ts TIMESTAMP LATENESS INTERVAL '1' HOUR, x INT DEFAULT 3) WITH ('append_only' = 'true');
        CREATE LOCAL VIEW v AS SELECT * FROM "T"; CREATE INDEX i ON v(id); LATENESS v.ts INTERVAL '2' HOUR; SET a = 'b'"""
    )
    assert (table.name, table.key, table.options) == ("T", ["id"], {"append_only": "true"})
    assert [c.lateness for c in table.columns] == [None, "INTERVAL '1' HOUR", None]
    assert table.columns[2].default == "3"
    assert view.local and view.query == 'SELECT * FROM "T"'
    assert (index.target, index.key) == ("v", ["id"])
    assert (late.target, late.key, option.name, option.query) == ("v", ["ts"], "a", "b")


def test_patterns():
    assert java_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    with pytest.raises(ValueError, match="directive"):
        java_pattern("%Q")
    with pytest.raises(ValueError, match="unbalanced|unclosed"):
        tree("(a]")


def test_asof_needs_ge():
    with pytest.raises(ValueError, match=">="):
        translate("SELECT * FROM a LEFT ASOF JOIN b MATCH_CONDITION (a.t > b.t) ON a.k = b.k")


@pytest.mark.parametrize(
    ("text", "want"),
    [("SELECT 7 / 2", 3), ("SELECT -7 / 2", -3), ("SELECT 7 / 2 / 2", 1), ("SELECT (7 / 2) * 2 + 9 / 4", 8), ("SELECT 7 / 2.0D", 3.5), ("SELECT CAST(7 AS DOUBLE) / 2", 3.5), ("SELECT AVG(x) FROM (VALUES (1), (2), (4)) AS t(x)", 2), ("SELECT AVG(x) / 2 FROM (VALUES (1), (2), (6)) AS t(x)", 1), ("SELECT (SELECT MAX(x) / 2 FROM (VALUES (5)) AS t(x)) + 0", 2), ("SELECT '1 / 2' || CAST(5 / 2 AS VARCHAR)", "1 / 22"), ("SELECT MAX(a) FROM (SELECT AVG(x) OVER (PARTITION BY x % 2) AS a FROM (VALUES (1), (2), (4)) AS t(x)) AS w", 3)],
)
def test_whole_numbers(spark, text, want):
    """Whole numbers divide to whole numbers, toward zero, and have a whole average; others don't."""
    got = typed.run(spark, text).first()[0]
    assert got == want and type(got) is type(want)
