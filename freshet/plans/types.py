"""SQL type names of the dialect and their Spark types."""

from __future__ import annotations

from freshet.plans.lexer import Group, Node, Token, split, tree

# Type names. Unsigned types are held in the next wider signed one and checked by range.
TYPES = {
    "BOOLEAN": "boolean", "BOOL": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INT2": "smallint", "INTEGER": "int", "INT": "int", "SIGNED": "int",
    "INT4": "int", "BIGINT": "bigint", "INT8": "bigint", "INT64": "bigint", "REAL": "float", "FLOAT4": "float", "FLOAT32": "float", "DOUBLE": "double", "FLOAT8": "double",
    "FLOAT64": "double", "VARCHAR": "string", "CHAR": "string", "CHARACTER": "string", "TEXT": "string", "STRING": "string", "BINARY": "binary", "VARBINARY": "binary", "BYTEA": "binary",
    "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz", "UUID": "string", "VARIANT": "variant", "GEOMETRY": "struct<x: double, y: double>",
}
UNSIGNED = {"TINYINT": ("smallint", 2**8 - 1), "SMALLINT": ("int", 2**16 - 1), "INTEGER": ("bigint", 2**32 - 1), "INT": ("bigint", 2**32 - 1), "BIGINT": ("decimal(20,0)", 2**64 - 1)}

_user: dict[str, str] = {}


def define(name: str, spark: str) -> None:
    """CREATE TYPE: an alias or a struct under a name."""
    _user[name.upper()] = spark


def spark_type(nodes: list[Node] | str) -> str:
    """The Spark type of a type's text or nodes; postfix ARRAY, MAP<k, v> and ROW(..) included."""
    nodes = tree(nodes) if isinstance(nodes, str) else [n for n in nodes]
    while len(nodes) > 1 and nodes[-1].is_("NULL"):
        nodes = nodes[:-2] if nodes[-2].is_("NOT") else nodes[:-1]
    if nodes[-1].is_("ARRAY"):
        return f"array<{spark_type(nodes[:-1])}>"
    first = nodes[0]
    if not isinstance(first, Token):
        raise ValueError("no type")
    word = first.text.upper().strip('"`')
    if word == "MAP":
        inner = nodes[2:-1]  # MAP < k , v >
        k, v = split(inner)
        return f"map<{spark_type(k)}, {spark_type(v)}>"
    if word == "ROW":
        fields = [(f[0].text, spark_type(f[1:])) for f in split(nodes[1].body)]
        return f"struct<{', '.join(f'{n}: {t}' for n, t in fields)}>"
    if word == "FLOAT":
        raise ValueError("FLOAT has no fixed width; use REAL or DOUBLE")
    if word in ("DECIMAL", "NUMERIC", "DEC"):
        size = [t.text for t in nodes[1].body if isinstance(t, Token) and t.kind == "number"] if len(nodes) > 1 and isinstance(nodes[1], Group) else ["38", "0"]
        return f"decimal({size[0]},{size[1] if len(size) > 1 else 0})"
    if len(nodes) > 1 and nodes[1].is_("UNSIGNED") and word in UNSIGNED:
        return UNSIGNED[word][0]
    if word == "TIMESTAMP" and any(n.is_("ZONE") for n in nodes) and any(n.is_("WITH") for n in nodes):
        return "timestamp"
    if word == "INTERVAL":
        unit = " ".join(n.text.upper() for n in nodes[1:] if isinstance(n, Token))
        return f"interval {unit.lower()}" if unit else "interval day to second"
    if word in _user:
        return _user[word]
    if word in TYPES:
        return TYPES[word]
    raise ValueError(f"no such type: {word}")


def unsigned_limit(nodes: list[Node]) -> int | None:
    """The largest value of an unsigned type, None for others."""
    if len(nodes) > 1 and nodes[1].is_("UNSIGNED"):
        return UNSIGNED[nodes[0].text.upper()][1]
    return None
