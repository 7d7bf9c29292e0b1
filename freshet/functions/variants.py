"""JSON and VARIANT functions."""

from __future__ import annotations

from freshet.functions.registry import define


@define("VARIANTNULL")
def variantnull() -> str:
    return "parse_json('null')"


@define("TO_JSON")
def to_json(v: str) -> str:
    return f"to_json({v})"


@define("PARSE_JSON")
def parse_json(s: str) -> str:
    return f"try_parse_json({s})"


@define("VARIANT_INDEX")
def variant_index(v: str, key: str) -> str:
    """v[key]: a field by name, or an element counted from 1; NULL if absent."""
    if key.startswith("'"):
        return f"try_variant_get({v}, '$.{key[1:-1]}')"
    return f"try_variant_get({v}, '$[{int(key) - 1}]')"


# Printed names of what a VARIANT holds, by the schema Spark reports.
TYPE_NAMES = {"VOID": "NULL", "STRING": "VARCHAR", "BIGINT": "BIGINT", "BOOLEAN": "BOOLEAN", "DOUBLE": "DOUBLE", "FLOAT": "REAL", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "TIMESTAMP_NTZ": "TIMESTAMP", "BINARY": "VARBINARY"}


@define("TYPEOF")
def typeof(v: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in TYPE_NAMES.items())
    of = f"schema_of_variant({v})"
    return f"CASE WHEN {v} IS NULL THEN 'NULL' WHEN {of} LIKE 'ARRAY%' THEN 'ARRAY' WHEN {of} LIKE 'OBJECT%' THEN 'MAP' WHEN {of} LIKE 'DECIMAL%' THEN 'DECIMAL' ELSE CASE {of} {cases} ELSE {of} END END"


@define("JSON_KEYS", "JSON_OBJECT_KEYS")
def json_keys(v: str) -> str:
    """Keys of an object in order; none of anything else."""
    return f"coalesce(sort_array(json_object_keys(to_json({v}))), cast(array() as array<string>))"


def _map(v: str) -> str:
    return f"cast({v} as map<string, variant>)"


@define("VARIANT_FILTER")
def variant_filter(v: str, f: str) -> str:
    return f"to_variant_object(map_filter({_map(v)}, {f}))"


@define("VARIANT_MAP")
def variant_map(v: str, f: str) -> str:
    return f"to_variant_object(transform_values({_map(v)}, {f}))"


@define("VARIANT_MERGE")
def variant_merge(a: str, b: str) -> str:
    """Fields of both; the second's win. Anything but two objects gives the second."""
    both = f"schema_of_variant({a}) LIKE 'OBJECT%' AND schema_of_variant({b}) LIKE 'OBJECT%'"
    return f"CASE WHEN {both} THEN to_variant_object(map_concat({_map(a)}, {_map(b)})) ELSE {b} END"


#: JSON_EACH_<type>(v) table functions: keys with values of one type, NULL where the value has another.
EACH = {"BIGINT": "bigint", "BOOLEAN": "boolean", "DATE": "date", "STRING": "string", "TIME": "time", "TIMESTAMP": "timestamp_ntz"}


def _each(kind: str):
    def build(v: str) -> str:
        if kind == "time":
            value = "try_to_time(try_variant_get(value, '$', 'string'))"
        elif kind == "boolean":  # a number is no boolean
            value = "CASE WHEN schema_of_variant(value) = 'BOOLEAN' THEN try_variant_get(value, '$', 'boolean') END"
        else:
            value = f"try_variant_get(value, '$', '{kind}')"
        return f"(SELECT key, {value} AS value FROM variant_explode({v}))"

    return build


for _name, _kind in EACH.items():
    define(f"JSON_EACH_{_name}")(_each(_kind))


@define("VARIANT_DEEP_MAP")
def variant_deep_map(v: str, name: str) -> str:
    """Every leaf through a registered Python function, see udf.register_variant."""
    return f"parse_json(freshet_deep_map_{name.strip(chr(39))}(to_json({v})))"


@define("VARIANT_DEEP_FILTER")
def variant_deep_filter(v: str, name: str) -> str:
    return f"parse_json(freshet_deep_filter_{name.strip(chr(39))}(to_json({v})))"
