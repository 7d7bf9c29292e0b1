"""Comparisons and casts."""

from __future__ import annotations

from freshet.functions.registry import define, renamed

renamed(greatest_ignore_nulls="greatest", least_ignore_nulls="least", countif="count_if", arg_max="max_by", arg_min="min_by", logical_and="bool_and", logical_or="bool_or")


def _strict(name: str, args: tuple[str, ...]) -> str:
    """NULL if any argument is."""
    return f"CASE WHEN {' OR '.join(f'{a} IS NULL' for a in args)} THEN NULL ELSE {name}({', '.join(args)}) END"


@define("GREATEST")
def greatest(*args: str) -> str:
    return _strict("greatest", args)


@define("LEAST")
def least(*args: str) -> str:
    return _strict("least", args)


@define("UUID")
def uuid(text: str) -> str:
    """Canonical lower case of any usual spelling of a UUID; an error of other text."""
    bare = f"lower(regexp_replace({text}, '^[{{]|[}}]$|-|^urn:uuid:', ''))"
    parts = ", '-', ".join(f"substring({bare}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN {bare} RLIKE '^[0-9a-f]{{32}}$' THEN concat({parts}) ELSE raise_error(concat('no UUID: ', {text})) END"


@define("ST_POINT", "ST_MAKEPOINT")
def st_point(x: str, y: str) -> str:
    return f"named_struct('x', double({x}), 'y', double({y}))"


@define("ST_DISTANCE")
def st_distance(a: str, b: str) -> str:
    return f"sqrt(power({a}.x - {b}.x, 2) + power({a}.y - {b}.y, 2))"


@define("XOR")
def xor(a: str, b: str) -> str:
    return f"(({a}) <> ({b}))"
