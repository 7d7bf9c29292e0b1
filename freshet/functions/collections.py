"""Array and map functions. Arrays are counted from 1; maps are ordered by key."""

from __future__ import annotations

from freshet.functions.registry import define, renamed

renamed(array_concat="concat", array_length="cardinality", array_size="cardinality", array_reverse="reverse", safe_offset="get", array_to_string="array_join", array_exists="exists")


@define("ARRAY_EXCEPT")
def array_except(a: str, b: str) -> str:
    return f"sort_array(array_except({a}, {b}))"


@define("ARRAY_UNION")
def array_union(a: str, b: str) -> str:
    return f"sort_array(array_union({a}, {b}))"


@define("ARRAY_INTERSECT")
def array_intersect(a: str, b: str) -> str:
    return f"sort_array(array_intersect({a}, {b}))"


@define("ARRAYS_OVERLAP")
def arrays_overlap(a: str, b: str) -> str:
    """Whether they share an element; NULL is an element like any other."""
    return f"(size(array_intersect({a}, {b})) > 0)"


@define("ELEMENT")
def element(a: str) -> str:
    """The only element; NULL of an empty array, an error of a longer one."""
    return f"CASE WHEN size({a}) > 1 THEN raise_error('more than one element') ELSE get({a}, 0) END"


@define("INDEX")
def index(a: str, i: str) -> str:
    """a[i]: NULL outside."""
    return f"get({a}, int({i}) - 1)"


@define("ARRAY_INSERT")
def array_insert(a: str, i: str, x: str) -> str:
    return f"array_insert({a}, {i}, {x})"


def _entries(m: str) -> str:
    return f"array_sort(map_entries({m}))"


@define("MAP_KEYS")
def map_keys(m: str) -> str:
    return f"sort_array(map_keys({m}))"


@define("MAP_VALUES")
def map_values(m: str) -> str:
    """In the order of the keys."""
    return f"transform(array_sort(map_keys({m})), k -> {m}[k])"


@define("MAP_EQUALS")
def map_equals(a: str, b: str) -> str:
    return f"(transform(array_sort(map_keys({a})), k -> struct(k, {a}[k])) <=> transform(array_sort(map_keys({b})), k -> struct(k, {b}[k])))"


@define("ARRAY_AGG_NULLS")
def array_agg_nulls(x: str) -> str:
    """ARRAY_AGG that respects NULLs."""
    return f"transform(collect_list(struct({x} as v)), s -> s.v)"
