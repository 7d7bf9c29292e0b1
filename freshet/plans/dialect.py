"""Translation of the dialect's queries to Spark SQL text.

Catalyst plans the result, so everything here is syntax: functions by the registry, clauses that Spark lacks as
subqueries and windows. Table functions become projections, an as-of join becomes one union and window.
"""

from __future__ import annotations

import itertools

from freshet.functions import FUNCTIONS
from freshet.functions.datetimes import PERIODS
from freshet.plans.lexer import Group, Node, Token, literal, quoted, split, tree
from freshet.plans.types import spark_type

CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "FETCH")
SET_OPS = ("UNION", "EXCEPT", "INTERSECT", "MINUS")
EXPRESSION_ENDS = ("AND", "OR", "THEN", "ELSE", "WHEN", "END", "AS", *CLAUSES, *SET_OPS)
_serial = itertools.count()


def translate(sql: str, now: str | None = None) -> str:
    """The Spark SQL of a query; ``now``: the text that stands for NOW()."""
    return _query(tree(sql.strip().rstrip(";")), now)


def _starts_query(nodes: list[Node]) -> bool:
    return bool(nodes) and nodes[0].is_("SELECT", "WITH", "VALUES") or bool(nodes) and isinstance(nodes[0], Group) and len(nodes) > 1 and nodes[1].is_(*SET_OPS)


def _query(nodes: list[Node], now: str | None) -> str:
    if nodes and nodes[0].is_("WITH"):
        out, i = ["WITH"], 1
        while i < len(nodes) and not nodes[i].is_("SELECT"):
            n = nodes[i]
            out.append(f"({_query(n.body, now)})" if isinstance(n, Group) and _starts_query(n.body) else _expr([n], now))
            i += 1
        return " ".join(out) + " " + _query(nodes[i:], now)
    parts: list[tuple[str, list[Node]]] = []
    op, part, i = "", [], 0
    while i < len(nodes):
        n = nodes[i]
        if n.is_(*SET_OPS) and part and not (n.is_("EXCEPT") and isinstance(nodes[i - 1], Token) and nodes[i - 1].text == "*"):
            parts.append((op, part))
            op, part = n.text.upper(), []
            if i + 1 < len(nodes) and nodes[i + 1].is_("ALL", "DISTINCT"):
                i += 1
                op += " " + nodes[i].text.upper()
        else:
            part.append(n)
        i += 1
    parts.append((op, part))
    return " ".join(f"{op} {_block(part, now)}" if op else _block(part, now) for op, part in parts)


def _clauses(nodes: list[Node]) -> dict[str, list[Node]]:
    """The clauses of a select block by their first word, in order."""
    out: dict[str, list[Node]] = {}
    current = ""
    for i, n in enumerate(nodes):
        starts = n.is_(*CLAUSES) and not (n.is_("ORDER", "GROUP") and not (i + 1 < len(nodes) and nodes[i + 1].is_("BY"))) and not (n.is_("FROM") and i and nodes[i - 1].is_("DISTINCT"))
        if starts:
            current = n.text.upper()
            out[current] = []
        else:
            out.setdefault(current, []).append(n)
    return out


def _block(nodes: list[Node], now: str | None) -> str:
    if not nodes or not nodes[0].is_("SELECT"):
        return _expr(nodes, now)
    c = _clauses(nodes)
    items = c["SELECT"]
    if "FROM" in c:
        c["FROM"] = _from(c["FROM"])
    group = c.get("GROUP", [])
    if len(group) > 1 and group[1].is_("DISTINCT"):
        sets = _grouping_sets(group[2:], now)
        c["GROUP"] = [Token("raw", "BY GROUPING SETS (" + ", ".join(f"({', '.join(x)})" for x in sets) + ")")]
    if len(items) > 2 and items[0].is_("DISTINCT") and items[1].is_("ON") and isinstance(items[2], Group):
        order = c.pop("ORDER", [])[1:]
        keys, items = items[2], items[3:]
        by = _expr(order, now) or _expr(keys.body, now)
        name = f"rn_{next(_serial)}"
        ranked = [f"{_items(items, now)}, row_number() OVER (PARTITION BY {_expr(keys.body, now)} ORDER BY {by}) AS {name}"]
        inner = _rest(ranked[0], c, now)
        return f"SELECT * EXCEPT ({name}) FROM ({inner}) WHERE {name} = 1"
    if "QUALIFY" in c:
        condition = _expr(c.pop("QUALIFY"), now)
        tail = {k: c.pop(k) for k in ("ORDER", "LIMIT", "OFFSET", "FETCH") if k in c}
        name = f"qualified_{next(_serial)}"
        inner = _rest(f"{_items(items, now)}, ({condition}) AS {name}", c, now)
        return f"SELECT * EXCEPT ({name}) FROM ({inner}) WHERE {name}" + _tail(tail, now)
    return _rest(_items(items, now), c, now)


def _grouping_sets(nodes: list[Node], now: str | None) -> list[list[str]]:
    """The sets of GROUP BY DISTINCT elements, each once."""
    parts: list[list[list[str]]] = []
    for e in split(nodes):
        exprs = lambda g: [_expr(x, now) for x in split(g.body)]
        if e[0].is_("ROLLUP"):
            all_ = exprs(e[1])
            parts.append([all_[:k] for k in range(len(all_), -1, -1)])
        elif e[0].is_("CUBE"):
            all_ = exprs(e[1])
            parts.append([list(x) for k in range(len(all_), -1, -1) for x in itertools.combinations(all_, k)])
        elif e[0].is_("GROUPING"):
            parts.append([exprs(x[0]) if isinstance(x[0], Group) else [_expr(x, now)] for x in split(e[2].body)])
        else:
            parts.append([[_expr(e, now)]])
    out: dict[frozenset[str], list[str]] = {}
    for choice in itertools.product(*parts):
        merged = list(dict.fromkeys(x for part in choice for x in part))
        out.setdefault(frozenset(merged), merged)
    return list(out.values())


def _rest(items: str, c: dict[str, list[Node]], now: str | None) -> str:
    return f"SELECT {items}" + _tail({k: v for k, v in c.items() if k not in ("", "SELECT")}, now)


def _tail(c: dict[str, list[Node]], now: str | None) -> str:
    out = ""
    for k, v in c.items():
        if k == "FETCH":  # FETCH FIRST n ROWS ONLY
            number = next((n.text for n in v if isinstance(n, Token) and n.kind == "number"), "1")
            out += f" LIMIT {number}"
        elif k == "OFFSET":
            out += f" OFFSET {_expr([n for n in v if not n.is_('ROW', 'ROWS')], now)}"
        else:
            out += f" {k} {_expr(v, now)}"
    return out


def _items(nodes: list[Node], now: str | None) -> str:
    """A select list, with EXCLUDE and REPLACE after a star."""
    out = []
    lead = ""
    if nodes and nodes[0].is_("DISTINCT", "ALL"):
        lead, nodes = ("DISTINCT " if nodes[0].is_("DISTINCT") else ""), nodes[1:]
    for item in split(nodes):
        star = next((i for i, n in enumerate(item) if isinstance(n, Token) and n.text == "*"), None)
        if star is not None and len(item) > star + 2 and item[star + 1].is_("EXCLUDE", "EXCEPT", "REPLACE") and isinstance(item[star + 2], Group):
            prefix, body = _expr(item[: star + 1], now), item[star + 2].body
            if item[star + 1].is_("REPLACE"):
                new = split(body)
                names = ", ".join(_expr(x[-1:], now) for x in new)
                out += [f"{prefix} EXCEPT ({names})", *[_expr(x, now) for x in new]]
            else:
                out.append(f"{prefix} EXCEPT ({_expr(body, now)})")
        else:
            out.append(_expr(item, now))
    return lead + ", ".join(out)


def _from(nodes: list[Node]) -> list[Node]:
    """A FROM clause with as-of joins replaced by derived tables."""
    for i, n in enumerate(nodes):
        if n.is_("ASOF") and i and nodes[i - 1].is_("LEFT"):
            return _asof(nodes, i)
    return nodes


def _table_and_alias(nodes: list[Node]) -> tuple[list[Node], str]:
    nodes = [n for n in nodes if not n.is_("AS")]
    if len(nodes) > 1 and isinstance(nodes[-1], Token) and nodes[-1].kind in ("name", "quoted") and not (isinstance(nodes[-2], Token) and nodes[-2].text == "."):
        return nodes[:-1], nodes[-1].text
    return nodes, nodes[-1].text


def _asof(nodes: list[Node], at: int) -> list[Node]:
    """``l LEFT ASOF JOIN r MATCH_CONDITION (l.t >= r.t) ON l.k = r.k`` as one derived table with a struct for each side."""
    left, a = _table_and_alias(nodes[: at - 1])
    match = next(i for i, n in enumerate(nodes) if n.is_("MATCH_CONDITION"))
    on = next(i for i, n in enumerate(nodes) if n.is_("ON") and i > match)
    right, b = _table_and_alias(nodes[at + 2 : match])
    condition = nodes[match + 1].body if isinstance(nodes[match + 1], Group) else nodes[match + 1 : on]
    ge = split(condition, ">=")
    if len(ge) != 2:
        raise ValueError("an as-of join needs a >= condition")
    own = lambda part, alias: bool(part) and isinstance(part[0], Token) and part[0].text.lower() == alias.lower()
    if not own(ge[0], a):
        raise ValueError("the as-of condition starts with the left side")
    end = next((i for i in range(on + 1, len(nodes)) if nodes[i].is_("JOIN", "LEFT", "INNER", "CROSS", "FULL", "RIGHT")), len(nodes))
    keys: list[tuple[str, str]] = []
    part: list[Node] = []
    for n in [*nodes[on + 1 : end], Token("name", "AND")]:
        if n.is_("AND"):
            x, y = split(part, "=")
            x, y = (x, y) if own(x, a) else (y, x)
            keys.append((_expr(x, None), _expr(y, None)))
            part = []
        else:
            part.append(n)
    lt, rt = _expr(ge[0], None), _expr(ge[1], None)
    cols = ", ".join(f"k{i}" for i in range(len(keys)))
    some = " AND ".join(f"k{i} IS NOT NULL" for i in range(len(keys)))
    lk = ", ".join(f"{x} AS k{i}" for i, (x, _) in enumerate(keys))
    rk = ", ".join(f"{y} AS k{i}" for i, (_, y) in enumerate(keys))
    sql = (
        f"(SELECT l AS {a}, CASE WHEN {some} AND t IS NOT NULL THEN r END AS {b} FROM (SELECT l, s, t, {cols}, last(r, true) OVER (PARTITION BY {cols} ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS r FROM ("
        f"SELECT struct({a}.*) AS l, NULL AS r, 1 AS s, {lt} AS t, {lk} FROM {_expr(left, None)} AS {a} UNION ALL "
        f"SELECT NULL, struct({b}.*), 0, {rt}, {rk} FROM {_expr(right, None)} AS {b} WHERE {rt} IS NOT NULL)) WHERE s = 1)"
    )
    return [Token("raw", sql), *nodes[end:]]


def _window_function(body: list[Node], now: str | None) -> str | None:
    """TUMBLE, HOP and SESSION inside TABLE(...)."""
    if len(body) != 2 or not body[0].is_("TUMBLE", "HOP", "SESSION") or not isinstance(body[1], Group):
        return None
    kind = body[0].text.upper()
    args = [[n for n in a if not (isinstance(n, Token) and n.text == "=>")] for a in split(body[1].body)]
    args = [a[1:] if a and a[0].is_("DATA", "TIMECOL", "SIZE", "SLIDE", "OFFSET", "GAP", "KEY") else a for a in args]
    source = _expr(args[0][1:] if args[0][0].is_("TABLE") else args[0], now)
    if isinstance(args[0][0], Group):
        source = _expr(args[0], now)
    column = _expr(args[1][1].body, now)
    if kind == "SESSION":
        keys = [_expr(a[1].body, now) for a in args[2:] if a[0].is_("DESCRIPTOR")]
        gap = next(_expr(a, now) for a in args[2:] if not a[0].is_("DESCRIPTOR"))
        part = f"PARTITION BY {keys[0]} " if keys and keys[0] else ""
        return (
            f"(SELECT * EXCEPT (fresh_, session_), min({column}) OVER ({part and part + ', session_ ' or 'PARTITION BY session_ '}) AS window_start, max({column}) OVER ({part and part + ', session_ ' or 'PARTITION BY session_ '}) + {gap} AS window_end FROM ("
            f"SELECT *, sum(fresh_) OVER ({part}ORDER BY {column} ROWS UNBOUNDED PRECEDING) AS session_ FROM ("
            f"SELECT *, CASE WHEN {column} < lag({column}) OVER ({part}ORDER BY {column}) + {gap} THEN 0 ELSE 1 END AS fresh_ FROM {source} WHERE {column} IS NOT NULL)))"
        )
    strings = [_interval_string(a) for a in args[2:]]
    if kind == "TUMBLE":
        size, offset = strings[0], strings[1] if len(strings) > 1 else "0 seconds"
        slide = size
    else:
        slide, size, offset = strings[0], strings[1], strings[2] if len(strings) > 2 else "0 seconds"
    w = f"window({column}, '{size}', '{slide}', '{offset}')"
    return f"(SELECT * EXCEPT (w_), w_.start AS window_start, w_.end AS window_end FROM (SELECT *, {w} AS w_ FROM {source} WHERE {column} IS NOT NULL))"


def _interval_string(nodes: list[Node]) -> str:
    """'10 minutes' of INTERVAL '10' MINUTE or INTERVAL 10 MINUTES."""
    words = [n for n in nodes if not n.is_("INTERVAL")]
    number = literal(words[0].text) if words[0].kind == "string" else words[0].text
    return f"{number} {words[1].text.lower()}" if len(words) > 1 else number


def _is_primary(n: Node) -> bool:
    return isinstance(n, Group) or n.kind in ("quoted", "name") and not n.is_(*EXPRESSION_ENDS, "BY", "IN", "LIKE", "NOT", "BETWEEN", "SELECT", "DISTINCT", "ARRAY", "MAP", "INTERVAL")


def _expr(nodes: list[Node], now: str | None) -> str:
    out: list[str] = []
    i = 0
    while i < len(nodes):
        n = nodes[i]
        nxt = nodes[i + 1] if i + 1 < len(nodes) else None
        if isinstance(n, Group):
            words = []
            for m in nodes[i + 1 : i + 3]:
                if isinstance(m, Token) and m.kind == "name":
                    words.append(m.text.upper())
            name = next((w for w in (" ".join(words[:2]), *words[:1]) if w in PERIODS), None)
            if n.open == "[" and out and i and _is_primary(nodes[i - 1]):
                base, inside = out.pop(), _expr(n.body, now)
                out.append(f"{base}[{inside}]" if inside.startswith("'") else f"get({base}, int({inside}) - 1)")
            elif name and isinstance(nodes[i + 1 + len(name.split())], Group) and len(split(n.body)) == 2:
                other = nodes[i + 1 + len(name.split())]
                (a, b), (c, d) = ([_expr(x, now) for x in split(g.body)] for g in (n, other))
                out.append(PERIODS[name].format(a=a, b=b, c=c, d=d))
                i += 1 + len(name.split())
            else:
                inside = _query(n.body, now) if _starts_query(n.body) else _expr(n.body, now)
                out.append(f"({inside})")
        elif n.kind == "string":
            out.append(quoted(literal(n.text)))
        elif n.kind == "quoted":
            out.append(n.text if n.text[0] == "`" else "`" + n.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif n.kind == "op" and n.text == "." and out and nxt is not None:
            out[-1] += "." + _expr([nxt], now)
            i += 1
        elif n.is_("BETWEEN") and nxt is not None and nxt.is_("SYMMETRIC", "ASYMMETRIC"):
            j = next(k for k in range(i + 2, len(nodes)) if nodes[k].is_("AND"))
            end = next((k for k in range(j + 1, len(nodes)) if nodes[k].is_(*EXPRESSION_ENDS) or isinstance(nodes[k], Token) and nodes[k].text == ","), len(nodes))
            a, b = _expr(nodes[i + 2 : j], now), _expr(nodes[j + 1 : end], now)
            out.append(f"BETWEEN least({a}, {b}) AND greatest({a}, {b})" if nxt.is_("SYMMETRIC") else f"BETWEEN {a} AND {b}")
            i = end - 1
        elif n.is_("UNKNOWN") and i and nodes[i - 1].is_("IS", "NOT"):
            out.append("NULL")
        elif n.is_("CROSS", "OUTER") and nxt is not None and nxt.is_("APPLY"):
            out.append("CROSS JOIN LATERAL" if n.is_("CROSS") else "LEFT JOIN LATERAL")
            i += 1
        elif n.kind == "name" and isinstance(nxt, Group) and nxt.open == "[" and n.is_("ARRAY", "MAP"):
            out.append(f"{n.text.lower()}({_expr(nxt.body, now)})")
            i += 1
        elif n.kind == "name" and isinstance(nxt, Group) and nxt.open == "(" and not n.is_("IN", "AS", "ON", "AND", "OR", "NOT", "BY", "WHERE", "USING", "OVER", "VALUES", "FROM", "SELECT", "JOIN", "EXISTS", "LATERAL", "WITHIN", "FILTER", "SETS", "ROLLUP", "CUBE", "UNION", "ALL", "THEN", "ELSE", "WHEN"):
            out.append(_call(n, nxt, now))
            i += 1
        else:
            out.append(n.text)
        i += 1
    return " ".join(out)


def _call(name: Token, group: Group, now: str | None) -> str:
    word, body = name.text.upper(), group.body
    if word in ("CAST", "SAFE_CAST", "TRY_CAST"):
        at = max(i for i, n in enumerate(body) if n.is_("AS"))
        return cast(_expr(body[:at], now), body[at + 1 :], word != "CAST")
    if word in ("SUBSTRING", "SUBSTR") and any(n.is_("FROM") for n in body):
        at = next(i for i, n in enumerate(body) if n.is_("FROM"))
        to = next((i for i, n in enumerate(body) if n.is_("FOR")), len(body))
        args = [body[:at], body[at + 1 : to], *([body[to + 1 :]] if to < len(body) else [])]
        return FUNCTIONS["SUBSTRING"](*[_expr(a, now) for a in args])
    if word in ("ARRAY", "MAP") and _starts_query(body):
        inner = _query(body, now)
        if word == "ARRAY":
            return f"(SELECT transform(collect_list(struct(c)), s -> s.c) FROM ({inner}) AS t(c))"
        return f"(SELECT map_from_entries(collect_list(struct(k, v))) FROM (SELECT k, max(v) AS v FROM ({inner}) AS t(k, v) GROUP BY k))"
    if word == "TABLE" and (windowed := _window_function(body, now)):
        return windowed
    if word in ("TUMBLE", "TUMBLE_START", "TUMBLE_END", "HOP", "HOP_START", "HOP_END") and len(split(body)) > 1:
        args = split(body)
        steps = [_interval_string(a) for a in args[1:]]
        size = steps[-1] if word.startswith("HOP") else steps[0]
        window = f"window({_expr(args[0], now)}, '{size}', '{steps[0]}')"
        return window + {"START": ".start", "END": ".end"}.get(word.partition("_")[2], "")
    if word == "UNNEST":
        args = split(body)
        return f"{'explode' if len(args) == 1 else 'inline'}({_expr(args[0], now) if len(args) == 1 else 'arrays_zip(' + ', '.join(_expr(a, now) for a in args) + ')'})"
    if word == "ROW":
        return f"struct({_expr(body, now)})"
    if word == "GROUPING" and len(split(body)) > 1:
        return f"grouping_id({_expr(body, now)})"
    if word in ("NOW", "CURRENT_TIMESTAMP") and not body:
        return now or "cast(current_timestamp() as timestamp_ntz)"
    if word in FUNCTIONS:
        return FUNCTIONS[word](*[_expr(a, now) for a in split(body)])
    return f"{name.text}({_query(body, now) if _starts_query(body) else _expr(body, now)})"


def cast(value: str, target: list[Node], safe: bool = False) -> str:
    """A cast: decimals cut digits off rather than round them, CHAR(n) pads and cuts, VARCHAR(n) cuts."""
    name = spark_type(target)
    call = "try_cast" if safe else "cast"
    word = target[0].text.upper() if isinstance(target[0], Token) else ""
    size = [t.text for t in target[1].body if isinstance(t, Token) and t.kind == "number"] if len(target) > 1 and isinstance(target[1], Group) else []
    if word in ("DECIMAL", "NUMERIC", "DEC") and not value.startswith("'"):
        scale = 10 ** int(size[1]) if len(size) > 1 else 1
        return f"{call}(sign({value}) * floor(abs({value}) * {scale}) / {scale} AS {name})"
    if word in ("CHAR", "CHARACTER") and size:
        return f"rpad({call}({value} AS string), {size[0]}, ' ')"
    if word == "VARCHAR" and size:
        return f"left({call}({value} AS string), {size[0]})"
    return f"{call}({value} AS {name})"
