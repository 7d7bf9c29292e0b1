"""Statements of a program: CREATE TABLE, VIEW, TYPE, FUNCTION and INDEX, DECLARE RECURSIVE VIEW, LATENESS, SET, INSERT."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from freshet.plans.lexer import Group, Node, Token, literal, split, tokens, tree
from freshet.plans.types import spark_type, unsigned_limit


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    key: bool = False
    lateness: str | None = None
    default: str | None = None
    limit: int | None = None


@dataclass
class Statement:
    kind: str
    name: str = ""
    columns: list[Column] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    query: str = ""
    type: str = ""
    target: str = ""
    local: bool = False
    materialized: bool = False


def text(nodes: list[Node]) -> str:
    """SQL text of nodes."""
    out = []
    for n in nodes:
        if isinstance(n, Group):
            out.append(n.open + text(n.body) + {"(": ")", "[": "]"}[n.open])
        else:
            out.append(n.text)
    return " ".join(out)


def mentions(sql: str, name: str) -> bool:
    """Whether a name occurs in a query as an identifier."""
    return any(t.kind == "name" and t.text.lower() == name.lower() or t.kind == "quoted" and t.text[1:-1] == name for t in tokens(sql))


def identifier(n: Node) -> str:
    """Unquoted names fold to lower case, quoted ones stay."""
    if not isinstance(n, Token) or n.kind not in ("name", "quoted"):
        raise ValueError(f"expected a name at {n}")
    return n.text[1:-1] if n.kind == "quoted" else n.text.lower()


def statements(sql: str) -> Iterator[Statement]:
    """One after the other, so that a type is known to the statements after it."""
    for part in split(tree(sql), ";"):
        if part:
            yield _statement(part)


def _statement(nodes: list[Node]) -> Statement:
    first = nodes[0]
    if first.is_("CREATE"):
        words = {n.text.upper() for n in nodes[1:5] if isinstance(n, Token) and n.kind == "name"}
        flags = {"LOCAL", "MATERIALIZED", "LINEAR", "OR", "REPLACE"}
        i = 1
        while nodes[i].is_(*flags):
            i += 1
        what = nodes[i].text.upper()
        rest = nodes[i + 1 :]
        return {"TABLE": _table, "VIEW": _view, "TYPE": _type, "FUNCTION": _function, "INDEX": _index}[what](rest, words)
    if first.is_("DECLARE"):
        return Statement("declare_recursive", identifier(nodes[3]), [_column(c) for c in split(nodes[4].body)])
    if first.is_("LATENESS"):
        return Statement("lateness", target=identifier(nodes[1]), key=[identifier(nodes[3])], query=text(nodes[4:]))
    if first.is_("SET"):
        value = nodes[3]
        return Statement("set", identifier(nodes[1]), query=literal(value.text) if value.kind == "string" else value.text.lower())
    if first.is_("INSERT"):
        key = [identifier(n) for (n,) in split(nodes[3].body)] if isinstance(nodes[3], Group) else []
        return Statement("insert", target=identifier(nodes[2]), key=key, query=text(nodes[4 if key else 3 :]))
    return Statement("select", query=text(nodes))


def _column(nodes: list[Node]) -> Column:
    words = ("NOT", "PRIMARY", "FOREIGN", "LATENESS", "WATERMARK", "DEFAULT", "REFERENCES", "INTERNED")
    at = [i for i, n in enumerate(nodes) if i and n.is_(*words)] + [len(nodes)]
    c = Column(identifier(nodes[0]), spark_type(nodes[1 : at[0]]), limit=unsigned_limit(nodes[1 : at[0]]))
    for a, b in zip(at, at[1:]):
        clause = nodes[a:b]
        if clause[0].is_("NOT"):
            c.nullable = False
        elif clause[0].is_("PRIMARY"):
            c.key, c.nullable = True, False
        elif clause[0].is_("LATENESS"):
            c.lateness = text(clause[1:])
        elif clause[0].is_("DEFAULT"):
            c.default = text(clause[1:])
    return c


def _options(nodes: list[Node]) -> dict[str, str]:
    """WITH ('k' = 'v', ...)"""
    for i, n in enumerate(nodes):
        if n.is_("WITH") and i + 1 < len(nodes) and isinstance(nodes[i + 1], Group) and nodes[i + 1].body and isinstance(nodes[i + 1].body[0], Token) and nodes[i + 1].body[0].kind == "string":
            return {literal(p[0].text): literal(p[2].text) for p in split(nodes[i + 1].body)}
    return {}


def _table(nodes: list[Node], flags: set[str]) -> Statement:
    columns, key = [], []
    for item in split(nodes[1].body):
        if item[0].is_("PRIMARY"):
            key = [identifier(n) for (n,) in split(item[2].body)]
        elif item[0].is_("CONSTRAINT", "FOREIGN"):
            continue
        else:
            columns.append(_column(item))
    return Statement("create_table", identifier(nodes[0]), columns, key or [c.name for c in columns if c.key], _options(nodes[2:]))


def _view(nodes: list[Node], flags: set[str]) -> Statement:
    at = next(i for i, n in enumerate(nodes) if n.is_("AS"))
    return Statement("create_view", identifier(nodes[0]), options=_options(nodes[1:at]), query=text(nodes[at + 1 :]), local="LOCAL" in flags, materialized="MATERIALIZED" in flags)


def _type(nodes: list[Node], flags: set[str]) -> Statement:
    body = nodes[2:]
    if isinstance(body[0], Group):
        fields = [_column(c) for c in split(body[0].body)]
        return Statement("create_type", identifier(nodes[0]), type=f"struct<{', '.join(f'{c.name}: {c.type}' for c in fields)}>")
    return Statement("create_type", identifier(nodes[0]), type=spark_type(body))


def _function(nodes: list[Node], flags: set[str]) -> Statement:
    at = next(i for i, n in enumerate(nodes) if n.is_("RETURNS"))
    end = next((i for i, n in enumerate(nodes) if n.is_("AS") and i > at), len(nodes))
    return Statement("create_function", identifier(nodes[0]), [_column(c) for c in split(nodes[1].body)], type=spark_type(nodes[at + 1 : end]), query=text(nodes[end + 1 :]))


def _index(nodes: list[Node], flags: set[str]) -> Statement:
    on = next(i for i, n in enumerate(nodes) if n.is_("ON"))
    return Statement("create_index", identifier(nodes[0]), target=identifier(nodes[on + 1]), key=[identifier(n) for (n,) in split(nodes[on + 2].body)])
