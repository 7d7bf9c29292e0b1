"""Tokens and bracket trees of SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:BD|[DLSYF])?(?!\w))
    |(?P<name>[^\W\d]\w*)
    |(?P<op><=>|<>|!=|<=|>=|\|\||::|=>|->|[-+*/%<>=.,;:&|^~?@!{}])
    |(?P<open>[(\[])
    |(?P<close>[)\]])""",
    re.S | re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    def is_(self, *words: str) -> bool:
        """A bare keyword among ``words`` (upper case)."""
        return self.kind == "name" and self.text.upper() in words


@dataclass
class Group:
    """A bracketed list of nodes."""

    open: str
    body: list[Node]

    def is_(self, *words: str) -> bool:
        return False


Node = Token | Group


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ValueError(f"cannot read SQL at: {sql[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0]))
    return out


def tree(sql: str | list[Token]) -> list[Node]:
    stack: list[list[Node]] = [[]]
    opens: list[str] = []
    for t in tokens(sql) if isinstance(sql, str) else sql:
        if t.kind == "open":
            stack.append([])
            opens.append(t.text)
        elif t.kind == "close":
            if not opens or {"(": ")", "[": "]"}[opens[-1]] != t.text:
                raise ValueError(f"unbalanced {t.text}")
            body = stack.pop()
            stack[-1].append(Group(opens.pop(), body))
        else:
            stack[-1].append(t)
    if opens:
        raise ValueError("unclosed bracket")
    return stack[0]


def split(nodes: list[Node], separator: str = ",") -> list[list[Node]]:
    """Parts between top-level separators; no nodes: no parts."""
    if not nodes:
        return []
    out: list[list[Node]] = [[]]
    for n in nodes:
        if isinstance(n, Token) and n.kind == "op" and n.text == separator:
            out.append([])
        else:
            out[-1].append(n)
    return out


def literal(text: str) -> str:
    """The value of a quoted SQL string."""
    return text[1:-1].replace("''", "'")


def quoted(value: str) -> str:
    """A Spark string literal of a value."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
