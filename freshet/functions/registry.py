"""Scalar functions of the dialect, each a builder of Spark SQL text from the texts of its arguments.

A builder states the dialect's semantics with built-in expressions, so calls stay in whole-stage code and
take part in pushdown. Functions that Spark has under the same name and meaning need no entry.
"""

from __future__ import annotations

from collections.abc import Callable

Builder = Callable[..., str]
FUNCTIONS: dict[str, Builder] = {}


def define(*names: str) -> Callable[[Builder], Builder]:
    def put(f: Builder) -> Builder:
        for name in names:
            FUNCTIONS[name] = f
        return f

    return put


def renamed(**names: str) -> None:
    """Functions that only have another name in Spark."""
    for ours, theirs in names.items():
        FUNCTIONS[ours.upper()] = lambda *args, _f=theirs: f"{_f}({', '.join(args)})"
