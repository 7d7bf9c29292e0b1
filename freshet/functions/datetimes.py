"""Date and time functions. Patterns are strftime ones and become Java patterns when a query is translated."""

from __future__ import annotations

from freshet.functions.registry import define, renamed
from freshet.plans.lexer import literal, quoted

renamed(dow="dayofweek", doy="dayofyear", week="weekofyear")

# Strftime directives and the Java pattern letters of the same meaning.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "j": "DDD", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a",
    "a": "EEE", "A": "EEEE", "b": "MMM", "h": "MMM", "B": "MMMM", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "q": "q", "%": "%",
}


def java_pattern(strftime: str) -> str:
    out, i, letters = [], 0, ""

    def flush() -> None:
        nonlocal letters
        if letters:
            out.append("'" + letters + "'")
            letters = ""

    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            flush()
            if strftime[i + 1] not in DIRECTIVES:
                raise ValueError(f"no such directive: %{strftime[i + 1]}")
            out.append(DIRECTIVES[strftime[i + 1]])
            i += 2
            continue
        if c.isalpha():
            letters += c
        else:
            flush()
            out.append("''" if c == "'" else c)
        i += 1
    flush()
    return "".join(out)


def _pattern(arg: str) -> str:
    if not (arg.startswith("'") and arg.endswith("'")):
        raise ValueError("a format must be a string literal")
    return quoted(java_pattern(literal(arg)))


@define("FORMAT_DATE", "FORMAT_TIMESTAMP")
def format_date(pattern: str, value: str) -> str:
    return f"date_format({value}, {_pattern(pattern)})"


@define("FORMAT_TIME")
def format_time(pattern: str, value: str) -> str:
    return f"date_format(to_timestamp(concat('1970-01-01 ', cast({value} as string))), {_pattern(pattern)})"


@define("PARSE_DATE")
def parse_date(pattern: str, text: str) -> str:
    return f"to_date({text}, {_pattern(pattern)})"


@define("PARSE_TIMESTAMP")
def parse_timestamp(pattern: str, text: str) -> str:
    return f"to_timestamp_ntz({text}, {_pattern(pattern)})"


@define("PARSE_TIME")
def parse_time(pattern: str, text: str) -> str:
    return f"to_time({text}, {_pattern(pattern)})"


def _unit(unit: str) -> str:
    return unit if unit.startswith("'") else f"'{unit}'"


@define("DATE_TRUNC")
def date_trunc(value: str, unit: str) -> str:
    return f"cast(date_trunc({_unit(unit)}, {value}) as date)"


@define("TIMESTAMP_TRUNC")
def timestamp_trunc(value: str, unit: str) -> str:
    return f"date_trunc({_unit(unit)}, {value})"


@define("TIME_TRUNC")
def time_trunc(value: str, unit: str) -> str:
    return f"time_trunc({_unit(unit)}, {value})"


@define("DATE_ADD")
def date_add(value: str, amount: str) -> str:
    return f"({value} + {amount})"


@define("DATE_SUB")
def date_sub(value: str, amount: str) -> str:
    return f"({value} - {amount})"


@define("MAKE_TIMESTAMP")
def make_timestamp(*parts: str) -> str:
    return f"make_timestamp_ntz({', '.join(parts)})"


@define("DATE_PART")
def date_part(unit: str, value: str) -> str:
    return f"date_part({_unit(unit)}, {value})"


#: Predicates on periods (start, end), written ``(a, b) OVERLAPS (c, d)``.
PERIODS = {
    "CONTAINS": "({a} <= {c} AND {b} >= {d})",
    "EQUALS": "({a} = {c} AND {b} = {d})",
    "OVERLAPS": "({a} <= {d} AND {c} <= {b})",
    "PRECEDES": "({b} <= {c})",
    "SUCCEEDS": "({a} >= {d})",
    "IMMEDIATELY PRECEDES": "({b} = {c})",
    "IMMEDIATELY SUCCEEDS": "({a} = {d})",
}
