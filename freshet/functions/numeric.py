"""Numeric functions. Where Spark returns NULL or raises outside a domain, these follow IEEE results or raise as the dialect does."""

from __future__ import annotations

from freshet.functions.registry import define, renamed

renamed(is_nan="isnan")

INF, NAN = "double('infinity')", "double('nan')"


@define("LN")
def ln(x: str) -> str:
    """-inf at 0, an error below."""
    return f"CASE WHEN {x} = 0 THEN -{INF} WHEN {x} < 0 THEN raise_error('LN of a negative number') ELSE ln({x}) END"


@define("LOG10")
def log10(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN -{INF} WHEN {x} < 0 THEN raise_error('LOG10 of a negative number') ELSE log10({x}) END"


@define("LOG")
def log(x: str, base: str | None = None) -> str:
    """LOG(value, base): value first; base 0 gives 0, value 0 gives -inf."""
    if base is None:
        return ln(x)
    return f"CASE WHEN {base} = 0 THEN 0D WHEN {x} = 0 THEN -{INF} ELSE ln({x}) / ln({base}) END"


@define("DIV_NULL")
def div_null(a: str, b: str) -> str:
    """Division, NULL where the divisor is zero."""
    return f"try_divide({a}, {b})"


@define("TRUNC", "TRUNCATE")
def truncate(x: str, digits: str = "0") -> str:
    """Toward zero, at a number of decimal digits."""
    return f"(sign({x}) * floor(abs({x}) * power(10, {digits})) / power(10, {digits}))"


@define("IS_INF")
def is_inf(x: str) -> str:
    return f"(abs(double({x})) = {INF})"


@define("FINITE_OR_NULL")
def finite_or_null(x: str) -> str:
    return f"CASE WHEN isnan({x}) OR abs(double({x})) = {INF} THEN NULL ELSE {x} END"


@define("COTH")
def coth(x: str) -> str:
    return f"(cosh({x}) / sinh({x}))"


@define("CSCH")
def csch(x: str) -> str:
    return f"(1 / sinh({x}))"


@define("SECH")
def sech(x: str) -> str:
    return f"(1 / cosh({x}))"


@define("SEQUENCE")
def sequence(a: str, b: str) -> str:
    """Empty where the end lies before the start."""
    return f"CASE WHEN {b} < {a} THEN slice(sequence({a}, {a}), 1, 0) ELSE sequence({a}, {b}) END"


@define("FDIV")
def fdiv(a: str, b: str) -> str:
    """Floating division by IEEE rules: x/0 is infinite, 0/0 is NaN."""
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 OR isnan(double({a})) THEN {NAN} WHEN {a} > 0 THEN {INF} ELSE -{INF} END ELSE double({a}) / double({b}) END"


@define("IDIV")
def idiv(a: str, b: str) -> str:
    """Integer division, toward zero."""
    return f"({a} div {b})"
