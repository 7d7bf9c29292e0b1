"""String and binary functions."""

from __future__ import annotations

from freshet.functions.registry import define, renamed

renamed(len="char_length", initcap_spaces="initcap")


@define("CHR")
def chr_(n: str) -> str:
    """The character of a code point; none for negative numbers and what is no code point."""
    return f"CASE WHEN {n} < 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN '' ELSE decode(unhex(lpad(hex(bigint({n})), 8, '0')), 'UTF-32') END"


@define("INITCAP")
def initcap(s: str) -> str:
    """Words start after every character that is neither letter nor digit."""
    runs = f"regexp_extract_all(lower({s}), '[\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}]+', 0)"
    return f"array_join(transform({runs}, w -> concat(upper(left(w, 1)), substring(w, 2))), '')"


@define("SUBSTRING", "SUBSTR")
def substring(s: str, start: str, count: str | None = None) -> str:
    """A start before 1 shortens the window; it never counts from the end."""
    if count is None:
        return f"substring({s}, greatest({start}, 1))"
    return f"substring({s}, greatest({start}, 1), greatest(0, ({count}) + least({start}, 1) - 1))"


@define("SPLIT")
def split(s: str, separator: str = "','") -> str:
    """By a literal separator; empty text has no parts, an empty separator leaves one."""
    return f"CASE WHEN {s} = '' THEN cast(array() as array<string>) WHEN {separator} = '' THEN array({s}) ELSE split({s}, concat('\\\\Q', {separator}, '\\\\E'), -1) END"


@define("REGEXP_REPLACE")
def regexp_replace(s: str, pattern: str, replacement: str = "''") -> str:
    return f"regexp_replace({s}, {pattern}, {replacement})"


@define("XXHASH")
def xxhash(s: str, seed: str = "0") -> str:
    """XXH64 over the bytes with a seed. Seed 42 is built in; others go through an Arrow UDF, see udf.register."""
    return f"xxhash64({s})" if seed.strip() == "42" else f"freshet_xxhash(cast({s} as binary), bigint({seed}))"


@define("BIN2UTF8")
def bin2utf8(b: str) -> str:
    """NULL where the bytes are no UTF-8."""
    return f"try_validate_utf8(cast({b} as string))"


@define("TO_HEX")
def to_hex(b: str) -> str:
    return f"lower(hex({b}))"


@define("TO_INT")
def to_int(b: str) -> str:
    """The last four bytes, big endian, as a signed integer."""
    unsigned = f"cast(conv(right(hex({b}), 8), 16, 10) as bigint)"
    return f"int(CASE WHEN {unsigned} >= 2147483648 THEN {unsigned} - 4294967296 ELSE {unsigned} END)"


@define("GUNZIP")
def gunzip(b: str) -> str:
    return f"freshet_gunzip({b})"
