"""One query for each scalar function."""

from __future__ import annotations

from freshet.workload.base import Registry

R = Registry()


def _put(prefix: str, table: str, key: str, cases: dict[str, tuple[str, str | None]]) -> None:
    for name, (ours, duck) in cases.items():
        oracle = None if duck is None else f"SELECT {key}, {duck or ours} AS v FROM {table}"
        R.sql(f"fn_{prefix}{name}", f"SELECT {key}, {ours} AS v FROM {table}", oracle)


_S = "p_name"
_put("", "part", "p_partkey", {
    # strings
    "ascii": (f"ASCII({_S})", ""), "char_length": (f"CHAR_LENGTH({_S})", f"CAST(length({_S}) AS INTEGER)"), "chr": ("CHR(p_size + 945)", ""), "concat": (f"CONCAT({_S}, '-', p_brand)", ""), "concat_ws": (f"CONCAT_WS('/', {_S}, NULL, p_brand)", ""),
    "like_escape": (f"replace({_S}, ' ', '_') LIKE '%!_widget' ESCAPE '!'", ""), "ilike": (f"{_S} ILIKE '%WIDGET'", ""), "initcap": ("INITCAP(concat(p_name, '-of_x'))", "regexp_replace(array_to_string(list_transform(string_split(p_name || '-of_x', ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), '-of_x', '-Of_X')"),
    "initcap_spaces": (f"INITCAP_SPACES({_S})", f"array_to_string(list_transform(string_split({_S}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"), "left": (f"LEFT({_S}, 4)", ""), "len": (f"LEN({_S})", f"CAST(length({_S}) AS INTEGER)"), "length": (f"LENGTH({_S})", f"CAST(length({_S}) AS INTEGER)"),
    "like": (f"{_S} LIKE 'red%'", ""), "lower": ("LOWER(p_brand)", ""), "md5": (f"MD5({_S})", ""), "not_ilike": (f"{_S} NOT ILIKE 'RED%'", ""), "not_like": (f"{_S} NOT LIKE 'red%'", ""), "not_rlike": (f"NOT ({_S} RLIKE '^red')", f"NOT regexp_matches({_S}, '^red')"),
    "overlay": (f"OVERLAY({_S} PLACING 'XY' FROM 2 FOR 3)", f"{_S}[1:1] || 'XY' || {_S}[5:]"), "position": (f"POSITION('e' IN {_S})", f"CAST(position('e' IN {_S}) AS INTEGER)"), "regexp_replace": (f"REGEXP_REPLACE({_S}, '[aeiou]')", f"regexp_replace({_S}, '[aeiou]', '', 'g')"),
    "repeat": ("REPEAT(p_brand, 2)", ""), "replace": (f"REPLACE({_S}, 'r', 'l')", ""), "reverse": (f"REVERSE({_S})", ""), "right": (f"RIGHT({_S}, 4)", ""), "rlike": (f"{_S} RLIKE '(red|blue) '", f"regexp_matches({_S}, '(red|blue) ')"),
    "split": (f"SPLIT({_S}, ' ')", f"string_split({_S}, ' ')"), "split_part": (f"SPLIT_PART({_S}, ' ', 2)", ""), "split_part_outside": (f"SPLIT_PART({_S}, ' ', 9)", ""), "substr": (f"SUBSTR({_S}, 2, 3)", ""), "substring": (f"SUBSTRING({_S} FROM 3 FOR 4)", f"substring({_S}, 3, 4)"),
    "substring_before_start": (f"SUBSTRING({_S} FROM -1 FOR 4)", f"substring({_S}, 1, 2)"), "trim": ("TRIM(concat('  ', p_brand, ' '))", "p_brand"), "trim_both": ("TRIM(BOTH 'B' FROM p_brand)", "trim(p_brand, 'B')"), "upper": (f"UPPER({_S})", ""), "concat_operator": (f"{_S} || '!'", ""),
    "xxhash": (f"XXHASH({_S}, 7) IS NOT NULL", "TRUE"),
    # numbers
    "abs": ("ABS(p_size - 25)", ""), "acos": ("round(ACOS(p_size / 100.0D), 9)", "round(ACOS(p_size / 100.0), 9)"), "acosh": ("round(ACOSH(p_size), 9)", ""), "asin": ("round(ASIN(p_size / 100.0D), 9)", "round(ASIN(p_size / 100.0), 9)"), "asinh": ("round(ASINH(p_size), 9)", ""), "atan": ("round(ATAN(p_size), 9)", ""),
    "atan2": ("round(ATAN2(p_size, 7), 9)", ""), "atanh": ("round(ATANH(p_size / 100.0D), 9)", "round(ATANH(p_size / 100.0), 9)"), "bround": ("CAST(BROUND(CAST(p_size AS DECIMAL(10,1)) / 2, 0) AS INTEGER)", "CAST(round_even(p_size / 2.0, 0) AS INTEGER)"), "cbrt": ("round(CBRT(p_size), 9)", ""), "ceil": ("CAST(CEIL(p_retailprice) AS BIGINT)", ""),
    "cos": ("round(COS(p_size), 9)", ""), "cosh": ("round(COSH(p_size / 10.0D), 9)", "round(COSH(p_size / 10.0), 9)"), "cot": ("round(COT(p_size), 6)", ""), "coth": ("round(COTH(p_size / 10.0D), 6)", "round(COSH(p_size / 10.0) / SINH(p_size / 10.0), 6)"), "csc": ("round(CSC(p_size), 6)", "round(1 / SIN(p_size), 6)"), "csch": ("round(CSCH(p_size / 10.0D), 6)", "round(1 / SINH(p_size / 10.0), 6)"),
    "degrees": ("round(DEGREES(p_size), 6)", ""), "div_null": ("DIV_NULL(p_retailprice, p_size - 25)", "CASE WHEN p_size = 25 THEN NULL ELSE p_retailprice / (p_size - 25) END"), "exp": ("round(EXP(p_size / 10.0D), 6)", "round(EXP(p_size / 10.0), 6)"), "finite_or_null": ("FINITE_OR_NULL(CASE WHEN p_size > 40 THEN double('infinity') ELSE p_retailprice END)", "CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice END"),
    "floor": ("CAST(FLOOR(p_retailprice) AS BIGINT)", ""), "is_inf": ("IS_INF(CASE WHEN p_size > 40 THEN double('infinity') ELSE 1D END)", "p_size > 40"), "is_nan": ("IS_NAN(CASE WHEN p_size > 40 THEN double('nan') ELSE 1D END)", "p_size > 40"), "ln": ("round(LN(p_size), 9)", ""), "log": ("round(LOG(p_retailprice, 2), 9)", "round(ln(p_retailprice) / ln(2), 9)"),
    "log10": ("round(LOG10(p_size), 9)", ""), "mod": ("MOD(p_size - 25, 7)", ""), "pi": ("round(PI() * p_size, 9)", ""), "power": ("round(POWER(p_size, 1.5), 6)", ""), "radians": ("round(RADIANS(p_size), 9)", ""), "round": ("ROUND(p_retailprice, 0)", ""), "sec": ("round(SEC(p_size), 6)", "round(1 / COS(p_size), 6)"), "sech": ("round(SECH(p_size / 10.0D), 9)", "round(1 / COSH(p_size / 10.0), 9)"),
    "sequence": ("SEQUENCE(25, p_size)", "CASE WHEN p_size < 25 THEN []::INTEGER[] ELSE list_transform(range(25, p_size + 1), lambda x: x::INTEGER) END"), "sign": ("CAST(SIGN(p_size - 25) AS INTEGER)", ""), "sin": ("round(SIN(p_size), 9)", ""), "sinh": ("round(SINH(p_size / 10.0D), 6)", "round(SINH(p_size / 10.0), 6)"), "sqrt": ("round(SQRT(p_size), 9)", ""), "tan": ("round(TAN(p_size), 6)", ""), "tanh": ("round(TANH(p_size / 10.0D), 9)", "round(TANH(p_size / 10.0), 9)"),
    "trunc": ("TRUNC(-p_retailprice, 0)", "trunc(-p_retailprice)"), "truncate": ("TRUNCATE(p_retailprice)", "trunc(p_retailprice)"),
    # operators and conditions
    "op_modulo": ("p_size % 7", ""), "op_multiply": ("p_size * 3", ""), "op_add": ("p_size + 3", ""), "op_subtract": ("p_size - 3", ""), "op_divide_integer": ("(p_size * 3 - 50) / 7", "trunc((p_size * 3 - 50)::DOUBLE / 7)::BIGINT"), "op_divide_double": ("FDIV(p_retailprice, p_size - 25)", "CASE WHEN p_size = 25 THEN 'inf'::DOUBLE ELSE p_retailprice / (p_size - 25) END"), "op_cast": ("p_size :: BIGINT", ""),
    "op_less": ("p_size < 25", ""), "op_less_equal": ("p_size <= 25", ""), "op_null_safe": ("nullif(p_size, 25) <=> NULL", "nullif(p_size, 25) IS NOT DISTINCT FROM NULL"), "op_not_equal": ("p_size <> 25", ""), "op_equal": ("p_size = 25", ""), "op_greater": ("p_size > 25", ""), "op_greater_equal": ("p_size >= 25", ""),
    "and": ("p_size > 10 AND p_size < 20", ""), "or": ("p_size < 10 OR p_size > 20", ""), "not": ("NOT (p_size > 10)", ""), "xor": ("XOR(p_size > 10, p_size > 20)", "(p_size > 10) <> (p_size > 20)"), "between": ("p_size BETWEEN 5 AND 9", ""), "not_between": ("p_size NOT BETWEEN 5 AND 9", ""), "between_symmetric": ("p_size BETWEEN SYMMETRIC 9 AND 5", "p_size BETWEEN 5 AND 9"), "not_between_symmetric": ("p_size NOT BETWEEN SYMMETRIC 9 AND 5", "p_size NOT BETWEEN 5 AND 9"),
    "case": ("CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END", ""), "cast": ("CAST(p_size AS VARCHAR)", ""), "cast_char": ("CAST(p_brand AS CHAR(12))", "rpad(p_brand, 12, ' ')"), "cast_varchar": ("CAST(p_brand AS VARCHAR(3))", "p_brand[1:3]"), "cast_decimal_cuts": ("CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DECIMAL(10,1))", "CAST(trunc(CAST(p_retailprice AS DECIMAL(10,2)) * 10) / 10 AS DECIMAL(10,1))"), "safe_cast": ("SAFE_CAST(p_name AS INTEGER)", "TRY_CAST(p_name AS INTEGER)"),
    "coalesce": ("COALESCE(nullif(p_size, 25), -1)", ""), "exists": ("EXISTS (SELECT 1 FROM region WHERE r_regionkey = p_size)", ""), "greatest": ("GREATEST(nullif(p_size, 25), 10)", "CASE WHEN p_size = 25 THEN NULL ELSE greatest(p_size, 10) END"), "greatest_ignore_nulls": ("GREATEST_IGNORE_NULLS(nullif(p_size, 25), 10)", "greatest(nullif(p_size, 25), 10)"),
    "least": ("LEAST(nullif(p_size, 25), 10)", "CASE WHEN p_size = 25 THEN NULL ELSE least(p_size, 10) END"), "least_ignore_nulls": ("LEAST_IGNORE_NULLS(nullif(p_size, 25), 10)", "least(nullif(p_size, 25), 10)"), "if": ("IF(p_size > 25, 'a', 'b')", "CASE WHEN p_size > 25 THEN 'a' ELSE 'b' END"), "ifnull": ("IFNULL(nullif(p_size, 25), 0)", ""), "in": ("p_size IN (1, 2, 3)", ""), "not_in": ("p_size NOT IN (1, 2, 3)", ""),
    "is_distinct": ("nullif(p_size, 25) IS DISTINCT FROM 10", ""), "is_not_distinct": ("nullif(p_size, 25) IS NOT DISTINCT FROM 10", ""), "is_null": ("nullif(p_size, 25) IS NULL", ""), "is_not_null": ("nullif(p_size, 25) IS NOT NULL", ""), "is_true": ("(nullif(p_size, 25) > 10) IS TRUE", ""), "is_not_true": ("(nullif(p_size, 25) > 10) IS NOT TRUE", ""), "is_false": ("(nullif(p_size, 25) > 10) IS FALSE", ""), "is_not_false": ("(nullif(p_size, 25) > 10) IS NOT FALSE", ""),
    "is_unknown": ("(nullif(p_size, 25) > 10) IS UNKNOWN", "(nullif(p_size, 25) > 10) IS NULL"), "is_not_unknown": ("(nullif(p_size, 25) > 10) IS NOT UNKNOWN", "(nullif(p_size, 25) > 10) IS NOT NULL"), "nullif": ("NULLIF(p_size, 25)", ""), "row": ("ROW(p_size, p_brand).p_brand", "p_brand"), "field": ("named_struct('x', p_size).x", "p_size"),
    "uuid": ("UUID(md5(p_name))", "CAST(CAST(md5(p_name) AS UUID) AS VARCHAR)"), "st_distance": ("round(ST_DISTANCE(ST_POINT(p_size, 0), ST_POINT(0, p_retailprice)), 6)", "round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6)"),
    # binaries
    "bin2utf8": ("BIN2UTF8(cast(p_name AS binary))", "p_name"), "octet_length": ("OCTET_LENGTH(p_name)", "CAST(strlen(p_name) AS INTEGER)"), "to_hex": ("TO_HEX(cast(p_name AS binary))", "lower(hex(p_name))"), "to_int": ("TO_INT(unhex(lpad(hex(p_size), 8, '0')))", "p_size"), "gunzip": ("CAST(GUNZIP(unhex('1f8b08000000000002ffcb48cdc9c9070086a6103605000000')) AS VARCHAR)", "'hello'"), "binary_concat": ("hex(cast(p_brand AS binary) || cast('x' AS binary))", "hex(p_brand || 'x')"), "binary_substring": ("hex(substring(cast(p_brand AS binary), 2, 3))", "hex(p_brand[2:4])"), "binary_left": ("hex(LEFT(cast(p_brand AS binary), 3))", "hex(p_brand[1:3])"), "binary_md5": ("MD5(cast(p_brand AS binary))", "md5(p_brand)"),
})

_T, _D = "o_orderdate", "CAST(o_orderdate AS DATE)"
_put("", "orders", "o_orderkey", {
    "year": (f"CAST(YEAR({_T}) AS BIGINT)", ""), "month": (f"CAST(MONTH({_T}) AS BIGINT)", ""), "dayofmonth": (f"CAST(DAYOFMONTH({_T}) AS BIGINT)", ""), "hour": (f"CAST(HOUR({_T} + INTERVAL '5' HOUR) AS BIGINT)", ""), "minute": (f"CAST(MINUTE({_T} + INTERVAL '7' MINUTE) AS BIGINT)", ""), "second": (f"CAST(SECOND({_T} + INTERVAL '9' SECOND) AS BIGINT)", ""), "quarter": (f"CAST(QUARTER({_T}) AS BIGINT)", ""),
    "week": (f"CAST(WEEK({_T}) AS BIGINT)", ""), "dow": (f"CAST(DOW({_T}) AS BIGINT)", f"CAST(dayofweek({_T}) + 1 AS BIGINT)"), "doy": (f"CAST(DOY({_T}) AS BIGINT)", f"CAST(dayofyear({_T}) AS BIGINT)"), "extract": (f"CAST(EXTRACT(MONTH FROM {_T}) AS BIGINT)", ""), "date_part": (f"CAST(DATE_PART(DAY, {_D}) AS BIGINT)", f"CAST(date_part('day', {_D}) AS BIGINT)"), "date": (f"{_D} >= DATE '1998-01-01'", ""), "timestamp": (f"{_T} >= TIMESTAMP '1998-01-01 00:00:00'", ""),
    "time": ("TIME '12:34:56' = TIME '12:34:56'", ""), "interval": (f"{_T} + INTERVAL '3' DAY", ""), "date_add": (f"DATE_ADD({_D}, INTERVAL '1' DAY)", f"CAST({_D} + INTERVAL 1 DAY AS DATE)"), "date_sub": (f"DATE_SUB({_D}, INTERVAL '1' MONTH)", f"CAST({_D} - INTERVAL 1 MONTH AS DATE)"), "date_trunc": (f"DATE_TRUNC({_D}, MONTH)", f"CAST(date_trunc('month', {_D}) AS DATE)"), "timestamp_trunc": (f"TIMESTAMP_TRUNC({_T}, YEAR)", f"CAST(date_trunc('year', {_T}) AS TIMESTAMP)"),
    "time_trunc": ("CAST(TIME_TRUNC(TIME '12:34:56', HOUR) AS VARCHAR)", "'12:00:00'"), "datediff": (f"DATEDIFF(DAY, {_T}, TIMESTAMP '2000-01-01 00:00:00')", f"datediff('day', {_T}, TIMESTAMP '2000-01-01 00:00:00')"), "timestampdiff": (f"TIMESTAMPDIFF(MONTH, {_T}, TIMESTAMP '2003-01-01 00:00:00')", f"datesub('month', {_T}, TIMESTAMP '2003-01-01 00:00:00')"), "timestampadd": (f"TIMESTAMPADD(DAY, 3, {_T})", f"{_T} + INTERVAL 3 DAY"),
    "format_date": (f"FORMAT_DATE('%Y-%m-%d', {_D})", f"strftime({_D}, '%Y-%m-%d')"), "format_timestamp": (f"FORMAT_TIMESTAMP('%d/%m/%Y %H:%M:%S', {_T})", f"strftime({_T}, '%d/%m/%Y %H:%M:%S')"), "format_time": ("FORMAT_TIME('%H:%M', TIME '12:34:56')", "'12:34'"), "parse_date": (f"PARSE_DATE('%d.%m.%Y', date_format({_T}, 'dd.MM.yyyy'))", f"{_D}"), "parse_timestamp": (f"PARSE_TIMESTAMP('%Y%m%d %H%M%S', date_format({_T}, 'yyyyMMdd HHmmss'))", f"{_T}"), "parse_time": ("CAST(PARSE_TIME('%H:%M', '12:34') AS VARCHAR)", "'12:34:00'"),
    "make_date": (f"MAKE_DATE(YEAR({_T}), MONTH({_T}), 1)", f"make_date(year({_T}), month({_T}), 1)"), "make_time": ("CAST(MAKE_TIME(1, 2, 3) AS VARCHAR)", "'01:02:03'"), "make_timestamp": (f"MAKE_TIMESTAMP(YEAR({_T}), 1, 2, 3, 4, 5)", f"make_timestamp(year({_T}), 1, 2, 3, 4, 5.0)"), "convert_timezone": (f"CONVERT_TIMEZONE('UTC', 'Asia/Tokyo', CAST({_T} AS timestamp))", f"{_T} + INTERVAL 9 HOUR"), "now": ("NOW() IS NOT NULL", "TRUE"),
    "period_contains": (f"({_T}, {_T} + INTERVAL '9' DAY) CONTAINS ({_T}, {_T} + INTERVAL '8' DAY)", "TRUE"), "period_equals": (f"({_T}, {_T} + INTERVAL '9' DAY) EQUALS ({_T}, {_T} + INTERVAL '8' DAY)", "FALSE"), "period_overlaps": (f"({_T}, {_T} + INTERVAL '9' DAY) OVERLAPS (TIMESTAMP '1998-01-01 00:00:00', TIMESTAMP '1999-01-01 00:00:00')", f"{_T} <= TIMESTAMP '1999-01-01' AND TIMESTAMP '1998-01-01' <= {_T} + INTERVAL 9 DAY"),
    "period_precedes": (f"({_T}, {_T}) PRECEDES (TIMESTAMP '1998-01-01 00:00:00', TIMESTAMP '1999-01-01 00:00:00')", f"{_T} <= TIMESTAMP '1998-01-01'"), "period_succeeds": (f"({_T}, {_T}) SUCCEEDS (TIMESTAMP '1998-01-01 00:00:00', TIMESTAMP '1999-01-01 00:00:00')", f"{_T} >= TIMESTAMP '1999-01-01'"), "period_immediately_precedes": (f"({_T}, {_T}) IMMEDIATELY PRECEDES ({_T}, {_T} + INTERVAL '1' DAY)", "TRUE"), "period_immediately_succeeds": (f"({_T}, {_T}) IMMEDIATELY SUCCEEDS ({_T} - INTERVAL '1' DAY, {_T})", "TRUE"),
})

_A, _B = "slice(sequence(1, p_size), 1, 6)", "array(2, 4, 6, NULL)"
_DA, _DB = "list_transform(range(1, least(p_size, 6) + 1), lambda x: x::INTEGER)", "[2, 4, 6, NULL]"
_M, _DM = "MAP['b', p_size, 'a', 1]", "MAP {'b': p_size, 'a': 1}"
_put("", "part", "p_partkey", {
    "array": ("ARRAY[p_size, 1]", "[p_size, 1]"), "array_append": (f"ARRAY_APPEND({_A}, 9)", f"list_append({_DA}, 9)"), "array_compact": (f"ARRAY_COMPACT({_B})", "[2, 4, 6]"), "array_concat": (f"ARRAY_CONCAT({_A}, {_B})", f"list_concat({_DA}, {_DB})"), "array_contains": (f"ARRAY_CONTAINS({_A}, 3)", f"list_contains({_DA}, 3)"), "array_distinct": (f"sort_array(ARRAY_DISTINCT(concat({_A}, {_A})))", f"list_sort(list_distinct({_DA}))"),
    "array_except": (f"ARRAY_EXCEPT({_A}, {_B})", f"list_sort(list_filter({_DA}, lambda x: x NOT IN (2, 4, 6)))"), "array_exists": (f"ARRAY_EXISTS({_A}, x -> x > 4)", "p_size > 4"), "array_insert": ("ARRAY_INSERT(array(1, 2), 2, p_size)", "[1, p_size, 2]"), "array_intersect": (f"ARRAY_INTERSECT({_A}, {_B})", f"list_sort(list_filter({_DA}, lambda x: x IN (2, 4, 6)))"), "array_join": (f"ARRAY_JOIN({_A}, '-')", f"array_to_string({_DA}, '-')"), "array_length": (f"ARRAY_LENGTH({_A})", f"CAST(len({_DA}) AS INTEGER)"),
    "array_max": (f"ARRAY_MAX({_A})", f"list_max({_DA})"), "array_min": (f"ARRAY_MIN({_A})", f"list_min({_DA})"), "array_position": (f"ARRAY_POSITION({_A}, 4)", f"CAST(coalesce(list_position({_DA}, 4), 0) AS BIGINT)"), "array_prepend": (f"ARRAY_PREPEND({_A}, 9)", f"list_prepend(9, {_DA})"), "array_remove": (f"ARRAY_REMOVE({_A}, 2)", f"list_filter({_DA}, lambda x: x <> 2)"), "array_repeat": ("ARRAY_REPEAT(p_brand, 2)", "[p_brand, p_brand]"), "array_reverse": (f"ARRAY_REVERSE({_A})", f"list_reverse({_DA})"), "array_size": (f"ARRAY_SIZE({_A})", f"CAST(len({_DA}) AS INTEGER)"),
    "array_to_string": (f"ARRAY_TO_STRING({_B}, '-', '?')", "'2-4-6-?'"), "array_union": (f"ARRAY_UNION({_A}, array(2, 9))", f"list_sort(list_distinct(list_concat({_DA}, [2, 9])))"), "arrays_overlap": (f"ARRAYS_OVERLAP({_A}, {_B})", "p_size > 1"), "array_cardinality": (f"CARDINALITY({_A})", f"CAST(len({_DA}) AS INTEGER)"), "element": ("ELEMENT(array(p_size))", "p_size"), "array_index": (f"ARRAY[p_size, 1][1] + coalesce(ARRAY[1][2], 0)", "p_size"), "safe_offset": (f"SAFE_OFFSET({_A}, 0)", "CAST(1 AS INTEGER)"),
    "sort_array": (f"SORT_ARRAY({_A}, false)", f"list_reverse({_DA})"), "transform": (f"TRANSFORM({_A}, x -> x * 2)", f"list_transform({_DA}, lambda x: (x * 2)::INTEGER)"), "map": (f"{_M}['b']", "p_size"), "map_cardinality": (f"CARDINALITY({_M})", "CAST(2 AS INTEGER)"), "map_concat": (f"MAP_CONCAT({_M}, MAP['a', 5])['a']", "CAST(5 AS INTEGER)"), "map_contains_key": (f"MAP_CONTAINS_KEY({_M}, 'c')", "FALSE"), "map_keys": (f"MAP_KEYS({_M})", "['a', 'b']"), "map_values": (f"MAP_VALUES({_M})", "[1, p_size]"), "map_equals": (f"MAP_EQUALS({_M}, MAP['a', 1, 'b', p_size])", "TRUE"),
})

_J = "PARSE_JSON(props)"
_O = "PARSE_JSON(concat('{\"k\": ', event_id, ', \"s\": \"x\", \"l\": [1, 2], \"d\": \"2024-01-02\", \"b\": true}'))"
_put("", "events", "event_id", {
    "parse_json": (f"CAST({_J} AS VARCHAR) IS NOT NULL", "TRUE"), "variant_field": (f"CAST(VARIANT_INDEX({_J}, 'k') AS BIGINT)", "CAST(props->>'k' AS BIGINT)"), "variant_element": (f"CAST(VARIANT_INDEX(VARIANT_INDEX({_O}, 'l'), 2) AS BIGINT)", "CAST(2 AS BIGINT)"), "to_json": (f"TO_JSON({_J})", "replace(props, ' ', '')"), "typeof": (f"TYPEOF(VARIANT_INDEX({_J}, 'k'))", "'BIGINT'"), "json_keys": (f"JSON_KEYS({_O})", "['b', 'd', 'k', 'l', 's']"), "json_object_keys": (f"JSON_OBJECT_KEYS({_J})", "['k']"),
    "variantnull": ("is_variant_null(VARIANTNULL())", "TRUE"), "variant_filter": (f"TO_JSON(VARIANT_FILTER({_O}, (k, v) -> k = 's'))", "'{\"s\":\"x\"}'"), "variant_map": (f"TO_JSON(VARIANT_MAP(VARIANT_FILTER({_O}, (k, v) -> k = 'k'), (k, v) -> parse_json('1')))", "'{\"k\":1}'"), "variant_merge": (f"JSON_KEYS(VARIANT_MERGE({_J}, PARSE_JSON('{{\"z\": 1}}')))", "['k', 'z']"),
})
for _kind, _duck in {"BIGINT": "event_id", "BOOLEAN": "NULL::BOOLEAN", "DATE": "NULL::DATE", "STRING": "CAST(event_id AS VARCHAR)", "TIME": "NULL::TIME", "TIMESTAMP": "NULL::TIMESTAMP"}.items():
    R.sql(
        f"fn_json_each_{_kind.lower()}",
        f"SELECT event_id, t.key, {'count(t.value) OVER (PARTITION BY event_id)' if _kind in ('DATE', 'TIME', 'TIMESTAMP', 'BOOLEAN') else 't.value'} AS v FROM events, LATERAL JSON_EACH_{_kind}({_O}) AS t WHERE t.key = 'k'",
        f"SELECT event_id, 'k' AS key, {'CAST(0 AS BIGINT)' if _kind in ('DATE', 'TIME', 'TIMESTAMP', 'BOOLEAN') else _duck} AS v FROM events",
    )
