"""Scalar expressions of the dialect, rewritten to expressions that Spark plans: no Python runs over rows.

Rewritten are calls (dates with modifiers, typeof, json_extract, vector_cosine, vector_l2, iif, substr, trim, hex, sqrt,
round, the decision functions), casts with the dialect's rules, ``a ->> 'key'``, ``a.b.c`` paths of JSON columns, LIKE in
any case, and ``column MATCH 'words'``. Parts within quotes stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from quillspark.functions.lite import json_path
from quillspark.sql.text import closing, masked, split_list

#: SQL functions made once a session: name, parameters, body. Their bodies are seen by the optimiser.
FUNCTIONS = (
    ("quill_time", "s STRING, epoch BOOLEAN", r"""
        CASE WHEN lower(trim(s)) = 'now' THEN current_timestamp()
             WHEN trim(s) RLIKE '^[+-]?[0-9]+([.][0-9]+)?$' THEN timestamp_millis(CAST(round(CASE WHEN epoch THEN try_cast(trim(s) AS DOUBLE) ELSE (try_cast(trim(s) AS DOUBLE) - 2440587.5D) * 86400D END * 1000) AS BIGINT))
             WHEN trim(s) RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,3})?)?)?$' THEN try_cast(trim(s) AS TIMESTAMP)
             WHEN trim(s) RLIKE '^[0-9]{2}:[0-9]{2}(:[0-9]{2})?$' THEN try_cast(concat('2000-01-01 ', trim(s)) AS TIMESTAMP) END"""),
    ("quill_moved", "t TIMESTAMP, m STRING", r"""
        CASE WHEN m IN ('utc', 'unixepoch') THEN t
             WHEN m LIKE 'start of %' THEN date_trunc(substr(m, 10), t)
             WHEN m RLIKE '^[+-]?[0-9]+([.][0-9]+)? *(month|year)s?$' THEN t + make_interval(0, CAST(try_cast(regexp_extract(m, '^([+-]?[0-9]+)', 1) AS INT) * CASE WHEN m LIKE '%year%' THEN 12 ELSE 1 END AS INT))
             WHEN m RLIKE '^[+-]?[0-9]+([.][0-9]+)? *(second|minute|hour|day)s?$' THEN timestamp_micros(CAST(unix_micros(t) + round(try_cast(regexp_extract(m, '^([+-]?[0-9.]+)', 1) AS DOUBLE) * 1000000 *
                  CASE WHEN m LIKE '%second%' THEN 1 WHEN m LIKE '%minute%' THEN 60 WHEN m LIKE '%hour%' THEN 3600 ELSE 86400 END) AS BIGINT))
             ELSE raise_error(concat('unknown modifier: ', m)) END"""),
    ("quill_real_text", "x DOUBLE", r"CASE WHEN x IS NULL THEN NULL WHEN abs(x) >= 1e18 THEN coalesce(CAST(try_cast(x AS DECIMAL(38, 0)) AS STRING), CAST(x AS STRING)) WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS STRING) WHEN CAST(x AS STRING) LIKE '%E%' THEN regexp_replace(regexp_replace(format_number(x, '0.##############################'), ',', ''), '0+$', '') ELSE CAST(x AS STRING) END"),
    ("quill_integer", "s STRING", r"CASE WHEN s IS NOT NULL THEN coalesce(try_cast(trim(s) AS BIGINT), try_cast(try_cast(trim(s) AS DOUBLE) AS BIGINT), 0) END"),
    ("quill_real", "s STRING", r"CASE WHEN s IS NOT NULL THEN coalesce(try_cast(trim(s) AS DOUBLE), 0D) END"),
    ("quill_true", "s STRING", r"coalesce(try_cast(trim(s) AS DOUBLE) <> 0, lower(trim(s)) IN ('true', 't', 'yes', 'y'), false)"),
    ("quill_json", "d STRING, p STRING", r"CASE get_json_object(d, p) WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE get_json_object(d, p) END"),
    ("quill_match", "s STRING, q STRING", r"coalesce(arrays_overlap(filter(split(lower(s), '[^\\p{L}\\p{N}_-]+'), x -> octet_length(x) > 1), filter(split(lower(q), '[^\\p{L}\\p{N}_-]+'), x -> octet_length(x) > 1)), false)"),
    ("quill_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", r"aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("quill_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", r"CASE WHEN size(a) = size(b) AND quill_dot(a, a) > 0 AND quill_dot(b, b) > 0 THEN greatest(0D, least(2D, 1 - quill_dot(a, b) / sqrt(quill_dot(a, a) * quill_dot(b, b)))) ELSE 1D END"),
    ("quill_l2", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", r"CASE WHEN size(a) = size(b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) ELSE 1.7976931348623157E308D END"),
)
_DIRECTIVES = {"%Y": "date_format({t}, 'yyyy')", "%m": "date_format({t}, 'MM')", "%d": "date_format({t}, 'dd')", "%H": "date_format({t}, 'HH')", "%M": "date_format({t}, 'mm')", "%S": "date_format({t}, 'ss')", "%f": "date_format({t}, 'ss.SSS')", "%w": "CAST(dayofweek({t}) - 1 AS STRING)", "%j": "lpad(CAST(dayofyear({t}) AS STRING), 3, '0')", "%W": "lpad(CAST(CAST(floor((dayofyear({t}) - 1 - pmod(dayofweek({t}) - 2, 7) + 7) / 7) AS INT) AS STRING), 2, '0')", "%s": "CAST(CAST(floor(unix_millis({t}) / 1000) AS BIGINT) AS STRING)", "%%": "'%'"}


def register(spark: SparkSession) -> None:
    for name, params, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")


def _instant(args: list[str]) -> str:
    """A timestamp from a time string and modifiers, which are literals or expressions."""
    text, mods = (args[0] if args else "'now'"), args[1:]
    epoch = " OR ".join(f"lower(trim({m})) = 'unixepoch'" for m in mods) or "false"
    out = f"quill_time(CAST({text} AS STRING), {epoch})"
    for m in mods:
        out = f"quill_moved({out}, lower(trim({m})))"
    return out


def _strftime(args: list[str]) -> str:
    form, t = args[0].strip("'"), _instant(args[1:])
    parts = []
    for piece in re.findall(r"%.|[^%]+", form):
        if piece[0] == "%" and piece not in _DIRECTIVES:
            raise ValueError(f"unknown directive: {piece}")
        parts.append(_DIRECTIVES[piece].format(t=t) if piece[0] == "%" else f"'{piece}'")
    return f"CASE WHEN {t} IS NOT NULL THEN concat({', '.join(parts)}) END"


def _typeof(args: list[str]) -> str:
    x = args[0]
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' WHEN typeof({x}) LIKE 'array%' THEN 'vector' ELSE 'text' END"


def _text(x: str) -> str:
    return f"CASE WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN quill_real_text(try_cast(CAST({x} AS STRING) AS DOUBLE)) ELSE CAST({x} AS STRING) END"


def _vector(x: str) -> str:
    """A column of numbers, a list in brackets, or its text."""
    x = x.strip()
    if x[:1] == "'":
        return f"from_json({x}, 'array<double>')"
    return f"CAST(array({x[1:-1]}) AS ARRAY<DOUBLE>)" if x[:1] == "[" else f"CAST({x} AS ARRAY<DOUBLE>)"


def _path(x: str) -> str:
    return "'" + json_path(x.strip().strip("'")).replace("'", "''") + "'"


def _substr(a: list[str]) -> str:
    return f"substr(CAST({a[0]} AS STRING), greatest({a[1]}, 1)" + (f", greatest({a[2]}, 0))" if len(a) > 2 else ")")


def _trim(side: str) -> Callable[[list[str]], str]:
    def f(a: list[str]) -> str:
        k = r"[\\s\\p{Z}]" if len(a) == 1 else "[" + "".join(f"\\\\x{{{ord(c):x}}}" for c in a[1].strip("'")) + "]"
        pattern = {"both": f"^{k}+|{k}+$", "left": f"^{k}+", "right": f"{k}+$"}[side]
        return f"regexp_replace({a[0]}, '{pattern}', '')"

    return f


CALLS: dict[str, Callable[[list[str]], str]] = {
    "date": lambda a: f"date_format({_instant(a)}, 'yyyy-MM-dd')",
    "time": lambda a: f"date_format({_instant(a)}, 'HH:mm:ss')",
    "datetime": lambda a: f"date_format({_instant(a)}, 'yyyy-MM-dd HH:mm:ss')",
    "strftime": _strftime,
    "unixepoch": lambda a: f"CAST(floor(unix_millis({_instant(a)}) / 1000) AS BIGINT)",
    "julianday": lambda a: f"(unix_millis({_instant(a)}) / 86400000D + 2440587.5D)",
    "typeof": _typeof,
    "json_extract": lambda a: f"quill_json({a[0]}, {_path(a[1])})",
    "vector_cosine": lambda a: f"quill_cosine({_vector(a[0])}, {_vector(a[1])})",
    "vector_l2": lambda a: f"quill_l2({_vector(a[0])}, {_vector(a[1])})",
    "iif": lambda a: f"CASE WHEN quill_true(CAST({a[0]} AS STRING)) THEN {a[1]} ELSE {a[2]} END",
    "substr": _substr,
    "trim": _trim("both"),
    "ltrim": _trim("left"),
    "rtrim": _trim("right"),
    "hex": lambda a: f"CASE WHEN typeof({a[0]}) = 'binary' THEN hex({a[0]}) ELSE hex(encode({_text(a[0])}, 'UTF-8')) END",
    "sqrt": lambda a: f"CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END",
    "round": lambda a: f"round(CAST({a[0]} AS DOUBLE), greatest(0, {a[1] if len(a) > 1 else 0}))",
    "mod": lambda a: f"try_mod({a[0]}, {a[1]})",
    "concat": lambda a: f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in a)})",
}
_CASTS = {"integer": "quill_integer(CAST({x} AS STRING))", "int": "quill_integer(CAST({x} AS STRING))", "bigint": "quill_integer(CAST({x} AS STRING))", "real": "quill_real(CAST({x} AS STRING))", "double": "quill_real(CAST({x} AS STRING))", "boolean": "CASE WHEN {x} IS NOT NULL THEN CAST(quill_true(CAST({x} AS STRING)) AS INT) END", "blob": "encode(CAST({x} AS STRING), 'UTF-8')"}
_CALL = re.compile(r"(?<![\w.`])(" + "|".join([*CALLS, "cast"]) + r")\s*\(", re.I)


def add_calls(calls: dict[str, Callable[[list[str]], str]]) -> None:
    """More calls that are rewritten, by name."""
    global _CALL
    CALLS.update(calls)
    _CALL = re.compile(r"(?<![\w.`])(" + "|".join([*CALLS, "cast"]) + r")\s*\(", re.I)


def _calls(text: str) -> str:
    mask, out, at = masked(text), [], 0
    while m := _CALL.search(mask, at):
        end = closing(mask, m.end() - 1)
        inner, name = text[m.end() : end], m[1].lower()
        out.append(text[at : m.start()])
        if name == "cast":
            parts = re.split(r"\s+AS\s+(?=[\w(), ]+$)", inner, flags=re.I)
            x, kind = _calls(" AS ".join(parts[:-1])), parts[-1].strip()
            out.append("(" + _CASTS[kind.lower()].format(x=x) + ")" if kind.lower() in _CASTS else f"({_text(x)})" if kind.lower() in ("text", "varchar") else f"CAST({x} AS {kind})")
        else:
            args = [_calls(x) for x in split_list(inner)] if inner.strip() else []
            if name in ("trim", "ltrim", "rtrim") and re.search(r"\bFROM\b", masked(inner), re.I):
                out.append(f"{m[1]}({_calls(inner)})")  # the standard's own form
            else:
                out.append("(" + CALLS[name](args) + ")")
        at = end + 1
    return "".join(out) + text[at:]


_ARROW = re.compile(r"((?:\w+\.)?\w+)\s*->>?\s*('(?:[^']|'')*')")
_MATCH = re.compile(r"((?:\w+\.)?\w+)\s+MATCH\s+('(?:[^']|'')*'|\?)", re.I)


def rewrite(text: str, json_columns: set[str] = frozenset(), names: set[str] = frozenset()) -> str:
    """SQL of the dialect as Spark's. json_columns: text columns whose dotted paths are looked into; names: tables and aliases, which stay."""
    text = _ARROW.sub(lambda m: f"json_extract({m[1]}, {m[2]})", text)
    text = _MATCH.sub(lambda m: f"quill_match({m[1]}, {m[2]})", text)
    if json_columns:
        from quillspark.sql.text import outside_quotes

        one = re.compile(r"(?<![\w.`])((?:\w+\.)?)(" + "|".join(sorted(map(re.escape, json_columns), key=len, reverse=True)) + r")((?:\.\w+)+)(?!\w|\s*\()")
        put = lambda m: m[0] if not m[1] and m[2].lower() in names or m[1] and m[1][:-1].lower() not in names else f"quill_json({m[1]}{m[2]}, {{{{{m[3][1:]}}}}})"
        text = outside_quotes(text, lambda part: one.sub(put, part))
        text = re.sub(r"\{\{([\w.]+)\}\}", lambda m: _path(m[1]), text)
    from quillspark.sql.text import outside_quotes

    text = outside_quotes(text, lambda part: re.sub(r"(?<!\w)LIKE(?!\w)", "ILIKE", part, flags=re.I))
    return _calls(text)
