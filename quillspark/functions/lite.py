"""Scalar functions with the rules of a small dynamically typed SQL dialect, as Columns that stay in the JVM.

Each function takes Columns or names and gives a Column. Where the built-in function has the same rules it is used as
it is (upper, lower, length, abs, coalesce, nullif, replace, instr, reverse, power).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def divide(a: Column | str, b: Column | str) -> Column:
    """Real division; null for a zero divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def int_divide(a: Column | str, b: Column | str) -> Column:
    """Division of integers, truncated towards zero; null for a zero divisor."""
    return F.call_function("div", _c(a).cast("long"), F.nullif(_c(b).cast("long"), F.lit(0).cast("long")))


def mod(a: Column | str, b: Column | str) -> Column:
    """Remainder with the sign of the dividend; null for a zero divisor."""
    return F.try_mod(_c(a), _c(b))


def plus(a: Column | str, b: Column | str) -> Column:
    """Sum; null where integers overflow."""
    return F.try_add(_c(a), _c(b))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.try_subtract(_c(a), _c(b))


def times(a: Column | str, b: Column | str) -> Column:
    return F.try_multiply(_c(a), _c(b))


def like(text: Column | str, pattern: str) -> Column:
    """Case-insensitive match with % and _; a backslash in the pattern stands for itself."""
    return _c(text).ilike(pattern.replace("\\", "\\\\"))


def concat(*parts: Column | str) -> Column:
    """All parts that aren't null, one after the other."""
    return F.concat_ws("", *(_c(p).cast("string") for p in parts))


def substr(text: Column | str, start: int | Column, length: int | Column | None = None) -> Column:
    """1-based; a start below 1 counts as 1, a negative length as 0."""
    s = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(1))
    if length is None:
        return F.substr(_c(text), s)
    n = length if isinstance(length, Column) else F.lit(length)
    return F.substr(_c(text), s, F.greatest(n, F.lit(0)))


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def trim(text: Column | str, chars: str | None = None, side: str = "both") -> Column:
    """Without white space of any kind, or any of chars, at the side named: both, left or right."""
    if chars == "":
        return _c(text)
    k = r"[\s\p{Z}]" if chars is None else _class(chars)
    pattern = {"both": f"^{k}+|{k}+$", "left": f"^{k}+", "right": f"{k}+$"}[side]
    return F.regexp_replace(_c(text), pattern, "")


def round_(x: Column | str, digits: int = 0) -> Column:
    """Half away from zero, as a real; fewer than 0 digits count as 0."""
    return F.round(_c(x).cast("double"), max(0, digits))


def floor(x: Column | str) -> Column:
    """The floor as a real, -0.0 included."""
    return F.floor(_c(x).cast("double")).cast("double")


def ceil(x: Column | str) -> Column:
    return F.ceil(_c(x).cast("double")).cast("double")


def sqrt(x: Column | str) -> Column:
    """Null for a negative number."""
    v = _c(x).cast("double")
    return F.when(v >= 0, F.sqrt(v))


def hex_(x: Column | str, kind: str = "string") -> Column:
    """Upper-case hex digits of the bytes; a number's are those of its text."""
    return F.hex(_c(x)) if kind == "binary" else F.hex(F.encode(to_text(x, kind), "UTF-8"))


def to_text(x: Column | str, kind: str = "string") -> Column:
    """Text of a value; a whole real has no fraction, and no real an exponent."""
    v = _c(x)
    if kind not in ("double", "float"):
        return v.cast("string")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e18)
    plain = F.call_function("format_number", v.cast("double"), F.lit("0." + "#" * 30))
    exponent = F.when(F.abs(v) >= 1e18, F.coalesce(v.cast("double").try_cast("decimal(38,0)").cast("string"), v.cast("string"))).otherwise(F.replace(plain, F.lit(","), F.lit("")))
    return F.when(whole, F.format_string("%d", v.cast("long"))).when(F.contains(v.cast("string"), F.lit("E")), exponent).otherwise(v.cast("string"))


def to_integer(x: Column | str) -> Column:
    """Text or number to integer: truncated, 0 for junk, null for null."""
    s = trim(_c(x).cast("string"))
    value = F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"), F.lit(0).cast("long"))
    return F.when(_c(x).isNotNull(), value)


def to_real(x: Column | str) -> Column:
    """Text or number to real: 0.0 for junk, null for null."""
    return F.when(_c(x).isNotNull(), F.coalesce(trim(_c(x).cast("string")).try_cast("double"), F.lit(0.0)))


def truthy(x: Column | str) -> Column:
    """True for a number but 0 and for the texts true, t, yes, y (any case); else false, for null too."""
    s = F.lower(trim(_c(x).cast("string")))
    return F.coalesce(s.try_cast("double") != 0, s.isin("true", "t", "yes", "y"), F.lit(False))


def to_boolean(x: Column | str) -> Column:
    """1 or 0; null for null."""
    return F.when(_c(x).isNotNull(), truthy(x).cast("long"))


def iif(condition: Column | str, yes: Column, no: Column) -> Column:
    return F.when(truthy(condition), yes).otherwise(no)


_KINDS = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "integer", "float": "real", "double": "real", "string": "text", "binary": "blob"}


def typeof(x: Column | str, kind: str) -> Column:
    """null, integer, real, text, blob or vector, for a column of Spark type kind."""
    name = "real" if kind.startswith("decimal") else "vector" if kind.startswith("array") else _KINDS.get(kind, "text")
    return F.when(_c(x).isNull(), "null").otherwise(name)


def json_path(path: str) -> str:
    """$.a.b.0 or a.b.0 as a path of get_json_object: a segment of digits is an index."""
    parts = path.removeprefix("$").strip(".").split(".")
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts if p)


def json_extract(doc: Column | str, path: str) -> Column:
    """The value at the path as text; true and false give 1 and 0, a null or missing value and broken JSON give null."""
    v = F.get_json_object(_c(doc), json_path(path))
    return F.when(v == "true", "1").when(v == "false", "0").otherwise(v)


def tokens_of(text: Column | str) -> Column:
    """Lower-case runs of letters, digits, _ and -, of more than one byte."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}_-]+"), lambda t: F.octet_length(t) > 1)


def match_any(text: Column | str, query: str) -> Column:
    """True if any token of the query is a token of the text; null text is no match."""
    return F.coalesce(F.arrays_overlap(tokens_of(text), tokens_of(F.lit(query))), F.lit(False))


#: Functions registered for SQL under a prefix, since their names belong to built-in ones with other rules.
SQL_FUNCTIONS: dict[str, tuple[str, str]] = {
    "lite_concat2": ("a STRING, b STRING", "concat_ws('', a, b)"),
    "lite_substr": ("s STRING, p INT, n INT", "substr(s, greatest(p, 1), greatest(n, 0))"),
    "lite_trim": ("s STRING", r"regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '')"),
    "lite_hex": ("s STRING", "hex(encode(s, 'UTF-8'))"),
    "lite_idiv": ("a BIGINT, b BIGINT", "a div nullif(b, 0)"),
    "lite_div": ("a DOUBLE, b DOUBLE", "try_divide(a, b)"),
    "lite_mod": ("a BIGINT, b BIGINT", "try_mod(a, b)"),
    "lite_sqrt": ("x DOUBLE", "CASE WHEN x >= 0 THEN sqrt(x) END"),
    "lite_like": ("s STRING, p STRING", r"s ILIKE replace(p, '\\', '\\\\')"),
    "lite_int": ("s STRING", "CASE WHEN s IS NOT NULL THEN coalesce(try_cast(trim(s) AS BIGINT), try_cast(try_cast(trim(s) AS DOUBLE) AS BIGINT), 0) END"),
    "lite_real": ("s STRING", "CASE WHEN s IS NOT NULL THEN coalesce(try_cast(trim(s) AS DOUBLE), 0D) END"),
    "iif": ("c BOOLEAN, a STRING, b STRING", "CASE WHEN c THEN a ELSE b END"),
    "unixepoch": ("s STRING", "unix_timestamp(try_to_timestamp(s))"),
    "julianday": ("s STRING", "unix_millis(try_to_timestamp(s)) / 86400000 + 2440587.5D"),
}


def register(spark: SparkSession) -> None:
    """Makes SQL_FUNCTIONS temporary SQL functions: their bodies are seen by the optimiser, unlike Python ones."""
    for name, (args, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")


def register_scalar(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """A user's function over pandas Series, for SQL and DataFrames, visible in WHERE as well."""
    spark.udf.register(name, F.pandas_udf(f, returns))
