"""Finding, reading and writing files of the formats that Spark reads itself."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.hadoop import FileSystem

#: Formats by ending.
ENDINGS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "tsv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "xlsx": "xlsx", "ods": "xlsx", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite", "sql": "dump", "txt": "text", "text": "text", "md": "text", "markdown": "text"}
_SEPARATORS = ",\t;|"


def infer_format(path: str) -> str:
    """The format by a path's ending, with .gz left off."""
    ending = re.sub(r"\.gz$", "", path.lower()).rpartition(".")[2]
    if ending not in ENDINGS:
        raise ValueError(f"no format is known for {path}")
    return ENDINGS[ending]


def discover(pattern: str, format: str | None = None) -> list[str]:
    """Files of a path, directory or glob (with ** for any depth) on any storage, sorted; hidden and marker files are left out."""
    fs = FileSystem(SparkSession.active(), pattern)
    base, deep, rest = pattern.partition("**")
    found = fs.files(base.rstrip("/") or "/" if deep else pattern)
    if deep and rest.strip("/"):
        last = re.compile(".*/" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in rest.strip("/")) + "$")
        found = [f for f in found if last.match(f)]
    inner = len(_root(pattern).rstrip("/")) + 1
    keep = [p for p in found if not any(x.startswith(("_", ".")) for x in (p[inner:] or p.rpartition("/")[2]).split("/"))]
    if format:
        keep = [p for p in keep if (e := re.sub(r"\.gz$", "", p.lower()).rpartition(".")[2]) in ENDINGS and ENDINGS[e] == format]
    if not keep:
        raise FileNotFoundError(pattern)
    return sorted(keep)


def clean_names(names: list[str]) -> list[str]:
    """Column names of letters, digits and _: empty ones are col_i, a leading digit gets c_, repeated ones get _n."""
    out: list[str] = []
    for i, name in enumerate(names):
        x = re.sub(r"\W", "_", (name or "").strip()).strip("_") or f"col_{i}"
        x = f"c_{x}" if x[0].isdigit() else x
        base, n = x, 2
        while x.lower() in (y.lower() for y in out):
            x, n = f"{base}_{n}", n + 1
        out.append(x)
    return out


def _root(pattern: str) -> str:
    """The part of a pattern before any wildcard or k=v segment."""
    parts = pattern.split("/")
    stop = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[") or "=" in p), len(parts))
    return "/".join(parts[:stop]) or "/"


def _base(pattern: str) -> str:
    root = _root(pattern)
    return root if FileSystem(SparkSession.active(), root).is_dir(root) else root.rpartition("/")[0]


def read_parquet(spark: SparkSession, pattern: str) -> DataFrame:
    """A file, directory or glob; k=v segments of the paths are columns, by which Spark prunes files."""
    if "**" in pattern:
        return spark.read.option("basePath", _base(pattern)).parquet(*discover(pattern, "parquet"))
    reader = spark.read.option("basePath", _base(pattern)) if "=" in pattern or any(c in pattern for c in "*?[") else spark.read
    return reader.parquet(pattern)


def sniff(line: str) -> str:
    """The separator that stands most often in a header line outside quotes; a comma if none does."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(_SEPARATORS, key=lambda c: (bare.count(c), -_SEPARATORS.index(c)))


def _typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as integers or reals where every value is one, by one aggregation over all rows; empty text is null."""
    if not columns:
        return df
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    checks = [F.bool_and(F.coalesce(blank(F.col(f"`{c}`")).try_cast(t).isNotNull(), F.lit(True)) | blank(F.col(f"`{c}`")).isNull()) for c in columns for t in ("bigint", "double")]
    fits = df.agg(*(x.alias(str(i)) for i, x in enumerate(checks))).first()
    casts = {}
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        casts[c] = blank(x).try_cast("bigint") if fits[2 * i] else blank(x).try_cast("double") if fits[2 * i + 1] else F.when(x != "", x)
    return df.withColumns(casts)


def read_csv(spark: SparkSession, pattern: str, sep: str | None = None, infer: bool = True) -> DataFrame:
    """With a header row; the separator is sniffed among comma, tab, semicolon and bar; quotes and line breaks as in RFC 4180.

    Rows with another number of fields than the header are left out. gzip is read by the ending.
    """
    files = discover(pattern)
    head = spark.read.text(files[0]).first()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    sep = sep or sniff(head[0].lstrip("﻿"))
    # Only a file with a quoted line break can't be split: one with a line that opens a quote and doesn't close it.
    broken = not spark.read.text(files).where(F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1).isEmpty()
    reader = spark.read.option("basePath", _base(pattern)).options(header=True, sep=sep, quote='"', escape='"', multiLine=broken, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=False)
    df = reader.csv(files)
    names = clean_names(next(csv.reader([head[0].lstrip("\ufeff")], delimiter=sep)))
    df = df.toDF(*names, *df.columns[len(names) :])  # partition columns stand last
    return _typed(df, names) if infer else df


def read_tsv(spark: SparkSession, pattern: str) -> DataFrame:
    return read_csv(spark, pattern, "\t")


def read_json(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of objects, or a file that holds one array of objects; columns in alphabetical order."""
    files = discover(pattern)
    first = spark.read.text(files[0]).where("trim(value) <> ''").first()
    whole = first is not None and first[0].lstrip().startswith("[")
    df = spark.read.option("multiLine", whole).json(files)
    return df.select(*sorted(df.columns)) if df.columns else df


def read_any(spark: SparkSession, pattern: str, format: str | None = None, **options) -> DataFrame:
    """Whatever the format is, given or by the ending."""
    from quillspark.sources import foreign, texts

    kind = format or infer_format(pattern if not FileSystem(spark, pattern).is_dir(pattern) else discover(pattern)[0])
    match kind:
        case "parquet":
            return read_parquet(spark, pattern)
        case "csv":
            return read_csv(spark, pattern)
        case "tsv":
            return read_tsv(spark, pattern)
        case "json" | "jsonl":
            return read_json(spark, pattern)
        case "xlsx":
            return foreign.read_xlsx(spark, pattern, **options)
        case "sqlite":
            return foreign.read_sqlite(spark, pattern, **options)
        case "dump":
            return foreign.read_dump(spark, pattern, **options)
        case "text":
            return texts.read_text(spark, pattern, **options)
        case "pdf":
            raise ValueError("PDF files can't be read here: no PDF library is available")
    raise ValueError(f"unknown format: {kind}")


def _as_json(df: DataFrame) -> DataFrame:
    """One column of JSON lines: binary as 0x hex, reals that aren't finite as null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.concat(F.lit("0x"), F.lower(F.hex(c)))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("value"))


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Writes a directory of Parquet (Snappy), CSV, TSV or JSON lines, one subdirectory per value of partition_by."""
    match format:
        case "parquet":
            w = df.write.mode(mode)
            (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        case "csv" | "tsv":
            flat = df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields))
            w = flat.write.mode(mode).options(header=True, sep="," if format == "csv" else "\t", quote='"', escape='"')
            (w.partitionBy(*partition_by) if partition_by else w).csv(path)
        case "jsonl":
            _as_json(df).write.mode(mode).text(path)
        case _:
            raise ValueError(f"unknown format: {format}")


def convert(spark: SparkSession, source: str, target: str, source_format: str | None = None, target_format: str = "parquet", **options) -> int:
    """Any input to any output; the number of rows written."""
    df = read_any(spark, source, source_format, **options)
    write(df, target, target_format)
    return read_any(spark, target, target_format).count()
