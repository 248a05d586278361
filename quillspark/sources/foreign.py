"""SQLite files, spreadsheets and SQL dumps, read without their own libraries on the executors' side of Spark."""

from __future__ import annotations

import itertools
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillspark.sources.files import clean_names

#: Rows of one partition of a SQLite scan.
SQLITE_ROWS = 200_000


def mapped_type(declared: str) -> str:
    """Spark type of a foreign column type: integers and booleans, reals and decimals, blobs, else text."""
    t = (declared or "").upper()
    if any(x in t for x in ("INT", "SERIAL", "BOOL")):
        return "bigint"
    if any(x in t for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "double"
    return "binary" if any(x in t for x in ("BLOB", "BYTEA", "BINARY")) else "string"


def _cast(v, kind: str):
    if v is None:
        return None
    try:
        return int(v) if kind == "bigint" else float(v) if kind == "double" else (v if isinstance(v, bytes) else str(v).encode()) if kind == "binary" else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    except (TypeError, ValueError):
        return None


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType) -> None:
        self.path, self.table, self.schema = path, table, schema

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [] if low is None else [_Range(x, min(high, x + SQLITE_ROWS - 1)) for x in range(low, high + 1, SQLITE_ROWS)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        kinds = [f.dataType.simpleString() for f in self.schema.fields]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(f'SELECT * FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high)):
                yield tuple(_cast(v, k) for v, k in zip(row, kinds))


class SqliteSource(DataSource):
    """spark.read.format('quill_sqlite').option('path', ..).option('table', ..): ranges of rowid are partitions."""

    @classmethod
    def name(cls) -> str:
        return "quill_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            info = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not info:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return ", ".join(f"`{n}` {mapped_type(t)}" for n, t in zip(clean_names([r[1] for r in info]), (r[2] for r in info)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], schema)


def read_sqlite(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A table of a SQLite file; the table must be named."""
    if not table:
        raise ValueError("a SQLite file needs the name of a table")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("quill_sqlite").option("path", path).option("table", table).load()


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet, named in any case, else the first; cells as text, empty ones and the word null as None."""
    with zipfile.ZipFile(path) as z:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheets = ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)
        named = {s.get("name", "").lower(): s.get(f"{{{_NS['r']}}}id") for s in sheets}
        rid = named.get((sheet or "").lower()) or next(iter(named.values()))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[rid].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                out: list[str | None] = []
                for i, c in enumerate(row.findall("m:c", _NS)):
                    at = _column(c.get("r")) if c.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    v = c.find("m:v", _NS)
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    text = strings[int(text)] if c.get("t") == "s" and text is not None else text
                    out[at] = None if text is None or text == "" or text.lower() == "null" else text
                yield out
                row.clear()


_ODS = {"o": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "t": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "x": "urn:oasis:names:tc:opendocument:xmlns:text:1.0"}


def ods_rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet of an OpenDocument spreadsheet (the first unless named), cells as text, null where empty; read as a stream."""
    o, t, x = (f"{{{_ODS[k]}}}" for k in "otx")
    inside = False
    with zipfile.ZipFile(path) as z, z.open("content.xml") as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            if e.tag == f"{t}table":
                if event == "end" and inside:
                    return
                inside = event == "start" and (sheet is None or e.get(f"{t}name") == sheet)
            elif event == "end" and e.tag == f"{t}table-row" and inside:
                row: list[str | None] = []
                for c in e:
                    kind, value = c.get(f"{o}value-type"), c.get(f"{o}value") or c.get(f"{o}date-value") or c.get(f"{o}boolean-value")
                    text = "\n".join("".join(p.itertext()) for p in c.findall(f"{x}p"))
                    cell = None if kind is None and not text else value if value is not None else text
                    times = int(c.get(f"{t}number-columns-repeated") or 1)
                    row += [cell] * (times if cell is not None else min(times, 16_384))
                while row and row[-1] is None:
                    row.pop()
                for _ in range(int(e.get(f"{t}number-rows-repeated") or 1) if row else 1):
                    yield list(row)
                e.clear()


def write_ods(df: DataFrame, path: str, sheet: str = "Sheet1", most: int = 1_048_575) -> int:
    """An OpenDocument spreadsheet of one sheet, in the order of the table; the number of rows written. A table of more rows than a sheet has is refused."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a sheet holds at most {most} rows")

    def cell(v) -> str:
        if v is None or v != v:
            return "<t:table-cell/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<t:table-cell o:value-type="float" o:value="{v}"/>'
        return f'<t:table-cell o:value-type="string"><x:p>{_escape(str(v))}</x:p></t:table-cell>'

    lines = ["<t:table-row>" + "".join(cell(v.item() if hasattr(v, "item") else v) for v in r) + "</t:table-row>" for r in [tuple(map(str, rows.columns)), *rows.itertuples(index=False)]]
    names = " ".join(f'xmlns:{k}="{v}"' for k, v in _ODS.items())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet", zipfile.ZIP_STORED)
        z.writestr("META-INF/manifest.xml", '<?xml version="1.0"?><m:manifest xmlns:m="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><m:file-entry m:full-path="/" m:media-type="application/vnd.oasis.opendocument.spreadsheet"/><m:file-entry m:full-path="content.xml" m:media-type="text/xml"/></m:manifest>')
        z.writestr("content.xml", f'<?xml version="1.0"?><o:document-content {names}><o:body><o:spreadsheet><t:table t:name="{_escape(sheet)}">' + "".join(lines) + "</t:table></o:spreadsheet></o:body></o:document-content>")
    return len(rows)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet with a header row; blank rows are skipped; a column is integer or real if all its cells are.

    A workbook holds about a million rows at most and is read by one process.
    """
    from quillspark.sources.files import _typed

    found = ods_rows(path, sheet) if path.lower().endswith(".ods") else sheet_rows(path, sheet)
    rows = (r for r in found if any(x is not None for x in r))
    head = next(rows, None)
    if head is None:
        return spark.createDataFrame([], StructType([]))
    names = clean_names([x or "" for x in head])
    body = [(r + [None] * len(names))[: len(names)] for r in rows]
    table = pa.table({n: pa.array([r[i] for r in body], pa.string()) for i, n in enumerate(names)})
    return _typed(spark.createDataFrame(table), names)


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1", most: int = 1_048_575) -> int:
    """A workbook of one sheet, in the order of the table; the number of rows written. A table of more rows than a sheet has is refused."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a sheet holds at most {most} rows")

    def cell(v) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{_escape(str(v))}</t></is></c>'

    lines = ["<row>" + "".join(cell(str(c)) for c in rows.columns) + "</row>"]
    lines += ["<row>" + "".join(cell(v.item() if hasattr(v, "item") else v) for v in r) + "</row>" for r in rows.itertuples(index=False)]
    m, r = _NS["m"], _NS["r"]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{r}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="{_escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{r}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="{m}"><sheetData>' + "".join(lines) + "</sheetData></worksheet>")
    return len(rows)


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


_CREATE = re.compile(r"^CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`\"\[\]]+)\s*\((.*)\)", re.I | re.S)
_INSERT = re.compile(r"^(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\s+([\w.`\"\[\]]+)\s*(?:\(([^()]*)\))?\s*VALUES\s*(.*)$", re.I | re.S)
_COPY = re.compile(r"^COPY\s+([\w.`\"\[\]]+)\s*(?:\(([^()]*)\))?\s+FROM\s+stdin;?\s*$", re.I)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", "b": "\b"}


def _name(x: str) -> str:
    return re.sub(r"[`\"\[\]]", "", x.strip()).rpartition(".")[2].lower()


def _statements(text: Iterator[str]) -> Iterator[str | tuple[str, list[str]]]:
    """Statements of a dump, and (COPY statement, data lines); comments are left out, quotes kept whole."""
    open_: list[str] = []
    lines = iter(text)
    for line in lines:
        if not open_ and (m := _COPY.match(line.strip())):
            data = []
            for d in lines:
                if d.rstrip("\n") == "\\.":
                    break
                data.append(d.rstrip("\n"))
            yield m.group(0), data
            continue
        if not open_ and (not line.strip() or line.lstrip().startswith(("--", "#", "/*"))):
            continue
        open_.append(line)
        whole = "".join(open_)
        bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", whole)
        if bare.rstrip().endswith(";") and bare.count("'") % 2 == 0:
            yield whole.strip().rstrip(";")
            open_ = []


def _tuples(text: str) -> Iterator[list[str | None]]:
    """The value lists of an INSERT."""
    token = re.compile(r"\s*('(?:[^'\\]|\\.|'')*'|[^,()']+|[(),])")
    row: list[str | None] | None = None
    for m in token.finditer(text):
        x = m[1].strip()
        if x == "(":
            row = []
        elif x == ")":
            if row is not None:
                yield row
            row = None
        elif x == "," or row is None or not x:
            continue
        elif x[0] == "'":
            row.append(re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), x[1:-1].replace("''", "'")))
        else:
            row.append(None if x.upper() == "NULL" else x)


def _columns_of(body: str) -> list[tuple[str, str]]:
    parts, depth, part = [], 0, ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    out = []
    for p in [*parts, part]:
        words = p.strip().split()
        if len(words) >= 1 and words[0].upper() not in ("PRIMARY", "UNIQUE", "KEY", "CONSTRAINT", "FOREIGN", "CHECK", "INDEX", "FULLTEXT"):
            out.append((_name(words[0]), mapped_type(words[1] if len(words) > 1 else "")))
    return out


def read_dump(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A table of a SQL dump (PostgreSQL COPY, MySQL or SQLite INSERT); without a name the first that has a definition.

    A dump is a stream of statements, so one task parses it, and sends rows on in batches; the path must be one that the
    executors see. SET, PRAGMA, ALTER, DROP, LOCK and comments are skipped.
    """
    wanted, columns = _name(table) if table else None, None
    with open(path, encoding="utf-8", errors="replace") as f:  # up to the definition, or the first rows
        for st in _statements(f):
            if isinstance(st, tuple):
                m = _COPY.match(st[0])
                if _name(m[1]) == (wanted or _name(m[1])):
                    wanted, columns = _name(m[1]), columns or [(_name(c), "string") for c in (m[2] or "").split(",") if c.strip()]
                    break
            elif (m := _CREATE.match(st)) and _name(m[1]) == (wanted or _name(m[1])):
                wanted, columns = _name(m[1]), _columns_of(m[2])
                break
            elif (m := _INSERT.match(st)) and _name(m[1]) == (wanted or _name(m[1])):
                first = next(_tuples(m[3]), [])
                wanted, columns = _name(m[1]), [(_name(c), "string") for c in (m[2] or "").split(",") if c.strip()] or [(f"col_{i}", "string") for i in range(len(first))]
                break
    if not columns:
        raise ValueError(f"no table {table or ''} in {path}")
    names, kinds, name = [n for n, _ in columns], dict(columns), wanted

    def rows() -> Iterator[tuple]:
        with open(path, encoding="utf-8", errors="replace") as f:
            for st in _statements(f):
                if isinstance(st, tuple):
                    m = _COPY.match(st[0])
                    listed, values = m[2], ([None if x == "\\N" else re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), x) for x in line.split("\t")] for line in st[1])
                elif m := _INSERT.match(st):
                    listed, values = m[2], _tuples(m[3])
                else:
                    continue
                if _name(m[1]) != name:
                    continue
                cols = [_name(c) for c in (listed or "").split(",") if c.strip()] or names
                for v in values:
                    found = dict(zip(cols, v))
                    yield tuple(_cast(found.get(n), kinds[n]) for n in names)

    schema = ", ".join(f"`{n}` {k}" for n, k in columns)
    kind = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        todo = rows()
        while block := list(itertools.islice(todo, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), kind)], schema=kind)

    return spark.range(0, 1, 1, 1).mapInArrow(parse, schema)


def write_dump(df: DataFrame, path: str, table: str, style: str = "insert") -> None:
    """A directory of INSERT statements, or of COPY blocks with style copy, a file a task, with the table's definition beside them."""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    if style == "copy":
        escaped = lambda c: F.coalesce(F.replace(F.replace(F.replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\\N"))
        head = f"COPY {table} ({', '.join(df.columns)}) FROM stdin;"

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = lambda x: pa.RecordBatch.from_arrays([x], names=["value"])
            yield one(pa.array([head]))
            for b in batches:
                yield one(b.column(0))
            yield one(pa.array(["\\."]))

        df.select(F.concat_ws("\t", *map(escaped, df.columns)).alias("value")).mapInArrow(block, "value string").write.mode("error").text(path)
    else:
        lit = [F.coalesce(F.col(f"`{c}`").cast("string") if t in ("bigint", "int", "double", "float", "smallint") else F.concat(F.lit("'"), F.replace(F.col(f"`{c}`").cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")) for c, t in df.dtypes]
        line = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *lit), F.lit(");"))
        df.select(line.alias("value")).write.mode("error").text(path)
    ddl = f"CREATE TABLE {table} ({', '.join(f'{c} {kinds.get(t, "TEXT")}' for c, t in df.dtypes)});"
    df.sparkSession.createDataFrame([(ddl,)], "value string").coalesce(1).write.mode("error").text(f"{path}.schema")
