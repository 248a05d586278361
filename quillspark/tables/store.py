"""Tables that change: hash-bucketed Parquet files, constraints, upserts, time travel and a change feed.

A table is a directory on any file system that Spark reaches. ``log/<n>`` describes version n: the files of each bucket,
the schema, the constraints, the versions that led to it and their change files. A version counts once its file in the
log is written, which fails if it exists, so a statement happens wholly or not at all. Rows are dealt to buckets by a hash
of their primary key; a statement writes only the buckets that hold rows it touches, and an insert only adds files.
Going back makes a new version with the description of the old one, so that rows, history and feed agree. One writer at a
time is assumed.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import checkpointed
from quillspark.sources.hadoop import FileSystem

OPEN_END = 9_223_372_036_854_775_807
#: Buckets of a new table; more for larger ones.
BUCKETS = 16


class ConstraintError(ValueError):
    """A statement would break a constraint; nothing is changed."""


@dataclass
class Rules:
    """Constraints of a table; SQL texts see the columns of the row to be written.

    unique: lists of columns, or {columns, where} for rows that a condition holds for. foreign_keys: {columns, table,
    references, on_delete, on_update}, the actions restrict (the default), cascade, set null.
    """

    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    unique: list = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    foreign_keys: list[dict] = field(default_factory=list)
    versioned: bool = False


def _renamed(text: str, old: str, new: str) -> str:
    """SQL with an identifier renamed outside quoted text."""
    return "".join(p if i % 2 else re.sub(rf"(?<![\w`])`?{re.escape(old)}`?(?!\w)", new, p) for i, p in enumerate(re.split(r"('(?:[^']|'')*')", text)))


class Store:
    """The tables under a directory."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = FileSystem(spark, root)
        self._saved: list[tuple[str | None, dict[str, int]]] = []
        self.fs.make_dir(self.root)

    # Catalog.
    def _dir(self, name: str) -> str:
        return f"{self.root}/{name.lower()}"

    def tables(self) -> list[str]:
        return [d for d in self.fs.names(self.root) if self.fs.names(f"{self._dir(d)}/log")]

    def version(self, name: str) -> int:
        log = [int(x) for x in self.fs.names(f"{self._dir(name)}/log") if x.isdigit()]
        if not log:
            raise KeyError(f"no table {name}")
        return max(log)

    def _state(self, name: str, version: int | None = None) -> dict:
        return json.loads(self.fs.read(f"{self._dir(name)}/log/{self.version(name) if version is None else version}"))

    def _write_state(self, name: str, version: int, state: dict) -> None:
        self.fs.write(f"{self._dir(name)}/log/{version}", json.dumps(state))

    def rules(self, name: str) -> Rules:
        return Rules(**self._state(name)["rules"])

    def create(self, name: str, schema: str, rules: Rules | None = None, if_not_exists: bool = False, buckets: int = BUCKETS) -> None:
        if name.lower() in self.tables():
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        rules = rules or Rules()
        if rules.versioned and not rules.primary_key:
            raise ValueError("a versioned table needs a primary key")
        kinds = self.spark.createDataFrame([], schema).dtypes
        self._write_state(name, 0, {"rules": asdict(rules), "columns": kinds, "buckets": buckets, "files": {}, "line": [[0, 0]], "changes": []})

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name.lower() not in self.tables():
            if if_exists:
                return
            raise KeyError(f"no table {name}")
        self.fs.remove(self._dir(name))

    def columns(self, name: str) -> list[tuple[str, str]]:
        """Names and types."""
        return [tuple(c) for c in self._state(name)["columns"]]

    def table_info(self, name: str) -> DataFrame:
        """cid, name, type, notnull, dflt_value, pk of each column."""
        rules = self.rules(name)
        rows = [(i, c, t, int(c in rules.not_null or c in rules.primary_key), rules.defaults.get(c), rules.primary_key.index(c) + 1 if c in rules.primary_key else 0) for i, (c, t) in enumerate(self.columns(name))]
        return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")

    def alter(self, name: str, add: tuple[str, str, str | None] | None = None, rename: tuple[str, str] | None = None, drop: str | None = None) -> None:
        """add (column, type, default SQL or None), rename (old, new) or drop a column. A renamed column is renamed in all rules, those of other tables too."""
        df, state = self.table(name), self._state(name)
        rules = Rules(**state["rules"])
        if add:
            df = df.withColumn(add[0], (F.expr(add[2]) if add[2] else F.lit(None)).cast(add[1]))
            if add[2]:
                rules.defaults[add[0]] = add[2]
        if rename:
            old, new = rename
            df = df.withColumnRenamed(old, new)
            swap = lambda cols: [new if c == old else c for c in cols]
            rules.primary_key, rules.not_null = swap(rules.primary_key), swap(rules.not_null)
            rules.unique = [{"columns": swap(u["columns"]), "where": _renamed(u["where"], old, new)} if isinstance(u, dict) else swap(u) for u in rules.unique]
            rules.checks = [_renamed(c, old, new) for c in rules.checks]
            rules.defaults = {new if k == old else k: v for k, v in rules.defaults.items()}
            rules.generated = {new if k == old else k: _renamed(v, old, new) for k, v in rules.generated.items()}
            rules.foreign_keys = [fk | {"columns": swap(fk["columns"])} | ({"references": swap(fk["references"])} if fk["table"].lower() == name.lower() else {}) for fk in rules.foreign_keys]
        if drop:
            used = [c for u in rules.unique for c in (u["columns"] if isinstance(u, dict) else u)] + [c for fk in rules.foreign_keys for c in fk["columns"]]
            if drop in rules.primary_key or drop in used or any(re.search(rf"\b{re.escape(drop)}\b", x) for x in [*rules.checks, *rules.generated.values()]):
                raise ConstraintError(f"{drop} is used by a constraint")
            df = df.drop(drop)
            rules.not_null = [c for c in rules.not_null if c != drop]
            rules.defaults.pop(drop, None)
        self._apply(name, df, list(range(state["buckets"])), None, None, rules=rules, columns=df.dtypes)
        if rename:
            for child in self.tables():
                theirs = self.rules(child)
                if child != name.lower() and any(fk["table"].lower() == name.lower() and rename[0] in fk["references"] for fk in theirs.foreign_keys):
                    theirs.foreign_keys = [fk | {"references": swap(fk["references"])} if fk["table"].lower() == name.lower() else fk for fk in theirs.foreign_keys]
                    self._apply(child, None, [], None, None, rules=theirs)

    def add_rules(self, name: str, rules: Rules) -> None:
        """New rules for a table, whose rows must keep them."""
        now = self._state(name)
        old = self.rules(name)
        self._apply(name, None, [], None, None, rules=rules)
        try:
            self._check(name, self._read(now), self._read(now).limit(0))
        except ConstraintError:
            self._apply(name, None, [], None, None, rules=old)
            raise

    # Reading.
    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        kinds = ", ".join(f"`{c}` {t}" for c, t in state["columns"])
        paths = [p for b, ps in state["files"].items() if buckets is None or int(b) in buckets for p in ps]
        return self.spark.read.schema(kinds).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], kinds)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(self._state(name, version))

    def _versioned(self, name: str) -> dict:
        state = self._state(name)
        if not state["rules"]["versioned"]:
            raise ValueError(f"{name} isn't versioned")
        return state

    def as_of(self, name: str, ts: int) -> DataFrame:
        """The rows valid at ts (seconds) of a versioned table: those of its last version by then."""
        line = [v for v, at in self._versioned(name)["line"] if at <= ts]
        return self.table(name, max(line)) if line else self.table(name).limit(0)

    def history(self, name: str) -> DataFrame:
        """All versions of the rows of a versioned table, with _valid_from and _valid_to in seconds, from the change feed."""
        state = self._versioned(name)
        feed = self._changes(state, -1)
        after = Window.partitionBy(*state["rules"]["primary_key"]).orderBy("version", F.col("op") != "before")
        kept = feed.withColumn("_valid_to", F.coalesce(F.lead("at").over(after), F.lit(OPEN_END))).where("op in ('insert', 'update')")
        return kept.select(*(F.col(c) for c, _ in state["columns"]), F.col("at").alias("_valid_from"), F.col("_valid_to"))

    def _changes(self, state: dict, after: int) -> DataFrame:
        kinds = "op string, version long, at long, " + ", ".join(f"`{c}` {t}" for c, t in state["columns"])
        paths = [f"{self.root}/{p}" for v, p in state["changes"] if v > after]
        return self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)

    def changes(self, name: str, after: int = -1) -> DataFrame:
        """op (insert, update, delete), version, at, and the row, of the versions after one; an update holds the new row."""
        return self._changes(self._state(name), after).where("op <> 'before'")

    def change_stream(self, name: str) -> DataFrame:
        """The change feed as a stream of files, those of statements that were rolled back included."""
        kinds = self.changes(name).schema
        return self.spark.readStream.schema(kinds).option("recursiveFileLookup", True).parquet(f"{self._dir(name)}/changes").where("op <> 'before'")

    # Writing.
    def _bucket(self, state: dict) -> Column:
        keys = state["rules"]["primary_key"] or [c for c, _ in state["columns"]][:1]
        return F.pmod(F.xxhash64(*keys), F.lit(state["buckets"])).cast("int")

    def _hit(self, state: dict, rows: DataFrame) -> list[int]:
        """The buckets that hold rows: at most as many numbers as the table has buckets."""
        return [r.b for r in rows.select(self._bucket(state).alias("b")).distinct().collect()]

    def _apply(self, name: str, rows: DataFrame | None, rewritten: list[int], feed: DataFrame | None, now: int | None, rules: Rules | None = None, columns: list | None = None) -> None:
        """The next version: the buckets rewritten hold only what rows has for them; other rows are added to theirs."""
        version = self.version(name)
        state = self._state(name, version)
        last = state["line"][-1][1]
        at = max(int(time.time()) if now is None else now, last + (version > 0 and state["rules"]["versioned"]))
        version += 1
        if rules:
            state["rules"] = asdict(rules)
        if columns:
            state["columns"] = columns
        files = {b: p for b, p in state["files"].items() if int(b) not in rewritten}
        if rows is not None:
            path = f"{name.lower()}/data/v={version}"
            rows.withColumn("_b", self._bucket(state)).repartition("_b").write.partitionBy("_b").parquet(f"{self.root}/{path}")
            for d in self.fs.names(f"{self.root}/{path}"):
                if d.startswith("_b="):
                    files.setdefault(d[3:], [])
                    files[d[3:]] = [*files[d[3:]], f"{path}/{d}"]
        if feed is not None:
            path = f"{name.lower()}/changes/v={version}"
            feed.withColumns({"version": F.lit(version).cast("long"), "at": F.lit(at).cast("long")}).write.parquet(f"{self.root}/{path}")
            state["changes"].append([version, path])
        state["files"] = files
        state["line"].append([version, at])
        self._write_state(name, version, state)

    def _check(self, name: str, new: DataFrame, rest: DataFrame) -> None:
        """new: the rows to be written; rest: those that stay. Only keys of new rows are looked up."""
        rules = self.rules(name)
        tests = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(dict.fromkeys([*rules.not_null, *rules.primary_key]))]
        tests += [F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(f"c{i}") for i, c in enumerate(rules.checks)]
        if tests and any(new.agg(*tests).first()):
            raise ConstraintError(f"{name}: NOT NULL or CHECK")
        for u in [*([rules.primary_key] if rules.primary_key else []), *rules.unique]:
            cols, where = (u["columns"], u["where"]) if isinstance(u, dict) else (u, "true")
            full = " AND ".join(f"`{c}` IS NOT NULL" for c in cols) + f" AND ({where})"
            mine = new.where(full).select(*cols)
            if not mine.groupBy(*cols).count().where("count > 1").isEmpty() or not mine.join(rest.where(full).select(*cols), cols, "left_semi").isEmpty():
                raise ConstraintError(f"{name}: {', '.join(cols)} must be unique")
        for fk in rules.foreign_keys:
            parent = self.table(fk["table"]) if fk["table"].lower() != name.lower() else rest.unionByName(new)
            keys = parent.select(*(F.col(r).alias(c) for c, r in zip(fk["columns"], fk["references"])))
            child = new.where(" AND ".join(f"`{c}` IS NOT NULL" for c in fk["columns"])).select(*fk["columns"])
            if not child.join(keys, fk["columns"], "left_anti").isEmpty():
                raise ConstraintError(f"{name}: foreign key to {fk['table']}")

    def _complete(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with defaults, numbers for a missing single integer key, generated columns, in the table's types and order."""
        rules, kinds = self.rules(name), self.columns(name)
        extra = set(rows.columns) - {c for c, _ in kinds}
        if extra:
            raise ValueError(f"no columns {sorted(extra)} in {name}")
        for c, t in kinds:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.expr(rules.defaults[c]).cast(t) if c in rules.defaults else F.lit(None).cast(t))
        if len(rules.primary_key) == 1 and dict(kinds)[rules.primary_key[0]] in ("int", "bigint"):
            key = rules.primary_key[0]
            if not rows.where(F.col(key).isNull()).isEmpty():
                top = self.table(name).select(key).unionAll(rows.select(key)).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
                # numbers are dealt within partitions by an offset per partition, so that no window runs over all rows
                parts = checkpointed(rows.where(F.col(key).isNull()).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
                sizes = parts.groupBy("_p").count().withColumn("_o", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                own = F.row_number().over(Window.partitionBy("_p").orderBy("_i"))
                made = parts.withColumn("_n", own).join(F.broadcast(sizes.select("_p", "_o")), "_p").withColumn(key, F.lit(top) + F.col("_o") + F.col("_n")).drop("_p", "_i", "_n", "_o")
                rows = rows.where(F.col(key).isNotNull()).unionByName(made)
        for c, e in rules.generated.items():
            rows = rows.withColumn(c, F.expr(e))
        return rows.select(*(F.col(c).cast(t).alias(c) for c, t in kinds))

    def insert(self, name: str, rows: DataFrame, conflict: str = "error", update: dict[str, str] | None = None, now: int | None = None, target: list[str] | None = None, where: str | None = None) -> DataFrame:
        """Inserts rows and returns those written.

        conflict says what a row does whose target columns (the primary key unless named) exist: error, ignore, replace,
        or update with the given {column: SQL}, which sees old values as old.x and new ones as excluded.x, where the
        condition holds; generated columns are computed again. Replace and ignore look at every unique rule. Of several
        new rows with one key the one with the greatest hash wins, the rest is ignored.
        """
        state = self._state(name)
        rules = Rules(**state["rules"])
        new = checkpointed(self._complete(name, rows))
        key = target or rules.primary_key
        if conflict == "error" or not (key or rules.unique):
            self._check(name, new, self._read(state))
            self._apply(name, new, [], new.withColumn("op", F.lit("insert")), now)
            return new
        if conflict not in ("ignore", "replace", "update"):
            raise ValueError(f"unknown conflict clause: {conflict}")
        row_hash = F.xxhash64(*new.columns)
        full = " AND ".join(f"`{c}` IS NOT NULL" for c in key) or "true"
        if key:
            new = new.where(full).groupBy(*key).agg(F.max_by(F.struct(*new.columns), row_hash).alias("_r")).select("_r.*").unionByName(new.where(f"NOT ({full})"))
        old = self._read(state)
        uniques = [key, *([u for u in [rules.primary_key, *rules.unique] if u and u != key] if conflict != "update" else [])]
        uniques = [(u["columns"], u["where"]) if isinstance(u, dict) else (u, "true") for u in uniques if u]
        new = checkpointed(new)
        if conflict == "ignore":
            written = new
            for cols, cond in uniques:
                written = written.join(old.where(cond).select(*cols), cols, "left_anti")
                written = written.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)).groupBy(*cols).agg(F.max_by(F.struct(*new.columns), F.xxhash64(*new.columns)).alias("_r")).select("_r.*").unionByName(written.where(" OR ".join(f"`{c}` IS NULL" for c in cols))) if cond == "true" else written
            written = checkpointed(written.select(*new.columns))
            self._check(name, written, old)
            self._apply(name, written, [], written.withColumn("op", F.lit("insert")), now)
            return written
        if conflict == "replace":
            gone = old.limit(0)
            for cols, cond in uniques:
                gone = gone.unionByName(old.where(cond).join(new.where(cond).select(*cols), cols, "left_semi").select(*old.columns))
            gone = checkpointed(gone.distinct())
            written = new
            same = gone.join(new.select(*key), key, "left_semi").select(*key)
            changed = new.join(same, key, "left_anti").select(*new.columns).withColumn("op", F.lit("insert")).unionByName(new.join(same, key, "left_semi").select(*new.columns).withColumn("op", F.lit("update")))
            changed = changed.unionByName(gone.join(new.select(*key), key, "left_anti").select(*old.columns).withColumn("op", F.lit("delete")))
        else:
            on = [F.col(f"old.{c}") == F.col(f"excluded.{c}") for c in key]
            fresh = new.join(old.select(*key), key, "left_anti").select(*new.columns)
            both = new.alias("excluded").join(old.alias("old"), on).where(F.expr(where) if where else F.lit(True))
            moved = both.select(F.struct("old.*").alias("_old"), *(F.expr((update or {}).get(c, f"old.{c}")).cast(t).alias(c) for c, t in old.dtypes))
            for c, e in rules.generated.items():
                moved = moved.withColumn(c, F.expr(e))
            moved = checkpointed(moved)
            gone = moved.select("_old.*")
            moved = moved.drop("_old")
            written = checkpointed(fresh.unionByName(moved))
            changed = fresh.withColumn("op", F.lit("insert")).unionByName(moved.withColumn("op", F.lit("update")))
        self._swap(name, state, gone, written, changed.unionByName(gone.join(written.select(*key), key, "left_semi").select(*old.columns).withColumn("op", F.lit("before"))), now)
        return written

    def _swap(self, name: str, state: dict, gone: DataFrame, written: DataFrame, feed: DataFrame, now: int | None, check: bool = True) -> None:
        """Takes rows out and puts others in; only the buckets that lose rows are written again."""
        hit = self._hit(state, gone)
        ids = state["rules"]["primary_key"] or [c for c, _ in state["columns"]]
        taken = gone.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(ids))).distinct()
        left = lambda df: df.join(taken, [df[c].eqNullSafe(taken[f"_g{i}"]) for i, c in enumerate(ids)], "left_anti")
        if check:
            self._check(name, written, left(self._read(state)))
        self._apply(name, left(self._read(state, hit)).unionByName(written) if hit else written, hit, feed, now)

    def update(self, name: str, values: dict[str, str], where: str | Column = "true", now: int | None = None) -> DataFrame:
        """Sets columns to SQL over the old row where the condition is true; returns the rows written."""
        state = self._state(name)
        rules, old = Rules(**state["rules"]), self._read(state)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        both = old.where(hit).select(F.struct(*old.columns).alias("_old"), *(F.expr(values[c]).cast(t).alias(c) if c in values else F.col(c) for c, t in old.dtypes))
        for c, e in rules.generated.items():
            both = both.withColumn(c, F.expr(e))
        return self._move(name, state, checkpointed(both), now)

    def _move(self, name: str, state: dict, both: DataFrame, now: int | None) -> DataFrame:
        """both: _old and the columns of the new row."""
        gone, written = both.select("_old.*"), both.drop("_old")
        for child, fk in self._children(name):
            if not any(r in fk["references"] for r in written.columns):
                continue
            moved = both.where(" OR ".join(f"NOT (_old.`{r}` <=> `{r}`)" for r in fk["references"]))
            if moved.isEmpty():
                continue
            keys = moved.select(*(F.col(f"_old.{r}").alias(f"_p{i}") for i, r in enumerate(fk["references"])), *(F.col(r).alias(f"_q{i}") for i, r in enumerate(fk["references"])))
            self._follow(child, fk, keys, fk.get("on_update", "restrict"), now, name)
        feed = written.withColumn("op", F.lit("update")).unionByName(gone.withColumn("op", F.lit("before")))
        self._swap(name, state, gone, written, feed, now)
        return written

    def _children(self, name: str) -> list[tuple[str, dict]]:
        return [(t, fk) for t in self.tables() for fk in self.rules(t).foreign_keys if fk["table"].lower() == name.lower() and t != name.lower()]

    def _follow(self, child: str, fk: dict, keys: DataFrame, action: str, now: int | None, parent: str) -> None:
        """What rows of child that refer to keys (_p0 ..; for cascading updates with new keys _q0 ..) do, by joins."""
        state = self._state(child)
        kids = self._read(state)
        on = [kids[c] == keys[f"_p{i}"] for i, c in enumerate(fk["columns"])]
        hits = kids.join(keys, on)
        if hits.isEmpty():
            return
        match action:
            case "cascade" if "_q0" in keys.columns:
                new = {c: F.col(f"_q{i}") for i, c in enumerate(fk["columns"])}
            case "set null":
                new = {c: F.lit(None) for c in fk["columns"]}
            case "cascade":
                self._remove(child, state, checkpointed(hits.select(*(kids[c] for c in kids.columns)).distinct()), now)
                return
            case _:
                raise ConstraintError(f"{child} refers to rows of {parent}")
        both = hits.select(F.struct(*(kids[c] for c in kids.columns)).alias("_old"), *(new[c].cast(t).alias(c) if c in new else kids[c] for c, t in kids.dtypes))
        gone, written = (x := checkpointed(both)).select("_old.*"), x.drop("_old")
        # The parent's new keys aren't written yet, so the reference itself isn't checked here.
        self._swap(child, state, gone, written, written.withColumn("op", F.lit("update")).unionByName(gone.withColumn("op", F.lit("before"))), now, check=False)

    def delete(self, name: str, where: str | Column = "true", now: int | None = None) -> DataFrame:
        """Deletes the rows where the condition is true, after the foreign keys that point here; returns them."""
        state = self._state(name)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        return self._remove(name, state, checkpointed(self._read(state).where(hit)), now)

    def _remove(self, name: str, state: dict, gone: DataFrame, now: int | None) -> DataFrame:
        for child, fk in self._children(name):
            keys = gone.select(*(F.col(r).alias(f"_p{i}") for i, r in enumerate(fk["references"]))).distinct()
            self._follow(child, fk, keys, fk.get("on_delete", "restrict"), now, name)
        self._swap(name, state, gone, gone.limit(0), gone.withColumn("op", F.lit("delete")), now, check=False)
        return gone

    # Transactions: versions to go back to.
    def begin(self) -> None:
        self._saved = []
        self.savepoint(None)

    def savepoint(self, label: str | None) -> None:
        self._saved.append((label, {t: self.version(t) for t in self.tables()}))

    def release(self, label: str) -> None:
        """Forgets a savepoint and those after it."""
        self._saved = self._saved[: self._place(label)]

    def _place(self, label: str | None) -> int:
        at = [i for i, (x, _) in enumerate(self._saved) if x == label]
        if not at:
            raise ValueError(f"no savepoint {label}" if label else "no transaction")
        return at[-1]

    def rollback(self, label: str | None = None) -> None:
        """Every table as it was at begin, or at a savepoint, which stays; tables made since are dropped. History and feed go back too."""
        at = self._place(label)
        saved = self._saved[at][1]
        for t in self.tables():
            if t not in saved:
                self.drop(t)
            elif (now := self.version(t)) != saved[t]:
                self._write_state(t, now + 1, self._state(t, saved[t]))
        self._saved = self._saved[: at + 1] if label else []

    def commit(self) -> None:
        self._saved = []

    def analyze(self, name: str) -> DataFrame:
        """column, rows, nulls, distinct (approximate), least, greatest: one pass over the table, for planning by hand."""
        df = self.table(name)
        each = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(F.to_json(F.struct(c)) if t.startswith(("array", "map", "struct")) else c).alias("distinct"), *((f(F.col(c)).cast("string") if not t.startswith(("array", "map", "struct", "binary")) else F.lit(None).cast("string")).alias(k) for k, f in (("least", F.min), ("greatest", F.max)))).alias(c) for c, t in df.dtypes]
        one = df.agg(*each)
        return one.select(F.explode(F.array(*(F.col(f"`{c}`") for c in one.columns))).alias("x")).select("x.*")

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Writes each bucket as one set of files and removes data that none of the newest keep versions, those to go back to and, for a versioned table, its past needs."""
        state = self._state(name)
        if state["files"] and not state["rules"]["versioned"]:
            self._apply(name, self._read(state), [int(b) for b in state["files"]], None, None)
        newest = self.version(name)
        needed = {*range(newest - keep + 1, newest + 1), *(s[name.lower()] for _, s in self._saved if name.lower() in s)} | ({v for v, _ in state["line"]} if state["rules"]["versioned"] else set())
        used = {p.split("/")[2] for v in needed if self.fs.exists(f"{self._dir(name)}/log/{v}") for ps in self._state(name, v)["files"].values() for p in ps}
        for d in self.fs.names(f"{self._dir(name)}/data"):
            if d not in used:
                self.fs.remove(f"{self._dir(name)}/data/{d}")


def last_writer_wins(current: DataFrame, incoming: DataFrame, key: list[str], clock: tuple[str, str, str] = ("wall", "counter", "node")) -> DataFrame:
    """One row per key: the greater hybrid clock (wall, counter, node) wins, the incoming row on a tie. By partial aggregation."""
    both = current.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    row = F.struct(*current.columns)
    return both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(row, F.struct(*clock, "_in")).alias("_r")).select("_r.*")
