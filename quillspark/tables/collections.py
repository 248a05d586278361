"""Collections of JSON documents: tables of a store with an integer id and a text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.lite import json_path
from quillspark.tables.store import Rules, Store


class Collection:
    """Documents under ids; the table is made if it doesn't exist."""

    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name = store, name
        store.create(name, "id long, doc string", Rules(["id"], ["doc"]), if_not_exists=True)

    def insert(self, docs: list | DataFrame) -> DataFrame:
        """id, doc of new documents: Python objects, or a table with doc and perhaps id; missing ids are numbered."""
        rows = docs if isinstance(docs, DataFrame) else self.store.spark.createDataFrame([(None, json.dumps(d)) for d in docs], "id long, doc string")
        if not rows.where("doc is not null and try_parse_json(doc) is null").isEmpty():
            raise ValueError("a document isn't JSON")
        return self.store.insert(self.name, rows)

    def insert_with_id(self, id: int, doc: object) -> DataFrame:
        return self.insert(self.store.spark.createDataFrame([(id, json.dumps(doc))], "id long, doc string"))

    def get(self, id: int) -> object | None:
        """A document as a Python object, or None."""
        row = self.find().where(F.col("id") == id).first()
        return None if row is None else json.loads(row.doc)

    def find(self, wanted: dict | None = None) -> DataFrame:
        """id, doc of all documents, or of those whose values at dotted paths equal the wanted ones (None: missing or null)."""
        df = self.store.table(self.name)
        for path, value in (wanted or {}).items():
            at = F.get_json_object("doc", json_path(path))
            text = {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else value if isinstance(value, str) or value is None else json.dumps(value)
            df = df.where(at.isNull() if text is None else at == text)
        return df

    def update(self, id: int, doc: object) -> bool:
        """True if there was such a document."""
        text = json.dumps(doc).replace("\\", "\\\\").replace("'", "''")
        return not self.store.update(self.name, {"doc": f"'{text}'"}, F.col("id") == id).isEmpty()

    def delete(self, id: int) -> bool:
        return not self.store.delete(self.name, F.col("id") == id).isEmpty()

    def count(self) -> int:
        return self.store.table(self.name).count()
