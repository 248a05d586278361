"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Registry:
    """queries and sql of a module; both by the name of the function."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add

    def spark_sql(self, name: str, text: str, tables: str, oracle: str | None = None) -> None:
        """A query that is one SQL text for both engines, or has another text for the oracle."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text, **{t: read(spark, sf_dir, t) for t in tables.split()})

        self.queries[name] = run
        self.sql[name] = oracle or text.replace("{", "").replace("}", "")
