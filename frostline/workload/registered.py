"""How a query is registered: a Spark callable and, where SQL can say it, its counterpart."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from frostline.workload import fixtures


@dataclass(frozen=True)
class Tables:
    """The derived tables of one scale factor as DataFrames."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in fixtures.TABLES:
            raise AttributeError(name)
        return fixtures.table(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str, extra: dict[str, str] | None = None):
    """Register a function of Tables under a name, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fixtures.with_tables(sql, *tables, extra=extra)
        return fn

    return register
