"""Relational databases: SQL over temporary views, JDBC tables, and a small embedded store."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A JDBC table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def sql(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """A statement over the given tables."""
    return spark.sql(statement, **tables)


class DatabaseMemory:
    """A database on the driver (in memory by default), for small tables and settings."""

    def __init__(self, spark: SparkSession, database: str = ":memory:"):
        self.spark, self.connection = spark, sqlite3.connect(database)

    def execute(self, statement: str, values: Iterable = ()) -> list[tuple]:
        return self.connection.execute(statement, tuple(values)).fetchall()

    def executemany(self, statement: str, rows: Iterable[Iterable]) -> None:
        self.connection.executemany(statement, rows)

    def table(self, statement: str, schema: str) -> DataFrame:
        """A query's rows as a DataFrame."""
        return self.spark.createDataFrame(self.execute(statement), schema)

    def commit(self) -> None:
        self.connection.commit()

    def rollback(self) -> None:
        self.connection.rollback()

    def close(self) -> None:
        self.connection.close()
