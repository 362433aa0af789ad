"""Where queries and their SQL twins are registered, and tables for them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict = {}
#: Runs on small built-in tables, kept as tests: what they return, and SQL that says what they should.
EXAMPLES: dict = {}
EXAMPLE_SQL: dict = {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def example(sql: str):
    """A run on built-in rows; tests compare it with its SQL, queries() doesn't have it."""

    def add(f):
        EXAMPLES[f.__name__], EXAMPLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer files than cores are dealt to all cores before costly text work; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


class Literal:
    """A small built-in table, for Spark and for SQL. Times are written as strings."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.rows = name, rows
        self.columns = [tuple(c.strip().split(" ", 1)) for c in schema.split(";")]

    def frame(self, spark: SparkSession, sf: str | None = None) -> DataFrame:
        raw = ", ".join(f"{c} {'string' if k == 'timestamp' else k}" for c, k in self.columns)
        out = spark.createDataFrame(self.rows, raw)
        return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in self.columns])

    @staticmethod
    def _sql(x, kind: str) -> str:
        kinds = {"string": "VARCHAR", "long": "BIGINT", "array<string>": "VARCHAR[]", "array<int>": "INT[]"}
        if isinstance(x, (list, tuple)):
            text = "[" + ", ".join(Literal._sql(y, "string" if isinstance(y, str) else "int") for y in x) + "]"
        elif isinstance(x, str):
            text = "'" + x.replace("'", "''") + "'"
        else:
            text = "NULL" if x is None else str(x)
        return f"{text}::{kinds.get(kind, kind.upper())}"

    @property
    def cte(self) -> str:
        """name(columns) AS (VALUES ...)"""
        rows = ", ".join("(" + ", ".join(self._sql(x, k) for x, (_, k) in zip(r, self.columns)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(c for c, _ in self.columns)}) AS (VALUES {rows})"


    def over(self, spark: SparkSession, sf: str, name: str = "documents", key: str = "doc_id", ids: list | None = None) -> DataFrame:
        """The rows dealt to all rows of a table: a row's key takes the place of the first column, whose distinct values it picks in
        turn; a long."""
        first, ids = self.columns[0][0], ids or self.ids
        keys = table(spark, sf, name).select(F.col(key).cast("long").alias("_v")).where("_v is not null").distinct()
        picked = keys.withColumn("_id", F.element_at(F.array(*map(F.lit, ids)), (F.pmod("_v", F.lit(len(ids))) + 1).cast("int")))
        rows = F.broadcast(self.frame(spark).withColumnRenamed(first, "_id"))  # as many rows as are written down
        return picked.join(rows, "_id").select(F.col("_v").alias(first), *[c for c, _ in self.columns[1:]])

    @property
    def ids(self) -> list:
        return list(dict.fromkeys(r[0] for r in self.rows))

    def dealt(self, schema: str, rows: list[tuple], name: str = "documents", key: str = "doc_id") -> str:
        """SQL of what over() should give: the rows expected of each of the first column's values, dealt likewise."""
        t = Literal("t", schema, rows)
        first = t.columns[0][0]
        rest = ", ".join(c for c, _ in t.columns[1:])
        return f"WITH {t.cte}, k AS (SELECT DISTINCT {key}::BIGINT AS v FROM {name} WHERE {key} IS NOT NULL) SELECT v AS {first}, {rest} FROM k JOIN t ON t.{first} = {self.ids!r}[(v % {len(self.ids)})::INT + 1]"


class Derived:
    """A table made from the driver's by a query that Spark and DuckDB both read; `{orders}` stands for a table."""

    def __init__(self, name: str, sql: str):
        self.name, self.sql, self.tables = name, sql, sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def frame(self, spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(self.sql, **{t: table(spark, sf, t) for t in self.tables})

    @property
    def cte(self) -> str:
        """name AS (...)"""
        return f"{self.name} AS ({re.sub(r'[{}]', '', self.sql)})"


def expected(schema: str, rows: list[tuple]) -> str:
    """SQL of a result that is written down row by row."""
    t = Literal("t", schema, rows)
    return f"WITH {t.cte} SELECT * FROM t"


def quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + re.sub("'", "''", pattern) + "'"
