"""Relational sources through Spark's JDBC reader: read-only, bounded, by key ranges."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Statements that make a session read-only and bound it, by dialect.
SESSION = {
    "mysql": "SET SESSION TRANSACTION READ ONLY",
    "postgresql": "SET default_transaction_read_only = on",
}
QUOTES = {"mysql": "`", "postgresql": '"', "sqlite": '"', "derby": '"'}


def quoted(name: str, dialect: str) -> str:
    if not name or len(name) > 256 or "\0" in name:
        raise ValueError("invalid identifier")
    q = QUOTES.get(dialect, '"')
    return q + name.replace(q, q + q) + q


@dataclass
class Relational:
    """A database of which the listed tables and columns may be read.

    ``password_env`` names the environment variable of the password; plain passwords are refused.
    """

    url: str
    tables: dict[str, list[str]]
    user: str | None = None
    password_env: str | None = None
    timeout: int = 5
    fetch: int = 1000
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.url.startswith("jdbc:"):
            raise ValueError("a JDBC address is expected")
        if {k.lower() for k in self.options} & {"password", "dbtable", "query"}:
            raise ValueError("passwords come from the environment, tables from the allowlist")
        if "sessioninitstatement" in {k.lower() for k in self.options}:
            raise ValueError("sessions are read-only; their first statement is not an option")
        if not 1 <= self.timeout <= 60:
            raise ValueError("the timeout is 1 to 60 seconds")

    @property
    def dialect(self) -> str:
        return self.url.split(":")[1]

    def _reader(self, spark: SparkSession):
        import os

        r = spark.read.format("jdbc").option("url", self.url).option("queryTimeout", self.timeout).option("fetchsize", self.fetch)
        if self.dialect in SESSION:
            r = r.option("sessionInitStatement", SESSION[self.dialect])
        if self.user:
            r = r.option("user", self.user)
        if self.password_env:
            r = r.option("password", os.environ[self.password_env])
        return r.options(**self.options)

    def table(self, spark: SparkSession, name: str, predicates: Iterable[str] | None = None) -> DataFrame:
        """A table's allowed columns; filters and columns are pushed to the database."""
        if name not in self.tables:
            raise ValueError("table is not allowed")
        where = ".".join(quoted(p, self.dialect) for p in name.split("."))
        reader = self._reader(spark)
        df = reader.option("dbtable", where).load() if predicates is None else self._by(spark, where, list(predicates))
        return df.select(*self.tables[name])

    def _by(self, spark: SparkSession, where: str, predicates: list[str]) -> DataFrame:
        import os

        properties = {"queryTimeout": str(self.timeout), "fetchsize": str(self.fetch), **self.options}
        if self.dialect in SESSION:
            properties["sessionInitStatement"] = SESSION[self.dialect]
        if self.user:
            properties["user"] = self.user
        if self.password_env:
            properties["password"] = os.environ[self.password_env]
        return spark.read.jdbc(self.url, where, predicates=predicates, properties=properties)

    def by_key_ranges(self, spark: SparkSession, name: str, key: str, cuts: list[int]) -> DataFrame:
        """The table read in parallel, a task for each range between the cuts (whole numbers)."""
        if key not in self.tables.get(name, ()):
            raise ValueError("column is not allowed")
        k = quoted(key, self.dialect)
        edges = sorted({int(c) for c in cuts})
        parts = [f"{k} < {edges[0]} OR {k} IS NULL", *(f"{k} >= {a} AND {k} < {b}" for a, b in zip(edges, edges[1:], strict=False)), f"{k} >= {edges[-1]}"] if edges else ["1 = 1"]
        return self.table(spark, name, parts)
