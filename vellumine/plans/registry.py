"""Registration of queries with the SQL that they equal."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; without ``sql`` it is checked by tests alone."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def values(rows: list[tuple]) -> str:
    """A VALUES list of SQL literals."""

    def lit(x) -> str:
        return str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"

    return "values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def pick(items: list, key: Column) -> Column:
    """The item whose turn it is for an integer key."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (key % len(items) + 1).cast("int"))


def picked(items: list[str], key: str) -> str:
    """The same in SQL."""
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + f"])[cast({key} % {len(items)} as int) + 1]"
