"""The table of queries and the SQL that they are held against."""

from quittance.plans.oracle import RESULT_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, results: bool = True):
    """Register a function (spark, sf_dir) under its name; its SQL continues that of the results unless results is false."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (RESULT_SQL + sql) if results else sql
        return f

    return add
