"""Where queries and their SQL are listed."""

from pyspark.sql import DataFrame, functions as F

from checks.views import SQL

QUERIES, ORACLES = {}, {}
DIGITS = 8


def query(name: str, sql: str = None):
    """List a query; `sql` must give the same rows on the same tables."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles (sums differ in the last digits from plan to plan)."""
    cols = [(F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0)).alias(c) if t in ("double", "float")
            else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*cols)


def r(expr: str, name: str = None) -> str:
    """The SQL form of `tidy` for one column."""
    return f"round({expr}, {DIGITS}) + 0.0 as {name or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def with_(*parts) -> str:
    """A WITH list from view names and (name, sql) pairs."""
    body = [f"{p} as ({SQL[p]})" if isinstance(p, str) else f"{p[0]} as ({p[1]})" for p in parts]
    return "with " + ",\n".join(body) + "\n"
