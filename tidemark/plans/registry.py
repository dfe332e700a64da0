"""Registry of the query catalogue: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from .series import Tables, with_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name, sql=None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_ctes(sql)
        return fn

    return deco


def r6(df, digits=6):
    """Round every double column, so both engines agree on the last digits of sums."""
    from pyspark.sql import functions as F

    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.typeName() == "double"})


def R(expr, digits=6):
    """The same rounding in the oracle (adding zero turns -0.0 into 0.0)."""
    return f"(round({expr}, {digits}) + 0e0)"
