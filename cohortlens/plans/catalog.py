"""Registry of named queries: a Spark builder and, where SQL can say it, the
equivalent DuckDB SQL used as an independent oracle.

Every builder reads whole tables from ``sf_dir``.  Double results are rounded
to 6 decimals on both sides so engines that sum in a different order agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (NaN -> NULL so both engines agree)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name).cast("double")
            cols.append(F.when(~F.isnan(c), F.round(c, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_sql(inner: str, double_cols: Sequence[str], digits: int = DIGITS) -> str:
    """Wrap SQL so the named double columns are rounded like :func:`rounded`."""
    if not double_cols:
        return inner
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) AS q"


def register(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the benchmark tables hold naive timestamps: read them as UTC wall time
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = round_sql(sql, doubles)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    import pkgutil

    import cohortlens.plans as plans
    for mod in pkgutil.iter_modules(plans.__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"cohortlens.plans.{mod.name}")
