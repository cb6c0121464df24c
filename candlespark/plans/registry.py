"""The catalogue of registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6, keep: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``; doubles are rounded like the SQL twin's.

    ``sql`` may hold a ``WITH`` list; ``{x}`` style gaps are filled by callers.
    Columns in ``keep`` are not rounded.
    """

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(prepare(spark), sf_dir), digits, keep)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double so that the order of additions does not show."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c)
            for c, t in df.dtypes
        ]
    )


def r(*names: str, digits: int = 6) -> str:
    """SQL select items: rounded expressions, ``"expr AS name"`` or ``"name"``."""
    out = []
    for item in names:
        expr, _, alias = item.rpartition(" AS ")
        out.append(f"round({expr or item}, {digits}) + 0.0 AS {alias if expr else item}")
    return ", ".join(out)
