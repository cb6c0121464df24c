"""Symbol names, catalogue predicates and prediction guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.functions.safe import finite


def symbol_key(symbol: Column | str) -> Column:
    """Path form of a symbol: separators and spaces removed."""
    col = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.regexp_replace(col, r"[/\\:\- ]", "")


def ticker(symbol: Column | str) -> Column:
    """Catalogue form of a symbol: lower case, without ``/`` and ``-``."""
    col = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.translate(F.lower(col), "/-", "")


def price_topics(topics: DataFrame, text: str = "metadata") -> DataFrame:
    low = F.lower(F.col(text))
    return topics.where(low.contains("price") & ~low.contains("log"))


def return_topics(topics: DataFrame, text: str = "metadata") -> DataFrame:
    low = F.lower(F.col(text))
    return topics.where(low.contains("log") & low.contains("return"))


def datasets(catalogue: DataFrame, source: str | None = None, frequency: str | None = None) -> DataFrame:
    """Entries whose ``metadata`` struct has the given source and frequency."""
    out = catalogue
    if source is not None:
        out = out.where(F.col("metadata.source") == source)
    if frequency is not None:
        out = out.where(F.col("metadata.frequency") == frequency)
    return out


def search(catalogue: DataFrame, text: str, columns=("name", "description")) -> DataFrame:
    """Case-insensitive substring search over several text columns."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(text.lower()), F.lit(False))
    return catalogue.where(hit)


def valid_prediction(value: Column | str, allow_zero: bool = True) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    ok = finite(col)
    return ok if allow_zero else ok & (col != 0)


def price_from_log_return(price: Column | str, log_return: Column | str) -> Column:
    """price * exp(r); NULL when the price or the result is not a positive number."""
    p = F.col(price) if isinstance(price, str) else price
    r = F.col(log_return) if isinstance(log_return, str) else log_return
    out = p * F.exp(r)
    return F.when(finite(p) & (p > 0) & finite(r) & finite(out), out)
