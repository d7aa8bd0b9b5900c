"""Row constraints and normal forms of canonical values, as boolean or string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(name: str) -> Column:
    """Trimmed and upper-cased; null if nothing is left."""
    return F.nullif(F.upper(F.trim(F.col(name))), F.lit(""))


def no_sentinel(name: str) -> Column:
    """The identity form, with blank, NA and N/A as null."""
    value = identity(name)
    return F.when(~value.isin("NA", "N/A"), value)


def ohlc_valid(o: str = "open", h: str = "high", low: str = "low", c: str = "close") -> Column:
    """Positive prices, with open and close between low and high."""
    o, h, low, c = map(F.col, (o, h, low, c))
    return F.coalesce((low > 0) & (low <= o) & (low <= c) & (o <= h) & (c <= h), F.lit(False))


def candle_valid(start: str = "start_us", end: str = "end_us", quantity: str = "quantity") -> Column:
    return ohlc_valid() & F.coalesce((F.col(end) > F.col(start)) & (F.col(quantity) >= 0), F.lit(False))


def quote_valid(bid: str = "bid_price", ask: str = "ask_price") -> Column:
    return F.coalesce((F.col(bid) > 0) & (F.col(ask) >= F.col(bid)), F.lit(False))


def contract_valid() -> Column:
    """A future has underlying and expiry alone, an option strike and type too, others none of them."""
    has = [F.col(c).isNotNull() for c in ("underlying", "expiry", "strike", "option_type")]
    u, e, s, t = has
    return (
        F.when(F.col("instrument_class") == "future", u & e & ~s & ~t)
        .when(F.col("instrument_class") == "option", u & e & s & t)
        .otherwise(~u & ~e & ~s & ~t)
    )


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that hold, rows that don't)."""
    flagged = rows.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    return flagged.where("__valid").drop("__valid"), flagged.where("not __valid").drop("__valid")


def require(rows: DataFrame, valid: Column, message: str) -> DataFrame:
    """rows, failing the job at the first that doesn't hold."""
    return rows.where(F.when(F.coalesce(valid, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
