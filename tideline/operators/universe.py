"""Instrument masters, universes, expiry ranks and request batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instrument_class(name: str = "instrument_type") -> Column:
    c = F.upper(F.col(name))
    return F.when(c.startswith("FUT"), "future").when(c.startswith("OPT"), "option").when(c == "EQUITY", "cash").otherwise("other")


def listing_symbol() -> Column:
    """Cash rows list by their underlying's symbol if they have one."""
    return F.when(F.col("instrument_class") == "cash", F.coalesce("underlying_symbol", "symbol_name")).otherwise(F.col("symbol_name"))


def stock_derivatives(master: DataFrame) -> DataFrame:
    """Futures and options on stocks whose underlying is an ES cash equity of the same exchange, by id and by symbol.

    master: security_id, exchange_segment, instrument, series, symbol, underlying_security_id, underlying_symbol.
    """
    cash = master.where("exchange_segment = 'NSE_EQ' and instrument = 'EQUITY' and series = 'ES'").select(
        F.col("security_id").alias("underlying_security_id"), F.col("symbol").alias("cash_symbol")
    )
    wanted = master.where("exchange_segment = 'NSE_FNO' and instrument in ('FUTSTK', 'OPTSTK')")
    return wanted.join(cash, "underlying_security_id").where("underlying_symbol = cash_symbol").drop("cash_symbol")


def fno_universe(master: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(futures, options, the distinct underlyings: underlying_security_id and underlying_symbol) of stock_derivatives."""
    linked = stock_derivatives(master)
    return linked.where("instrument = 'FUTSTK'"), linked.where("instrument = 'OPTSTK'"), linked.select("underlying_security_id", "underlying_symbol").distinct()


def resolve_universe(derivatives: DataFrame, master: DataFrame) -> DataFrame:
    """exchange, underlying_symbol, status and security_id of each underlying: RESOLVED, or blocked as MISSING, MISMATCHED or AMBIGUOUS.

    One derivative whose id isn't in the master, or names another symbol, blocks its underlying; so does more than one cash row.
    Linked rows that aren't ES cash equities are passed over.
    """
    listed = master.select(
        F.col("security_id").alias("underlying_security_id"), F.col("symbol").alias("cash_symbol"),
        ((F.col("exchange_segment") == "NSE_EQ") & (F.col("series") == "ES")).alias("cash"),
    )
    linked = derivatives.join(listed, "underlying_security_id", "left")
    cash = F.when(F.coalesce("cash", F.lit(False)), F.col("underlying_security_id"))
    grouped = linked.groupBy("exchange", "underlying_symbol").agg(
        F.bool_or(F.col("cash_symbol").isNull()).alias("missing"),
        F.bool_or(F.coalesce(F.col("cash") & (F.col("cash_symbol") != F.col("underlying_symbol")), F.lit(False))).alias("mismatched"),
        F.count_distinct(cash).alias("n"), F.min(cash).alias("security_id"),
    )
    status = F.when(F.col("missing"), "MISSING").when(F.col("mismatched"), "MISMATCHED").when(F.col("n") != 1, "AMBIGUOUS").otherwise("RESOLVED")
    return grouped.select("exchange", "underlying_symbol", status.alias("status"), F.when(status == "RESOLVED", F.col("security_id")).alias("security_id"))


def finalize_universe(resolved: DataFrame, empty: bool = False) -> DataFrame:
    """The resolved underlyings; fails if one is named twice, and if there is none unless empty is allowed."""
    good = resolved.where("status = 'RESOLVED'")
    n, distinct = good.agg(F.count("*"), F.count_distinct("exchange", "underlying_symbol")).first()
    if n != distinct or not (n or empty):
        raise ValueError("the universe names an instrument twice" if n else "the universe is empty")
    return good


def expiry_rank(contracts: DataFrame, as_of: Column) -> DataFrame:
    """contracts plus expiry_rank: 0, 1 and 2 for the near, next and far expiry of its exchange, underlying and class; else null."""
    order = Window.partitionBy("exchange", "underlying", "instrument_class").orderBy("expiry")
    ahead = contracts.where(F.col("expiry") >= as_of).withColumn("__r", F.dense_rank().over(order) - 1)
    rest = contracts.where((F.col("expiry") < as_of) | F.col("expiry").isNull()).withColumn("__r", F.lit(None).cast("int"))
    return ahead.unionByName(rest).withColumn("expiry_rank", F.when(F.col("__r") < 3, F.col("__r"))).drop("__r")


def resolve_packets(packets: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets with their instrument, packets of unknown ids); reference: segment_code, security_id, instrument."""
    keys = ["segment_code", "security_id"]
    return packets.join(reference, keys), packets.join(reference.select(*keys), keys, "left_anti")


def subscription_batches(requested: DataFrame, size: int = 100) -> DataFrame:
    """batch, n, security_ids: the union of requests in order of exchange, symbol and id, in batches of size.

    A universe is some hundreds of instruments; for requests at large, number within partitions instead.
    """
    order = Window.orderBy("exchange", "symbol", "security_id")
    ranked = requested.select("exchange", "symbol", "security_id").distinct().withColumn("__n", F.row_number().over(order))
    grouped = ranked.groupBy(F.floor((F.col("__n") - 1) / size).cast("long").alias("batch"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("__n", "security_id"))), lambda x: x["security_id"])
    return grouped.agg(F.count("*").alias("n"), ordered.alias("security_ids"))


def quote_request(requested: DataFrame, mapping: DataFrame, most: int = 1000) -> DataFrame:
    """exchange_segment and its sorted security_ids; fails at an unmapped instrument or over most."""
    asked = requested.select("exchange", "symbol").distinct()
    n = asked.count()
    if n > most:
        raise ValueError(f"{n} instruments asked for, {most} are allowed")
    joined = asked.join(mapping, ["exchange", "symbol"], "left")
    sure = joined.where(F.when(F.col("security_id").isNotNull(), True).otherwise(F.raise_error(F.lit("unmapped instrument")).cast("boolean")))
    return sure.groupBy("exchange_segment").agg(F.sort_array(F.collect_set("security_id")).alias("security_ids"))
