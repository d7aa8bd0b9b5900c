"""Instrument-master CSV, historical JSON arrays, session-OHLC JSON and calendar datasets."""

from __future__ import annotations

import json
from datetime import date, time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.calendar import Calendar, attested
from tideline.functions import constraints
from tideline.operators import universe

#: Fixed values of the master's format.
MASTER_COLUMNS = ("EXCH_ID", "SEGMENT", "SECURITY_ID", "INSTRUMENT", "UNDERLYING_SYMBOL", "SYMBOL_NAME", "DISPLAY_NAME", "INSTRUMENT_TYPE", "SERIES", "SM_EXPIRY_DATE", "STRIKE_PRICE", "OPTION_TYPE")
EXCHANGE_SEGMENTS = {("NSE", "E"): "NSE_EQ", ("NSE", "D"): "NSE_FNO", ("NSE", "C"): "NSE_CURRENCY", ("BSE", "E"): "BSE_EQ", ("BSE", "D"): "BSE_FNO", ("BSE", "C"): "BSE_CURRENCY", ("MCX", "M"): "MCX_COMM", ("IDX", "I"): "IDX_I"}
MARKET_SEGMENTS = {"E": "equity", "D": "derivatives", "C": "currency", "M": "commodity", "I": "index"}
IDENTITY = ["exchange", "market_segment", "symbol", "instrument_class", "underlying", "display_name", "listing_type", "series", "expiry", "strike", "option_type"]


def _or_fail(value: Column, ok: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def _lookup(table: dict, *keys: Column) -> Column:
    joined = {"/".join(k) if isinstance(k, tuple) else k: v for k, v in table.items()}
    pairs = F.create_map(*[F.lit(x) for kv in joined.items() for x in kv])
    return F.try_element_at(pairs, F.concat_ws("/", *keys))


def instrument_master(spark: SparkSession, path: str) -> DataFrame:
    """The master's instruments. A missing column, an unknown segment, a bad contract or a repeated identity fails the load."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    if missing := [c for c in MASTER_COLUMNS if c not in raw.columns]:
        raise ValueError(f"the master lacks {missing}")
    if "UNDERLYING_SECURITY_ID" not in raw.columns:
        raw = raw.withColumn("UNDERLYING_SECURITY_ID", F.lit(None).cast("string"))
    clean = constraints.no_sentinel
    segment = _lookup(MARKET_SEGMENTS, F.upper(F.trim("SEGMENT")))
    rows = raw.select(
        constraints.identity("EXCH_ID").alias("exchange"),
        _or_fail(segment, segment.isNotNull(), "unknown market segment").alias("market_segment"),
        _lookup(EXCHANGE_SEGMENTS, F.upper(F.trim("EXCH_ID")), F.upper(F.trim("SEGMENT"))).alias("exchange_segment"),
        _or_fail(F.trim("SECURITY_ID"), F.length(F.trim("SECURITY_ID")) > 0, "no security id").alias("security_id"),
        constraints.identity("INSTRUMENT").alias("instrument"), clean("UNDERLYING_SECURITY_ID").alias("underlying_security_id"),
        clean("UNDERLYING_SYMBOL").alias("underlying_symbol"), constraints.identity("SYMBOL_NAME").alias("symbol_name"),
        constraints.identity("DISPLAY_NAME").alias("display_name"), clean("INSTRUMENT_TYPE").alias("listing_type"), clean("SERIES").alias("series"),
        F.trim("SM_EXPIRY_DATE").alias("expiry_text"), F.trim("STRIKE_PRICE").alias("strike_text"), clean("OPTION_TYPE").alias("option_text"),
    ).withColumn("instrument_class", universe.instrument_class("instrument"))
    contract = F.col("instrument_class").isin("future", "option")
    option = F.col("instrument_class") == "option"
    expiry, strike = F.try_to_date("expiry_text"), F.col("strike_text").try_cast("decimal(18,6)")
    kind = F.when(F.col("option_text") == "CE", "call").when(F.col("option_text") == "PE", "put")
    made = rows.select(
        "*", universe.listing_symbol().alias("symbol"), F.when(contract, F.col("underlying_symbol")).alias("underlying"),
        F.when(contract, _or_fail(expiry, expiry.isNotNull(), "bad expiry")).alias("expiry"),
        F.when(option, _or_fail(strike, strike > 0, "bad strike")).alias("strike"),
        F.when(option, _or_fail(kind, kind.isNotNull(), "bad option type")).alias("option_type"),
    ).drop("expiry_text", "strike_text", "option_text")
    if made.groupBy(*IDENTITY).count().where("count > 1").limit(1).count():
        raise ValueError("the master names an instrument twice")
    return constraints.require(made, F.col("symbol").isNotNull() & constraints.contract_valid(), "bad contract")


def _price(text: Column) -> Column:
    """A price's own digits as decimal(20,8); null if it isn't one or has more. Nothing is rounded."""
    wide = text.try_cast("decimal(38,18)")
    narrow = wide.try_cast("decimal(20,8)")
    return F.when(narrow == wide, narrow)


_ARRAYS = ("open", "high", "low", "close", "volume", "timestamp")
_WHOLE = r"^-?[0-9]+(\.0+)?$"


def historical_json(spark: SparkSession, path: str, seconds: int) -> DataFrame:
    """start_us, end_us, open, high, low, close, quantity from parallel arrays.

    Numbers are read as their own text: arrays of unequal length, fractions or booleans where a whole number is
    due, negative volumes and broken prices fail.
    """
    raw = spark.read.schema(", ".join(f"{c} array<string>" for c in _ARRAYS)).json(path, multiLine=True)
    sizes = [F.size(c) for c in _ARRAYS]
    even = F.lit(True)
    for n in sizes[1:]:
        even = even & (n == sizes[0]) & (n >= 0)
    sure = constraints.require(raw, even, "arrays of unequal length")
    rows = sure.select(F.inline(F.arrays_zip(*_ARRAYS)))
    whole = lambda c: _or_fail(F.col(c).cast("decimal(20,0)").cast("long"), F.col(c).rlike(_WHOLE), f"{c} isn't whole")
    price = lambda c: _or_fail(_price(F.col(c)), _price(F.col(c)).isNotNull(), f"{c} isn't a price").alias(c)
    told = rows.select(
        (whole("timestamp") * 1_000_000).alias("start_us"), (whole("timestamp") * 1_000_000 + seconds * 1_000_000).alias("end_us"),
        *map(price, ("open", "high", "low", "close")), whole("volume").alias("quantity"),
    )
    return constraints.require(told, constraints.candle_valid(), "a candle is broken")


def session_ohlc_json(payloads: DataFrame, requested: DataFrame) -> DataFrame:
    """exchange_segment, security_id, open, high, low, close of requested ids that the payload (column body) gives soundly.

    A status other than success fails; missing, zero and incoherent values are withheld, not errors.
    """
    kind = "struct<status:string,data:map<string,map<string,struct<ohlc:struct<open:string,high:string,low:string,close:string>>>>>"
    read = payloads.select(F.from_json("body", kind).alias("p"))
    sure = constraints.require(read, F.col("p.status") == "success", "the quote batch failed")
    flat = sure.select(F.explode("p.data").alias("exchange_segment", "m")).select("exchange_segment", F.explode("m").alias("security_id", "v"))
    price = lambda c: _price(F.col(f"v.ohlc.{c}")).alias(c)
    rows = flat.select("exchange_segment", "security_id", *map(price, ("open", "high", "low", "close")))
    return requested.join(rows, ["exchange_segment", "security_id"]).where(constraints.ohlc_valid())


def _seconds(text: str) -> int:
    t = time.fromisoformat(text)
    return t.hour * 3600 + t.minute * 60 + t.second


def calendar_dataset(spark: SparkSession, path: str, zone: str = "Asia/Kolkata") -> Calendar:
    """The calendar of a JSON dataset (one file of some dozens of dates). Repeats, dates outside coverage or that no provenance attests fail."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a dataset is one file")
    data = json.loads(rows[0].value)
    day = date.fromisoformat
    for name in ("closed_dates", "open_sessions"):
        if len(set(data[name])) != len(data[name]):
            raise ValueError(f"{name} repeats a date")
    overrides = {day(o["trading_date"]): tuple((_seconds(i["start"]), _seconds(i["end"])) for i in o["intervals"]) for o in data.get("session_overrides", [])}
    made = Calendar(day(data["coverage_start"]), day(data["coverage_end"]), zone, frozenset(map(day, data["closed_dates"])), frozenset(map(day, data["open_sessions"])), overrides=overrides)
    texts = [json.dumps(p) for p in data.get("provenance", [])]
    if bare := attested([*made.closed, *made.open_sessions], texts):
        raise ValueError(f"no provenance for {bare}")
    return made
