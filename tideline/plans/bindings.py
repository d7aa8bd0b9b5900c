"""The events table as canonical ticks, quotes and sessions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.calendar import Calendar

#: The events lie in January 2024; trading dates run one on, so the last session has a day after it.
ALWAYS = Calendar.always(date(2024, 1, 1), date(2024, 2, 15))
EXCHANGE = Calendar(date(2024, 1, 1), date(2024, 2, 15), closed=frozenset({date(2024, 1, 22), date(2024, 1, 26)}), open_sessions=frozenset({date(2024, 1, 20)}), overrides={date(2024, 1, 20): ((33300, 36000), (41400, 45000))})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, arrival, ts, ts_us, trading_date, price, quantity, kind, open_us and close_us of the whole day."""
    ts = F.col("ts").cast("timestamp")
    day = F.to_date(ts)
    opened = F.unix_micros(day.cast("timestamp"))
    return events(spark, sf_dir).select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("instrument"),
        F.col("event_id").alias("arrival"), ts.alias("ts"), F.unix_micros(ts).alias("ts_us"), day.alias("trading_date"),
        F.col("value").cast("decimal(12,4)").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("quantity"),
        F.when(F.col("event_type") == "view", "quote").otherwise("tick").alias("kind"),
        "event_type", opened.alias("open_us"), (opened + 86_400_000_000).alias("close_us"),
    )


def with_cumulative(rows: DataFrame) -> DataFrame:
    """The session's cumulative volume: the running sum of quantities by instrument and day."""
    from pyspark.sql import Window

    running = Window.partitionBy("instrument", "trading_date").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum", F.sum("quantity").over(running))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session candle for each instrument and date with events."""
    return ticks(spark, sf_dir).groupBy("instrument", "trading_date").agg(
        F.min_by("price", "arrival").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "arrival").alias("close"),
        F.sum("quantity").alias("quantity"), F.count("*").alias("ticks"),
    )
