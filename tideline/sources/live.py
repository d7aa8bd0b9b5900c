"""Live events: streams of canonical events or wire packets, and their delivery to consumers by instrument and kind."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources import packets

KINDS = ("tick", "quote", "depth", "candle")


@dataclass(frozen=True)
class Subscription:
    """What a consumer asked for: instruments and kinds of data."""

    instruments: frozenset[str]
    kinds: frozenset[str]

    def __post_init__(self):
        if odd := self.kinds - set(KINDS):
            raise ValueError(f"no such kinds: {sorted(odd)}")


def event_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the events that arrive as Parquet files in folder; a trigger reads files_at_once of them at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def packet_stream(spark: SparkSession, folder: str, reference: DataFrame, files_at_once: int = 100) -> DataFrame:
    """Canonical events of a stream of wire packets (arrival, packet): instrument, arrival, kind, ts_us, and tick, quote and depth as packets give them.

    reference: segment_code, security_id, instrument. A packet of several kinds is a row for each; faulty packets, those
    that hold no data and those of unknown ids give none.
    """
    raw = event_stream(spark, folder, "arrival long, packet binary", files_at_once)
    return of_packets(packets.decode(raw), reference)


def of_packets(decoded: DataFrame, reference: DataFrame) -> DataFrame:
    """packet_stream's rows from decoded packets, streaming or not."""
    held = decoded.where("fault is null").join(F.broadcast(reference), ["segment_code", "security_id"])
    told = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in KINDS[:3]]), lambda x: x.isNotNull())
    rows = held.select("instrument", "arrival", F.explode(told).alias("kind"), "ts_us", *KINDS[:3])
    return rows.select("instrument", "arrival", "kind", "ts_us", *[F.when(F.col("kind") == k, F.col(k)).alias(k) for k in KINDS[:3]])


def matching(events: DataFrame, wanted: Subscription) -> DataFrame:
    """The events of a subscription's instruments and kinds."""
    return events.where(F.col("instrument").isin(sorted(wanted.instruments)) & F.col("kind").isin(sorted(wanted.kinds)))


def fan_out(events: DataFrame, consumers: dict[str, Subscription], deliver: Callable[[str, DataFrame, int], None], checkpoint: str, **trigger):
    """Starts a stream that reads events once and hands each consumer what it asked for, with the batch's number.

    A batch that failed half way is delivered again under its number, so consumers that note the number see each event once.
    """

    def split(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name in sorted(consumers):
            deliver(name, matching(batch, consumers[name]), number)
        batch.unpersist()

    return events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def union_of(consumers: Iterable[Subscription]) -> Subscription:
    """What the feed must be asked for, for all consumers together."""
    held = list(consumers)
    return Subscription(frozenset().union(*[c.instruments for c in held]), frozenset().union(*[c.kinds for c in held]))
