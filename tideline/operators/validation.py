"""Validation, sequence stamping and the as-of merge of ticks and quotes, as windows over each instrument's arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUTURE_SKEW_US = 60_000_000


def classify_events(events: DataFrame, payload: list[str], universe: DataFrame | None = None, now_us: Column | None = None) -> DataFrame:
    """events (instrument, arrival, ts_us, kind, payload columns) plus verdict: ACCEPT, DUPLICATE, STALE or INVALID.

    Unknown instruments and events over a minute ahead of now are INVALID. An event equal to the latest of its
    kind is DUPLICATE, one older than any accepted before is STALE. A stale or repeated event never passes the
    running maximum, so that may run over all eligible rows; a repeat equals the latest, so that may include repeats.
    """
    known = F.lit(True)
    if universe is not None:
        marked = universe.select("instrument").distinct().withColumn("__known", F.lit(True))
        events = events.join(marked, "instrument", "left")
        known = F.coalesce("__known", F.lit(False))
    timely = F.lit(True) if now_us is None else F.col("ts_us") <= now_us + FUTURE_SKEW_US
    before = Window.partitionBy("instrument").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("instrument", "kind").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    content = F.struct("ts_us", *payload)
    eligible = events.withColumn("__fit", known & timely)
    ordered = eligible.withColumn("__last", F.max(F.when(F.col("__fit"), F.col("ts_us"))).over(before))
    ordered = ordered.withColumn("__stale", F.coalesce(F.col("ts_us") < F.col("__last"), F.lit(False)))
    twin = F.last(F.when(F.col("__fit") & ~F.col("__stale"), content), ignorenulls=True).over(same)
    verdict = (
        F.when(~F.col("__fit"), "INVALID")
        .when(F.coalesce(F.col("__twin").eqNullSafe(content), F.lit(False)) & F.col("__twin").isNotNull(), "DUPLICATE")
        .when(F.col("__stale"), "STALE")
        .otherwise("ACCEPT")
    )
    out = ordered.withColumn("__twin", twin).withColumn("verdict", verdict)
    return out.drop("__known", "__fit", "__last", "__stale", "__twin")


def stamp_versions(events: DataFrame) -> DataFrame:
    """Accepted events plus version (from 1, by instrument) and lifecycle (CREATED, then UPDATED); arrival orders them throughout."""
    order = Window.partitionBy("instrument").orderBy("arrival")
    numbered = events.where("verdict = 'ACCEPT'").withColumn("version", F.row_number().over(order))
    return numbered.withColumn("lifecycle", F.when(F.col("version") == 1, "CREATED").otherwise("UPDATED"))


def stamp_sequence(events: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Accepted events plus sequence: their number, from 1, over all instruments in order of arrival.

    They are numbered within blocks of arrivals and offset by the counts of the blocks before, a row each.
    """
    rows = events.where("verdict = 'ACCEPT'").withColumn("__block", F.floor(F.col("arrival") / block).cast("long"))
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__block").orderBy("arrival")))
    counts = rows.groupBy("__block").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__block", before.alias("__before"))
    return numbered.join(offsets, "__block").withColumn("sequence", (F.col("__n") + F.col("__before")).cast("long")).drop("__block", "__n", "__before")


def merge_latest(events: DataFrame, tick: list[str], quote: list[str]) -> DataFrame:
    """Each event with the latest tick and quote columns of its instrument up to it: each kind carries the other forward."""
    so_far = Window.partitionBy("instrument").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    carried = {}
    for kind, names in (("tick", tick), ("quote", quote)):
        held = F.last(F.when(F.col("kind") == kind, F.struct(*names)), ignorenulls=True).over(so_far)
        carried |= {f"{kind}_{c}": held[c] for c in names}
    return events.withColumns(carried)
