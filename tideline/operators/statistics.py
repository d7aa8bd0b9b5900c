"""Current-session statistics: a sequential fold, as an aggregate over each session's ordered candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<trading_date:date,as_of_us:bigint,open:decimal(12,4),high:decimal(12,4),low:decimal(12,4)>"


def step(state: Column, x: Column) -> Column:
    """The state after a candidate: only live, verified ones with an aggregate advance it, and a new date starts afresh.

    The prior state stays if the candidate is older, changes the open, lowers the high, raises the low or says the same.
    """
    usable = (x["market_state"] == "LIVE_SESSION") & x["verified"] & x["open"].isNotNull()
    fresh = F.struct(*[x[c].alias(c) for c in ("trading_date", "as_of_us", "open", "high", "low")]).cast(STATE)
    same_day = state["trading_date"] == x["trading_date"]
    stays = (
        (x["as_of_us"] < state["as_of_us"]) | (x["open"] != state["open"]) | (x["high"] < state["high"]) | (x["low"] > state["low"])
        | ((x["open"] == state["open"]) & (x["high"] == state["high"]) & (x["low"] == state["low"]))
    )
    older = x["trading_date"] < state["trading_date"]
    reset = F.when(x["trading_date"] > state["trading_date"], F.lit(None).cast(STATE)).otherwise(state)
    return F.when(~F.coalesce(usable, F.lit(False)), reset).when(state.isNull(), fresh).when(older, state).when(same_day & stays, state).otherwise(fresh)


def fold(candidates: DataFrame) -> DataFrame:
    """instrument, trading_date and its final statistics from candidates in order of seq.

    Grouped by session as well: a date's state never depends on other dates, and a session bounds the group.
    """
    fields = ["seq", "trading_date", "as_of_us", "verified", "market_state", "open", "high", "low"]
    ordered = F.sort_array(F.collect_list(F.struct(*fields)))
    grouped = candidates.groupBy("instrument", "trading_date").agg(ordered.alias("rows"))
    state = F.aggregate("rows", F.lit(None).cast(STATE), step)
    held = grouped.select("instrument", F.col("trading_date").alias("session_date"), state.alias("s")).where("s is not null")
    return held.select("instrument", F.col("session_date").alias("trading_date"), "s.as_of_us", "s.open", "s.high", "s.low")


def stage(observations: DataFrame) -> DataFrame:
    """The newest observation of each instrument; equal instants with different values fail."""
    values = F.struct("trading_date", "open", "high", "low")
    newest = observations.groupBy("instrument").agg(F.max("as_of_us").alias("as_of_us"))
    tied = observations.join(newest, ["instrument", "as_of_us"]).groupBy("instrument", "as_of_us").agg(F.min(values).alias("v"), F.max(values).alias("w"))
    agreed = F.when(F.col("v") == F.col("w"), True).otherwise(F.raise_error(F.lit("observations of one instant differ")).cast("boolean"))
    return tied.where(agreed).select("instrument", "as_of_us", "v.*")


def accept_refresh(batch: DataFrame, requested: DataFrame, trading_date) -> DataFrame:
    """batch, or no row of it: an instrument that wasn't asked for, a repeat or another date rejects it whole."""
    odd = batch.join(requested.select("instrument").distinct().withColumn("__asked", F.lit(True)), "instrument", "left")
    bad = odd.groupBy("instrument").agg(
        (F.bool_or(F.col("__asked").isNull()) | (F.count("*") > 1) | F.bool_or(~F.col("trading_date").eqNullSafe(trading_date))).alias("bad")
    )
    return batch.where(F.lit(bad.where("bad").limit(1).count() == 0))


def due(reference_us: Column, last_us: Column, max_age_us: Column) -> Column:
    """Whether a refresh is due; never without a greatest age."""
    return F.coalesce(max_age_us.isNotNull() & (last_us.isNull() | (reference_us - last_us >= max_age_us)), F.lit(False))


def with_staged(ticks: DataFrame, staged: DataFrame) -> DataFrame:
    """Candidates in order: a staged observation stands before the first live tick of its date and day's later arrival, whose own aggregate it replaces.

    ticks: instrument, seq, trading_date, market_state, as_of_us, verified, open, high, low. staged: instrument, seq
    (of arrival), trading_date, as_of_us, open, high, low. One of an older date than the tick's is dropped, of a newer waits.
    """
    live = ticks.where("market_state = 'LIVE_SESSION'").select("instrument", "trading_date", F.col("seq").alias("tick_seq"))
    meets = staged.join(live, ["instrument", "trading_date"]).where("tick_seq > seq")
    used = meets.groupBy("instrument", "trading_date", "seq").agg(F.min("tick_seq").alias("tick_seq"), F.first("as_of_us").alias("as_of_us"), *[F.first(c).alias(c) for c in ("open", "high", "low")])
    newest = used.groupBy("instrument", F.col("tick_seq").alias("seq")).agg(F.max_by(F.struct("as_of_us", "open", "high", "low"), "as_of_us").alias("s"))
    joined = ticks.join(newest, ["instrument", "seq"], "left")
    pick = {c: F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)) for c in ("as_of_us", "open", "high", "low")}
    return joined.withColumns(pick | {"verified": F.col("s").isNotNull() | F.col("verified")}).drop("s")
