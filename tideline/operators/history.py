"""Historical candles: verification, exact resampling, session canonicalisation, lookbacks and reconciliation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import sessions

SESSION = 0


def union_requirements(needs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(timeframe, greatest lookback), intraday by length, then sessions."""
    most: dict[int, int] = {}
    for tf, n in needs:
        most[tf] = max(n, most.get(tf, 0))
    return sorted(most.items(), key=lambda x: (x[0] == SESSION, x[0]))


def strictest_max_age(ages: Iterable[int]) -> int | None:
    """The least max_age over consumers; none without a consumer."""
    return min(ages, default=None)


def select_base(target: int, bases: Sequence[int]) -> int | None:
    """The longest base that is shorter than the target and divides it."""
    fits = [b for b in bases if b < target and target % b == 0]
    return max(fits, default=None)


def fetch_kind(target: int, direct: Sequence[int]) -> str:
    if target in direct or target == SESSION:
        return "direct"
    return "pending" if select_base(target, [d for d in direct if d != SESSION]) is None else "reconstruct"


def verify_series(candles: DataFrame, seconds: int | None = None, asked: str = "instrument") -> DataFrame:
    """The rows of series (asked, tf) without repeats, overlaps, wrong widths or foreign instruments; one bad row rejects its whole series.

    asked: the column of the instrument that a row was fetched for; a row of another, or of none, is foreign.
    """
    keyed = Window.partitionBy(asked, "tf")
    order = keyed.orderBy("start_us", "end_us")
    wrong = F.coalesce(F.lag("end_us").over(order) > F.col("start_us"), F.lit(False))
    if asked != "instrument":
        wrong = wrong | ~F.col("instrument").eqNullSafe(F.col(asked))
    if seconds is not None:
        wrong = wrong | (F.col("end_us") - F.col("start_us") != seconds * sessions.SECOND)
    marked = candles.withColumn("__wrong", wrong)
    return marked.withColumn("__bad", F.bool_or("__wrong").over(keyed)).where("not __bad").drop("__wrong", "__bad")


def resample_exact(candles: DataFrame, intervals: DataFrame, base: int, target: int, zone: str = "UTC") -> DataFrame:
    """Candles of target seconds from those of base, only where the base covers a bucket without a flaw.

    candles: instrument, start_us, end_us, open, high, low, close, quantity. intervals: the calendar's. A bucket
    is given if its first candle starts and its last ends with it, all have the base's width (or end with
    the block) and each starts where the one before ended. Rows aren't cut to a block first: a candle after its close
    withholds the last bucket.
    """
    local = sessions.local_date(F.timestamp_micros("start_us"), zone)
    dated = candles.withColumn("trading_date", local).join(F.broadcast(intervals.where("timed")), "trading_date")
    last_index = F.ceil((F.col("close_us") - F.col("open_us")) / (target * sessions.SECOND)) - 1
    index = sessions.bucket_index(F.col("start_us"), F.col("open_us"), target)
    placed = dated.withColumn("index", index).where((F.col("index") >= 0) & (F.col("index") <= last_index))
    order = Window.partitionBy("instrument", "trading_date", "block", "index").orderBy("start_us")
    whole = (F.col("end_us") - F.col("start_us") == base * sessions.SECOND) | (F.col("end_us") == F.col("close_us"))
    follows = F.coalesce(F.lag("end_us").over(order) == F.col("start_us"), F.lit(True))
    checked = placed.withColumn("__fit", whole & follows)
    buckets = checked.groupBy("instrument", "trading_date", "block", "index", "open_us", "close_us").agg(
        F.min_by("open", "start_us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "start_us").alias("close"),
        F.sum("quantity").alias("quantity"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.bool_and("__fit").alias("fit"),
    )
    starts = F.col("start_us") == sessions.bucket_start(F.col("index"), F.col("open_us"), target)
    ends = F.col("end_us") == sessions.bucket_end(F.col("index"), F.col("open_us"), F.col("close_us"), target)
    return buckets.where(F.col("fit") & starts & ends).drop("fit", "open_us", "close_us")


def canonical_sessions(daily: DataFrame, envelopes: DataFrame, zone: str = "UTC") -> DataFrame:
    """Daily bars stamped with their session's envelope; of a date's bars the first stays, non-trading dates go."""
    dated = daily.withColumn("trading_date", sessions.local_date(F.timestamp_micros("start_us"), zone))
    order = Window.partitionBy("instrument", "trading_date").orderBy("start_us", "end_us")
    first = dated.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "start_us", "end_us")
    return first.join(F.broadcast(envelopes.withColumnsRenamed({"open_us": "start_us", "close_us": "end_us"})), "trading_date")


def last_n(series: DataFrame, n: int, order: str = "trading_date", keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """The last n rows of each series, or none of it: no short lookbacks. Adds rn, 1 the newest."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = series.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)
    return ranked.withColumn("__c", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__c") == n).drop("__c")


def previous_session(daily: DataFrame, previous_days: DataFrame) -> DataFrame:
    """For each trading date the candle of the calendar's day before it: instrument, trading_date, source_date, open .. close."""
    old = daily.withColumnRenamed("trading_date", "previous_date")
    return old.join(F.broadcast(previous_days), "previous_date").withColumnRenamed("previous_date", "source_date")


def warmup_status(resolved: str = "resolved", unresolved: str = "unresolved"):
    """PARTIAL with both, FAILED with only unresolved, else SATISFIED."""
    some, none = F.col(resolved) > 0, F.col(unresolved) > 0
    return F.when(some & none, "PARTIAL").when(none, "FAILED").otherwise("SATISFIED")


IDENTITY = ["instrument", "tf", "start_us", "end_us"]


VALUES = ["open", "high", "low", "close", "quantity"]


def reconcile(
    incomplete: DataFrame, finalized: DataFrame, authority: DataFrame, *, current_date, trading_days: DataFrame, allow_current: bool = False, partial: DataFrame | None = None
) -> DataFrame:
    """An outcome for each incomplete or authoritative candle of trading dates up to today, and the candle given.

    Columns: IDENTITY, trading_date and VALUES (of incomplete and partial candles no values are read). RECONCILED repairs an
    incomplete candle with the authority's; finalized candles are ALREADY_RECONCILED, or in CONFLICT if any value, the
    quantity too, differs; today's are CURRENT_DAY_WITHHELD unless allowed; incomplete ones the authority lacks are
    NO_AUTHORITATIVE_CANDLE; what nobody waits for is NO_MATCH, or OUT_OF_WINDOW if it starts before all that its
    series retains, an open (partial) candle included.
    """
    values = F.struct(*VALUES)
    a = authority.select(*IDENTITY, "trading_date", values.alias("given"))
    waits = incomplete.select(*IDENTITY, F.col("trading_date").alias("w_date"), F.lit(True).alias("waits"))
    done = finalized.select(*IDENTITY, values.alias("held"))
    series = ["instrument", "tf"]
    starts = [x.select(*series, "start_us") for x in (incomplete, finalized, partial) if x is not None]
    retained = starts[0]
    for x in starts[1:]:
        retained = retained.unionByName(x)
    oldest = retained.groupBy(*series).agg(F.min("start_us").alias("oldest"))
    joined = a.join(waits, IDENTITY, "full").join(done, IDENTITY, "left").join(oldest, series, "left")
    joined = joined.withColumn("trading_date", F.coalesce("trading_date", "w_date")).join(F.broadcast(trading_days.select("trading_date").distinct()), "trading_date", "left_semi")
    outcome = (
        F.when((F.col("trading_date") == current_date) & F.lit(not allow_current), "CURRENT_DAY_WITHHELD")
        .when(F.col("given").isNull(), "NO_AUTHORITATIVE_CANDLE")
        .when(F.col("held").isNotNull(), F.when(F.col("held") == F.col("given"), "ALREADY_RECONCILED").otherwise("CONFLICT"))
        .when(F.col("waits"), "RECONCILED")
        .when(F.col("start_us") < F.col("oldest"), "OUT_OF_WINDOW")
        .otherwise("NO_MATCH")
    )
    return joined.where(F.col("trading_date") <= current_date).select(*IDENTITY, "trading_date", outcome.alias("outcome"), F.col("given"))


def apply_reconciled(outcomes: DataFrame, incomplete: DataFrame, finalized: DataFrame, keep: int = 20) -> tuple[DataFrame, DataFrame]:
    """(incomplete without the repaired, finalized with them: the newest keep of each series)."""
    repaired = outcomes.where("outcome = 'RECONCILED'").select(*IDENTITY, "trading_date", "given.*")
    rest = incomplete.join(repaired.select(*IDENTITY), IDENTITY, "left_anti")
    order = Window.partitionBy("instrument", "tf").orderBy(F.desc("start_us"))
    grown = finalized.select(*repaired.columns).unionByName(repaired).withColumn("__n", F.row_number().over(order))
    return rest, grown.where(F.col("__n") <= keep).drop("__n")


def fetch_requests(needs: DataFrame, most_days: int = 90, intraday: Sequence[int] = (60, 300, 900, 1500, 3600)) -> DataFrame:
    """needs (instrument, seconds, start_us, end_us) as requests: the endpoint, and the range in chunks [start_us, end_us) in order.

    Whole days are one daily request; intraday widths that the provider knows go in chunks of most_days at most;
    another width fails. An empty range asks nothing.
    """
    day = 86_400 * sessions.SECOND
    daily = F.col("seconds") == 86_400
    known = F.when(daily, "daily").when(F.col("seconds").isin(*intraday), "intraday").otherwise(F.raise_error(F.lit("no endpoint for this width")))
    chunk = F.when(daily, F.col("end_us") - F.col("start_us")).otherwise(F.lit(most_days * day))
    asked = needs.where("end_us > start_us").select("instrument", "seconds", known.alias("endpoint"), "start_us", "end_us", chunk.alias("__chunk"))
    starts = asked.withColumn("__at", F.explode(F.sequence("start_us", F.col("end_us") - 1, F.col("__chunk"))))
    return starts.select("instrument", "seconds", "endpoint", F.col("__at").alias("start_us"), F.least(F.col("__at") + F.col("__chunk"), F.col("end_us")).alias("end_us"))


def with_previous(contexts: DataFrame, sessions_: DataFrame) -> DataFrame:
    """contexts (instrument, trading_date, ..) with the session before as a struct previous (source_date, open, high, low, close), null where history lacks.

    sessions_: previous_session's rows. A date's history is one row an instrument, so contexts keep their number.
    """
    held = sessions_.select("instrument", "trading_date", F.struct("source_date", "open", "high", "low", "close").alias("previous"))
    return contexts.join(held, ["instrument", "trading_date"], "left")


def in_range(candles: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Candles that start in [start, end). The dates that can hold them are asked for too, so a table partitioned by trading_date is pruned."""
    day = 86_400_000_000
    first, last = (F.to_date(F.timestamp_micros(F.lit(x))) for x in (start_us - day, end_us + day))
    return candles.where(F.col("trading_date").between(first, last) & (F.col("start_us") >= start_us) & (F.col("start_us") < end_us))
