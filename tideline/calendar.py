"""Trading calendars: a driver-side description and the DataFrames that queries join with."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import sessions


class CoverageError(ValueError):
    """A date outside the calendar's coverage was asked for."""


class MissingTimingError(ValueError):
    """A special open date in an intraday window has no session times."""


@dataclass(frozen=True)
class Calendar:
    """Coverage, explicit closures and open sessions, weekend days (0 Monday) and session times in seconds of the local day."""

    start: date
    end: date
    zone: str = "Asia/Kolkata"
    closed: frozenset[date] = frozenset()
    open_sessions: frozenset[date] = frozenset()
    weekend: frozenset[int] = frozenset({5, 6})
    phases: tuple[int, int, int, int, int] = sessions.DEFAULT_PHASES
    block: tuple[int, int] = (33300, 55800)
    overrides: dict[date, tuple[tuple[int, int], ...]] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if both := self.closed & self.open_sessions:
            raise ValueError(f"both open and closed: {sorted(both)}")
        if extra := set(self.overrides) - set(self.open_sessions):
            raise ValueError(f"times of dates that aren't open sessions: {sorted(extra)}")
        if outside := [d for d in (*self.closed, *self.open_sessions) if not self.start <= d <= self.end]:
            raise CoverageError(f"outside coverage: {sorted(outside)}")

    @classmethod
    def always(cls, start: date, end: date) -> Calendar:
        """Every day from midnight to midnight, UTC."""
        return cls(start, end, "UTC", weekend=frozenset(), phases=(0, 0, 0, 86400, 86400), block=(0, 86400))

    def is_trading_day(self, day: date) -> bool:
        if not self.start <= day <= self.end:
            raise CoverageError(str(day))
        return day in self.open_sessions or (day.weekday() not in self.weekend and day not in self.closed)

    def blocks(self, day: date) -> tuple[tuple[int, int], ...]:
        return self.overrides.get(day, (self.block,))

    def previous_trading_days(self, day: date, n: int) -> list[date]:
        """The n trading days before, oldest first; fails where the search leaves coverage."""
        out: list[date] = []
        while len(out) < n:
            day -= timedelta(days=1)
            if self.is_trading_day(day):
                out.append(day)
        return out[::-1]

    def capacity(self, day: date, seconds: int) -> int:
        """How many candles of so many seconds a day holds at least one of a block."""
        return sum(max(1, (b - a) // seconds) for a, b in self.blocks(day))

    def lookback_window(self, day: date, lookback: int, seconds: int | None = None, margin: int = 1) -> list[date]:
        """The trading days before day whose candles suffice for a lookback, and margin more; of sessions if seconds is None.

        With a special session among them each date counts what it holds; one without times fails, wherever it lies.
        """
        if seconds is None:
            return self.previous_trading_days(day, lookback)
        span = -(-lookback // max(1, (self.block[1] - self.block[0]) // seconds)) + margin
        days = self.previous_trading_days(day, span)
        if not self.open_sessions.intersection(days):
            return days
        days, held, spare = [], 0, margin
        while held < lookback or spare:
            spare -= held >= lookback
            days[:0] = self.previous_trading_days(days[0] if days else day, 1)
            if days[0] in self.open_sessions and days[0] not in self.overrides:
                raise MissingTimingError(f"no session times: {days[0]}")
            held += self.capacity(days[0], seconds)
        return days

    def days(self, spark: SparkSession) -> DataFrame:
        """trading_date, explicit_open, explicit_closed, weekend, trading: a row per covered date."""
        listed = lambda ds: F.array(*[F.lit(d) for d in sorted(ds)]) if ds else F.array().cast("array<date>")
        days = spark.range(1).select(F.explode(F.sequence(F.lit(self.start), F.lit(self.end))).alias("trading_date"))
        marked = days.select(
            "trading_date",
            F.array_contains(listed(self.open_sessions), F.col("trading_date")).alias("explicit_open"),
            F.array_contains(listed(self.closed), F.col("trading_date")).alias("explicit_closed"),
            F.weekday("trading_date").isin(sorted(self.weekend)).alias("weekend") if self.weekend else F.lit(False).alias("weekend"),
        )
        return marked.withColumn("trading", sessions.is_trading_day(F.col("explicit_open"), F.col("weekend"), F.col("explicit_closed")))

    def intervals(self, spark: SparkSession) -> DataFrame:
        """trading_date, block, open_us, close_us, special, timed: a row per trading date and block.

        A special open date without times has the default block and timed false: intraday work withholds it.
        """
        special = F.col("explicit_open")
        times = F.array(F.struct(F.lit(self.block[0]).alias("a"), F.lit(self.block[1]).alias("b")))
        chosen = times
        for day, blocks in sorted(self.overrides.items()):
            own = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in blocks])
            chosen = F.when(F.col("trading_date") == F.lit(day), own).otherwise(chosen)
        timed = ~special | F.col("trading_date").isin(sorted(self.overrides)) if self.overrides else ~special
        rows = self.days(spark).where("trading").select("trading_date", special.alias("special"), timed.alias("timed"), F.posexplode(chosen).alias("block", "t"))
        return rows.select(
            "trading_date", "block", "special", "timed",
            sessions.instant(F.col("trading_date"), F.col("t.a"), self.zone).alias("open_us"),
            sessions.instant(F.col("trading_date"), F.col("t.b"), self.zone).alias("close_us"),
        )

    def envelopes(self, spark: SparkSession) -> DataFrame:
        """trading_date, open_us, close_us: from the first block's start to the last's end."""
        return self.intervals(spark).groupBy("trading_date").agg(F.min("open_us").alias("open_us"), F.max("close_us").alias("close_us"))

    def previous_days(self, spark: SparkSession, n: int = 1) -> DataFrame:
        """trading_date and previous_date, the n-th trading day before it; dates without one are left out."""
        order = Window.orderBy("trading_date")  # a calendar's days are few
        days = self.days(spark).where("trading").select("trading_date")
        return days.withColumn("previous_date", F.lag("trading_date", n).over(order)).where("previous_date is not null")


def classify(rows: DataFrame, calendar: Calendar, ts: str = "ts", halted: str | None = None) -> DataFrame:
    """rows plus trading_date (local) and market_state."""
    local = sessions.local_time(F.col(ts), calendar.zone)
    dated = rows.withColumns({"trading_date": F.to_date(local), "__second": sessions.second_of_day(local)})
    days = calendar.days(rows.sparkSession).select("trading_date", "trading", F.lit(True).alias("__covered"))
    halt = F.coalesce(F.col(halted), F.lit(False)) if halted else F.lit(False)
    state = sessions.market_state(F.col("__covered").isNotNull(), F.coalesce("trading", F.lit(False)), halt, F.col("__second"), calendar.phases)
    return dated.join(F.broadcast(days), "trading_date", "left").withColumn("market_state", state).drop("__second", "__covered", "trading")


def day_buckets(calendar: Calendar, spark: SparkSession, seconds: int) -> DataFrame:
    """trading_date, index, start_us, end_us: the buckets of every block, numbered through a date; a gap between blocks takes no number."""
    blocks = calendar.intervals(spark).where("timed")
    n = F.ceil((F.col("close_us") - F.col("open_us")) / (seconds * sessions.SECOND)).cast("long")
    each = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    start = sessions.bucket_start(F.col("k"), F.col("open_us"), seconds)
    rows = each.select("trading_date", start.alias("start_us"), sessions.bucket_end(F.col("k"), F.col("open_us"), F.col("close_us"), seconds).alias("end_us"))
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("trading_date").orderBy("start_us")) - 1)


def attested(dates: list[date], provenance: list[str]) -> list[date]:
    """Which dates no provenance text names in ISO form."""
    named = {d for text in provenance for d in re.findall(r"\d{4}-\d{2}-\d{2}", text)}
    return [d for d in sorted(dates) if d.isoformat() not in named]


#: Severity of comparison results, mildest first.
SEVERITY = ("MATCH", "AUTHORITATIVE_COVERAGE_MISSING", "TIMING_CHANGE", "NEW_CLOSED", "NEW_OPEN", "CONFLICT")


def compare(observed: DataFrame, calendar: Calendar) -> DataFrame:
    """trading_date, status of observed rows (trading_date, status OPEN or CLOSED, intervals: array of (a, b) seconds or null)."""
    days = calendar.days(observed.sparkSession)
    timing = calendar.intervals(observed.sparkSession).groupBy("trading_date").agg(
        F.array_sort(F.collect_list(F.concat_ws("-", "open_us", "close_us"))).alias("held"), F.max("timed").alias("timed")
    )
    seen = F.array_sort(F.transform("intervals", lambda x: F.concat_ws(
        "-", sessions.instant(F.col("trading_date"), x["a"], calendar.zone), sessions.instant(F.col("trading_date"), x["b"], calendar.zone))))
    joined = observed.join(F.broadcast(days), "trading_date", "left").join(F.broadcast(timing), "trading_date", "left")
    closed = F.col("status") == "CLOSED"
    status = (
        F.when(F.col("trading").isNull(), "AUTHORITATIVE_COVERAGE_MISSING")
        .when(closed & F.col("explicit_open"), "CONFLICT")
        .when(closed, F.when(~F.col("trading"), "MATCH").otherwise("NEW_CLOSED"))
        .when(F.col("explicit_closed"), "CONFLICT")
        .when(F.col("explicit_open"), F.when(F.col("intervals").isNull() | (F.size("intervals") == 0) | (F.col("timed") & (seen == F.col("held"))), "MATCH").otherwise("TIMING_CHANGE"))
        .when(~F.col("trading"), "NEW_OPEN")
        .otherwise("MATCH")
    )
    return joined.select("trading_date", status.alias("status"))


def signature(compared: DataFrame) -> DataFrame:
    """overall and signature: the gravest status, and match or the SHA-256 of what differs."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    lines = F.when(F.col("status") != "MATCH", F.concat_ws("|", F.concat_ws(":", F.col("trading_date").cast("string"), "status")))
    summed = compared.agg(F.max_by("status", rank).alias("overall"), F.array_sort(F.collect_list(lines)).alias("lines"))
    text = F.concat_ws("|", F.array("overall"), "lines")
    return summed.select("overall", F.when(F.size("lines") == 0, "match").otherwise(F.sha2(text, 256)).alias("signature"))
