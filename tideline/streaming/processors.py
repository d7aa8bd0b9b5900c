"""Keyed stateful streams: validation with versions, live candles and session statistics.

Each is one pure step over (state, event) in order of arrival; a micro-batch is sorted by arrival within a key first,
as Spark promises no order there. State is bounded: the latest values of a key, or its open buckets.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FUTURE_SKEW_US = 60_000_000
#: Prices go through the states as whole ten-thousandths: JSON has no decimals.
PRICE_UNIT = 10_000
#: Most series that a feed-wide event is dealt out to.
MOST_SERIES = 100_000


def validate_step(state: dict, e: dict) -> tuple[dict, dict]:
    """state: last_us, tick, quote, version. An event has arrival, kind, ts_us, now_us and payload (any text)."""
    same = [e["ts_us"], e["payload"]]
    if e["ts_us"] > e["now_us"] + FUTURE_SKEW_US:
        verdict = "INVALID"
    elif state.get(e["kind"]) == same:
        verdict = "DUPLICATE"
    elif state.get("last_us") is not None and e["ts_us"] < state["last_us"]:
        verdict = "STALE"
    else:
        verdict = "ACCEPT"
        state = state | {"last_us": max(e["ts_us"], state.get("last_us") or e["ts_us"]), e["kind"]: same, "version": state.get("version", 0) + 1}
    return state, {"arrival": e["arrival"], "verdict": verdict, "version": state.get("version", 0) if verdict == "ACCEPT" else None}


def candle_step(state: dict, e: dict) -> tuple[dict, dict | None]:
    """state: the open bucket and what the next one needs. A tick of a later bucket or day gives out the bucket before.

    A row of kind loss taints an instrument that has ticks: its open bucket, if it isn't over, and those that follow that day.
    A row of kind flush gives out a bucket that ends by its instant. What comes later for a bucket given out is dropped.
    """
    now = state.get("bucket")
    if e["kind"] == "flush":
        return flush_step(state) if now and now["end_us"] <= e["ts_us"] else (state, None)
    if e["kind"] == "loss":
        if now and now["trading_date"] == e["trading_date"]:
            state = state | {"broken": True, "bucket": now | {"cut": now["cut"] or e["ts_us"] <= now["end_us"]}}
        elif now and e["ts_us"] <= now["end_us"]:
            state = state | {"bucket": now | {"cut": True}}
        return state, None
    width = e["tf"] * 1_000_000
    index = (e["ts_us"] - e["open_us"]) // width
    done = None
    if now and (now["trading_date"], now["index"]) == (e["trading_date"], index):
        if now.get("given"):
            return state, None
        top = now["cum"]
        back = e["cum"] is not None and top is not None and e["cum"] < top
        cum = top if e["cum"] is None or back else e["cum"]
        bucket = now | {"high": max(now["high"], e["price"]), "low": min(now["low"], e["price"]), "close": e["price"], "ticks": now["ticks"] + 1, "cum": cum, "invalid": now["invalid"] or back}
        return state | {"bucket": bucket}, None
    broken, before = False, None
    if now:
        done = None if now.get("given") else finish(now)
        if now["trading_date"] == e["trading_date"]:
            broken, before = bool(state.get("broken")), now
    gap = broken or (before is not None and index != before["index"] + 1)
    base = None if gap or before is None or before["gap"] else before["cum"]
    bucket = {
        "trading_date": e["trading_date"], "index": index, "end_us": min(e["open_us"] + (index + 1) * width, e["close_us"]), "open": e["price"], "high": e["price"], "low": e["price"], "close": e["price"],
        "ticks": 1, "cum": e["cum"], "invalid": False, "gap": gap, "cut": False, "base": base,
    }
    return {"bucket": bucket, "broken": broken}, done


def flush_step(state: dict) -> tuple[dict, dict | None]:
    """Gives the open bucket out; the state keeps what the next one needs of it."""
    now = state.get("bucket")
    if not now or now.get("given"):
        return state, None
    return state | {"bucket": now | {"given": True}}, finish(now)


def finish(b: dict) -> dict:
    sure = not b["invalid"] and b["base"] is not None and b["cum"] is not None and b["cum"] >= b["base"]
    quality = "FEED_GAP" if b["gap"] else "INCOMPLETE_OHLC" if b["cut"] else "INCOMPLETE_VOLUME"
    return {k: b[k] for k in ("trading_date", "index", "open", "high", "low", "close", "ticks")} | {"volume": b["cum"] - b["base"] if sure else None, "quality": quality}


def statistics_step(state: dict, e: dict) -> tuple[dict, dict | None]:
    """state: trading_date, as_of_us, open, high, low. Gives the statistics out when they move on."""
    if state and e["trading_date"] > state["trading_date"]:
        state = {}
    if e["market_state"] != "LIVE_SESSION" or not e["verified"] or e["open"] is None:
        return state, None
    fresh = {k: e[k] for k in ("trading_date", "as_of_us", "open", "high", "low")}
    if state:
        same = all(e[k] == state[k] for k in ("open", "high", "low"))
        if e["trading_date"] < state["trading_date"] or e["as_of_us"] < state["as_of_us"] or e["open"] != state["open"] or e["high"] < state["high"] or e["low"] > state["low"] or same:
            return state, None
    return fresh, fresh


def _plain(row: dict) -> dict:
    return {k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v for k, v in row.items()}


def stateful(
    events: DataFrame, step: Callable, schema: str, names: list[str], mode: str = "append", keys: Sequence[str] = ("instrument",),
    timer: tuple[Callable[[dict], int | None], Callable[[dict], tuple[dict, dict | None]]] | None = None,
) -> DataFrame:
    """step over each key's events; the state is JSON text, so any step's state fits.

    timer: (the microseconds at which a state is due, or None; what is then done with it). It needs a watermark on events, and fires
    once that has passed the instant, with no further event of the key.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState):
        state = json.loads(held.get[0]) if held.exists else {}
        out = []
        if held.hasTimedOut:
            state, told = timer[1](state)
            out += [told] if told else []
        else:
            for e in pd.concat(list(frames)).sort_values("arrival").to_dict("records"):
                state, told = step(state, _plain(e))
                out += [told] if told is not None else []
        held.update((json.dumps(state),))
        if timer and (due := timer[0](state)) is not None:
            held.setTimeoutTimestamp(max(due // 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([dict(zip(keys, key, strict=True)) | x for x in out], columns=[*keys, *names]).astype(object)

    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    timeout = GroupStateTimeout.EventTimeTimeout if timer else GroupStateTimeout.NoTimeout
    return events.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, {schema}", "state string", mode, timeout)


def _units(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({c: (F.col(c).cast("decimal(12,4)") * PRICE_UNIT).cast("long") for c in names})


def _prices(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({c: (F.col(c) / F.lit(PRICE_UNIT).cast("decimal(20,0)")).cast("decimal(12,4)") for c in names})


def validated(events: DataFrame) -> DataFrame:
    """events: instrument, arrival, kind, ts_us, now_us, payload."""
    return stateful(events, validate_step, "arrival long, verdict string, version long", ["arrival", "verdict", "version"])


def fan_out(events: DataFrame, timeframes: Sequence[int]) -> DataFrame:
    """A row of events for each timeframe (tf, in seconds), which may be given anew at each start of the stream: states are by (instrument, tf)."""
    return events.withColumn("tf", F.explode(F.array(*map(F.lit, timeframes))))


def candles(events: DataFrame, flush: bool = False) -> DataFrame:
    """Candles of each (instrument, tf) from events: instrument, tf, arrival, kind (tick, loss or flush), ts_us, trading_date (text), open_us, close_us, price, cum.

    Losses and flushes come as a row a series (per_series). A bucket is given out by a tick of a later one, by a flush, or, with
    flush, as soon as the watermark (which events must have, on any instant column) has passed its end.
    """

    def due(state: dict) -> int | None:
        now = state.get("bucket")
        return now["end_us"] if now and not now.get("given") else None

    names = ["trading_date", "index", "open", "high", "low", "close", "ticks", "volume", "quality"]
    schema = "trading_date string, index long, open long, high long, low long, close long, ticks long, volume long, quality string"
    made = stateful(_units(events, "price"), candle_step, schema, names, keys=("instrument", "tf"), timer=(due, flush_step) if flush else None)
    return _prices(made, "open", "high", "low", "close")


def session_statistics(events: DataFrame) -> DataFrame:
    """events: instrument, arrival, trading_date (text), as_of_us, market_state, verified, open, high, low."""
    names = ["trading_date", "as_of_us", "open", "high", "low"]
    made = stateful(_units(events, "open", "high", "low"), statistics_step, "trading_date string, as_of_us long, open long, high long, low long", names)
    return _prices(made, "open", "high", "low")


def per_series(events: DataFrame, instruments: Sequence[str], timeframes: Sequence[int] = ()) -> DataFrame:
    """A feed-wide event as a row for each instrument (and timeframe); Spark has no broadcast state. MOST_SERIES rows an event at most, else it fails."""
    names = sorted(set(instruments))
    if len(names) * max(1, len(timeframes)) > MOST_SERIES:
        raise ValueError(f"{len(names)} instruments; {MOST_SERIES} series are dealt out to")
    rows = events.withColumn("instrument", F.explode(F.array(*map(F.lit, names))))
    return fan_out(rows, timeframes) if timeframes else rows
