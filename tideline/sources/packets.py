"""Binary live packets, decoded by column in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the wire format, little-endian.
HEADER = [("code", "u1"), ("length", "<i2"), ("segment", "u1"), ("security_id", "<i4")]
PRICES = [("open", "<f4"), ("close", "<f4"), ("high", "<f4"), ("low", "<f4")]
TRADE = [("price", "<f4"), ("traded", "<i2"), ("time", "<i4"), ("average", "<f4"), ("volume", "<i4"), ("sells", "<i4"), ("buys", "<i4")]
LEVEL = [("bid_quantity", "<i4"), ("ask_quantity", "<i4"), ("bid_orders", "<i2"), ("ask_orders", "<i2"), ("bid_price", "<f4"), ("ask_price", "<f4")]
LAYOUTS = {
    4: np.dtype([*HEADER, *TRADE, *PRICES]),
    8: np.dtype([*HEADER, *TRADE, ("interest", "<i4"), ("high_interest", "<i4"), ("low_interest", "<i4"), *PRICES, ("levels", LEVEL, 5)]),
    6: np.dtype([*HEADER, ("previous_close", "<f4"), ("interest", "<i4")]),
    50: np.dtype([*HEADER, ("reason", "<i2")]),
}
SEGMENT_CODES = {"IDX_I": 0, "NSE_EQ": 1, "NSE_FNO": 2, "NSE_CURRENCY": 3, "BSE_EQ": 4, "MCX_COMM": 5, "BSE_CURRENCY": 7, "BSE_FNO": 8}

_P = "decimal(38,18)"
_OHLC = ("open", "high", "low", "close")
#: What the decoder gives, flat; prices as the text of their shortest form, which Spark casts.
_FLAT = {
    "arrival": pa.int64(), "code": pa.int32(), "segment_code": pa.int32(), "security_id": pa.int64(), "fault": pa.string(), "ts_us": pa.int64(),
    "price": pa.string(), "traded": pa.int64(), "volume": pa.int64(), **dict.fromkeys(_OHLC, pa.string()),
    "said": pa.struct([("ts_us", pa.int64()), ("last_price", pa.float64()), ("traded_quantity", pa.int64())]),
    **{x: pa.list_(pa.struct([("price", pa.string()), ("quantity", pa.int64())])) for x in ("bid", "ask")},
}
_FLAT_SCHEMA = (
    "arrival long, code int, segment_code int, security_id long, fault string, ts_us long, price string, traded long, volume long, open string, high string, low string, close string, "
    "said struct<ts_us:bigint,last_price:double,traded_quantity:bigint>, "
    "bid array<struct<price:string,quantity:bigint>>, ask array<struct<price:string,quantity:bigint>>"
)


def _texts(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64).astype(str)


def _bad(x: np.ndarray) -> np.ndarray:
    """Which decoded records break a rule: a price that isn't positive, a negative count or average, no time."""
    names = x.dtype.names
    bad = np.zeros(len(x), bool)
    for name in ("open", "close", "high", "low", "average", "previous_close"):
        if name in names:
            bad |= ~np.isfinite(x[name]) | (x[name] < 0)
    for name in ("traded", "volume", "sells", "buys", "interest", "high_interest", "low_interest"):
        if name in names:
            bad |= x[name] < 0
    if "price" in names:
        bad |= ~np.isfinite(x["price"]) | (x["price"] <= 0) | (x["time"] <= 0)
    if "levels" in names:
        v = x["levels"]
        for name in ("bid_quantity", "ask_quantity", "bid_orders", "ask_orders"):
            bad |= (v[name] < 0).any(1)
        for name in ("bid_price", "ask_price"):
            bad |= (~np.isfinite(v[name]) | (v[name] <= 0)).any(1)
        bad |= v["ask_price"][:, 0] < v["bid_price"][:, 0]
    return bad


def _sides(x: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Prices (as text) and quantities of a side's levels, record by record."""
    return _texts(x["levels"][f"{side}_price"].ravel()), x["levels"][f"{side}_quantity"].ravel().astype(np.int64)


def _columns(arrivals: pa.Array, data: list[bytes | None]) -> pa.RecordBatch:
    n = len(data)
    codes = np.array([body[0] if body else -1 for body in data], np.int64)
    lengths = np.array([len(body) if body else 0 for body in data], np.int64)
    fault = np.full(n, None, object)
    fault[lengths == 0] = "empty"
    fault[(lengths > 0) & ~np.isin(codes, list(LAYOUTS))] = "unknown code"
    whole = {c: np.zeros(n, np.int64) for c in ("code", "segment_code", "security_id", "ts_us", "traded", "volume")}
    known, traded, refused = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    refused_price = np.zeros(n)
    text = {c: np.full(n, None, object) for c in ("price", *_OHLC)}
    levels: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    deep = np.zeros(0, np.int64)
    for code, layout in LAYOUTS.items():
        mine = codes == code
        fault[mine & (lengths != layout.itemsize)] = "wrong length"
        at = np.flatnonzero(mine & (lengths == layout.itemsize))
        if not len(at):
            continue
        x = np.frombuffer(b"".join([data[i] for i in at]), layout)
        known[at] = True
        for name, field in (("code", "code"), ("segment_code", "segment"), ("security_id", "security_id")):
            whole[name][at] = x[field]
        header = (x["length"] != layout.itemsize) | ~np.isin(x["segment"], list(SEGMENT_CODES.values())) | ((x["security_id"] <= 0) if code != 50 else False)
        values = _bad(x) & ~header
        fault[at[header]], fault[at[values]] = "bad header", "bad values"
        good = ~header & ~values
        if code not in (4, 8):
            continue
        whole["ts_us"][at] = x["time"].astype(np.int64) * 1_000_000
        whole["traded"][at], whole["volume"][at] = x["traded"], x["volume"]
        refused[at[values]], refused_price[at[values]] = True, x["price"][values]
        if not good.any():
            continue
        at, x = at[good], x[good]
        traded[at] = True
        text["price"][at] = _texts(x["price"])
        # the day's prices only where they are coherent: zeros stand for not yet known
        o, h, low, c = (x[k] for k in _OHLC)
        sound = (low > 0) & (low <= np.minimum(o, c)) & (np.maximum(o, c) <= h)
        for k in _OHLC:
            text[k][at[sound]] = _texts(x[k][sound])
        if code == 8:
            deep = at
            levels = {side: _sides(x, side) for side in ("bid", "ask")}
    offsets = np.concatenate([[0], np.cumsum(np.where(np.isin(np.arange(n), deep), 5, 0))])
    out: dict[str, pa.Array] = {"arrival": arrivals, "fault": pa.array(fault, pa.string())}
    for name, x in whole.items():
        out[name] = pa.array(x, mask=~(known if name in ("code", "segment_code", "security_id") else traded)).cast(_FLAT[name])
    out |= {name: pa.array(x, pa.string()) for name, x in text.items()}
    fields = [pa.array(whole["ts_us"]), pa.array(refused_price), pa.array(whole["traded"])]
    out["said"] = pa.StructArray.from_arrays(fields, fields=list(_FLAT["said"]), mask=pa.array(~refused))
    for side in ("bid", "ask"):
        prices, quantities = levels.get(side, (np.zeros(0, str), np.zeros(0, np.int64)))
        cells = pa.StructArray.from_arrays([pa.array(prices, pa.string()), pa.array(quantities)], names=["price", "quantity"])
        out[side] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)
    return pa.RecordBatch.from_arrays([out[c] for c in _FLAT], names=list(_FLAT))


def decode(packets: DataFrame) -> DataFrame:
    """packets (arrival, packet) as rows of arrival, code, segment_code, security_id, fault, ts_us, tick, quote, depth and refused.

    What can't be read has a fault and stays; a disconnect is code 50; a previous-close packet is checked and
    carries nothing. Null packets are empty ones. A trade of bad values makes no tick; what it said is in refused. Records are decoded by column, prices keep the shortest text of their floats.
    """

    def run(batches):
        for batch in batches:
            yield _columns(batch.column(0), batch.column(1).to_pylist())

    flat = packets.select("arrival", "packet").mapInArrow(run, _FLAT_SCHEMA)
    exact = lambda x: x.cast(_P)
    side = lambda c: F.transform(c, lambda x: F.struct(exact(x["price"]).alias("price"), x["quantity"].alias("quantity")))
    prices = F.when(F.col("open").isNotNull(), F.struct(*[exact(F.col(c)).alias(c) for c in _OHLC]))
    best = [F.get("bids", F.lit(0)), F.get("asks", F.lit(0))]
    deep = F.size("bids") > 0
    return flat.withColumns({"bids": side("bid"), "asks": side("ask")}).select(
        "arrival", "code", "segment_code", "security_id", "fault", "ts_us",
        F.when(F.col("price").isNotNull(), F.struct(
            exact(F.col("price")).alias("last_price"), F.col("traded").alias("traded_quantity"), F.col("volume").alias("session_cumulative_volume"), prices.alias("session_ohlc"),
        )).alias("tick"),
        F.when(deep, F.struct(
            best[0]["price"].alias("bid_price"), best[1]["price"].alias("ask_price"), best[0]["quantity"].alias("bid_quantity"), best[1]["quantity"].alias("ask_quantity"),
        )).alias("quote"),
        F.when(deep, F.struct("bids", "asks")).alias("depth"), F.col("said").alias("refused"),
    )


def encode_quotes(rows: DataFrame) -> DataFrame:
    """rows (arrival, user_id, at, value, k) as quote packets: the wire form of a made feed, for replays and tests."""

    def run(batches):
        layout = LAYOUTS[4]
        for batch in batches:
            arrival, user, at, value, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.zeros(len(arrival), layout)
            x["code"], x["length"], x["segment"], x["security_id"] = 4, layout.itemsize, SEGMENT_CODES["NSE_EQ"], user + 1
            x["price"], x["traded"], x["time"] = value, k, at
            data = x.tobytes()
            bodies = [data[i : i + layout.itemsize] for i in range(0, len(data), layout.itemsize)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["arrival", "packet"])

    return rows.select("arrival", "user_id", "at", "value", "k").mapInArrow(run, "arrival long, packet binary")
