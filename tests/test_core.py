"""Golden vectors, sequential models and stream-batch equality of the market operators."""

import json
import random
import struct
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import calendar as cal
from tideline.operators import candles, evaluation, history, statistics, universe, validation
from tideline.plans import strategies
from tideline.sources import files, html_calendar, packets
from tideline.streaming import processors

IST = cal.Calendar(date(2026, 1, 1), date(2026, 12, 31), open_sessions=frozenset({date(2026, 8, 8)}), overrides={date(2026, 8, 8): ((33300, 36000), (41400, 45000))})
DAY = date(2026, 8, 6)
OPEN = 1785987900_000_000  # 2026-08-06 09:15 in Kolkata
CLOSE = OPEN + 375 * 60_000_000
MINUTE = 60_000_000


def sessions_of(spark, *hlc):
    rows = [(f"S{i}", DAY, date(2026, 8, 5), *map(Decimal, (o, h, low, c))) for i, (o, h, low, c) in enumerate(hlc)]
    p = "decimal(12,4)"
    return spark.createDataFrame(rows, f"instrument string, trading_date date, source_date date, open {p}, high {p}, low {p}, close {p}")


def test_narrow_cpr_golden(spark):
    frame = sessions_of(spark, ("100", "120", "68", "112"), ("80", "140", "72", "88"), ("100", "110", "90", "100"), ("100", "140", "36", "124"), ("100", "140", "56", "104"))
    got = {r.instrument: r for r in strategies.evaluate(strategies.CATALOG["narrow_cpr"], frame).collect()}
    assert (got["S0"].pivot, got["S0"].bc, got["S0"].tc, got["S0"].cpr_width, got["S0"].cpr_width_pct) == (100, 94, 106, 12, 12)
    assert (got["S1"].bc, got["S1"].tc, got["S1"].cpr_bottom, got["S1"].cpr_top) == (106, 94, 94, 106)
    assert got["S2"].cpr_width_pct == 0 and got["S3"].cpr_width_pct == 24 and got["S4"].cpr_width_pct == 4
    limited = strategies.evaluate(strategies.CATALOG["narrow_cpr"], frame, Decimal("12"))
    assert {r.instrument for r in limited.collect() if r.status == "MATCHED"} == {"S0", "S2", "S4", "S1"} - ({"S1"} if got["S1"].cpr_width_pct > 12 else set())


def test_range_body_and_ties(spark):
    frame = sessions_of(spark, ("100", "120", "110", "115"), ("100", "120", "110", "90"), ("50", "60", "55", "58"))
    ranged = strategies.evaluate(strategies.CATALOG["previous_session_range_pct"], frame).withColumns({"exchange": F.lit("X"), "symbol": F.col("instrument")})
    ranked = evaluation.rank_candidates(ranged, "previous_range_pct", True).orderBy("rank").collect()
    assert [(r.instrument, r.rank, r.previous_range_pct) for r in ranked] == [("S0", 1, 10), ("S1", 2, 10), ("S2", 3, 10)]
    body = {r.instrument: r.previous_body_pct for r in strategies.evaluate(strategies.CATALOG["previous_session_body_pct"], frame).collect()}
    assert body == {"S0": 15, "S1": 10, "S2": 16}


def test_relative_range_needs_21_sessions(spark):
    p = "decimal(12,4)"
    rows = [(f"SYM{k:03}", d, Decimal(100), Decimal(110) if d else Decimal(100) + Decimal(k + 1) / 10, Decimal(100), Decimal(100)) for k in range(4) for d in range(21)]
    rows += [("SHORT", d, Decimal(100), Decimal(110), Decimal(100), Decimal(100)) for d in range(20)] + [("FLAT", d, *[Decimal(100)] * 4) for d in range(21)]
    daily = spark.createDataFrame(rows, f"instrument string, back int, open {p}, high {p}, low {p}, close {p}").withColumn("trading_date", F.date_sub(F.lit("2026-03-31").cast("date"), F.col("back"))).drop("back")
    days = spark.range(40).select(F.date_add(F.lit("2026-03-01").cast("date"), F.col("id").cast("int")).alias("trading_date"), (F.col("id") + 1).cast("int").alias("number"))
    got = {r.instrument: r for r in strategies.evaluate(strategies.CATALOG["previous_session_relative_range"], strategies.lookback(daily, days, 21)).collect()}
    assert {k: round(v.relative_range_ratio, 6) for k, v in got.items() if k.startswith("SYM")} == {f"SYM{k:03}": (k + 1) / 100 for k in range(4)}
    assert "SHORT" not in got and got["FLAT"].status == "SKIPPED"


def test_registry_fails_closed():
    with pytest.raises(ValueError):
        strategies.Registry(strategies.CATALOG["narrow_cpr"], strategies.CATALOG["narrow_cpr"])
    with pytest.raises(KeyError):
        strategies.CATALOG["unknown"]


def test_calendar():
    assert IST.capacity(date(2026, 8, 8), 300) == 9 + 12
    assert IST.is_trading_day(date(2026, 8, 8)) and not IST.is_trading_day(date(2026, 8, 9))
    assert IST.previous_trading_days(date(2026, 8, 10), 2) == [date(2026, 8, 7), date(2026, 8, 8)]
    with pytest.raises(cal.CoverageError):
        IST.previous_trading_days(date(2026, 1, 2), 3)
    bare = cal.Calendar(date(2026, 1, 1), date(2026, 12, 31), open_sessions=frozenset({date(2026, 8, 8)}))
    with pytest.raises(cal.MissingTimingError):
        bare.lookback_window(date(2026, 8, 10), 100, 300)
    assert len(IST.lookback_window(date(2026, 8, 6), 76, 300)) == 3
    assert IST.lookback_window(date(2026, 8, 10), 21, 300)[-1] == date(2026, 8, 8)


def test_day_buckets_skip_the_gap(spark):
    rows = cal.day_buckets(IST, spark, 300).where("trading_date = date'2026-08-08'").orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(21))
    assert rows[9].start_us - rows[8].end_us == 90 * MINUTE


def test_phases(spark):
    seconds = [32399, 32400, 32880, 33300, 55799, 55800, 56400]
    frame = spark.createDataFrame([(s,) for s in seconds], "s int").select("s", F.timestamp_micros(F.lit(OPEN) + (F.col("s").cast("long") - 33300) * 1_000_000).alias("ts"))
    got = [r.market_state for r in cal.classify(frame, IST).orderBy("s").collect()]
    assert got == ["MARKET_CLOSED", "PRE_OPEN", "OPENING_AUCTION", "LIVE_SESSION", "LIVE_SESSION", "CLOSING_SESSION", "MARKET_CLOSED"]


def ticks_of(spark, rows):
    data = [(i, n, OPEN + int(m * MINUTE), DAY, OPEN, CLOSE, Decimal(p), c) for n, (i, m, p, c) in enumerate(rows)]
    return spark.createDataFrame(data, "instrument string, arrival long, ts_us long, trading_date date, open_us long, close_us long, price decimal(12,4), cum long")


def test_buckets_and_volume_golden(spark):
    got = candles.live_candles(ticks_of(spark, [("A", 0, 100, 1000), ("A", 4, 101, 1000), ("A", 5, 102, 1070), ("A", 9, 99, None), ("A", 10, 100, 1090), ("A", 374, 100, 2000)]), [300, 420]).orderBy("tf", "index").collect()
    five = [r for r in got if r.tf == 300]
    assert [(r.volume, r.quality) for r in five] == [(None, "INCOMPLETE_VOLUME"), (70, "INCOMPLETE_VOLUME"), (20, "INCOMPLETE_VOLUME"), (None, "FEED_GAP")]
    assert (five[1].open, five[1].high, five[1].low, five[1].close) == (102, 102, 99, 99)
    assert got[-1].tf == 420 and got[-1].end_us == CLOSE
    back = candles.live_candles(ticks_of(spark, [("A", 0, 1, 1000), ("A", 5, 1, 1070), ("A", 6, 1, 1050)]), [300]).orderBy("index").collect()
    assert back[1].volume is None and back[1].volume_invalid


def random_events(rng, n):
    out, at = [], 0.0
    for _ in range(n):
        at += rng.choice([0.2, 1, 4, 11])
        if rng.random() < 0.1:
            out.append(("loss", at, None, None))
        else:
            out.append(("tick", at, rng.randint(1, 50), rng.choice([None, int(at * 10), int(at * 10) - rng.randint(0, 9)])))
    return [e for e in out if e[1] < 370]


def test_candles_equal_the_sequential_model(spark):
    rng, ticks, losses, want = random.Random(7), [], [], []
    for k in range(25):
        state = {}
        for n, (kind, m, price, cum) in enumerate(random_events(rng, 40)):
            us = OPEN + int(m * MINUTE)
            e = {"kind": kind, "ts_us": us, "trading_date": str(DAY), "tf": 300, "open_us": OPEN, "close_us": CLOSE, "price": price, "cum": cum}
            state, done = processors.candle_step(state, e)
            if done:
                want.append((f"I{k}", done["index"], done["open"], done["high"], done["low"], done["close"], done["volume"], done["quality"]))
            (losses if kind == "loss" else ticks).append((f"I{k}", n, us, DAY, OPEN, CLOSE, None if price is None else Decimal(price), cum))
        if state.get("bucket"):
            d = processors.finish(state["bucket"])
            want.append((f"I{k}", d["index"], d["open"], d["high"], d["low"], d["close"], d["volume"], d["quality"]))
    got = []
    schema = "instrument string, arrival long, ts_us long, trading_date date, open_us long, close_us long, price decimal(12,4), cum long"
    for k in range(25):
        own = [t for t in ticks if t[0] == f"I{k}"]
        lost = spark.createDataFrame([(x[1], x[2], DAY) for x in losses if x[0] == f"I{k}"], "arrival long, ts_us long, trading_date date")
        if k < 6 and own:
            got += [(r.instrument, r["index"], r.open, r.high, r.low, r.close, r.volume, r.quality) for r in candles.live_candles(spark.createDataFrame(own, schema), [300], lost).collect()]
    assert sorted(map(str, ((*w[:2], *map(lambda x: Decimal(x).quantize(Decimal("0.0001")), w[2:6]), *w[6:]) for w in want if int(w[0][1:]) < 6))) == sorted(map(str, got))


def test_validation_equals_the_sequential_model_and_the_stream(spark, tmp_path):
    rng, rows, want = random.Random(3), [], []
    for k in range(12):
        state = {}
        for n in range(60):
            e = {"arrival": n, "kind": rng.choice(["tick", "quote"]), "ts_us": rng.choice([100, 101, 102, n, 10**9]), "now_us": 1000, "payload": str(rng.randint(0, 1))}
            state, told = processors.validate_step(state, e)
            want.append((f"I{k}", n, told["verdict"], told["version"]))
            rows.append((f"I{k}", e["arrival"], e["kind"], e["ts_us"], e["now_us"], e["payload"]))
    schema = "instrument string, arrival long, kind string, ts_us long, now_us long, payload string"
    frame = spark.createDataFrame(rows, schema)
    judged = validation.classify_events(frame, ["payload"], now_us=F.col("now_us"))
    assert sorted((r.instrument, r.arrival, r.verdict) for r in judged.collect()) == sorted(w[:3] for w in want)
    versions = {(r.instrument, r.arrival): r.version for r in validation.stamp_versions(judged).collect()}
    assert versions == {w[:2]: w[3] for w in want if w[2] == "ACCEPT"}
    for part in (frame.where("arrival < 25"), frame.where("arrival >= 25")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = processors.validated(stream).writeStream.format("memory").queryName("validated").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.instrument, r.arrival, r.verdict) for r in spark.table("validated").collect()) == sorted(w[:3] for w in want)


def test_statistics_fold_equals_the_sequential_model(spark):
    rng, rows, want = random.Random(5), [], {}
    for k in range(20):
        state = {}
        for n in range(25):
            o, h, low = 10, 10 + rng.randint(0, 3), 10 - rng.randint(0, 3)
            e = {"arrival": n, "trading_date": DAY, "as_of_us": n + rng.choice([0, -2]), "market_state": rng.choice(["LIVE_SESSION", "PRE_OPEN"]), "verified": rng.random() < 0.9, "open": rng.choice([o, o, o, None, 11]), "high": h, "low": low}
            state, _ = processors.statistics_step(state, e)
            rows.append((f"I{k}", n, DAY, e["as_of_us"], e["verified"], e["market_state"], *[None if e[c] is None else Decimal(e[c]) for c in ("open", "high", "low")]))
        if state:
            want[f"I{k}"] = (state["as_of_us"], state["open"], state["high"], state["low"])
    p = "decimal(12,4)"
    frame = spark.createDataFrame(rows, f"instrument string, seq long, trading_date date, as_of_us long, verified boolean, market_state string, open {p}, high {p}, low {p}")
    assert {r.instrument: (r.as_of_us, r.open, r.high, r.low) for r in statistics.fold(frame).collect()} == want


def test_exact_resampling(spark):
    def bars(name, minutes, width=1, **change):
        return [(name, OPEN + m * MINUTE, OPEN + (m + width) * MINUTE, *map(Decimal, (100, change.get("h", {}).get(m, 101), change.get("l", {}).get(m, 99), 100)), change.get("q", {}).get(m, 10)) for m in minutes]

    rows = bars("whole", range(7), h={3: 105}, l={4: 97}, q=dict(zip(range(7), (5, 7, 1, 1, 1, 1, 1), strict=True))) + bars("hole", [0, 1, 2, 4, 5, 6]) + bars("late", range(1, 7)) + bars("wide", [0, 1, 2, 3, 4]) + bars("wide", [5], 2)
    p = "decimal(12,4)"
    frame = spark.createDataFrame(rows, f"instrument string, start_us long, end_us long, open {p}, high {p}, low {p}, close {p}, quantity long")
    got = history.resample_exact(frame, IST.intervals(spark), 60, 420, IST.zone).collect()
    assert [(r.instrument, r.open, r.high, r.low, r.close, r.quantity) for r in got] == [("whole", 100, 105, 97, 100, 17)]
    assert (history.select_base(600, [60, 300]), history.select_base(420, [60, 300]), history.select_base(1800, [60, 300, 900])) == (300, 60, 900)
    assert history.union_requirements([(0, 1), (300, 5), (0, 21), (60, 2)]) == [(60, 2), (300, 5), (0, 21)]
    overlap = frame.where("instrument = 'whole'").unionByName(frame.where("instrument = 'whole' and start_us = %d" % OPEN).withColumn("end_us", F.col("end_us") + 1)).withColumn("tf", F.lit(60))
    assert history.verify_series(overlap).count() == 0


def test_strictest_freshness_and_foreign_instruments(spark):
    assert (history.strictest_max_age([300, 60, 900]), history.strictest_max_age([])) == (60, None)
    rows = [("A", "A", 0), ("A", "A", 60), ("B", "B", 0), ("B", "A", 60), ("C", None, 0)]
    frame = spark.createDataFrame(rows, "wanted string, instrument string, s long")
    frame = frame.selectExpr("wanted", "instrument", "60 as tf", "s * 1000000 as start_us", "(s + 60) * 1000000 as end_us")
    got = history.verify_series(frame, 60, asked="wanted").collect()
    assert [(r.wanted, r.instrument) for r in got] == [("A", "A")] * 2


def test_expiry_and_readiness(spark):
    rows = [("X", "U", "future", date(2026, m, 1)) for m in (1, 7, 8, 9, 10, 10)]
    frame = spark.createDataFrame(rows, "exchange string, underlying string, instrument_class string, expiry date")
    got = sorted((r.expiry, r.expiry_rank) for r in universe.expiry_rank(frame, F.lit(date(2026, 7, 1))).collect() if r.expiry_rank is not None)
    assert got == [(date(2026, 7, 1), 0), (date(2026, 8, 1), 1), (date(2026, 9, 1), 2)]


def master(tmp_path, rows):
    head = "EXCH_ID,SEGMENT,SECURITY_ID,INSTRUMENT,UNDERLYING_SECURITY_ID,UNDERLYING_SYMBOL,SYMBOL_NAME,DISPLAY_NAME,INSTRUMENT_TYPE,SERIES,SM_EXPIRY_DATE,STRIKE_PRICE,OPTION_TYPE"
    path = tmp_path / "m.csv"
    path.write_text("\n".join([head, *rows]))
    return str(path)


def test_instrument_master(spark, tmp_path):
    good = ["NSE,E,1,EQUITY,NA,alpha,Alpha Ltd,Alpha,ES,EQ,,,", "NSE,D,2,FUTSTK,1,ALPHA,ALPHA-FUT,Alpha F,NA,NA,2026-08-27,,XX", "NSE,D,3,OPTSTK,1,ALPHA,ALPHA-O,Alpha O,NA,NA,2026-08-27,100.5,CE"]
    rows = {r.security_id: r for r in files.instrument_master(spark, master(tmp_path, good)).collect()}
    assert rows["1"].symbol == "ALPHA" and rows["1"].exchange_segment == "NSE_EQ" and rows["3"].option_type == "call" and rows["2"].expiry == date(2026, 8, 27)
    for bad in (good + good[:1], [good[2].replace("100.5", "0")], [good[0].replace("NSE,E", "NSE,Q")]):
        with pytest.raises(Exception):
            files.instrument_master(spark, master(tmp_path, bad)).collect()


def test_historical_json(spark, tmp_path):
    body = {"open": [100, 101.5], "high": [102, 103], "low": [99, 100], "close": [101, 102], "volume": [10.0, 20], "timestamp": [1735689600.0, 1735776000]}
    path = tmp_path / "h.json"
    path.write_text(json.dumps(body))
    got = files.historical_json(spark, str(path), 86400).orderBy("start_us").collect()
    assert [(r.start_us, r.quantity, r.open) for r in got] == [(1735689600_000_000, 10, 100), (1735776000_000_000, 20, Decimal("101.5"))]
    for change in ({"volume": [1]}, {"volume": [1.5, 2]}, {"volume": [True, 2]}, {"volume": [-1, 2]}):
        path.write_text(json.dumps(body | change))
        with pytest.raises(Exception):
            files.historical_json(spark, str(path), 86400).collect()


def test_packets(spark):
    quote = struct.pack("<BhBi", 4, 50, 1, 77) + struct.pack("<fhififiii", 101.2, 5, 1_754_452_800, 100.0, 900, 1.0, 2, 3, 4)[:0] + struct.pack("<f h i f i i i f f f f", 101.25, 5, 1_754_452_800, 100.0, 900, 1, 2, 100.0, 101.0, 102.0, 99.0)
    full = struct.pack("<f h i f i i i i i i f f f f", 10.5, 1, 1_754_452_800, 10.0, 5, 1, 1, 0, 0, 0, 0, 0, 0, 0) + b"".join(struct.pack("<i i h h f f", 10 + i, 20 + i, 1, 1, 10.0 - i, 11.0 + i) for i in range(5))
    full = struct.pack("<BhBi", 8, 8 + len(full), 2, 5) + full
    gone = struct.pack("<BhBih", 50, 10, 0, 0, 805)
    frame = spark.createDataFrame([(1, bytearray(quote)), (2, bytearray(full)), (3, bytearray(gone)), (4, bytearray(quote[:-1])), (5, bytearray(b""))], "arrival long, packet binary")
    got = {r.arrival: r for r in packets.decode(frame).collect()}
    assert got[1].fault is None and got[1].tick.last_price == Decimal("101.25") and got[1].tick.session_ohlc.high == 102 and got[1].quote is None
    assert got[2].tick.session_ohlc is None and got[2].quote.bid_price == 10 and len(got[2].depth.asks) == 5
    assert got[3].code == 50 and got[3].fault is None and got[4].fault and got[5].fault
    assert got[2].depth.asks[4].asDict() == {"price": Decimal(15), "quantity": 24} and got[2].quote.ask_quantity == 20 and got[1].depth is None
    # prices are the shortest text of the float, whatever its size; a batch may hold each kind of packet, or none
    odd = [0.1, 100.05, 16777217.0, 1e-7, 3.0e8, 7.5e-5]
    bodies = [(k, bytearray(struct.pack("<BhBi", 4, 50, 1, 7) + struct.pack("<f h i f i i i f f f f", v, 1, 1_754_452_800, v, 1, 1, 1, 0, 0, 0, 0))) for k, v in enumerate(odd)]
    more = packets.decode(spark.createDataFrame([*bodies, (90, None), (91, bytearray(b"\xff\x00"))], "arrival long, packet binary").coalesce(1))
    told = {r.arrival: r for r in more.collect()}
    assert [told[k].tick.last_price for k in range(len(odd))] == [Decimal(str(struct.unpack("<f", struct.pack("<f", v))[0])).quantize(Decimal(1).scaleb(-18)) for v in odd]
    assert told[90].fault == "empty" and told[91].fault == "unknown code" and told[0].tick.session_ohlc is None


def test_html_calendar(spark):
    page = "<table><tr><th>x</th></tr></table><table><tr><th>Date</th><th>Segment</th><th>Status</th><th>Timings</th></tr>%s</table>"
    row = "<tr><td>%s</td><td>%s</td><td>%s</td><td>%s</td></tr>"
    good = page % (row % ("2026-11-08", "NSE Equity", "Muhurat", "18:00 – 19:15") + row % ("2026-01-26", "NSE", "Closed", "") + row % ("2026-01-27", "MCX", "odd", ""))
    twice = page % (row % ("2026-01-26", "NSE", "Closed", "") * 2)
    frame = spark.createDataFrame([(1, good), (2, twice), (3, "<p>none</p>"), (4, None)], "page_id long, html string")
    got = {r.page_id: r for r in html_calendar.observe(frame).collect()}
    assert [(d.trading_date, d.status) for d in got[1].dates] == [(date(2026, 1, 26), "CLOSED"), (date(2026, 11, 8), "OPEN")]
    assert got[1].dates[1].intervals[0].asDict() == {"a": 64800, "b": 69300}
    assert all(got[k].fault and not got[k].dates for k in (2, 3, 4))


def test_calendar_dataset(spark, tmp_path):
    body = {"coverage_start": "2026-01-01", "coverage_end": "2026-12-31", "closed_dates": ["2026-01-26"], "open_sessions": ["2026-02-01"], "session_overrides": [{"trading_date": "2026-02-01", "intervals": [{"start": "09:15", "end": "15:30"}]}], "provenance": [{"fact": "closed 2026-01-26, open 2026-02-01"}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(body))
    made = files.calendar_dataset(spark, str(path))
    assert made.is_trading_day(date(2026, 2, 1)) and not made.is_trading_day(date(2026, 1, 26))
    path.write_text(json.dumps(body | {"provenance": []}))
    with pytest.raises(ValueError):
        files.calendar_dataset(spark, str(path))


def test_queries_match_their_sql(spark):
    import duckdb

    from tideline.plans.queries import ORACLES, QUERIES

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")

    def plain(frame):
        frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
        return sorted(tuple("~" if x is None else f"{float(x):.6f}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False, name=None))

    for name, sql in ORACLES.items():
        assert plain(QUERIES[name](spark, sf).toPandas()) == plain(con.execute(sql).df()), name


def test_validation_judges_every_event(spark):
    import duckdb

    from tideline.plans.queries import ORACLES, QUERIES

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    for name in ("validate_events", "version_stamping"):
        got = QUERIES[name](spark, sf)
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()), name
    judged = {r.arrival for r in QUERIES["validate_events"](spark, sf).collect()}
    assert {2 * a for (a,) in con.execute("select event_id from events").fetchall()} <= judged


def test_lifecycle_and_snapshot_service(spark, tmp_path):
    from tideline.plans import service

    commands = ["pause", "start", "mark_running", "pause", "stop", "start", "mark_error", "force_stop"]
    frame = spark.createDataFrame([("s", i, c) for i, c in enumerate(commands)], "strategy_id string, arrival long, command string")
    got = [(r.after, r.allowed) for r in evaluation.lifecycle(frame).orderBy("arrival").collect()]
    assert got == [("REGISTERED", False), ("STARTING", True), ("RUNNING", True), ("PAUSED", True), ("STOPPED", True), ("STARTING", True), ("ERROR", True), ("STOPPED", True)]
    with pytest.raises(service.Unavailable):
        service.read_snapshot(spark, None, "narrow_cpr")
    with pytest.raises(service.UnknownStrategy):
        service.read_snapshot(spark, str(tmp_path), "nothing")
    assert service.read_snapshot(spark, str(tmp_path), "narrow_cpr") is None
    results = strategies.evaluate(strategies.CATALOG["narrow_cpr"], sessions_of(spark, ("100", "140", "36", "124"), ("100", "140", "56", "104"), ("100", "140", "48", "112")))
    results = results.withColumns({"exchange": F.lit("X"), "symbol": F.col("instrument")})
    evaluation.rank_candidates(results, "cpr_width_pct").write.parquet(str(tmp_path / "narrow_cpr" / "ranked"))
    evaluation.snapshot_header(results, "cpr_width_pct", results).write.parquet(str(tmp_path / "narrow_cpr" / "header"))
    read = service.read_snapshot(spark, str(tmp_path), "narrow_cpr", 2)
    assert [(c["instrument"], c["rank"]) for c in read.candidates] == [("S1", 1), ("S2", 2)] and read.header["eligible"] == 3 and read.header["completeness"] == "COMPLETE"


@pytest.mark.parametrize(("rows", "want"), [
    ([("2026-01-26", "equity derivatives", "Closed", "")], None),
    ([("2026-01-26", "NSE Equity & Currency", "Closed", "")], [("CLOSED", [])]),
    ([("2026-01-26", "Currency", "odd", "")], []),
    ([("2026-01-26", "NSE", "Open", " ; ")], None),
    ([("2026-01-26", "NSE", "Open", "")], [("OPEN", [])]),
    ([("2026-01-26", "NSE", "Closed")], [("CLOSED", [])]),
    ([("2026-01-26", "NSE", "Open")], None),
    ([("2026-01-26", "NSE", "Open", "09:15-10:00; 11:30-12:30")], [("OPEN", [(33300, 36000), (41400, 45000)])]),
    ([("2026-01-26", "NSE", "Open", "10:00-09:15")], None),
    ([("2026-01-26", "somewhere", "Closed", "")], None),
])
def test_holiday_rows_fail_closed(rows, want):
    head = "<tr><td>Date</td><th>Segment</th><th>Status</th><th>Timings</th></tr>"
    page = f"<table>{head}{''.join('<tr><th>%s</th>' % r[0] + ''.join('<td>%s</td>' % c for c in r[1:]) + '</tr>' for r in rows)}</table>"
    if want is None:
        with pytest.raises(html_calendar.Unsure):
            html_calendar.read_page(page)
    else:
        assert [(s, i) for _, s, i in html_calendar.read_page(page)] == want


def test_lookback_checks_every_special_date():
    """A special date without times fails wherever the walk meets it: beyond the first span, and among the margin days."""
    short, bare = date(2026, 2, 1), date(2026, 1, 31)
    made = cal.Calendar(date(2026, 1, 1), date(2026, 2, 28), open_sessions=frozenset({short, bare}), overrides={short: ((33300, 33600),)})
    with pytest.raises(cal.MissingTimingError):
        made.lookback_window(date(2026, 2, 2), 10, 300, margin=0)
    with pytest.raises(cal.MissingTimingError):
        made.lookback_window(date(2026, 2, 2), 1, 300, margin=1)
    both = cal.Calendar(made.start, made.end, open_sessions=made.open_sessions, overrides={short: ((33300, 33600),), bare: ((33300, 36000),)})
    assert both.lookback_window(date(2026, 2, 2), 10, 300, margin=0) == [bare, short]
    assert both.lookback_window(date(2026, 2, 2), 10, 300) == [date(2026, 1, 30), bare, short]
    assert both.lookback_window(date(2026, 2, 2), 2) == [bare, short]


def test_relative_range_says_why_it_skips(spark):
    p = "decimal(12,4)"
    rows = [(n, d, Decimal(o), Decimal(110), Decimal(100 if n != "FLAT" else 110), Decimal(105)) for n, o, k in (("GOOD", 100, 21), ("SHORT", 100, 20), ("FLAT", 100, 21), ("ZERO", 0, 21)) for d in range(k)]
    daily = spark.createDataFrame(rows, f"instrument string, back int, open {p}, high {p}, low {p}, close {p}").withColumn("trading_date", F.date_sub(F.lit("2026-03-31").cast("date"), F.col("back"))).drop("back")
    days = spark.range(40).select(F.date_add(F.lit("2026-03-01").cast("date"), F.col("id").cast("int")).alias("trading_date"), (F.col("id") + 1).cast("int").alias("number"))
    held = strategies.lookback(daily, days, 21, latest_only=False, short=True).where("trading_date = '2026-04-01'")
    got = {r.instrument: (r.status, r.reason) for r in strategies.evaluate(strategies.CATALOG["previous_session_relative_range"], held).collect()}
    assert got == {"GOOD": ("MATCHED", "VALID"), "SHORT": ("SKIPPED", "NO_HISTORY"), "FLAT": ("SKIPPED", "DEGENERATE_BASELINE"), "ZERO": ("ERROR", "NO_OPEN")}


def test_a_row_that_fails_stops_no_other(spark):
    frame = sessions_of(spark, ("100", "120", "110", "115"), ("0", "120", "110", "115"))
    got = {r.instrument: r.status for r in strategies.evaluate(strategies.CATALOG["previous_session_range_pct"], frame).collect()}
    assert got == {"S0": "MATCHED", "S1": "ERROR"}


def test_error_runs_over_blocks(spark):
    rng, rows, want = random.Random(11), [], {}
    for s in range(3):
        failures, stuck = 0, False
        for n in range(200):
            failed = rng.random() < (0.3, 0.7, 0.95)[s]
            failures = failures + 1 if failed else 0
            stuck = stuck or failures >= 4
            rows.append((f"s{s}", n * 3, failed))
            want[f"s{s}", n * 3] = (failures, stuck)
    frame = spark.createDataFrame(rows, "strategy_id string, arrival long, failed boolean")
    for block in (7, 30, 1 << 16):
        assert {(r.strategy_id, r.arrival): (r.failures, r.in_error) for r in evaluation.error_lifecycle(frame, 4, block).collect()} == want, block


def test_a_clean_start_can_be_stopped(spark):
    rows = [("a", 0, "start", None), ("a", 1, "force_stop", False), ("a", 2, "force_stop", True), ("b", 0, "force_stop", True), ("b", 1, "start", None), ("b", 2, "mark_running", None), ("b", 3, "force_stop", True)]
    frame = spark.createDataFrame(rows, "strategy_id string, arrival long, command string, clean boolean")
    got = {(r.strategy_id, r.arrival): (r.command, r.after, r.allowed) for r in evaluation.lifecycle(frame, "clean").collect()}
    assert got["a", 1] == ("force_stop", "STARTING", False) and got["a", 2] == ("force_stop", "STOPPED", True)
    assert got["b", 0] == ("force_stop", "REGISTERED", False) and got["b", 3] == ("force_stop", "STOPPED", True)


EVENT = "instrument string, arrival long, kind string, ts_us long, trading_date string, open_us long, close_us long, price decimal(12,4), cum long, at timestamp"


def feed(spark, folder, *files):
    for rows in files:
        data = [(i, n, kind, OPEN + int(m * MINUTE), str(DAY), OPEN, CLOSE, None if p is None else Decimal(p), None) for i, n, kind, m, p in rows]
        spark.createDataFrame(data, EVENT.replace(", at timestamp", "")).withColumn("at", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, rows, name, tmp_path):
    q = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_stream_candles_by_timeframe_with_flush(spark, tmp_path):
    """Timeframes don't mix; a flush event gives out what is over, and what comes late for it is dropped."""
    folder = str(tmp_path / "in")
    feed(spark, folder, [("A", 1, "tick", 0.2, "10.05"), ("A", 2, "tick", 0.7, "11"), ("A", 3, "tick", 1.5, "9.9999"), ("B", 4, "tick", 0.1, "5")], [("A", 5, "tick", 4.9, "8"), ("A", 6, "flush", 5.0, None), ("B", 6, "flush", 5.0, None), ("A", 7, "tick", 4.95, "1")])
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    got = streamed(spark, processors.candles(processors.fan_out(events, [60, 300])), "by_timeframe", tmp_path)
    told = sorted((r.instrument, r.tf, r["index"], r.ticks, str(r.open), str(r.close)) for r in got)
    assert told == [
        ("A", 60, 0, 2, "10.0500", "11.0000"), ("A", 60, 1, 1, "9.9999", "9.9999"), ("A", 60, 4, 1, "8.0000", "8.0000"), ("A", 300, 0, 4, "10.0500", "8.0000"),
        ("B", 60, 0, 1, "5.0000", "5.0000"), ("B", 300, 0, 1, "5.0000", "5.0000"),
    ]


def test_stream_candles_flush_by_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [("A", 1, "tick", 0.2, "10")], [("B", 2, "tick", 3.2, "20")], [("B", 3, "tick", 3.4, "21")])
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("at", "0 seconds")
    got = streamed(spark, processors.candles(processors.fan_out(events, [60]), flush=True), "by_watermark", tmp_path)
    assert [(r.instrument, r["index"], r.ticks) for r in got] == [("A", 0, 1)]


def test_feed_wide_events_reach_every_series(spark):
    loss = spark.createDataFrame([(1, "loss")], "arrival long, kind string")
    assert sorted((r.instrument, r.tf) for r in processors.per_series(loss, ["b", "a", "a"], [60, 300]).collect()) == [("a", 60), ("a", 300), ("b", 60), ("b", 300)]
    with pytest.raises(ValueError):
        processors.per_series(loss, [str(i) for i in range(processors.MOST_SERIES)], [1, 2])


def test_snapshots_outlive_silent_batches(spark, tmp_path):
    from tideline.plans import service
    from tideline.streaming import snapshots

    schema = "arrival long, strategy_id string, strategy_version string, config_version string, instrument string, exchange string, symbol string, context_version long, trading_date date, status string, cpr_width_pct double"
    row = lambda n, i, v, status="MATCHED", version="1", context=1, day=DAY, strategy="narrow_cpr": (n, strategy, version, "1", i, "X", i, context, day, status, v)
    files_ = [
        [row(1, "A", 3.0), row(2, "B", 1.0), row(3, "zz", 0.1)],
        [row(4, "C", 2.0), row(5, "B", 9.0, context=1), row(6, "A", 0.5, version="2"), row(7, "A", 0.7, strategy="other")],
        [row(8, "B", None, "NO_MATCH", context=2), row(9, "C", None, "ERROR", context=3)],
    ]
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    universe_ = spark.createDataFrame([(x,) for x in "ABCD"], "instrument string")
    seen = []
    for k, rows in enumerate(files_):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        snapshots.keep(stream, [strategies.CATALOG["narrow_cpr"]], universe_, folder, str(tmp_path / "c")).awaitTermination()
        read = service.read_snapshot(spark, folder, "narrow_cpr")
        seen.append(([(c["instrument"], float(c["cpr_width_pct"])) for c in read.candidates], read.header["evaluated"], read.header["expected"], read.header["completeness"]))
    assert seen == [([("B", 1.0), ("A", 3.0)], 2, 4, "PARTIAL"), ([("B", 1.0), ("C", 2.0), ("A", 3.0)], 3, 4, "PARTIAL"), ([("C", 2.0), ("A", 3.0)], 3, 4, "PARTIAL")]
    held = snapshots.versions(spark, f"{folder}/narrow_cpr")
    snapshots.merge(spark.createDataFrame([row(99, "D", 7.0)], schema), strategies.CATALOG["narrow_cpr"], universe_, folder, held[-1])
    assert snapshots.versions(spark, f"{folder}/narrow_cpr") == held and len(service.read_snapshot(spark, folder, "narrow_cpr").candidates) == 2
    fresh = [row(20, "D", 4.0, day=date(2026, 8, 7), version="2")]
    snapshots.merge(spark.createDataFrame(fresh, schema), strategies.CATALOG["narrow_cpr"], universe_, folder, held[-1] + 5)
    assert [c["instrument"] for c in service.read_snapshot(spark, folder, "narrow_cpr").candidates] == ["D"]


def test_live_packets_reach_their_consumers(spark, tmp_path):
    from tideline.sources import live

    raw = spark.createDataFrame([(n, n % 3, 1_786_000_000 + n, 10.5 + n, 7) for n in range(12)], "arrival long, user_id long, at long, value double, k int")
    folder = str(tmp_path / "in")
    for part in ("arrival < 6", "arrival >= 6"):
        packets.encode_quotes(raw.where(part)).coalesce(1).write.mode("append").parquet(folder)
    reference = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "segment_code int, security_id long, instrument string")
    events = live.packet_stream(spark, folder, reference, 1)
    got = {}

    def deliver(name, batch, number):
        got[name, number] = sorted((r.instrument, r.arrival, r.kind) for r in batch.collect())

    wants = {"both": live.Subscription(frozenset("AB"), frozenset({"tick"})), "one": live.Subscription(frozenset("B"), frozenset({"tick", "quote"})), "none": live.Subscription(frozenset("A"), frozenset({"depth"}))}
    live.fan_out(events, wants, deliver, str(tmp_path / "c")).awaitTermination()
    flat = {name: sorted(x for (n, _), rows in got.items() if n == name for x in rows) for name in wants}
    assert flat["both"] == sorted((i, n, "tick") for k, i in ((0, "A"), (1, "B")) for n in range(k, 12, 3))
    assert flat["one"] == [x for x in flat["both"] if x[0] == "B"] and flat["none"] == []
    assert live.union_of(wants.values()) == live.Subscription(frozenset("AB"), frozenset({"tick", "quote", "depth"}))
    with pytest.raises(ValueError):
        live.Subscription(frozenset(), frozenset({"news"}))


def test_requests_and_range_edges(spark):
    day = 86_400_000_000
    needs = spark.createDataFrame([("A", 300, 0, 181 * day), ("B", 86_400, 0, 500 * day), ("C", 300, 5, 5), ("D", 60, 0, 90 * day)], "instrument string, seconds int, start_us long, end_us long")
    got = sorted((r.instrument, r.endpoint, r.start_us // day, r.end_us // day) for r in history.fetch_requests(needs).collect())
    assert got == [("A", "intraday", 0, 90), ("A", "intraday", 90, 180), ("A", "intraday", 180, 181), ("B", "daily", 0, 500), ("D", "intraday", 0, 90)]
    with pytest.raises(Exception, match="no endpoint"):
        history.fetch_requests(needs.withColumn("seconds", F.lit(7))).collect()


def test_prices_are_never_rounded(spark, tmp_path):
    body = {c: ["123456789.12345678", "1.5"] for c in ("open", "high", "low", "close")} | {"volume": [1, 2], "timestamp": [1735689600, 1735776000]}
    path = tmp_path / "h.json"
    path.write_text(json.dumps(body).replace('"123456789.12345678"', "123456789.12345678").replace('"1.5"', "1.5"))
    assert [str(r.open) for r in files.historical_json(spark, str(path), 86400).orderBy("start_us").collect()] == ["123456789.12345678", "1.50000000"]
    path.write_text(json.dumps(body).replace('"123456789.12345678"', "1.123456789").replace('"1.5"', "1.5"))
    with pytest.raises(Exception, match="isn't a price"):
        files.historical_json(spark, str(path), 86400).collect()


def test_a_timeframe_as_long_as_the_session_fails(spark):
    rows = ticks_of(spark, [("A", 0, 100, 1000)])
    with pytest.raises(Exception, match="shorter than the session"):
        candles.ohlc(rows, [(CLOSE - OPEN) // 1_000_000]).collect()
    assert candles.ohlc(rows, [0, 300]).count() == 2


def test_session_prices_by_request(spark):
    body = json.dumps({"status": "success", "data": {"S": {"1": {"ohlc": {"open": 10.5, "high": 11, "low": 10, "close": 10.25}}, "2": {"ohlc": {"open": 0, "high": 0, "low": 0, "close": 0}}, "3": {"ohlc": {"open": 1.123456789, "high": 2, "low": 1, "close": 1}}}}})
    asked = spark.createDataFrame([("S", "1", 0), ("S", "2", 1), ("S", "3", 2), ("S", "9", 3)], "exchange_segment string, security_id string, place int")
    got = files.session_ohlc_json(spark.createDataFrame([(body,)], "body string"), asked).collect()
    assert [(r.security_id, r.place, str(r.open)) for r in got] == [("1", 0, "10.50000000")]
    with pytest.raises(Exception, match="batch failed"):
        files.session_ohlc_json(spark.createDataFrame([(body.replace("success", "failure"),)], "body string"), asked).collect()


def test_a_universe_of_none_is_no_failure_of_its_query(spark, tmp_path):
    """Parts of which no underlying resolves give no rows, as the SQL does; the operator itself still refuses them."""
    from tideline.plans import queries

    spark.range(1, 4).select((F.col("id") * 36).alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    resolved = queries.universe_resolution(spark, str(tmp_path))
    assert {r.status for r in resolved.collect()} == {"MISMATCHED"}
    assert queries.finalized_universe(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="empty"):
        universe.finalize_universe(resolved)


def against_sql(spark, folder, values, *names):
    """The queries of these names over events made of values (user, day, prices in order), row by row as their SQL gives them."""
    import duckdb

    from tideline.plans.queries import ORACLES, QUERIES

    rows = [(user, day, i, float(price)) for user, day, prices in values for i, price in enumerate(prices)]
    made = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "event_id long, user_id long, day int, place int, value double")
    ts = F.timestamp_seconds(1704067200 + F.col("day") * 86400 + F.col("place") * 60).cast("timestamp_ntz").alias("ts")
    made.select("event_id", ts, "user_id", F.lit("click").alias("event_type"), "value", F.lit('{"k": 7}').alias("props")).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    for name in names:
        got = QUERIES[name](spark, str(folder))
        want = con.execute(f"select {', '.join(map(json.dumps, got.columns))} from ({ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name


def test_packets_of_a_price_of_zero_say_what_they_said(spark, tmp_path):
    against_sql(spark, tmp_path, [(0, 0, (0, 1.5)), (1, 0, (0.01,))], "packet_decode")
    layout = packets.LAYOUTS[4]
    x = np.zeros(1, layout)
    x["code"], x["length"], x["segment"], x["security_id"], x["time"] = 4, layout.itemsize, 1, 5, 9
    (row,) = packets.decode(spark.createDataFrame([(1, bytearray(x.tobytes()))], "arrival long, packet binary")).collect()
    assert (row.fault, row.tick, row.ts_us, tuple(row.refused)) == ("bad values", None, None, (9_000_000, 0.0, 0))


def odd_sessions():
    """Sessions of 22 days: prices of 0 to open with, throughout and among the others, and shares that are equal but for their doubles."""
    rng = random.Random(5)
    for user in range(40):
        for day in range(22):
            prices = [rng.choice((0.1, 0.3, 0.7, 1.1, 2.3, 4.1, 5.7)) * rng.choice((1, 1, 2, 3, 7)) for _ in range(rng.randint(1, 4))]
            prices = [round(p, 2) for p in prices]
            zero = {0: [0, 0], 1: [0, 2.5], 2: [0, *prices] if day == 4 else prices, 3: [0] if day > 9 else prices, 4: [0, 1] if day == 20 else prices}
            yield user, day, zero.get(user, prices)


def test_scans_place_sessions_of_zero_prices_as_their_sql(spark, tmp_path):
    against_sql(spark, tmp_path, odd_sessions(), "scan_body_pct", "scan_narrow_cpr", "scan_narrow_cpr_threshold", "scan_range_pct", "scan_top_n")


def test_relative_ranges_over_zero_prices_as_their_sql(spark, tmp_path):
    against_sql(spark, tmp_path, odd_sessions(), "scan_relative_range")


def test_headers_count_sessions_of_zero_prices_as_their_sql(spark, tmp_path):
    against_sql(spark, tmp_path, odd_sessions(), "scanner_snapshot_header")
