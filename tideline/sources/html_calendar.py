"""Holiday tables of HTML pages as observed calendar dates; a page that can't be read surely gives a fault and no date."""

from __future__ import annotations

import re
from datetime import date
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: How pages name columns, segments and statuses.
DATE_NAMES = {"date", "trading date", "holiday date"}
SEGMENT_NAMES = {"segment", "exchange", "exchange segment", "exchange/segment", "market"}
STATUS_NAMES = {"status", "type"}
TIMING_NAMES = {"timings", "timing", "session timings", "hours", "session hours"}
EQUITY = {"nse", "nse eq", "nse_eq", "nse equity", "nse cm", "nse cash", "capital market", "equity"}
#: Of NSE segments by longer names, what marks equity.
EQUITY_PARTS = ("equity", "cash", " eq", "capital market")
OTHER_PARTS = ("mcx", "currency", "cds", "clearing", "bse", "commodity")
CLOSED = {"closed", "close", "holiday", "trading holiday"}
OPEN = {"open", "muhurat", "muhurat trading", "special", "special session", "live", "live session"}
SPAN = re.compile(r"(\d{1,2}):(\d{2})\s*[-–—]\s*(\d{1,2}):(\d{2})")


class _Tables(HTMLParser):
    """Tables of rows of (is header, text)."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[tuple[bool, str]]]] = []
        self.cell: list[str] | None = None
        self.header = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell, self.header = [], tag == "th"

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append((self.header, " ".join("".join(self.cell).split())))
            self.cell = None


class Unsure(ValueError):
    """The page doesn't say for sure."""


def _spans(text: str) -> list[tuple[int, int]]:
    """The spans of a timings cell; none of an empty one. A cell of separators alone says nothing for sure."""
    out = []
    parts = [p.strip() for p in re.split("[;,]", text)]
    if text.strip() and not any(parts):
        raise Unsure(f"timing {text!r}")
    for part in filter(None, parts):
        m = SPAN.fullmatch(part)
        if not m:
            raise Unsure(f"timing {part!r}")
        a, b, c, d = map(int, m.groups())
        if max(a, c) > 23 or max(b, d) > 59 or (a, b) >= (c, d):
            raise Unsure(f"timing {part!r}")
        out.append((a * 3600 + b * 60, c * 3600 + d * 60))
    return out


def _of_equity(segment: str) -> bool:
    """Whether a segment is NSE equity; False for others that are known. NSE equity is asked first: its names may hold others' words."""
    if segment in EQUITY or ("nse" in segment and any(p in segment for p in EQUITY_PARTS)):
        return True
    if any(p in segment for p in OTHER_PARTS):
        return False
    raise Unsure(f"segment {segment!r}")


def read_page(html: str) -> list[tuple[date, str, list[tuple[int, int]]]]:
    """(date, OPEN or CLOSED, intervals in seconds) of the first table with date, segment and status columns; raises Unsure."""
    parser = _Tables()
    parser.feed(html)
    for table in parser.tables:
        rows = [r for r in table if r]
        if not rows:
            continue
        top = next((r for r in rows if any(header for header, _ in r)), rows[0])
        names = [text.lower() for _, text in top]
        place = [next((i for i, n in enumerate(names) if n in wanted), None) for wanted in (DATE_NAMES, SEGMENT_NAMES, STATUS_NAMES, TIMING_NAMES)]
        if None in place[:3]:
            continue
        found: dict[date, tuple[str, list]] = {}
        for row in (r for r in rows if r is not top):
            if len(row) <= max(place[:3]):
                raise Unsure("short row")
            segment, status = row[place[1]][1].lower(), row[place[2]][1].lower()
            if not _of_equity(segment):
                continue
            if status not in OPEN | CLOSED:
                raise Unsure(f"status {status!r}")
            timed = status in OPEN and place[3] is not None
            if timed and len(row) <= place[3]:
                raise Unsure("no timings cell")
            try:
                day = date.fromisoformat(row[place[0]][1])
            except ValueError as error:
                raise Unsure("date") from error
            if day in found:
                raise Unsure(f"{day} twice")
            spans = _spans(row[place[3]][1]) if timed else []
            found[day] = ("OPEN" if status in OPEN else "CLOSED", spans)
        return [(d, s, i) for d, (s, i) in sorted(found.items())]
    raise Unsure("no holiday table")


def observe(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) as page_id, fault, dates: array of (trading_date, status, intervals)."""
    kind = pa.list_(pa.struct([("trading_date", pa.date32()), ("status", pa.string()), ("intervals", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))

    def run(batches):
        for batch in batches:
            faults, dates = [], []
            for html in batch.column(1).to_pylist():
                try:
                    told = read_page(html or "")
                    dates.append([{"trading_date": d, "status": s, "intervals": [{"a": a, "b": b} for a, b in i]} for d, s, i in told])
                    faults.append(None)
                except Unsure as error:
                    dates.append([])
                    faults.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(faults, pa.string()), pa.array(dates, kind)], names=["page_id", "fault", "dates"])

    schema = "page_id long, fault string, dates array<struct<trading_date:date,status:string,intervals:array<struct<a:int,b:int>>>>"
    return pages.selectExpr("cast(page_id as long) page_id", "html").mapInArrow(run, schema)
