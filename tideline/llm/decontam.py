"""Benchmark decontamination by Wu-Manber search over word symbols."""

from __future__ import annotations

import hashlib
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stored, append_arrow, held_by_worker, quoted

WINDOW = 13
#: Most bytes of benchmark text that a worker holds patterns of (some 60 bytes a byte); a larger benchmark is searched in blocks, one after the other.
BLOCK_BYTES = 4 << 20
#: ASCII letters are lowered, digits and bytes of other characters stay, all else parts words.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class WuManber:
    """Finds every occurrence of word tuples, each a stretch (item, start, length) of the items' words.

    Blocks of up to 3 words index the table. It says how far the search may jump; where it may not, it holds the
    bucket of the patterns whose first m words end in the block (m: the shortest length), and each is compared with the text.
    """

    def __init__(self, items: list[list[bytes]], patterns: list[tuple[int, int, int]]):
        self.items, self.patterns = items, patterns
        self.m = min(n for *_, n in patterns)
        self.size = min(3, self.m)
        self.far = self.m - self.size + 1
        self.table: dict[tuple[bytes, ...], int | list[int]] = {}
        for k, (item, start, _) in enumerate(patterns):
            words = items[item]
            for end in range(self.size, self.m + 1):
                block = tuple(words[start + end - self.size : start + end])
                held = self.table.get(block, self.far)
                if end == self.m:
                    if isinstance(held, list):
                        held.append(k)
                    else:
                        self.table[block] = [k]
                elif not isinstance(held, list) and self.m - end < held:
                    self.table[block] = self.m - end

    def search(self, words: list[bytes]):
        """Yields (start, length, number of the pattern) of each occurrence."""
        table, far, size, items, patterns = self.table.get, self.far, self.size, self.items, self.patterns
        at, end = self.m, len(words)
        while at <= end:
            found = table(tuple(words[at - size : at]), far)
            if found.__class__ is int:
                at += found
                continue
            start = at - self.m
            for k in found:
                item, first, length = patterns[k]
                if words[start : start + length] == items[item][first : first + length]:
                    yield start, length, k
            at += 1


class Matcher:
    """The windows of some items, whole ones and those of items that are shorter apart, and which items each stands in."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        pool: dict[bytes, bytes] = {}
        words = [[pool.setdefault(w, w) for w in words_of(text)] for _, text in items]
        groups: tuple[list, list] = ([], [])
        self.names: tuple[list, list] = ([], [])
        first: dict[tuple[int, int], list[int]] = {}
        for i, own in enumerate(words):
            for start in range(max(1, len(own) - window + 1) if own else 0):
                length = min(window, len(own))
                short = length < window
                piece = own[start : start + length]
                alike = first.setdefault((length, hash(tuple(piece))), [])
                for k in alike:
                    item, at, _ = groups[short][k]
                    if words[item][at : at + length] == piece:
                        held = self.names[short][k]
                        if isinstance(held, str):
                            held = self.names[short][k] = {held}
                        held.add(items[i][0])
                        break
                else:
                    alike.append(len(groups[short]))
                    groups[short].append((i, start, length))
                    self.names[short].append(items[i][0])
        self.searches = [WuManber(words, g) if g else None for g in groups]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, length) of the windows that occur, and the items they stand in."""
        ranges, found = [], set()
        for search, names in zip(self.searches, self.names, strict=True):
            for start, length, k in search.search(words) if search else ():
                ranges.append((start, length))
                if isinstance(names[k], str):
                    found.add(names[k])
                else:
                    found |= names[k]
        return ranges, found


def covered(ranges: list[tuple[int, int]]) -> int:
    """How many positions lie in the union of (start, length) ranges."""
    total = reach = 0
    for start, length in sorted(ranges):
        total += max(0, start + length - max(start, reach))
        reach = max(reach, start + length)
    return total


_FOUND = "n_words long, n_hit long, n_items long, item_ids array<string>, contaminated boolean"


def _found(rows: list[tuple[int, list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
    """The columns of _FOUND from each text's number of words, hit ranges and sorted items."""
    n, hit = [x[0] for x in rows], [covered(x[1]) for x in rows]
    return [
        pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x[2]) for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.string())),
        pa.array([h > 0 and 20 * h >= m for h, m in zip(hit, n, strict=True)], pa.bool_()),
    ]


def _search(frame: DataFrame, text: str, block: DataFrame, window: int, keep: list[str], whole: bool) -> DataFrame:
    """frame's columns in keep and, if the block is the whole benchmark, those of _FOUND, else __hits and __items."""
    held = frame.sparkSession.sparkContext.broadcast([(r.item, bytes(r.text)) for r in block.toLocalIterator()])

    def make(token=uuid.uuid4().hex):
        matcher = held_by_worker(token, lambda: Matcher(held.value, window))

        def run(texts):
            out = []
            for data in texts.to_pylist():
                words = words_of(data or b"")
                ranges, names = matcher.find(words)
                out.append((len(words), ranges, sorted(names)))
            if whole:
                return _found(out)
            hits = [[x for r in ranges for x in r] for _, ranges, _ in out]
            return [pa.array(hits, pa.list_(pa.int32())), pa.array([names for *_, names in out], pa.list_(pa.string()))]

        return run

    return append_arrow(frame, [quoted(text).cast("binary")], _FOUND if whole else "__hits array<int>, __items array<string>", make, keep)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs plus n_words, n_hit, n_items (long), item_ids (sorted strings) and contaminated.

    A row whose words are hit by 1 in 20 or more is contaminated. Null and empty texts have no words and are
    clean; a null item has no window, a null item_id none either; repeated rows are judged alike; an empty
    benchmark hits nothing; an empty table gives no rows. Columns of docs with these names are replaced. The benchmark's text is measured
    first. Up to block_bytes it is broadcast and searched in one pass over docs; a larger one in blocks of about
    that size, one at a time, over a stored copy of the texts, and a row's hits are joined from the blocks.
    """
    spark = docs.sparkSession
    items = benchmark.select(quoted(item_id).cast("string").alias("item"), quoted(item_text).cast("binary").alias("text"))
    items = items.where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    shown = docs.columns if keep is None else keep
    if n_blocks == 1:
        return _search(docs, text, items, window, shown, True)
    new = {f.split()[0] for f in _FOUND.split(", ")}
    shown = [c for c in shown if c not in new]
    rows = Stored(docs.select(F.struct(*map(quoted, shown), F.lit(0).alias("__")).alias("d"), quoted(text).cast("binary").alias("t"), F.monotonically_increasing_id().alias("row"))).df
    parts = None
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        part = Stored(_search(rows, "t", block, window, ["row"], False).where(F.size("__hits") > 0)).df
        parts = part if parts is None else parts.unionByName(part)
    hits = parts.groupBy("row").agg(F.flatten(F.collect_list("__hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("items"))

    def make():
        def run(texts, hits, names):
            cells = zip(texts.to_pylist(), hits.to_pylist(), names.to_pylist(), strict=True)
            return _found([(len(words_of(t or b"")), list(zip((h or [])[::2], (h or [])[1::2], strict=True)), sorted(x or [])) for t, h, x in cells])

        return run

    joined = rows.join(hits, "row", "left")
    return append_arrow(joined, [F.col("t"), F.col("hits"), F.col("items")], _FOUND, make, ["d"]).select(
        *[F.col("d")[c].alias(c) for c in shown], *[f.split()[0] for f in _FOUND.split(", ")]
    )


def digest(found: DataFrame) -> DataFrame:
    """The item ids' SHA-256 in place of the list."""
    return found.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids")


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple:
    """What find_contamination and digest give for one text, by comparing all positions with all windows."""
    words, hit, names = words_of((text or "").encode()), set(), set()
    for item, passage in items:
        own = words_of((passage or "").encode())
        for i in range(max(1, len(own) - window + 1) if own else 0):
            piece = own[i : i + window]
            for at in range(len(words) - len(piece) + 1):
                if words[at : at + len(piece)] == piece:
                    hit.update(range(at, at + len(piece)))
                    names.add(item)
    sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(words)
