"""Packing documents into sequences by a configuration linear program over the length histogram."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Stored, append_arrow, held_by_worker, quoted

CAPACITY = 4096
END_ID = 1
#: How sharply prices answer to a class's lag.
ETA = 4.0
TOKENIZER = "word_bpe_49k.json"
#: Distinct words whose ids a worker remembers before it turns its memory over.
CACHE_WORDS = 200_000


#: What the tokenizer file's splitter keeps as pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Bytes as the byte-level alphabet writes them: printed ones as they are, the rest from U+0100 on.
_ALPHABET = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Words(dict):
    """Ids (little-endian uint32 bytes) by stretch between spaces; the tokenizer never joins across white space.

    A stretch that isn't known is normalised and split here and its pieces go to the tokenizer's model. One whose
    normal form depends on more than its characters, or that holds a character this Python doesn't know and the
    tokenizer may, goes through the whole tokenizer. Of the words, those used since the last turnover are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        self.former: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def __missing__(self, word: str) -> bytes:
        ids = self.former[0].get(word)
        if ids is None:
            ids = self.look_up(word)
        self[word] = ids
        return ids

    def look_up(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                low = word.lower()
                return self.tokenized(word) if low == word else self[low]
            if "<|" in word:
                return self.whole(word)
        elif not unicodedata.is_normalized("NFC", word) or "<|" in word or "Σ" in word or "İ" in word or any(unicodedata.category(c) == "Cn" for c in word):
            return self.whole(word)
        return b"".join(map(self.piece, _PIECES.findall(word.lower())))

    def piece(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():  # lowered already, so a word too
            return self[text]
        ids = self.pieces.get(text) or self.former[1].get(text) or self.tokenized(text)
        self.pieces[text] = ids
        return ids

    def tokenized(self, text: str) -> bytes:
        plain = text.isascii() and text.isprintable()
        found = self.model.tokenize(text if plain else text.encode().decode("latin-1").translate(_ALPHABET))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.former = (dict(self), self.pieces)
            self.pieces = {}
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces_of(docs: DataFrame, path: str, capacity: int, keep: list[str]) -> DataFrame:
    """A row per piece: keep, piece, start, length, ids_crc32, __part (the partition) and __rank (among the partition's pieces of that length)."""

    def make():
        words = held_by_worker(path, lambda: _Words(path))
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        part, seen = TaskContext.get().partitionId(), defaultdict(int)

        def numbered(piece):
            n = len(piece) // 4
            seen[n] += 1
            return {"n": n, "crc": zlib.crc32(piece), "part": part, "rank": seen[n] - 1}

        def run(texts):
            rows = []
            for text in texts.to_pylist():
                ids = words.encode(text or "") + end
                rows.append([numbered(ids[i : i + step]) for i in range(0, len(ids), step)])
            return [pa.array(rows, pa.list_(pa.struct([("n", pa.int64()), ("crc", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])))]

        return run

    # one operator of Python: a task of two would keep two workers, and so their memory
    cut = append_arrow(docs, [F.col("text")], "__pieces array<struct<n:bigint,crc:bigint,part:int,rank:bigint>>", make, keep)
    flat = cut.select(*map(quoted, keep), F.posexplode("__pieces").alias("piece", "__p"))
    return flat.select(
        *map(quoted, keep), "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("__p.n").alias("length"), F.col("__p.crc").alias("ids_crc32"),
        F.col("__p.part").alias("__part"), F.col("__p.rank").alias("__rank"),
    )


def price(weights: np.ndarray, capacity: int) -> list[int]:
    """The multiset of class sizes (1..len(weights)) of greatest weight that fits: an unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    sizes = np.flatnonzero(weights > 0) + 1
    gain = weights[sizes - 1]
    for room in range(1, capacity + 1):
        n = np.searchsorted(sizes, room, "right")
        if n:
            values = gain[:n] + best[room - sizes[:n]]
            k = int(values.argmax())
            best[room], took[room] = values[k], sizes[k]
        if best[room - 1] > best[room]:
            best[room], took[room] = best[room - 1], 0
    chosen, room = [], capacity
    while room > 0:
        if took[room]:
            chosen.append(int(took[room]))
            room -= int(took[room])
        else:
            room -= 1
    return chosen


def configurations(demand: np.ndarray, capacity: int, rounds: int, eta: float) -> dict[tuple[int, ...], float]:
    """Fractional multiplicities of configurations: multiplicative weights on the covering program.

    demand[k]: items of class size k+1. A class's price is its size (the dual of a program whose sequences are
    all full) times exp(eta * how far it lags behind the share of sequences made so far); the knapsack finds the
    configuration of greatest price, which is taken for 1/rounds of the sequences or till a class runs out.
    """
    sizes = np.arange(1, len(demand) + 1)
    least = float((demand * sizes).sum()) / capacity
    cover, x, done = np.zeros(len(demand)), defaultdict(float), 0.0
    share = np.zeros(len(demand))
    have = demand > 0
    for _ in range(2 * rounds):
        share[have] = cover[have] / demand[have]
        weight = np.where(have & (share < 1 - 1e-9), sizes * np.exp(np.clip(eta * (done / least - share), -30, 30)), 0.0)
        if done >= least or not weight.any():
            break
        chosen = price(weight, capacity)
        size, count = np.unique(chosen, return_counts=True)
        step = min(least / rounds, float(((demand - cover)[size - 1] / count).min()))
        x[tuple(chosen)] += step
        cover[size - 1] += step * count
        done += step
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = 8, rounds: int = 400) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: items in each}) that use up the histogram exactly.

    Classes of grain tokens keep the program small at every size of input. Configurations are rounded down and
    met with exact lengths (the fullest of a class first), one of them swapped for what fits tighter. What
    rounding leaves is dealt out by best fit decreasing, over the rooms of those and of new sequences, equal
    ones at a time: the work depends on the number of lengths and patterns, not of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    made: list = []

    def longest(top: int) -> int:
        """The longest length there is, of top at most; 0 if none."""
        found = np.flatnonzero(left[: top + 1])
        return int(found[-1]) if len(found) else 0

    def tighten(chosen: dict[int, int]) -> bool:
        """Swaps one length for a longer one, such that least room stays; whether there was one."""
        room = capacity - sum(k * v for k, v in chosen.items())
        best = (0, 0, 0)
        for k in chosen:
            found = np.flatnonzero(left[k + 1 : k + room + 1])
            for more in found[::-1] + 1:
                if left[k + more] > chosen.get(k + int(more), 0):
                    best = max(best, (int(more), k, k + int(more)))
                    break
        more, k, longer = best
        if more:
            chosen[k] -= 1
            if not chosen[k]:
                del chosen[k]
            chosen[longer] = chosen.get(longer, 0) + 1
        return more > 0

    def take(chosen: dict[int, int], most: int) -> int:
        """Takes as many of a sequence as there are items for, most at most."""
        times = min([most, *(int(left[k]) // v for k, v in chosen.items())])
        for k, v in chosen.items():
            left[k] -= times * v
        made.append([times, dict(chosen)])
        return times

    units = capacity // grain
    demand = np.zeros(units)
    for length in np.flatnonzero(left):
        demand[-(-int(length) // grain) - 1] += left[length]
    if demand.any():
        x = configurations(demand, units, rounds, ETA)
        for config, share in sorted(x.items(), key=lambda e: -e[1]):
            todo = int(share)
            while todo > 0:
                chosen: dict[int, int] = {}
                for size in config:
                    span = range(size * grain, (size - 1) * grain, -1)
                    fits = [k for k in span if left[k] > chosen.get(k, 0)]
                    if fits:
                        k = max(fits, key=lambda k: left[k] // (chosen.get(k, 0) + 1))
                        chosen[k] = chosen.get(k, 0) + 1
                if not chosen:
                    break
                while tighten(chosen):
                    pass
                todo -= take(chosen, todo)
    room_of = lambda chosen: capacity - sum(k * v for k, v in chosen.items())
    open_rows = sorted((room_of(m[1]), i) for i, m in enumerate(made))
    while top := longest(capacity):
        at = bisect_left(open_rows, (top, -1))
        if at == len(open_rows):  # none has room: new sequences, each as full of this length as it gets
            each = min(capacity // top, int(left[top]))
            take({top: each}, int(left[top]) // each)
            insort(open_rows, (capacity - each * top, len(made) - 1))
            continue
        room, i = open_rows.pop(at)
        times, chosen = made[i]
        each = max(1, min(room // top, int(left[top]) // times))
        n = min(times, int(left[top]) // each)
        left[top] -= n * each
        grown = chosen | {top: chosen.get(top, 0) + each}
        if n < times:
            made[i][0] -= n
            insort(open_rows, (room, i))
            made.append([n, grown])
            i = len(made) - 1
        else:
            made[i][1] = grown
        insort(open_rows, (room - each * top, i))
    made = [(n, chosen) for n, chosen in made]
    return made


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, keep: list[str] | None = None) -> DataFrame:
    """A row per piece of a document: keep (default doc_id), piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone; repeated rows are packed each; an empty table gives
    no rows; other columns play no part. The driver sees the histogram of lengths only (capacity numbers) and
    sends back the plan, of a few thousand patterns at any size of input. A piece finds its place by its rank
    among those of its length, which is counted within partitions and offset by the partitions before.
    """
    keep = ["doc_id"] if keep is None else keep
    path = path or public_tokenizers.path(TOKENIZER)
    stored = Stored(pieces_of(docs, path, capacity, keep)).df
    counts = Stored(stored.groupBy("length", "__part").agg(F.count("*").alias("__n"))).df
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # by length: items before, first sequence, items in each, offset
    used, sequences = defaultdict(int), 0
    for times, chosen in plan(histogram, capacity):
        offset = 0
        for length, n in chosen.items():
            slots[length].append((used[length], sequences, n, offset))
            used[length] += times * n
            offset += length * n
        sequences += times
    held = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})

    def place():
        table = held.value

        def run(lengths, ranks):
            length, rank = lengths.to_numpy(), ranks.to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = table[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                k = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + k // row[:, 2]
                offset[own] = row[:, 3] + k % row[:, 2] * n
            return [pa.array(sequence), pa.array(offset)]

        return run

    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    # as many rows as lengths met in all partitions: too many to broadcast in the long run
    ranked = stored.join(offsets.hint("merge"), ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    shown = [*keep, "piece", "start", "length", "ids_crc32"]
    return append_arrow(ranked, [F.col("length"), F.col("__rank")], "sequence_id long, offset long", place, shown)
