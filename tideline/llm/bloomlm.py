"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tideline.llm.common import ROWS_AT_ONCE, Stored, quoted

#: The end token; a word can't hold white space, so none equals it.
END = b"\n"
#: Base of the count levels: level q stands for counts from BASE ** (q - 1) on.
BASE = 1.5
HASHES = 4
#: Chance that a probe for what was never inserted passes; it sets the filter's bits for each inserted (n-gram, level).
FALSE_RATE = 0.01
#: Of a chunk of texts each n-gram is counted and looked up once; it ends after the text that reaches this many tokens or bytes.
CHUNK_TOKENS = 2_000_000
CHUNK_BYTES = 32 << 20
#: N-grams are dealt out by the top bits of their hashes, so many that a segment gets about this many at most; a task holds one segment at a time.
SEGMENT_TOKENS = 1 << 21
LEAST_BITS = 6
KAPPA = 300.0


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x632BE59BD9B4E019)))


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The least whole count of each level; 0 for level 0. It never overstates what was counted."""
    return np.where(levels > 0, np.ceil(BASE ** (np.maximum(levels, 1) - 1.0) - 1e-9), 0.0)


class Filter:
    """The Bloom filter of one segment: HASHES positions for each (key, level). top is the greatest level inserted; no higher one is probed."""

    def __init__(self, size: int, data: np.ndarray, top: int):
        self.size, self.data, self.top = size, data, top

    @staticmethod
    def positions(keys: np.ndarray, level: int, k: int, size: int) -> np.ndarray:
        turn = np.uint64((k * 0xD6E8FEB86659FD93 + level * 0xA0761D6478BD642F) % (1 << 64))
        return _mix(keys + turn) % np.uint64(size)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: membership is probed for level 1, 2, .. until a probe fails."""
        out = np.zeros(len(keys), np.int64)
        live, level = np.arange(len(keys)), 0
        while len(live) and level < self.top:
            level += 1
            for k in range(HASHES):
                at = self.positions(keys[live], level, k, self.size)
                live = live[(self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            out[live] = level
        return out


def segment_filter(keys: np.ndarray, counts: np.ndarray, false_rate: float = FALSE_RATE) -> Filter:
    """The filter of one segment's keys (repeated ones are summed, those of count 0 left out), sized by its insertions for false_rate."""
    keys, inverse = np.unique(keys, return_inverse=True)
    counts = np.bincount(inverse, counts, len(keys))
    keys, counts = keys[counts > 0], counts[counts > 0]
    level = level_of(counts)
    bits = -HASHES / math.log(1 - false_rate ** (1 / HASHES))
    size = max(64, math.ceil(bits * int(level.sum()) / 8) * 8)
    flags = np.zeros(size, np.uint8)
    live, q = np.arange(len(keys)), 0
    while len(live):
        q += 1
        for k in range(HASHES):
            flags[Filter.positions(keys[live], q, k, size)] = 1
        live = live[level[live] > q]
    return Filter(size, np.packbits(flags, bitorder="little"), q)


_TOP48 = np.uint64(0xFFFFFFFFFFFF0000)


def _shrunk(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers written byte by byte, compressed: most of the high bytes are 0. The length stands before."""
    return len(numbers).to_bytes(8, "little") + _shrunk(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes())


def _numbers(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd") if n else b"", np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps. The top 48 bits are kept, which their positions derive from."""
    return _planes(np.diff(keys >> np.uint64(16), prepend=np.uint64(0)).astype("<u8"))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, "<u8"), dtype=np.uint64) << np.uint64(16)


class _Numbering(dict):
    """A number for each new word, from 0 on."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Gathered:
    """The texts of a chunk so far, as numbers of its words."""

    def __init__(self):
        self.words, self.tokens, self.rows, self.learns, self.size, self.bytes = _Numbering(), [], [], [], 0, 0

    def add(self, text: bytes, row: int | None, learns: bool) -> int:
        tokens = tokens_of(text)
        self.tokens.append(np.fromiter(map(self.words.__getitem__, tokens), np.uint32, len(tokens)))
        self.rows.append(-1 if row is None else row)
        self.learns.append(learns)
        self.size += len(tokens)
        self.bytes += len(text)
        return len(tokens)

    def full(self) -> bool:
        return self.size >= CHUNK_TOKENS or self.bytes >= CHUNK_BYTES

    def packed(self) -> dict[str, bytes]:
        """Frequent words get low numbers, so that the numbers compress."""
        sizes = np.array([len(x) for x in self.tokens], "<u4")
        tokens = np.concatenate(self.tokens)
        order = np.argsort(-np.bincount(tokens), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.words)
        return {
            "words": _blob([words[i] for i in order.tolist()]), "tokens": _planes(number[tokens].astype("<u4")), "sizes": _planes(sizes),
            "rows": _planes(np.array(self.rows, "<i8")), "learns": _planes(np.array(self.learns, np.uint8)),
        }


def _blob(words: list[bytes]) -> bytes:
    """Words never hold a space."""
    data = b" ".join(words)
    return len(data).to_bytes(8, "little") + _shrunk(data)


def _unblob(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, "zstd", asbytes=True).split(b" ") if n else []


class Chunk:
    """Some texts as numbers: each text's tokens as places among the chunk's words, and the distinct pairs of neighbours."""

    def __init__(self, made: dict[str, bytes]):
        self.sizes, self.rows = _numbers(made["sizes"], "<u4").astype(np.int64), _numbers(made["rows"], "<i8")
        self.learns = _numbers(made["learns"], "u1").astype(bool)
        self.tokens = _numbers(made["tokens"], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.words = _unblob(made["words"])
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.starts] = self.tokens[-1]  # the end token stands before a text's first, too
        pairs, self.where = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        self.first, self.second = pairs // len(self.words), pairs % len(self.words)
        hashes = np.array([xxh64_intdigest(w) for w in self.words], np.uint64)
        keys, alone = pair_keys(hashes[self.first], hashes[self.second]) & _TOP48, _mix(hashes) & _TOP48
        self.order, self.word_order = np.argsort(keys, kind="stable"), np.argsort(alone, kind="stable")
        self.keys, self.word_keys = keys[self.order], alone[self.word_order]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each pair, and each word, stands in the texts to learn from, in the order of their keys."""
        mine = np.repeat(self.learns, self.sizes)
        return np.bincount(self.where[mine], minlength=len(self.first))[self.order], np.bincount(self.tokens[mine], minlength=len(self.words))[self.word_order]

    def questions(self, bits: int) -> pa.RecordBatch:
        """What each segment is asked: keys of pairs, and words, each with its count here."""
        pairs, words = self.counts()
        names = [self.words[i] for i in self.word_order.tolist()]
        bounds = [np.searchsorted(k >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) for k in (self.keys, self.word_keys)]
        columns: list[list] = [[], [], [], [], [], []]
        for s in range(1 << bits):
            (a, b), (c, d) = ((int(x[s]), int(x[s + 1])) for x in bounds)
            if a < b or c < d:
                cells = (s, _packed_keys(self.keys[a:b]), _planes(pairs[a:b].astype("<u4")), _blob(names[c:d]), d - c, _planes(words[c:d].astype("<u4")))
                for column, cell in zip(columns, cells, strict=True):
                    column.append(cell)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["segment", "keys", "counts", "words", "n_words", "word_counts"])

    def probabilities(self, levels: np.ndarray, word_levels: np.ndarray, n: int, v: int, kappa: float = KAPPA) -> np.ndarray:
        """p(second | first) of each distinct pair, given its keys' levels: Dirichlet-smoothed bigrams over add-one unigrams.

        Every count but N and V comes from the filter. Over all words the probabilities after a context sum to 1 at
        most, false positives apart: a level gives the least count it stands for, and contexts, in the
        denominator, BASE times that. What lacks is what the levels' width loses, a third at most.
        """
        pairs, alone = np.empty(len(levels)), np.empty(len(word_levels))
        pairs[self.order], alone[self.word_order] = count_of(levels), count_of(word_levels)
        context = alone[self.first]
        return (np.minimum(pairs, context) + kappa * (alone[self.second] + 1) / (n + v + 1)) / (context * BASE + kappa)

    def score(self, levels: np.ndarray, word_levels: np.ndarray, n: int, v: int) -> np.ndarray:
        """log10 probability of each text."""
        return np.add.reduceat(np.log10(self.probabilities(levels, word_levels, n, v))[self.where], self.starts)

    def base(self, counts: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """The known tokens and the base score of each text, given its words' exact counts."""
        exact = np.empty(len(counts))
        exact[self.word_order] = counts
        sums = np.add.reduceat(np.log10(exact + 1)[self.tokens], self.starts) - self.sizes * math.log10(n + v + 1)
        return np.add.reduceat((exact > 0)[self.tokens].astype(np.int64), self.starts), sums


_MADE = T.StructType([T.StructField(x, T.BinaryType()) for x in ("words", "tokens", "sizes", "rows", "learns")])
_MADE_ARROW = pa.struct([(x, pa.binary()) for x in _MADE.names])


def gather(docs: DataFrame, text: Column, learns: Column, scored: Column, kept: list[str]) -> DataFrame:
    """A row (kept, __row, n_tokens) for each scored row of docs, and, after those it holds, a row (__chunk, __made) for each chunk."""
    # within, columns go by their places: mapInArrow resolves names as they stand, and theirs may hold dots
    chosen = docs.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)], text.alias("t"), learns.alias("learns"), scored.alias("scored"))
    fields = [T.StructField(c, chosen.schema[i].dataType) for i, c in enumerate(kept)]
    out = T.StructType([*fields, T.StructField("__row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("__chunk", T.LongType()), T.StructField("__made", _MADE)])

    def run(batches):
        part = TaskContext.get().partitionId()
        now, done, chunks, kinds = _Gathered(), 0, 0, []

        def closed():
            nonlocal now, chunks
            chunks += 1
            cells = [pa.nulls(1, k) for k in kinds] + [pa.nulls(1, pa.int64())] * 2 + [pa.array([part << 32 | chunks], pa.int64()), pa.array([now.packed()], _MADE_ARROW)]
            now = _Gathered()
            return pa.RecordBatch.from_arrays(cells, names=out.names)

        for whole in batches:
            kinds = [c.type for c in whole.columns[: len(kept)]]
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows, sizes = [], []
                for t, learn, shown in zip(*[c.to_pylist() for c in batch.columns[len(kept) :]], strict=True):
                    row = part << 40 | done if shown else None
                    size = now.add(t or b"", row, bool(learn))
                    if shown:
                        rows.append(row)
                        sizes.append(size)
                        done += 1
                    if now.full():
                        yield closed()
                mine = batch.filter(pa.compute.fill_null(batch.column(len(kept) + 2), False))
                yield pa.RecordBatch.from_arrays(
                    [*mine.columns[: len(kept)], pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), _MADE_ARROW)], names=out.names
                )
        if now.size:
            yield closed()

    return chosen.mapInArrow(run, out)


def ask(chunks: DataFrame, bits: int) -> DataFrame:
    """(chunk, segment, keys, counts, words, n_words, word_counts): the n-grams of each chunk (chunk, made) by segment."""

    def run(batches):
        for batch in batches:
            for number, made in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                asked = Chunk(made.as_py()).questions(bits)
                yield pa.RecordBatch.from_arrays([pa.array([number] * asked.num_rows, pa.int64()), *asked.columns], names=["chunk", *asked.schema.names])

    return chunks.mapInArrow(run, "chunk long, segment int, keys binary, counts binary, words binary, n_words int, word_counts binary")


def answer(asked: DataFrame, false_rate: float = FALSE_RATE) -> DataFrame:
    """(chunk, segment, levels, word_levels, exact, n, v) for each row of ask: by the filter each key's level, and words' exact counts.

    A segment's rows meet, its filter is built from their sums, probed for all of them and given up, so nothing
    holds the whole filter. n and v are a segment's tokens and distinct words, on one of its rows.
    """
    names = ["chunk", "segment", "levels", "word_levels", "exact", "n", "v"]

    def answered(segment: int, rows: list[tuple]):
        chunks, packed, counts, blobs, sizes, word_counts = zip(*rows, strict=True)
        keys = [_unpacked_keys(k) for k in packed]
        words = [_unblob(b) if n else [] for b, n in zip(blobs, sizes, strict=True)]
        exact: Counter[bytes] = Counter()
        for w, c in zip(words, word_counts, strict=True):
            for x, k in zip(w, _numbers(c, "<u4").tolist(), strict=True):
                exact[x] += k
        every = list(exact)
        alone = _mix(np.array([xxh64_intdigest(w) for w in every], np.uint64)) & _TOP48
        sums = np.array([exact[w] for w in every], float)
        held = segment_filter(np.concatenate([*keys, alone]), np.concatenate([*[_numbers(c, "<u4") for c in counts], sums]).astype(float), false_rate)
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        found = np.split(held.levels(distinct).astype(np.uint8)[inverse], np.cumsum([len(k) for k in keys])[:-1])
        level = dict(zip(every, held.levels(alone).tolist(), strict=True))
        n, v = int(sums.sum()), int((sums > 0).sum())
        for i, (chunk, w, mine) in enumerate(zip(chunks, words, found, strict=True)):
            cells = (chunk, segment, _planes(mine), _planes(np.array([level[x] for x in w], np.uint8)), _planes(np.array([exact[x] for x in w], "<i8")), 0 if i else n, 0 if i else v)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for segment, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if segment != now and rows:
                    yield from answered(now, rows)
                    rows = []
                now = segment
                rows.append(row)
        if rows:
            yield from answered(now, rows)

    dealt = asked.repartition("segment").sortWithinPartitions("segment", "chunk")
    return dealt.select("segment", "chunk", "keys", "counts", "words", "n_words", "word_counts").mapInArrow(
        run, "chunk long, segment int, levels binary, word_levels binary, exact binary, n long, v long"
    )


def tell(chunks: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """(__row, n_known, base_score, score) of every scored text of chunks (chunk, made)."""

    def told(made, parts):
        chunk = Chunk(made)
        levels, word_levels, exact = (np.concatenate([_numbers(p[i], kind) for p in parts]) for i, kind in enumerate(("u1", "u1", "<i8")))
        known, base = chunk.base(exact, n, v)
        mine = chunk.rows >= 0
        cells = (chunk.rows, known, base, chunk.score(levels.astype(np.int64), word_levels.astype(np.int64), n, v))
        return pa.RecordBatch.from_arrays([pa.array(x[mine]) for x in cells], names=["__row", "n_known", "base_score", "score"])

    def run(batches):
        made, parts = None, []
        for batch in batches:
            for x, *part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if x is None:
                    parts.append(part)
                    continue
                if made:
                    yield told(made, parts)
                made, parts = x, []
        if made:
            yield told(made, parts)

    none = [F.lit(None).cast("binary").alias(x) for x in ("levels", "word_levels", "exact")]
    both = chunks.select("chunk", F.lit(-1).alias("segment"), "made", *none).unionByName(
        answers.select("chunk", "segment", F.lit(None).cast(_MADE).alias("made"), "levels", "word_levels", "exact")
    )
    return both.repartition("chunk").sortWithinPartitions("chunk", "segment").select("made", "levels", "word_levels", "exact").mapInArrow(
        run, "__row long, n_known long, base_score double, score double"
    )


_NEW = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_marked(
    docs: DataFrame, learns: Column, *, scored: Column | None = None, text: str = "text", keep: list[str] | None = None, false_rate: float = FALSE_RATE
) -> DataFrame:
    """keep (default: all but the text) plus n_tokens, n_known, train_tokens, base_score and score for every row of docs (where scored holds).

    The model is that of the rows where learns holds. Null texts count as empty, which is one end token; a null
    learns is false; if nothing is learned from, N and V are 0 and every p is that of an unseen token; repeated
    rows learn and score alike; an empty table gives no rows; columns of these names are replaced.
    Texts become numbers chunk by chunk, and of a chunk each distinct n-gram goes, once, with its count to the
    segment of its hash, where counts are summed, the filter's segment is built and probed, and levels and words' exact
    counts (for the base score) go back. Filter and segments grow with the input; no task holds more than one of them.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _NEW and (keep or c != text)]
    rows = Stored(gather(docs, quoted(text).cast("binary"), learns, F.lit(True) if scored is None else scored, kept)).df
    chunks = rows.where("__chunk is not null").select(F.col("__chunk").alias("chunk"), F.col("__made").alias("made"))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, total) / SEGMENT_TOKENS)))
    answers = Stored(answer(ask(chunks, bits), false_rate)).df
    sums = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    told = tell(chunks, answers, n, v)
    return rows.where("__row is not null").drop("__chunk", "__made").join(told, "__row").select(
        *map(quoted, kept), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def score(docs: DataFrame, train: DataFrame, *, text: str = "text", keep: list[str] | None = None, false_rate: float = FALSE_RATE) -> DataFrame:
    """score_marked for every row of docs, learning from the texts of another table, train."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _NEW and (keep or c != text)]
    mine = docs.select(F.struct(*map(quoted, kept), F.lit(1).alias("__")).alias("d"), quoted(text).alias("t"), F.lit(False).alias("learns"))
    both = mine.unionByName(train.select(F.lit(None).cast(mine.schema["d"].dataType).alias("d"), quoted(text).alias("t"), F.lit(True).alias("learns")))
    told = score_marked(both, F.col("learns"), scored=~F.col("learns"), text="t", keep=["d"], false_rate=false_rate)
    return told.select(*[F.col("d")[c].alias(c) for c in kept], *[c for c in told.columns if c != "d"])
