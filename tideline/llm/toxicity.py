"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import functools
import re
import sys
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stored, append_arrow, held_by_worker, least, quoted

CUTOFF = 0.7
GRAMS = (4, 5, 6, 7, 8)
ROWS = 1 << 22
#: Least evidence of a feature (log-count ratio times the root of its texts): what lies under it adds noise to every text.
EVIDENCE = 5.0
#: Bounds of the sample that the linear weights are fitted on, of either label, and of the features kept.
SAMPLE_OF_LABEL = 3000
FEATURES = 1 << 16
#: Up to so many labels are broadcast to the texts; of more, texts and labels are shuffled, once.
BROADCAST_LABELS = 1_000_000
#: Characters whose features are looked for in one go, in pieces that end between words. It bounds what is held of a longer text.
PIECE = 1 << 18
#: Words of more bytes are hashed one by one.
SHORT = 64
#: CRC-32 is linear: the hash of some bytes is the xor of what each of them adds, which depends on how many bytes follow it
#: (ADDS, by that number and the byte). ROWS is a power of two, so that holds modulo ROWS.
ADDS = np.array([[(zlib.crc32(bytes([b]) + bytes(n)) ^ zlib.crc32(bytes(n))) % ROWS for b in range(256)] for n in range(SHORT + 4)])


@functools.cache
def _word_characters() -> np.ndarray:
    """Of every code point, whether words hold it."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for found in re.finditer(r"\w+", "".join(map(chr, range(len(out))))):
        out[found.start() : found.end()] = True
    return out


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % ROWS


def _pieces(texts: list[str]):
    """(number of the first, texts or one part of a text, whether more of it follows) of PIECE characters or little more."""
    some, size = [], 0
    for number, text in enumerate(texts):
        if some and size + len(text) > PIECE:
            yield number - len(some), some, False
            some, size = [], 0
        at = 0
        while len(text) - at > PIECE and (gap := re.compile(r"\W").search(text, at + PIECE)):
            yield number, [text[at : gap.start()]], True
            at = gap.start()
        some.append(text[at:] if at else text)
        size += len(text) - at
    if some:
        yield len(texts) - len(some), some, False


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(keys)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


class _Characters:
    """The characters that some code points are, by numbers, with the bytes of each and what it adds to a hash (as ADDS)."""

    def __init__(self, codes: np.ndarray):
        held = np.zeros(max(128, int(codes.max()) + 1), bool)
        held[codes] = held[[ord(c) for c in "<=>"]] = True
        points = np.flatnonzero(held)
        self.open, self.equals, self.close = np.searchsorted(points, [ord(c) for c in "<=>"])
        self.numbers = (np.cumsum(held) - 1)[codes]
        self.n = len(points)
        self.bytes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        self.wide = self.n > 0 and int(self.bytes.max()) > 1
        low = ADDS[: SHORT + 1, np.where(self.bytes > 1, 0x80 | points & 0x3F, points)]
        for k, lead in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            at = np.flatnonzero(self.bytes > k)
            byte = np.where(self.bytes[at] == k + 1, lead | points[at] >> 6 * k, 0x80 | points[at] >> 6 * k & 0x3F)
            low[:, at] ^= ADDS[k : k + SHORT + 1, byte]
        self.adds = low.reshape(-1)


def _whole(chars: _Characters, words: np.ndarray) -> np.ndarray:
    """Hashes of words of equal length as a whole (a row for each place, a column for each word); 0 for those that aren't SHORT."""
    if len(words) > SHORT:
        return np.zeros(words.shape[1], np.int64)
    named = np.concatenate([np.full((1, words.shape[1]), chars.equals), words])
    after = np.cumsum(chars.bytes[named[::-1]], 0)[::-1] - chars.bytes[named]
    return np.where(after[0] <= SHORT, np.bitwise_xor.reduce(chars.adds[named + chars.n * np.minimum(after, SHORT)], 0), 0)


def _grams(chars: _Characters, bounded: np.ndarray):
    """Hashes of the n-grams of words between their bounds, as rows and columns, length by length."""
    n, places = chars.n, len(bounded)
    if chars.wide:  # how many bytes come before, as a distance in what characters add
        before = n * np.cumsum(chars.bytes[bounded], 0)
    for size in range(1, min(places, max(GRAMS)) + 1):
        # those of so many characters from those of one fewer that begin at the next one
        end = places - size + 1
        if chars.wide:
            found = chars.adds[bounded[:end] + (before[size - 1 :] - before[:end])]
        else:
            found = chars.adds[n * (size - 1) : n * size][bounded[:end]]
        if size > 1:
            found ^= grams[1:]
        grams = found
        if size in GRAMS:
            yield grams


def _hashes(chars: _Characters, codes: np.ndarray, starts: np.ndarray, length: int):
    """Hashes of the features of words of a length that start there, as rows and columns."""
    words = chars.numbers[starts + np.arange(length)[:, None]]
    whole = _whole(chars, words)
    for i in np.flatnonzero(whole == 0):  # not short, or indeed 0
        whole[i] = _hash("=" + codes[starts[i] : starts[i] + length].tobytes().decode("utf-32-le"))
    yield whole[None]
    bounded = np.empty((length + 2, len(starts)), np.int64)
    bounded[0], bounded[1:-1], bounded[-1] = chars.open, words, chars.close
    for at in range(0, len(bounded), PIECE):
        yield from _grams(chars, bounded[at : at + PIECE + max(GRAMS) - 1])


def _keys(texts: list[str], first: int, chosen: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """ROWS times a text's number (first for the first) plus a feature of it, for all of them in order."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_characters()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    chars = _Characters(codes)
    base = ROWS * (first + np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right"))
    # words of a length together, long ones each by itself
    kinds = np.minimum(sizes, SHORT).astype(np.uint8)
    order = np.argsort(kinds, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(kinds, minlength=SHORT + 1)))
    groups = [order[cuts[i] : cuts[i + 1]] for i in range(1, SHORT)] + [order[i : i + 1] for i in range(cuts[SHORT], cuts[SHORT + 1])]
    out, held = [np.zeros(0, np.int64)], 0
    for group in groups:
        if not len(group):
            continue
        rows = base[group]
        for hashes in _hashes(chars, codes, starts[group], sizes[group[0]]):
            if chosen is None:
                out.append((rows + hashes).reshape(-1))
            else:
                flat = hashes.reshape(-1)
                at = np.flatnonzero(chosen[0][flat & (len(chosen[0]) - 1)])
                at = at[chosen[1][flat[at]]]
                out.append(rows[at % len(rows)] + flat[at])
            held += len(out[-1])
            if held > 16 * PIECE:  # of a long word, which has few features that differ
                out = [_distinct(out)]
                held = 0
    return _distinct(out)


def features(texts: list[str | None], chosen: tuple[np.ndarray, np.ndarray] | None = None):
    """(rows, features) of some texts after the other: which features each has, by row, then feature.

    Features are the hashed character n-grams of a word between its bounds, and the word as a whole; how often a text has
    them plays no part. Those that chosen (made by marked) doesn't mark are left out.
    """
    parts: list[np.ndarray] = []
    for first, some, more in _pieces([(t or "").lower() for t in texts]):
        parts.append(_keys(some, first, chosen))
        if more and len(parts) < 16:
            continue
        keys = _distinct(parts) if len(parts) > 1 else parts[0]
        parts = [keys] if more else []
        if not more:
            yield keys // ROWS, keys % ROWS


def marked(names) -> tuple[np.ndarray, np.ndarray]:
    """Marks of some features, before them marks of the last 19 bits that any of them has, which fit a core's cache."""
    out = np.zeros(ROWS, bool)
    out[np.fromiter(names, int)] = True
    return out.reshape(-1, 1 << 19).any(0), out


class Model:
    """A weight per kept feature (already times its log-count ratio) and a bias."""

    def __init__(self, weight: dict[int, float], bias: float):
        self.weight, self.bias = weight, bias

    def scorer(self):
        """A function from texts to their scores."""
        chosen, names = marked(self.weight), np.array(sorted(self.weight), int)
        weights = np.array([self.weight[x] for x in names.tolist()])

        def run(texts: list[str | None]) -> np.ndarray:
            z = np.full(len(texts), float(self.bias))
            for rows, found in features(texts, chosen):
                z += np.bincount(rows, weights[np.searchsorted(names, found)], len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return run


def document_counts(labelled: DataFrame) -> DataFrame:
    """(feature, clean, toxic): in how many labelled texts of either label each feature occurs, over all of them."""

    def run(batches):
        counts = np.zeros((2, ROWS), np.int64)
        for batch in batches:
            texts, toxic = batch.columns[0].to_pylist(), batch.columns[1].to_numpy()
            for rows, found in features(texts):
                np.add.at(counts.reshape(-1), toxic[rows] * ROWS + found, 1)
        names = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *map(pa.array, counts[:, names])], names=["feature", "clean", "toxic"])

    return labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, "feature int, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )


def log_ratio(toxic, clean, n_toxic, n_clean):
    """Naive Bayes log-count ratio of a feature, smoothed by half a document."""
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def train(rows: list[tuple[Sequence[int] | np.ndarray, int]], counts: dict[int, tuple[int, int]], n_toxic: int, n_clean: int, *, steps: int = 300, ridge: float = 2e-3) -> Model:
    """Logistic regression on x_j = the log-count ratio of a present feature, by Adam over all rows.

    A training row's own count is taken out of its ratios, as it is for a text that comes later; else features that
    few texts have would look surer than they are. Either label weighs the same in all, so the share of toxic
    rows in the sample doesn't move the scores. counts: (toxic, clean) texts with a feature.
    """
    names = sorted(counts)
    if not rows or len({y for _, y in rows}) < 2 or not names:
        share = np.mean([y for _, y in rows]) if rows else 0.0
        return Model(dict.fromkeys(names, 0.0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    table = np.array([counts[x] for x in names], float)
    scale = log_ratio(table[:, 0], table[:, 1], n_toxic, n_clean)
    y = np.array([y for _, y in rows], float)
    sizes = np.array([len(found) for found, _ in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    cols = np.searchsorted(names, np.concatenate([np.asarray(found, int) for found, _ in rows]))
    # a ratio for rows of either label; where no such row has the feature, it isn't used
    values = np.concatenate([log_ratio(np.maximum(table[:, 0] - own, 0), np.maximum(table[:, 1] - (1 - own), 0), n_toxic - own, n_clean - (1 - own)) for own in (0, 1)])[
        np.where(y[row] == 1, len(names), 0) + cols
    ]
    moved = np.empty(len(cols))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias, m, v = np.zeros(len(names)), 0.0, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        np.take(w, cols, out=moved, mode="clip")
        moved *= values
        z = np.bincount(row, moved, len(rows)) + bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        np.take(error, row, out=moved, mode="clip")
        moved *= values
        grad = np.concatenate([np.bincount(cols, moved, len(names)) + ridge * w, [error.sum()]])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(dict(zip(names, (w * scale).tolist(), strict=True)), float(bias))


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The classifier of the labelled rows of docs.

    Log-count ratios come from all labelled texts. Features are kept where the ratio is far from 0 for its count
    (EVIDENCE; FEATURES at most, those of most evidence). Weights are fitted on SAMPLE_OF_LABEL texts of either label at most,
    those of least hashed id, then text. A label that is null or neither 0 nor 1 is left out; of repeated labels the larger
    holds; without labels of both kinds, or with empty docs, the model knows no feature. Labelled texts are stored once.
    """
    marks = labels.where(quoted(label).isin(0, 1)).groupBy(quoted(doc_id).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    few = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    whole = docs.select(quoted(doc_id).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    labelled = Stored(whole.join(F.broadcast(marks) if few else marks, "id").select("toxic", F.xxhash64(F.col("id").cast("string")).alias("h"), F.xxhash64("text").alias("g"), "text")).df
    totals = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Model({}, -4.0 if n0 or not n1 else 4.0)
    p, q = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("clean") + 0.5) / (n0 + 1)
    evidence = F.abs(F.log(p / q)) * F.sqrt(F.col("toxic") + F.col("clean"))
    kept = (
        document_counts(labelled).withColumn("evidence", evidence).where(F.col("evidence") >= EVIDENCE)
        .orderBy(F.desc("evidence"), "feature").limit(FEATURES).select("feature", "toxic", "clean").collect()
    )
    counts = {r.feature: (r.toxic, r.clean) for r in kept}
    held = docs.sparkSession.sparkContext.broadcast(frozenset(counts))

    def make(token=uuid.uuid4().hex):
        chosen = held_by_worker(token, lambda: marked(held.value))

        def run(texts):
            found = [*features(texts.to_pylist(), chosen)]
            sizes = sum((np.bincount(rows, minlength=len(texts)) for rows, _ in found), np.zeros(len(texts), int))
            values = np.concatenate([np.zeros(0, int), *(f for _, f in found)])
            return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()))]

        return run

    rows = []
    for value in (0, 1):
        part = least(labelled.where(F.col("toxic") == value), ["h", "g"], SAMPLE_OF_LABEL)
        # as arrays: lists of numbers would take some hundred MB of the driver
        for chunk in append_arrow(part, [F.col("text")], "found array<int>", make, []).toArrow().column("found").chunks:
            offsets, found = chunk.offsets.to_numpy(), chunk.values.to_numpy()
            rows += [(found[a:b], value) for a, b in zip(offsets, offsets[1:], strict=False)]
    return train(rows, counts, n1, n0)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 from cutoff on).

    Null and empty texts get the score of no feature; repeated rows score alike; columns of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(token=uuid.uuid4().hex):
        scorer = held_by_worker(token, held.value.scorer)

        def run(texts):
            scores = scorer(texts.to_pylist())
            return [pa.array(scores, pa.float64()), pa.array(scores >= cutoff).cast(pa.int32())]

        return run

    return append_arrow(docs, [quoted(text)], "score double, predicted int", make, keep)
