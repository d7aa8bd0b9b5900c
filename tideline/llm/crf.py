"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import append_arrow, quoted

UNDETERMINED = "und"
#: Bounds of the sample that the field is fitted on: documents of a language, and characters of a document (longer ones give a stretch from anywhere).
SAMPLE_OF_LANGUAGE = 300
SAMPLE_CHARS = 20_000
#: Code-switched sequences that are fitted: so many, or so many a language if that is more.
SEQUENCES = 2400
SEQUENCES_OF_LANGUAGE = 100
#: Feature weights are held in this many hashed rows.
ROWS = 1 << 16
#: Words whose features are found at once.
WORDS_AT_ONCE = 5_000
#: Texts whose chains are run together, those of like length side by side; the words of no more are held.
TEXTS_AT_ONCE = 2_000


def _not_letters() -> str:
    """The numerals that Python's words hold beside letters and digits (categories No and Nl), as ranges of a character class."""
    found = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl")]
    starts = [c for i, c in enumerate(found) if not i or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i == len(found) - 1 or found[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


_LETTERS = re.compile(rf"[^\W\d_{_not_letters()}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lowered."""
    return _LETTERS.findall(text.lower())


def features(word: str, lexicon: dict[str, str]) -> list[int]:
    """Rows of a word's affixes (up to 4), inner 2- and 3-grams, length and lexicon entry. Of over 64 letters the grams repeat little more."""
    bound = f"^{word}$"
    found = {f"p{word[:k]}" for k in (1, 2, 3, 4)} | {f"s{word[-k:]}" for k in (1, 2, 3, 4)}
    found |= {f"g{bound[i : i + k]}" for k in (2, 3) for i in range(len(bound) - k + 1)}
    found |= {"b", f"l{min(len(word), 12)}", f"x{lexicon.get(word, '-')}"}
    return [*map(_row, found)]


def _row(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % ROWS


def _crc_table() -> np.ndarray:
    """CRC-32 of one byte more: what each low byte of the register adds."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _crcs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: str) -> np.ndarray:
    """The CRC-32 of each stretch of data, with the letter before in front of it."""
    register = np.full(len(starts), zlib.crc32(before.encode()) ^ 0xFFFFFFFF, np.uint32)
    sizes, at, step = stops - starts, slice(None), 0
    while len(starts):
        register[at] = _CRC[(register[at] ^ data[starts[at] + step]) & 255] ^ (register[at] >> 8)
        step += 1
        at = np.flatnonzero(sizes > step)
        if not len(at):
            break
    return register ^ np.uint32(0xFFFFFFFF)


def feature_rows(words: list[str], lexicon: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of features() of each of the words (none of them empty), one word's after the other's, and where each begins."""
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-8", "replace"), np.uint8)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
    heads = np.cumsum(sizes + 2) - sizes - 2
    all_words = np.arange(n)
    of, crc = [], []

    def add(own: np.ndarray, starts: np.ndarray, size: int, before: str) -> None:
        of.append(own)
        crc.append(_crcs(data, places[starts], places[starts + size], before))

    for k in (1, 2, 3, 4):  # a shorter word's longer affixes are the word again
        own = all_words[sizes >= k]
        add(own, heads[own] + 1, k, "p")
        add(own, heads[own] + 1 + sizes[own] - k, k, "s")
    characters = np.repeat(all_words, sizes + 2)
    left = (heads + sizes + 2)[characters] - np.arange(len(characters))
    for k in (2, 3):
        starts = np.flatnonzero(left >= k)
        add(characters[starts], starts, k, "g")
    keys = np.sort(np.concatenate(of) << 32 | np.concatenate(crc))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    lengths = np.array([_row(f"l{k}") for k in range(13)])[np.minimum(sizes, 12)]
    entries = {x: _row(f"x{x}") for x in {"-", *lexicon.values()}}
    known = np.fromiter((entries[lexicon.get(w, "-")] for w in words), np.int64, n)
    of = np.concatenate([keys >> 32, all_words, all_words, all_words])
    rows = np.concatenate([(keys & 0xFFFFFFFF) % ROWS, np.full(n, _row("b")), lengths, known])
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=n)
    return rows[order], np.cumsum(counts) - counts


class Field:
    """Emissions by hashed features and learned start and transition weights; everything is picklable and small."""

    def __init__(self, labels: list[str], lexicon: dict[str, str]):
        self.labels, self.lexicon = labels, lexicon
        k = len(labels)
        self.weight = np.zeros((ROWS, k), np.float32)
        self.start, self.move = np.zeros(k, np.float32), np.zeros((k, k), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, labels) log scores."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), WORDS_AT_ONCE):
            rows, heads = feature_rows(words[at : at + WORDS_AT_ONCE], self.lexicon)
            out[at : at + WORDS_AT_ONCE] = np.add.reduceat(self.weight[rows], heads)
        return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Posterior marginals (B, T, K) of padded sequences, and the expected transitions (K, K) if asked for.

    emit: (B, T, K) log scores. Steps beyond a sequence's length have zero marginals.
    """
    b, t, k = emit.shape
    e = np.exp(emit - emit.max(-1, keepdims=True))
    alive = np.arange(t)[None, :] < lengths[:, None]
    e[~alive] = 1
    go = np.exp(move - move.max())
    forward, one = np.empty_like(e), np.ones((k, 1), e.dtype)
    now = e[:, 0] * np.exp(start - start.max())
    forward[:, 0] = now / (now @ one)
    for i in range(1, t):
        now = (forward[:, i - 1] @ go) * e[:, i]
        np.divide(now, now @ one, out=forward[:, i])
    back = np.ones((b, k), e.dtype)
    expected = np.zeros((k, k))
    least = lengths.min()
    for i in range(t - 1, -1, -1):
        if i >= least - 1:
            back = np.where((i >= lengths - 1)[:, None], 1, back)
        if pairs and i + 1 < t:
            step = e[:, i + 1] * after
            joint = forward[:, i, :, None] * go[None] * step[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            expected += joint[alive[:, i + 1]].sum(0)
        after = back
        np.multiply(forward[:, i], back, out=(emit if pairs else forward)[:, i])
        back = (e[:, i] * back) @ go.T
        back /= back @ one
    out = emit if pairs else forward
    out /= out @ one
    out[~alive] = 0
    return out, expected


def _switched(rows: list[tuple[str, list[str]]], n: int, rng) -> list[tuple[list[str], list[str]]]:
    """n sequences, each of 1 to 4 stretches of 4 to 20 words from documents of any languages, evenly drawn."""
    by = defaultdict(list)
    for label, words in rows:
        if len(words) >= 4:
            by[label].append(words)
    labels, out = sorted(by), []
    for _ in range(n if labels else 0):
        words, tags = [], []
        for _ in range(rng.integers(1, 5)):
            label = labels[rng.integers(len(labels))]
            source = by[label][rng.integers(len(by[label]))]
            size = int(rng.integers(4, 21))
            at = int(rng.integers(0, max(1, len(source) - size + 1)))
            words += source[at : at + size]
            tags += [label] * len(source[at : at + size])
        out.append((words, tags))
    return out


def fit_rows(rows: list[tuple[str, str]], *, epochs: int = 12, seed: int = 0) -> Field:
    """The field fitted on (lang, text) rows by AdaGrad on the conditional likelihood of code-switched sequences."""
    rng = np.random.default_rng(seed)
    taken = [(lang, words_of(text)) for lang, text in rows]
    labels = sorted({lang for lang, _ in taken})
    counts = defaultdict(Counter)
    for lang, words in taken:
        for w in words:
            counts[w][lang] += 1
    totals = {lang: max(1, sum(len(w) for a, w in taken if a == lang)) for lang in labels}
    lexicon = {}
    for w, c in counts.items():
        shares = {lang: c[lang] / totals[lang] for lang in c}
        best = max(sorted(shares), key=shares.get)
        if sum(c.values()) >= 5 and shares[best] >= 0.9 * sum(shares.values()):
            lexicon[w] = best
    field = Field(labels, lexicon)
    data = _switched(taken, max(SEQUENCES, SEQUENCES_OF_LANGUAGE * len(labels)), rng)
    if len(labels) < 2 or not data:
        return field
    number = {lang: i for i, lang in enumerate(labels)}
    vocabulary = {w: i for i, w in enumerate(sorted({w for words, _ in data for w in words}))}
    rows_of = []
    for at in range(0, len(vocabulary), WORDS_AT_ONCE):
        rows, heads = feature_rows([*vocabulary][at : at + WORDS_AT_ONCE], lexicon)
        rows_of += np.split(rows, heads[1:])
    k = len(labels)
    sums = [np.full(x.shape, 1e-3) for x in (field.weight, field.start, field.move)]
    rate = 0.15
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 200):
            part = [data[i] for i in order[at : at + 200]]
            lengths = np.array([len(w) for w, _ in part])
            t = lengths.max()
            ids, gold = np.zeros((len(part), t), int), np.zeros((len(part), t), int)
            for i, (words, tags) in enumerate(part):
                ids[i, : len(words)] = [vocabulary[w] for w in words]
                gold[i, : len(words)] = [number[x] for x in tags]
            alive = np.arange(t)[None] < lengths[:, None]
            seen, inverse = np.unique(ids[alive], return_inverse=True)
            flat = np.concatenate([rows_of[i] for i in seen])
            sizes = np.array([len(rows_of[i]) for i in seen])
            heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            table = np.add.reduceat(field.weight[flat].astype(float), heads)
            emit = np.zeros((len(part), t, k))
            emit[alive] = table[inverse]
            marginal, expected = forward_backward(emit, lengths, field.start, field.move, True)
            error = np.eye(k)[gold[alive]] - marginal[alive]
            by_word = np.stack([np.bincount(inverse, error[:, j], len(seen)) for j in range(k)], 1)
            spread = np.repeat(by_word, sizes, axis=0)
            grad = np.stack([np.bincount(flat, spread[:, j], ROWS) for j in range(k)], 1) / len(part)
            first = (np.eye(k)[gold[:, 0]] - marginal[:, 0]).mean(0)
            observed = np.zeros((k, k))
            follow = alive[:, 1:]
            np.add.at(observed, (gold[:, :-1][follow], gold[:, 1:][follow]), 1)
            moved = (observed - expected) / len(part)
            for target, g, s in zip((field.weight, field.start, field.move), (grad, first, moved), sums, strict=True):
                g = g - 1e-5 * target
                s += g * g
                target += (rate * g / np.sqrt(s)).astype(np.float32)
    return field


def sample(docs: DataFrame, *, text: str = "text", lang: str = "lang", order: str = "doc_id", of_language: int = SAMPLE_OF_LANGUAGE) -> DataFrame:
    """(lang, text): of every language that docs hold, the of_language rows whose hashed order column, then text, is least; equal rows once.

    Rows are counted by language first; of large languages only keys under a bound that three times as many
    should pass, and the least, are ranked, so no task sees a whole language.
    """
    known = docs.where(quoted(lang).isNotNull() & quoted(text).isNotNull()).select(
        quoted(lang).cast("string").alias("lang"), quoted(text).alias("text"), F.xxhash64(quoted(order).cast("string")).alias("h"), F.xxhash64(quoted(text)).alias("g")
    )
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not sizes:
        return known.select("lang", "text")
    whole = lambda n: (1 << 63) - 1 if n <= 20 * of_language else int(3 * of_language / n * (1 << 64)) - (1 << 63)
    spark = docs.sparkSession
    bounds = spark.createDataFrame([(r.lang, max(r.least, whole(r.n))) for r in sizes], "lang string, bound long")
    few = known.join(F.broadcast(bounds), "lang").where("h <= bound")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "g"))
    ranked = few.select("lang", "h", "g").distinct().withColumn("rank", rank).where(F.col("rank") <= of_language)
    ends = ranked.groupBy("lang").agg(F.max(F.struct("h", "g")).alias("last")).collect()
    ends = spark.createDataFrame([(r.lang, r.last.h, r.last.g) for r in ends], "lang string, h1 long, g1 long")
    chosen = few.join(F.broadcast(ends), "lang").where((F.col("h") < F.col("h1")) | ((F.col("h") == F.col("h1")) & (F.col("g") <= F.col("g1"))))
    place = 1 + F.pmod(F.col("g"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    return chosen.groupBy("lang", "h", "g").agg(F.first(F.substr("text", place.cast("int"), F.lit(SAMPLE_CHARS))).alias("text")).select("lang", "text")


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", order: str = "doc_id", of_language: int = SAMPLE_OF_LANGUAGE) -> Field:
    """The field of a bounded sample of every language; which languages there are is taken from all rows.

    Rows without language or text teach nothing; with none left no language is learned. Predictions read whole
    texts of any length.
    """
    rows = sample(docs, text=text, lang=lang, order=order, of_language=of_language).collect()
    return fit_rows(sorted((r.lang, r.text) for r in rows))


class _Met(dict):
    """Words by number, in the order in which they were met."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def emissions(self) -> np.ndarray:
        return self.field.emissions([*self])


def judge(texts: list[str | None] | pa.Array, field: Field, cells: int = 100_000) -> list[tuple[str, float, float]]:
    """(language, its mean posterior over the words, the mean of each word's greatest posterior) of each text."""
    out: list[tuple[str, float, float]] = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
    if not field.labels:
        return out
    met = _Met(field)
    rows: list[tuple[int, np.ndarray]] = []
    for at in range(0, len(texts), 100):  # the words of few texts at a time; what stays is 4 bytes a word
        part = texts[at : at + 100]
        part = part.to_pylist() if isinstance(part, pa.Array) else part
        rows += [(at + i, met.rows(words)) for i, t in enumerate(part) if t and (words := words_of(t))]
    emissions = met.emissions()
    rows.sort(key=lambda r: len(r[1]))
    at = 0
    while at < len(rows):
        stop = at + 1
        while stop < len(rows) and len(rows[stop][1]) * (stop + 1 - at) <= cells and len(rows[stop][1]) <= 1.3 * len(rows[at][1]) + 16:
            stop += 1
        part = rows[at:stop]
        lengths = np.array([len(r[1]) for r in part])
        ids = np.zeros((len(part), lengths.max()), np.int32)
        for i, (_, row) in enumerate(part):
            ids[i, : len(row)] = row
        marginal, _ = forward_backward(emissions[ids], lengths, field.start, field.move)
        shares = marginal.sum(1) / lengths[:, None]
        sure = marginal.max(2).sum(1) / lengths
        for (i, _), share, s in zip(part, shares, sure, strict=True):
            best = int(share.argmax())
            out[i] = (field.labels[best], float(min(1.0, share[best])), float(min(1.0, s)))
        at = stop
    return out


def tag(text: str, field: Field) -> list[tuple[str, str]]:
    """Each word of a code-switched text with its language of greatest posterior."""
    words, met = words_of(text), _Met(field)
    if not words:
        return []
    ids = met.rows(words)[None]
    marginal, _ = forward_backward(met.emissions()[ids], np.array([len(words)]), field.start, field.move)
    return [(w, field.labels[int(m.argmax())]) for w, m in zip(words, marginal[0], strict=True)]


def identify(docs: DataFrame, field: Field, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs plus lang_pred, score (the mean posterior of lang_pred over the text's words) and certainty (the mean of each word's greatest).

    An evenly code-switched text has a low score, however sure its words are; certainty tells whether the learned languages
    explain it. Null texts and texts without a letter are 'und' with 0 for both, as is any text if no language
    was learned; repeated rows are judged alike; an empty table gives no rows; columns of these names are replaced.
    Whole texts are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        def run(texts):
            found = judge(texts, held.value)
            return [pa.array([x[0] for x in found], pa.string()), *[pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)]]

        return run

    return append_arrow(docs, [text], "lang_pred string, score double, certainty double", make, keep, TEXTS_AT_ONCE)
