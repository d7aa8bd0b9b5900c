"""SimHash near-duplicates by generalised pigeonhole search in Hamming space."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tideline.llm.common import Stored, append_arrow, connected_components, quoted

BITS = 64
THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: Most fingerprints of a bucket that are compared in one go; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
#: Bits of the blocks whose exact distance histograms are held to estimate candidates.
GRAM_BITS = 8


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer; a bit is set if it is in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - size + 1)
    stops = ends[min(size, len(words)) - 1 :] - 1
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), stops[at : at + (1 << 16)].tolist(), strict=False)
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def make():
        return lambda texts: [pa.array([fingerprint(t or b"") for t in texts.to_pylist()], pa.int64())]

    return append_arrow(docs, [F.col(text).cast("binary")], "fp long", make, keep)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _extract(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each value, packed into the low bits."""
    out = np.zeros(len(values), np.uint64)
    v = values.view(np.uint64)
    for k, b in enumerate(bits):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of near-equal size: each grows from the most correlated free bit by what correlates most with it."""
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        seed = max(sorted(free), key=lambda b: correlation[b, sorted(free)].sum())
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: correlation[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


class Allocation:
    """Bit partitions and per-fingerprint thresholds: T sums to tau - m + 1, -1 meaning that a partition isn't probed.

    Candidates within t in a partition are estimated from the distance histograms of its grams (blocks of up
    to GRAM_BITS bits), taken as independent, and n, the number of fingerprints.
    """

    def __init__(self, partitions: list[list[int]], histograms: dict[tuple[int, ...], np.ndarray], n: int, tau: int):
        self.partitions, self.n, self.tau, self.m = partitions, n, tau, len(partitions)
        self.budget = tau - self.m + 1
        self.grams = [[p[i : i + GRAM_BITS] for i in range(0, len(p), GRAM_BITS)] for p in partitions]
        self.near = {}
        for grams in self.grams:
            for gram in grams:
                share = histograms[tuple(gram)] / max(1, n)
                codes = np.arange(len(share))
                apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
                self.near[tuple(gram)] = np.stack([(share * (apart == d)).sum(1) for d in range(tau + 1)])
        self.balls = [[sum(comb(len(p), d) for d in range(t + 1)) for t in range(-1, tau + 1)] for p in partitions]

    def _flips(self, bits: list[int], d: int) -> np.ndarray:
        if comb(len(bits), d) > 200_000:
            return np.zeros(0, np.uint64)
        return np.array([sum(1 << k for k in c) for c in combinations(range(len(bits)), d)], np.uint64)

    def candidates(self, values: np.ndarray, i: int) -> np.ndarray:
        """(tau + 2, rows): estimated fingerprints within -1, 0, .. tau of each value in partition i."""
        spread = np.zeros((self.tau + 1, len(values)))
        spread[0] = 1
        for gram in self.grams[i]:
            near = self.near[tuple(gram)][:, _extract(values, gram).astype(np.int64)]
            spread = np.stack([sum(spread[a] * near[d - a] for a in range(d + 1)) for d in range(self.tau + 1)])
        return np.concatenate([np.zeros((1, len(values))), spread.cumsum(0) * self.n])

    def thresholds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the thresholds (rows, m) and their cost, by dynamic programming over the partitions."""
        top = self.tau + 1
        costs = []
        for i in range(self.m):
            cost = self.candidates(values, i) + np.array(self.balls[i])[:, None] * 1.0
            for t in range(-1, self.tau + 1):
                if t >= 0 and comb(len(self.partitions[i]), t) > 200_000:
                    cost[t + 1 :] = np.inf
                    break
            costs.append(cost)
        # best[s]: the least cost of the partitions so far whose thresholds, each plus 1, sum to s
        best, took = costs[0][: top + 1].copy(), []
        for cost in costs[1:]:
            options = np.full((top + 1, top + 1, len(values)), np.inf)
            for s in range(top + 1):
                for t in range(s + 1):
                    options[s, t] = best[s - t] + cost[t]
            took.append(options.argmin(1))
            best = options.min(1)
        s = np.full(len(values), self.budget + self.m)
        chosen, rows = np.zeros((len(values), self.m), int), np.arange(len(values))
        for i in range(self.m - 1, 0, -1):
            chosen[:, i] = took[i - 1][s, rows] - 1
            s = s - took[i - 1][s, rows]
        chosen[:, 0] = s - 1
        return chosen, best[self.budget + self.m]

    def signatures(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, value): each value in its own bucket of each partition, and in those its thresholds reach."""
        chosen, _ = self.thresholds(values)
        keys, members = [], []
        for i, bits in enumerate(self.partitions):
            own = _extract(values, bits)
            tag = np.uint64(i) << np.uint64(60)
            for d in range(self.tau + 1):
                rows = np.arange(len(values)) if d == 0 else np.flatnonzero(chosen[:, i] >= d)
                if len(rows):
                    flips = np.array([0], np.uint64) if d == 0 else self._flips(bits, d)
                    keys.append(((own[rows, None] ^ flips[None, :]) | tag).ravel())
                    members.append(np.repeat(values[rows], len(flips)))
        return np.concatenate(keys).view(np.int64), np.concatenate(members)


def spanning_links(values: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links values within tau bits: at most len(values) - 1 links."""
    left, links = values.view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= tau
            if near.any():
                found = left[near]
                links += [(int(at.view(np.int64)), int(x)) for x in found.view(np.int64)]
                queue.extend(found)
                left = left[~near]
    return links


def _links_of_runs(batches, tau: int):
    """Links within runs of equal (key, one, other) in sorted batches of key, one, other, fp."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
        last = int(cut[-1]) if len(cut) else 0
        held = [c[last:] for c in columns]
        if last:
            yield from _emit(columns[3][:last], np.concatenate([[0], cut[:-1], [last]]), tau, schema)
    if held is not None and len(held[0]):
        yield from _emit(held[3], np.array([0, len(held[3])]), tau, schema)


def _emit(values: np.ndarray, bounds: np.ndarray, tau: int, schema: pa.Schema):
    sizes = np.diff(bounds)
    run = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes <= 32
    a, b = [], []
    mine = small[run]
    for gap in range(1, int(sizes[small].max(initial=0))):
        left = np.flatnonzero((run[gap:] == run[:-gap]) & mine[:-gap])
        x, y = values[left], values[left + gap]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= tau
        a.append(x[near])
        b.append(y[near])
    for k in np.flatnonzero(~small):
        links = spanning_links(np.unique(values[bounds[k] : bounds[k + 1]]), tau)
        if links:
            pairs = np.array(links, np.int64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)


def _statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them each pair of bits is set (a 64 x 64 table)."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        cells = pa.array(np.concatenate([[n], total.ravel()]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), cells], names=["cell", "n"])

    rows = prints.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        table[r.cell] = r.n
    return int(table[0]), table[1:].reshape(BITS, BITS)


def _histograms(prints: DataFrame, grams: list[tuple[int, ...]]) -> dict[tuple[int, ...], np.ndarray]:
    """How often each value of each gram occurs: at most 256 numbers a gram."""

    def run(batches):
        counts = [np.zeros(1 << len(g), np.int64) for g in grams]
        for batch in batches:
            values = batch.column(0).to_numpy()
            for k, gram in enumerate(grams):
                counts[k] += np.bincount(_extract(values, list(gram)).astype(np.int64), minlength=1 << len(gram))
        which = np.repeat(np.arange(len(grams), dtype=np.int32), [len(c) for c in counts])
        code = np.concatenate([np.arange(len(c), dtype=np.int32) for c in counts])
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(code), pa.array(np.concatenate(counts))], names=["gram", "code", "n"])

    rows = prints.mapInArrow(run, "gram int, code int, n long").where("n > 0").groupBy("gram", "code").agg(F.sum("n").alias("n")).collect()
    out = {g: np.zeros(1 << len(g), np.int64) for g in grams}
    for r in rows:
        out[grams[r.gram]][r.code] = r.n
    return out


def allocate(prints: DataFrame, tau: int) -> Allocation:
    """Partitions from the bits' correlations, and their number from the costs that the histograms let expect."""
    n, both = _statistics(prints)
    share = both / max(1, n)
    alone = np.diag(share)
    spread = np.sqrt(np.maximum(alone * (1 - alone), 1e-9))
    correlation = np.abs(share - np.outer(alone, alone)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    plans = {m: group_bits(correlation, m) for m in range(2, tau + 2)}
    grams = sorted({tuple(p[i : i + GRAM_BITS]) for ps in plans.values() for p in ps for i in range(0, len(p), GRAM_BITS)})
    histograms = _histograms(prints, grams)
    # costs at values drawn from the marginals: they rank the plans, no result depends on them
    rng = np.random.default_rng(0)
    drawn = np.packbits(rng.random((256, BITS)) < alone, axis=1, bitorder="little").view("<i8").ravel()
    options = [Allocation(ps, histograms, n, tau) for ps in plans.values()]
    return min(options, key=lambda o: o.thresholds(drawn)[1].mean())


def near_links(prints: DataFrame, tau: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b): links of fingerprints (column fp, distinct) within tau bits that connect all that are so linked.

    Buckets of up to 32 give their links, larger ones a spanning forest. Buckets of over block are dealt out as pairs of blocks,
    each compared apart, so no task holds more than two blocks and all pairs are still met.
    """
    held = prints.sparkSession.sparkContext.broadcast(allocate(prints, tau))

    def probe(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                keys, members = held.value.signatures(values[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(members)], names=["key", "fp"])

    signed = prints.select("fp").mapInArrow(probe, "key long, fp long")
    large = Stored(signed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)).df
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = (
        signed.join(large, "key")
        .select("key", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"), "fp")
        .select("key", F.least("mine", "with").alias("one"), F.greatest("mine", "with").alias("other"), "fp")
    )
    plain = signed.join(large.select("key"), "key", "left_anti").select("key", F.lit(0).alias("one"), F.lit(0).alias("other"), "fp")
    runs = plain.unionByName(dealt).repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    return runs.mapInArrow(lambda batches: _links_of_runs(batches, tau), "a long, b long")


def _groups(printed: DataFrame, tau: int) -> DataFrame:
    """(fp, component_id, first) of rows with doc_id, row and fp: the component's least doc_id and the row that stands for it."""
    stands = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = Stored(printed.groupBy("fp").agg(F.min(stands).alias("least"))).df
    roots = connected_components(near_links(nodes, tau)).df
    members = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    # stored, so that the joins on roots and fingerprints, of which one may hold a third of all rows, are between plain shuffles, which Spark can split
    named = Stored(members.groupBy("root").agg(F.min("least").alias("named"))).df
    labels = Stored(members.join(named, "root").select("fp", "named")).df
    least = F.coalesce("named", "least")
    return Stored(nodes.join(labels, "fp", "left").select("fp", least["doc_id"].alias("component_id"), least["row"].alias("first"))).df


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tau: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), a row per row of docs.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows each keep their row; a
    null doc_id is ignored when a component is named, and a component of null ids alone has a null id;
    an empty table gives no rows; other columns play no part. Texts are read once; after that equal
    fingerprints are one row, so copies cost no links.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    printed = Stored(add_fingerprint(rows, keep=["doc_id", "row"])).df
    return printed.join(_groups(printed, tau), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def distinct_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tau: int = THRESHOLD) -> DataFrame:
    """The rows of docs, one of each component: that of the smallest doc_id (null after all others), of equal rows one."""
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("d"), quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    printed = Stored(add_fingerprint(rows, keep=["d", "doc_id", "row"])).df
    kept = _groups(printed.select("doc_id", "row", "fp"), tau).select(F.col("first").alias("row")).distinct()
    return printed.join(kept, "row", "left_semi").select(*[F.col("d")[c].alias(c) for c in docs.columns])
