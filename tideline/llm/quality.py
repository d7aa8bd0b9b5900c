"""Quality rules whose cutoffs are certified on labelled documents. Built of DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Stored, quoted

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Share of good documents that may be rejected in a stratum, and the chance that any stratum exceeds it.
ALPHA = 0.02
DELTA = 0.05
#: One labelled document in so many fits the score; the others, held out, certify its cutoffs.
FIT_PART = 4
#: Metrics are told apart by ceil(sqrt(value) * BINS); the weight of a bin is that of PRIOR documents of the usual mixture and those in it.
BINS = 20
PRIOR = 2.0
#: Cutoffs are multiples of 1 / STEPS of the joint score, from -GREATEST to GREATEST.
STEPS = 4
GREATEST = 40
#: Bad documents that one good one outweighs when a certified cutoff is chosen.
GOOD_WEIGHT = 50
#: Most strata whose cutoffs are broadcast; more are joined by shuffle.
BROADCAST_STRATA = 10_000

#: SQL of metrics of 0 to 1 of which more is worse, from the features below.
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "bangs": "n_bangs / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "least(1.0D, word_chars / greatest(n_words, 1) / 50.0D)",
}


def _repeat_words() -> Column:
    """Words in windows that occur twice or more, from hashes (column __h: one a window, in order).

    The windows are sorted by hash; neighbours that are equal give the places, whose reach is then summed. Windows of
    equal 64-bit hash pass as equal, their words aren't compared: in a text of a million words one pair in 40 million
    texts collides.
    """
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size("__h")
    twins = F.zip_with(
        F.slice(placed, 1, n - 1), F.slice(placed, 2, n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    places = F.sort_array(F.array_distinct(F.flatten(twins)))
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("total"))
    step = lambda s, i: F.struct((i + WINDOW).alias("reach"), (s["total"] + i + WINDOW - F.greatest(i, s["reach"])).alias("total"))
    covered = F.aggregate(places, start, step, lambda s: s["total"])
    return F.when(n > F.size(F.array_distinct("__h")), covered).otherwise(0).cast("long")


def features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep plus n_words, word_chars, n_symbols, n_bangs, n_capitals, n_lines, n_dup_lines, n_repeat_words.

    Null counts as empty: no words, no lines. Columns of keep with these names are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_bangs", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*map(quoted, kept), whole.alias("__t"), F.array_remove(F.split(whole, SPACE), "").alias("__w"))
    count = lambda pattern: F.regexp_count("__t", F.lit(pattern)).cast("long")
    counted = split.select(
        *map(quoted, kept),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count("[!?]").alias("n_bangs"),
        count(r"\p{Lu}").alias("n_capitals"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD)).alias("__l"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__x"),
    )
    room = F.greatest(F.size("__x") - (WINDOW - 1), F.lit(0))
    tuples = F.arrays_zip(*[F.slice("__x", k + 1, room) for k in range(WINDOW)])
    hashed = counted.select(
        *map(quoted, kept), *new[:5],
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.transform(tuples, lambda t: F.xxhash64(t)).alias("__h"),
    )
    return hashed.select(*map(quoted, kept), *new[:7], _repeat_words().alias("n_repeat_words"))


def binomial_at_most(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k), X binomial of n and p: exact, its terms by their ratio; 1 where k is over the mean (it is then over 1/4)."""
    first = n * F.log(1 - p)
    odds = F.log(p / (1 - p))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(s, j):
        log = s["log"] + F.log((n - j + 1) / j) + odds
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(terms, start, step, lambda s: F.least(s["sum"], F.lit(1.0))))


def _bin(metric: str) -> Column:
    return F.ceil(F.sqrt(F.greatest(F.least(F.expr(metric).cast("double"), F.lit(1.0)), F.lit(0.0))) * BINS).cast("int")


def weights(labelled: DataFrame) -> dict[str, list[float]]:
    """Of each rule the weight of each bin, from rows of good (boolean) and the features: how much it raises the log odds of a bad document.

    Weights never fall from a bin to the next: neighbouring bins whose shares of bad documents do are pooled.
    Bins without documents have the weight of the bin below. The driver gets RULES x BINS numbers.
    """
    metrics = F.array(*[F.struct(F.lit(k).alias("rule"), _bin(v).alias("bin")) for k, v in RULES.items()])
    counts = labelled.select("good", F.inline(metrics)).groupBy("rule", "bin").agg(F.count_if(~F.col("good")).alias("bad"), F.count("*").alias("n")).collect()
    return {k: monotone_weights({r.bin: (r.bad, r.n) for r in counts if r.rule == k}) for k in RULES}


def monotone_weights(counts: dict[int, tuple[int, int]]) -> list[float]:
    """The weights of bins 0 to BINS, from (bad, all) documents by bin."""
    bad, n = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not bad or bad == n:
        return [0.0] * (BINS + 1)
    share, pools = bad / n, []
    for k in sorted(counts):
        pools.append([k, *counts[k]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, b, m = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + b, pools[-1][2] + m]
    out, logit = [], lambda p: math.log(p / (1 - p))
    for k in range(BINS + 1):
        mine = [x for x in pools if x[0] <= k] or pools[:1]
        out.append(logit((mine[-1][1] + PRIOR * share) / (mine[-1][2] + PRIOR)) - logit(share))
    return out


def joint_score(held: dict[str, list[float]]) -> Column:
    """The sum of the weights of a row's bins."""
    cells = [F.get(F.array(*map(F.lit, held[k])), _bin(v)) for k, v in RULES.items()]
    return sum(cells[1:], cells[0])


def cutoffs(labelled: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoff, n_good, n_rejected, n_caught) from held-out rows of stratum, good (boolean) and score: reject above cutoff.

    In a stratum cutoffs are tested from the greatest down until one fails: "a good document is rejected with
    probability alpha or more" must be refuted, by the exact binomial tail, at level delta / strata. Testing in
    that fixed order needs no further correction, the division is Bonferroni's over strata. So with chance 1 - delta no
    stratum loses over alpha of its good documents. Of the certified cutoffs that is taken which rejects most
    bad documents less GOOD_WEIGHT times the good ones, the highest of equals. Strata with so few good documents that
    nothing can be certified are tested together, as one, and the bound holds for them as one; if
    these are too few, too, they have no row and reject nothing.
    """
    sizes = Stored(labelled.groupBy("stratum").agg(F.count_if("good").alias("n"))).df
    strata = max(1, sizes.count())
    least = math.log(delta / strata) / math.log(1 - alpha)
    groups = sizes.select("stratum", F.when(F.col("n") >= least, F.concat(F.lit("="), "stratum")).otherwise("small").alias("group"))
    if strata <= BROADCAST_STRATA:
        groups = F.broadcast(groups)
    step = F.least(F.greatest(F.ceil(F.col("score") * STEPS), F.lit(-GREATEST * STEPS)), F.lit(GREATEST * STEPS)).cast("int")
    counts = labelled.join(groups, "stratum").groupBy("group", step.alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    grid = counts.groupBy("group").agg(F.sum("good").alias("n")).select("group", "n", F.explode(F.sequence(F.lit(-GREATEST * STEPS), F.lit(GREATEST * STEPS))).alias("bin"))
    above = Window.partitionBy("group").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    rejected = grid.join(counts, ["group", "bin"], "left").select(
        "group", "n", "bin", F.coalesce(F.sum("good").over(above), F.lit(0)).alias("k"), F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("caught")
    )
    passed = rejected.withColumn("passed", binomial_at_most(F.col("k"), F.col("n"), F.lit(alpha)) <= delta / strata)
    down = Window.partitionBy("group").orderBy(F.desc("bin"))
    gain = F.col("caught") - GOOD_WEIGHT * F.col("k")
    certified = passed.withColumn("held", F.min("passed").over(down)).where("held").groupBy("group")
    best = certified.agg(F.max_by(F.struct("bin", "n", "k", "caught"), F.struct(gain, "bin")).alias("x"))
    return groups.join(best, "group").select(
        "stratum", (F.col("x.bin") / STEPS).alias("cutoff"), F.col("x.n").alias("n_good"), F.col("x.k").alias("n_rejected"), F.col("x.caught").alias("n_caught")
    )


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality") -> DataFrame:
    """doc_id, the base features, base_failed, kept and quality_score (more is worse) for every row of docs.

    A base failure is under 10 words or over a fifth of the words in repeated windows; kept is false then, or if the joint score
    of the rules is over its stratum's cutoff. One labelled document in FIT_PART (by hashed id) fits the score, over all
    strata, the others certify the cutoffs. Null and empty texts fail the base; a null stratum is one of its own; labels
    that are null or neither 0 nor 1 don't count, of repeated labels the smaller holds; repeated rows are judged alike; with
    no labels, or in a stratum without any, the base alone decides; an empty table gives no rows; columns of other
    names play no part.
    """
    named = F.coalesce(F.concat(F.lit("="), quoted(stratum).cast("string")), F.lit(""))
    rows = docs.select(quoted(doc_id).alias("doc_id"), named.alias("stratum"), quoted(text).alias("text"))
    known = Stored(features(rows, keep=["doc_id", "stratum"])).df
    marks = labels.where(quoted(label).isin(0, 1)).groupBy(quoted(doc_id).alias("doc_id")).agg((F.min(label) == 1).alias("good"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    labelled = Stored(known.where(~base).join(marks, "doc_id").withColumn("fits", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FIT_PART)) == 0)).df
    score = joint_score(weights(labelled.where("fits")))
    limits = Stored(cutoffs(labelled.where("not fits").select("stratum", "good", score.alias("score")))).df
    chosen = limits.select("stratum", "cutoff")
    if limits.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    return known.join(chosen, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~F.coalesce(score > F.col("cutoff"), F.lit(False))).alias("kept"), score.alias("quality_score"),
    )
