"""Personal data by base patterns and bootstrapped contextual extraction. Built of DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Stored, quoted

#: Parts matches from the text around them. A text's own U+FFFF reads as U+FFFD, which no pattern tells apart.
MARK = "\uffff"
#: The base kinds, and, after them, what only contexts can confirm.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: The base patterns. Runs are taken whole (possessive, from their start or the last match on), so none is scanned twice.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without it has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Stretches without white space that hold a digit or an at sign may be identifiers.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Least digits of a candidate without an at sign.
CANDIDATE_DIGITS = 6
#: Seeds of the kind secret: hexadecimal keys of 128 bits or more. They are no spans unless a context confirms them.
SECRET = r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}$"
#: How much text on either side of an identifier its context is read from.
CONTEXT_CHARS = 64
ROUNDS = 3
#: Least distinct instances of a pattern, its least precision, and least confidence of a new identifier.
SUPPORT = 5
PRECISION = 0.9
CONFIDENCE = 0.8
#: Texts are redacted in blocks of so many characters.
BLOCK = 16_384


def _sums(lengths: Column) -> Column:
    """Where each part begins, given the parts' lengths. In two levels of 256: one array that grows part by part costs its square."""
    empty, nested = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def add(s, x):
        return F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def add_slice(s, part):
        inner = F.aggregate(part, F.struct(s["at"].alias("at"), empty.alias("out")), add)
        joined = F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))
        return joined[0]

    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda k: F.slice(lengths, k * 256 + 1, 256))
    return F.aggregate(slices, F.struct(F.lit(0).alias("at"), nested.alias("out")), add_slice, lambda s: F.flatten(s["out"]))


_MATCH = "start:int,end:int,value:string,before:string,after:string"


def _matches(parts: Column) -> Column:
    """Matches (start, end, value, before, after) from a text split at the marks: the parts with odd index.

    parts is used as a column of its own, once in each argument, so it isn't computed again for every part. The text's
    own start and end count as ends of lines.
    """
    starts = _sums(F.transform(parts, lambda p: F.length(p)))
    before, after = F.concat(F.array(F.lit("")), parts), F.concat(parts, F.array(F.lit("")))
    zipped = F.arrays_zip(parts.alias("value"), starts.alias("start"), F.slice(before, 1, F.size(parts)).alias("before"), F.slice(after, 2, F.size(parts)).alias("after"))
    odd = F.filter(zipped, lambda x, i: i % 2 == 1)
    made = F.transform(odd, lambda x, i: F.struct(
        x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
        F.concat(F.when(i == 0, F.lit("\n")).otherwise(F.lit("")), F.right(x["before"], F.lit(CONTEXT_CHARS))).alias("before"),
        F.concat(F.left(x["after"], F.lit(CONTEXT_CHARS)), F.when(i == (F.size(parts) - 3) / 2, F.lit("\n")).otherwise(F.lit(""))).alias("after"),
    ))
    return F.when(F.size(parts) > 1, made).otherwise(F.array().cast(f"array<struct<{_MATCH}>>"))


def _marked(text: Column, pattern: str, needs: str | None = None) -> Column:
    parts = F.split(F.regexp_replace(text, f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK)
    return parts if needs is None else F.when(F.contains(text, F.lit(needs)), parts).otherwise(F.array(F.lit("")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, its own digits summed."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    n = F.length(digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), luhn(digits(value))).otherwise(False)


def _tagged(i: int, kind: str) -> Column:
    """The valid matches of a kind, so ordered that sorting goes by start, then kind."""
    return F.transform(F.filter(f"m_{kind}", lambda m: _valid(kind, m["value"])), lambda m: F.struct(
        m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"),
    ))


def _count_of(i: int, kind: str) -> Column:
    return F.size(F.filter("__base", lambda b: b["kind"] == i)).cast("long").alias(f"n_{kind}")


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> Stored:
    """keep, a row number, base (valid base spans with kind, value and context) and candidates (other likely stretches).

    One pass over the texts; what follows reads this table.
    """
    kept = docs.columns if keep is None else keep
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, "�")
    whole = F.coalesce(F.col(text), F.lit(""))
    clean = F.when(F.contains(whole, F.lit(MARK)), clean).otherwise(whole)
    rows = docs.select(*[quoted(c).alias(f"k_{c}") for c in kept], clean.alias("t"))
    split = rows.select(
        *[quoted(f"k_{c}") for c in kept],
        *[_marked(F.col("t"), PATTERNS[k], NEEDS[k]).alias(f"p_{k}") for k in KINDS],
        F.when(F.col("t").rlike("[0-9@]"), _marked(F.col("t"), CANDIDATE)).otherwise(F.array(F.lit(""))).alias("p_other"),
    )
    found = split.select(*[quoted(f"k_{c}") for c in kept], *[_matches(F.col(f"p_{k}")).alias(f"m_{k}") for k in (*KINDS, "other")])
    tagged = [_tagged(i, k) for i, k in enumerate(KINDS)]
    likely = F.filter("m_other", lambda m: m["value"].contains("@") | (F.length(digits(m["value"])) >= CANDIDATE_DIGITS))
    numbered = found.select(
        *[quoted(f"k_{c}") for c in kept], F.monotonically_increasing_id().alias("row"), F.sort_array(F.concat(*tagged)).alias("base"), likely.alias("candidates")
    )
    return Stored(numbered)


def occurrences(found: DataFrame) -> DataFrame:
    """(row, start, end, instance, kind, seed, before, after): valid base spans, and candidates that none of them overlaps.

    Overlaps are seen in the order of starts, by how far the base spans before reach and where the next one begins.
    """
    held = found.where((F.size("base") > 0) | (F.size("candidates") > 0))
    base = held.select("row", F.inline("base")).select("row", "start", "end", F.lower("value").alias("instance"), "kind", F.lit(1.0).alias("seed"), "before", "after")
    core = F.regexp_extract("value", r"^[^\p{L}0-9+]*(.*?)[^\p{L}0-9]*$", 1)
    lead = F.length("value") - F.length(F.regexp_replace("value", r"^[^\p{L}0-9+]+", ""))
    others = held.select("row", F.inline("candidates")).select("row", F.lower(core).alias("instance"), (F.col("start") + lead).alias("start"), F.length(core).alias("length"), "before", "after")
    secret = F.col("instance").rlike(SECRET)
    others = others.select(
        "row", "start", (F.col("start") + F.col("length")).alias("end"), "instance",
        F.when(secret, len(KINDS)).cast("int").alias("kind"), F.when(secret, 1.0).otherwise(0.0).alias("seed"), "before", "after",
    )
    is_base = F.col("kind").isNotNull() & (F.col("kind") < len(KINDS))
    order = Window.partitionBy("row").orderBy("start", F.when(is_base, 0).otherwise(1), "end")
    reach = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    overlapped = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("following") < F.col("end"), F.lit(False))
    return base.unionByName(others).withColumns({"reach": reach, "following": following}).where((is_base | ~overlapped) & (F.col("instance") != "")).drop("reach", "following")


def shape(instance: Column) -> Column:
    """What an identifier looks like: its length if it is of digits alone, 'hex' or 'mixed' for long runs, else its runs of letters as a and of digits as 9."""
    runs = F.regexp_replace(F.regexp_replace(instance, r"\p{L}+", "a"), "[0-9]+", "9")
    return (
        F.when(instance.rlike("^[0-9]+$"), F.concat(F.lit("9x"), F.length(instance).cast("string")))
        .when(instance.rlike("^[0-9a-f]{12,}$"), F.lit("hex")).when(instance.rlike("^[0-9a-z_-]{12,}$"), F.lit("mixed")).otherwise(F.left(runs, F.lit(24)))
    )


def patterns_of(before: Column, after: Column, instance: Column) -> Column:
    """The lexical patterns that an occurrence stands in: the word or two before it, the word after, both sides, and these with its shape.

    Words are lowered and of the same line: ^ and $ stand for its ends, # for another identifier beside it.
    """
    line, next_line = F.lower(F.regexp_extract(before, r"([^\n\x0B-\x0D]*)$", 1)), F.lower(F.regexp_extract(after, r"^([^\n\x0B-\x0D]*)", 1))
    edge = F.when(before.rlike(r"[\n\x0B-\x0D]"), F.lit("^")).otherwise(F.lit("#"))
    last = F.regexp_extract(line, r"([^\x20\x09]+)[\x20\x09]*$", 1)
    two = F.regexp_extract(line, r"([^\x20\x09]+[\x20\x09]+[^\x20\x09]+)[\x20\x09]*$", 1)
    first = F.regexp_extract(next_line, r"^[^\x20\x09]*[\x20\x09]+([^\x20\x09]+)", 1)
    left, right = F.when(last == "", edge).otherwise(last), F.when(first == "", F.when(after.rlike(r"[\n\x0B-\x0D]"), F.lit("$")).otherwise(F.lit("#"))).otherwise(first)
    pair = F.when(two == "", F.concat(edge, F.lit(" "), left)).otherwise(F.regexp_replace(two, r"[\x20\x09]+", " "))
    like = shape(instance)
    told = lambda name, *cells: F.concat_ws("\t", F.lit(name), *cells)
    return F.array(told("l", left), told("ll", pair), told("r", right), told("l_r", left, right), told("l_s", left, like), told("ll_s", pair, like), told("s_r", like, right))


def bootstrap(found: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """(row, start, end, kind): identifiers beyond the base, found by the patterns that seeds stand in.

    Nodes are patterns and instances (the identifier's lowered text), an edge is that they met. Seeds, of
    confidence 1, are base identifiers and long hexadecimal keys. In each round a pattern's precision is the sum of its distinct
    instances' confidence, and 1, by their number, and 2 (so small numbers prove little), and an instance's
    confidence is 1 less the product of its good patterns' errors; a pattern is good if it has SUPPORT instances and PRECISION.
    Every occurrence of an instance of CONFIDENCE or more that no base span overlaps is taken, with the kind that
    most seeds of its most precise pattern have (of equals the first). Keys in no good pattern are no spans.
    """
    seen = Stored(occurrences(found)).df
    met = seen.select("instance", "kind", "seed", F.explode(F.array_distinct(patterns_of(F.col("before"), F.col("after"), F.col("instance")))).alias("pattern"))
    edges = Stored(met.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min("kind").alias("kind"))).df
    graph, patterns, lifted = edges.withColumn("confidence", F.col("seed")), None, None
    for _ in range(rounds):
        by_kind = [F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(ALL_KINDS))]
        scored = graph.groupBy("pattern").agg(F.count("*").alias("n"), ((F.sum("confidence") + 1) / (F.count("*") + 2)).alias("precision"), *by_kind)
        most = F.greatest(*[F.col(f"k{k}") for k in range(len(ALL_KINDS))])
        kind = F.coalesce(*[F.when(F.col(f"k{k}") == most, k) for k in range(len(ALL_KINDS))])
        good = scored.where((F.col("n") >= SUPPORT) & (F.col("precision") >= PRECISION) & (most > 0))
        patterns = Stored(good.select("pattern", "precision", kind.alias("told"))).df
        error = F.greatest(1 - F.col("precision"), F.lit(1e-9))
        lifted = Stored(edges.join(patterns, "pattern").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log(error)))).alias("lifted"), F.max_by("told", F.struct("precision", -F.col("told"))).alias("told")
        )).df
        graph = edges.join(lifted, "instance", "left").withColumn("confidence", F.greatest("seed", F.coalesce("lifted", F.lit(0.0))))
    taken = lifted.where(F.col("lifted") >= CONFIDENCE).select("instance", "told")
    beyond = seen.where(F.col("kind").isNull() | (F.col("kind") >= len(KINDS)))
    return beyond.join(taken, "instance").select("row", "start", "end", F.coalesce("kind", "told").alias("kind"))


def _text_of(spans: Column) -> Column:
    name = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def detect(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns) plus n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans and span_list for each row.

    The first five tell of base spans alone, the others of all. Null and empty texts have no span; an empty table
    gives no rows; repeated rows give equal rows; spans are code points, the end exclusive, by start, then kind.
    span_list holds (start, kind number, end) of all spans. Columns with these names are replaced.
    """
    new = {"n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "span_list"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    found = find(docs, text, kept).df
    # written first: Spark then knows its size, and moves the texts only if it is too large to broadcast
    more = Stored(bootstrap(found).groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))).df
    bare = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    joined = found.drop("candidates").join(more, "row", "left").select(
        *[quoted(f"k_{c}").alias(c) for c in kept], bare.alias("__base"), F.sort_array(F.concat(bare, F.coalesce("more", empty))).alias("span_list")
    )
    return joined.select(
        *map(quoted, kept),
        *[_count_of(i, k) for i, k in enumerate(KINDS)],
        F.sha2(_text_of(F.col("__base")), 256).alias("base_sha256"),
        _text_of(F.col("span_list")).alias("spans"),
        F.size("span_list").cast("long").alias("n_spans"),
        "span_list",
    )


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Each span of span_list (as detect gives it, text kept) replaced by its kind in brackets; spans that overlap are one, of the first's kind.

    A text is taken in blocks, so that long ones cost no square; a span's name stands in the block where it begins.
    """
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])

    def cleaned(block: Column, number: Column) -> Column:
        low = number * BLOCK
        high = low + F.length(block)
        mine = F.filter("span_list", lambda s: (s["start"] < high) & (s["end"] > low))
        start = F.struct(low.alias("at"), F.array().cast("array<string>").alias("out"))

        def step(s, x):
            reach = F.least(x["end"], high)
            gap = F.substr(block, s["at"] - low + 1, x["start"] - s["at"])
            fresh = F.struct(reach.alias("at"), F.concat(s["out"], F.array(gap, F.get(name, x["kind"]))).alias("out"))
            return F.when(x["start"] >= s["at"], fresh).otherwise(F.struct(F.greatest(s["at"], reach).alias("at"), s["out"].alias("out")))

        return F.aggregate(mine, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(block, s["at"] - low + 1, F.length(block))))

    blocks = F.regexp_extract_all(quoted(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    done = F.when(F.size("span_list") > 0, F.array_join(F.transform(blocks, cleaned), "")).otherwise(quoted(text))
    return found.withColumn(text, done)
