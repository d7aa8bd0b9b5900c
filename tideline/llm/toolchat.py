"""Chat formatting: tool calls linked to results, ordered topologically, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stored, append_arrow

#: Conversations of up to so many references between calls are ordered within a task, larger ones by rounds of joins.
SOLO_EDGES = 100_000
#: The JSON Schema types and what Python reads them as.
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_LONE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    """Lone surrogates, which no encoding holds, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, whole floats as integers; NaN, infinities and what is nested too deep raise ValueError."""

    def plain(v):
        if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 1 << 53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    try:
        return _escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))
    except RecursionError:
        raise ValueError("nested too deep") from None


def fault(value, schema: dict, at: str = "$") -> str | None:
    """The first thing wrong with a value by a JSON Schema of type, enum, required, properties, additionalProperties, items, minimum and maximum.

    Schemas that aren't objects (as true) allow anything, but for false.
    """
    if not isinstance(schema, dict):
        return f"{at}: not allowed" if schema is False else None
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def fits(kind: str) -> bool:
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if kind == "number":
            return number
        if kind == "integer":
            return number and math.isfinite(value) and value == int(value)
        return isinstance(value, _TYPES.get(kind, object))

    if kinds and not any(map(fits, kinds)):
        return f"{at}: not of type {'|'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of range"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if found := fault(value[name], known[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def references(value) -> set[str]:
    """Ids of calls whose results arguments name, as {"$ref": id}."""
    if isinstance(value, dict):
        own = {value["$ref"]} if isinstance(value.get("$ref"), str) else set()
        return own.union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def _object(text: str | None) -> dict | None:
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def parse(text: str | None) -> tuple[str, list[dict]]:
    """(the content as canonical JSON, the calls and results that a turn holds).

    A call stands in a turn {"tool_calls": [{"id", "name", "arguments"}], "content"}, its name and arguments
    possibly within "function" and the arguments possibly as JSON text. A result is a turn
    {"tool_call_id", "content"}. All else is content. Ids and names are told apart by their JSON text.
    """
    body, items = _object(text), []
    content = text
    told = lambda x: canonical(x) if isinstance(x, str) else None
    if body is not None and isinstance(body.get("tool_calls"), list):
        content = body.get("content")
        for call in body["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            inner = call["function"] if isinstance(call.get("function"), dict) else call
            number, name, arguments, wrong, refs = told(call.get("id")), told(inner.get("name")), inner.get("arguments", {}), None, []
            if isinstance(arguments, str):
                arguments = _object(arguments)
            if number is None or name is None:
                wrong = "no id or name"
            elif not isinstance(arguments, dict):
                wrong = "arguments aren't an object"
            try:
                written = canonical(arguments)
                refs = sorted(map(canonical, references(arguments)))
            except ValueError as e:
                written, wrong = "null", wrong or ("arguments nested too deep" if "deep" in str(e) else "arguments hold no JSON number")
            except RecursionError:
                written, wrong = "null", wrong or "arguments nested too deep"
            items.append({"kind": "call", "id": number, "name": name, "wrong": wrong, "refs": refs, "args": written})
    elif body is not None and isinstance(body.get("tool_call_id"), str):
        content = body.get("content")
        items.append({"kind": "result", "id": told(body["tool_call_id"]), "name": None, "wrong": None, "refs": [], "args": None})
    try:
        written = canonical(content)
    except ValueError:
        written = canonical(text)
    return written, items


_ITEM = pa.struct([("kind", pa.string()), ("id", pa.string()), ("name", pa.string()), ("wrong", pa.string()), ("refs", pa.list_(pa.string())), ("args", pa.string())])


class _Schemas(dict):
    """Schemas by their text."""

    def __missing__(self, text: str) -> dict | bool | None:
        if len(self) > 1000:
            self.clear()
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            found = None
        self[text] = found if isinstance(found, dict | bool) else None
        return self[text]


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with wrong, where it is null, told by the schema of the call's name: one row a name, the least text if it repeats."""
    known = schemas.where("name is not null and schema is not null").groupBy(F.col("name").alias("__n")).agg(F.min("schema").alias("__schema"))

    def key():
        return lambda names: [pa.array([canonical(n) for n in names.to_pylist()], pa.string())]

    known = append_arrow(known, [F.col("__n")], "name string", key, ["__schema"])

    def make():
        read = _Schemas()

        def told(wrong, args, schema):
            if wrong is not None:
                return wrong
            if schema is None:
                return "unknown tool"
            if read[schema] is None:
                return "its schema can't be read"
            try:
                found = fault(json.loads(args), read[schema])
                return found and _escaped(found)
            except RecursionError:
                return "arguments nested too deep"

        return lambda *cells: [pa.array([told(*x) for x in zip(*[c.to_pylist() for c in cells], strict=True)], pa.string())]

    joined = calls.join(known, "name", "left")
    return append_arrow(joined, [F.col("wrong"), F.col("args"), F.col("__schema")], "wrong string", make, [c for c in calls.columns if c != "wrong"])


def _quoted_json(name: str) -> Column:
    """A string column as JSON text, null as null."""
    return F.coalesce(F.when(F.col(name).isNotNull(), F.regexp_extract(F.to_json(F.array(name)), r"^\[(.*)\]$", 1)), F.lit("null"))


def link(turns: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """A row per turn: conv_id, turn, role, n_calls, n_results, n_linked, n_invalid, level, message.

    turns: conv_id, turn, role, text; schemas: name, schema (JSON text), or None to take any arguments. A call and
    a result link if their conversation and id are equal and the result stands after the call; of repeated call ids the
    first (by turn, then place) is linked to, the others are invalid, as are results without a call or before it, references to no call and
    calls on a cycle of references. level is the topological level, the most of the turn's items': 0 for plain turns and calls without
    references, for others one over the calls they refer to; calls after which nothing can come (on a cycle) have 0. A turn's items
    stand by level, then place, and level, then turn orders a conversation. message is canonical JSON with each item's
    fault ("fault") and whether it is linked. Null texts are null content; a null conversation id links nothing;
    schemas that can't be read make their tools' calls invalid; repeated rows are turns of their own; an empty table gives
    no rows; other columns play no part.
    """

    def make():
        def run(texts):
            found = [parse(t) for t in texts.to_pylist()]
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(_ITEM))]

        return run

    schema = "content string, items array<struct<kind:string,id:string,name:string,wrong:string,refs:array<string>,args:string>>"
    read = append_arrow(turns, [F.col("text")], schema, make, ["conv_id", "turn", "role"])
    rows = Stored(read.withColumn("row", F.monotonically_increasing_id())).df
    held_items = rows.where(F.size("items") > 0).select("row", "conv_id", "turn", F.posexplode("items").alias("place", "item")).select("row", "conv_id", "turn", "place", "item.*")
    if schemas is not None:
        calls = validated(held_items.where("kind = 'call'"), schemas)
        held_items = calls.unionByName(held_items.where("kind <> 'call'"))
    items = Stored(held_items).df
    place = F.struct("turn", "row", "place")
    calls = Stored(items.where("kind = 'call' and id is not null").groupBy("conv_id", "id").agg(F.min(place).alias("first"))).df
    answers = items.where("kind = 'result'").groupBy("conv_id", "id").agg(F.max(place).alias("last"))
    levels = _levels(items, calls)
    joined = items.join(calls, ["conv_id", "id"], "left").join(answers, ["conv_id", "id"], "left").join(levels, ["conv_id", "id"], "left")
    called = F.col("kind") == "call"
    first = F.coalesce(F.col("first") == place, F.lit(False))
    after = F.coalesce(F.col("first") < place, F.lit(False))
    wrong = F.coalesce(
        "wrong",
        F.when(called & ~first & F.col("first").isNotNull(), F.lit("repeated id")),
        F.when(called & F.coalesce("dangling", F.lit(False)), F.lit("refers to no call")),
        F.when(called & F.col("first").isNotNull() & F.col("level").isNull(), F.lit("on a cycle")),
        F.when(~called & F.col("first").isNull(), F.lit("no call")),
        F.when(~called & ~after, F.lit("stands before its call")),
    )
    linked = F.when(called, first & F.coalesce(F.col("last") > F.col("first"), F.lit(False))).otherwise(after)
    text = lambda name: F.coalesce(name, F.lit("null"))
    told = joined.withColumns({"fault": wrong, "linked": linked}).select(
        "row", "place", "kind", "fault", "linked", F.coalesce("level", F.lit(0)).alias("level"),
        F.concat(
            F.lit("{"), F.when(called, F.concat(F.lit('"arguments":'), text("args"), F.lit(","))).otherwise(F.lit("")),
            F.when(F.col("fault").isNull(), F.lit("")).otherwise(F.concat(F.lit('"fault":'), _quoted_json("fault"), F.lit(","))),
            F.lit('"id":'), text("id"), F.lit(',"linked":'), F.col("linked").cast("string"),
            F.when(called, F.concat(F.lit(',"name":'), text("name"))).otherwise(F.lit("")), F.lit("}"),
        ).alias("json"),
    )
    per_turn = told.groupBy("row").agg(
        F.count_if(F.col("kind") == "call").alias("n_calls"), F.count_if(F.col("kind") == "result").alias("n_results"),
        F.count_if("linked").alias("n_linked"), F.count_if(F.col("fault").isNotNull()).alias("n_invalid"), F.max("level").alias("level"),
        F.transform(F.sort_array(F.collect_list(F.struct("level", "place", "json"))), lambda x: x["json"]).alias("written"),
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    written = F.concat(
        F.lit('{"content":'), "content",
        F.when(F.col("written").isNotNull(), F.concat(F.lit(',"items":['), F.array_join("written", ","), F.lit("]"))).otherwise(F.lit("")),
        F.lit(',"role":'), _quoted_json("role"),
        F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    return rows.join(per_turn, "row", "left").select("conv_id", "turn", "role", *map(none, ("n_calls", "n_results", "n_linked", "n_invalid", "level")), written.alias("message"))


def depths(edges: list[tuple[str, str]]) -> dict[str, int]:
    """The level of each call of edges (id, what it refers to): one over the greatest it refers to; calls on or behind a cycle have none."""
    open_refs: dict[str, int] = defaultdict(int)
    used_by: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        open_refs[a] += 1
        used_by[b].append(a)
    level = {b: 0 for b in used_by if b not in open_refs}
    ready = list(level)
    for b in ready:
        for a in used_by.get(b, ()):
            level[a] = max(level.get(a, 0), level[b] + 1)
            open_refs[a] -= 1
            if not open_refs[a]:
                ready.append(a)
    done = set(ready)
    return {k: v for k, v in level.items() if k in done}


def _solo_levels(edges: DataFrame) -> DataFrame:
    """(conv_id, id, level) of the calls of edges, conversation by conversation."""

    def run(batches):
        now, held = None, []

        def solved():
            found = depths(held)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(found), edge_type), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], names=["conv_id", "id", "level"])

        edge_type = None
        for batch in batches:
            edge_type = batch.column(0).type
            for conversation, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conversation != now and held:
                    yield solved()
                    held = []
                now = conversation
                held.append((a, b))
        if held:
            yield solved()

    kind = edges.schema["conv_id"].dataType.simpleString()
    return edges.repartition("conv_id").sortWithinPartitions("conv_id").select("conv_id", "id", "ref").mapInArrow(run, f"conv_id {kind}, id string, level int")


def _levels(items: DataFrame, calls: DataFrame) -> DataFrame:
    """(conv_id, id, level, dangling) of every call id; level is null on cycles and behind them.

    Conversations of up to SOLO_EDGES references are solved whole. Of larger ones each round settles a level:
    the calls all of whose references have one; it writes that level and the references that are still open.
    """
    edges = items.where("kind = 'call' and id is not null").select("conv_id", "id", F.explode("refs").alias("ref")).distinct()
    known = calls.select("conv_id", F.col("id").alias("ref"), F.lit(True).alias("known"))
    marked = Stored(edges.join(known, ["conv_id", "ref"], "left")).df
    good = marked.where("known").select("conv_id", "id", "ref")
    sizes = Stored(good.groupBy("conv_id").agg(F.count("*").alias("n"))).df
    large = sizes.where(F.col("n") > SOLO_EDGES).select("conv_id")
    levels = _solo_levels(good.join(large, "conv_id", "left_anti"))
    open_edges = Stored(good.join(large, "conv_id", "left_semi"))
    waiting = open_edges.df.select("conv_id", "id").distinct()
    settled = Stored(open_edges.df.select("conv_id", F.col("ref").alias("id")).distinct().join(waiting, ["conv_id", "id"], "left_anti")).df
    level = 0
    while settled.limit(1).count():
        levels = levels.unionByName(settled.withColumn("level", F.lit(level)))
        following = Stored(open_edges.df.join(settled.withColumnRenamed("id", "ref"), ["conv_id", "ref"], "left_anti"))
        still = following.df.select("conv_id", "id").distinct()
        settled = Stored(open_edges.df.select("conv_id", "id").distinct().join(still, ["conv_id", "id"], "left_anti")).df
        open_edges.drop()
        open_edges, level = following, level + 1
    dangling = marked.where("known is null").select("conv_id", "id").distinct().withColumn("dangling", F.lit(True))
    referring = good.select("conv_id", "id").distinct().withColumn("refers", F.lit(True))
    told = calls.select("conv_id", "id").join(levels, ["conv_id", "id"], "left").join(dangling, ["conv_id", "id"], "left").join(referring, ["conv_id", "id"], "left")
    return told.select("conv_id", "id", F.when(F.col("refers").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"), "dangling")
