"""Tool-call linking on small conversations."""

import json

from tideline.llm import toolchat

SCHEMA = {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}, "additionalProperties": False}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def linked(spark, rows, schemas=True):
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    known = spark.createDataFrame([("find", json.dumps(SCHEMA))], "name string, schema string") if schemas else None
    return {(r.conv_id, r.turn): r for r in toolchat.link(turns, known).collect()}


def test_links_levels_and_faults(spark):
    got = linked(spark, [
        (1, 0, "user", "hi\n\"there\""),
        (1, 1, "assistant", call(("a,1", "find", {"q": "x", "n": 2.0}), ("b", "find", {"q": {"$ref": "a,1"}}))),
        (1, 2, "tool", result("a,1")),
        (1, 3, "tool", result("zzz")),
        (1, 4, "assistant", call(("c", "find", {"n": 0, "q": "y"}), ("d", "find", {"q": {"$ref": "nope"}}), ("a,1", "find", {"q": "z"}))),
        (2, 0, "assistant", call(("x", "other", {"$ref": "y"}), ("y", "other", {"v": [{"$ref": "x"}]}))),
        (None, 0, "tool", result("a,1")),
        (3, None, None, None),
    ])
    one = json.loads(got[1, 1].message)
    assert [x["id"] for x in one["items"]] == ["a,1", "b"]
    assert one["items"][0] == {"arguments": {"n": 2, "q": "x"}, "id": "a,1", "linked": True, "name": "find"}
    assert one["items"][1]["fault"].startswith("$.q: not of type")
    assert got[1, 1].level == 1 and got[1, 1].n_linked == 1
    assert got[1, 2].n_linked == 1 and got[1, 2].n_invalid == 0
    assert json.loads(got[1, 3].message)["items"][0]["fault"] == "no call"
    faults = [x["fault"] for x in json.loads(got[1, 4].message)["items"]]
    assert faults == ["$.n: out of range", "$.q: not of type string", "repeated id"]
    assert got[2, 0].n_invalid == 2
    assert got[None, 0].n_linked == 0
    assert got[3, None].message == '{"content":null,"role":null,"turn":null}'
    assert json.loads(got[1, 0].message)["content"] == 'hi\n"there"'


def test_messages_are_canonical(spark):
    got = linked(spark, [(1, 0, "assistant", call(("b", "t", {"z": 1, "a": {"d": 2.50, "c": "é"}})))], schemas=False)
    assert got[1, 0].message == '{"content":null,"items":[{"arguments":{"a":{"c":"é","d":2.5},"z":1},"id":"b","linked":false,"name":"t"}],"role":"assistant","turn":0}'


def test_chains_and_cycles(spark):
    chain = [(1, i, "assistant", call((f"c{i}", "t", {"v": {"$ref": f"c{i - 1}"}} if i else {}))) for i in range(5)]
    cycle = [(2, 0, "assistant", call(("x", "t", {"v": {"$ref": "y"}}))), (2, 1, "assistant", call(("y", "t", {"v": {"$ref": "x"}})))]
    got = linked(spark, chain + cycle, schemas=False)
    assert [got[1, i].level for i in range(5)] == [0, 1, 2, 3, 4]
    assert "on a cycle" in got[2, 0].message and "on a cycle" in got[2, 1].message


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string, level string, message string")
    assert toolchat.link(empty).collect() == []


def test_odd_json_does_not_crash(spark):
    deep = "[" * 3000 + "]" * 3000
    huge = '{"tool_calls":[{"id":"a","name":"find","arguments":{"q":"x","n":1e400}}]}'
    got = linked(spark, [
        (1, 0, "assistant", huge),
        (1, 1, "assistant", '{"tool_calls":[{"id":"b","name":"find","arguments":{"q":"x","n":Infinity}}]}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"c","name":"find","arguments":{"q":' + deep + "}}]}"),
        (1, 3, "assistant", '{"tool_calls":[],"content":' + deep + "}"),
        (1, 4, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"\\udfff","arguments":{"\\ud801":{"$ref":"\\ud800"}}}]}'),
        (1, 5, "tool", '{"tool_call_id":"\\ud800","content":"\\ud800 \u00e9"}'),
        (1, 6, "tool", '{"tool_call_id":"d","content":1}'),
        (1, 7, "assistant", '{"tool_calls":[{"id":"d","name":"find","arguments":{"q":"x"}}, 5, null]}'),
    ])
    assert [got[1, i].n_invalid for i in range(3)] == [1, 1, 1]
    for i in range(8):
        json.loads(got[1, i].message) if i != 3 else None
    assert got[1, 5].n_linked == 1 and got[1, 4].n_invalid == 1 and '"\\ud800"' in got[1, 5].message
    assert "stands before its call" in got[1, 6].message and got[1, 6].n_linked == got[1, 7].n_linked == 0
    assert got[1, 7].n_calls == 3 and got[1, 7].n_invalid == 2


def test_items_stand_in_topological_order(spark):
    got = linked(spark, [(1, 0, "assistant", call(("a", "t", {"v": {"$ref": "b"}}), ("b", "t", {"v": {"$ref": "c"}}), ("c", "t", {})))], schemas=False)
    assert [x["id"] for x in json.loads(got[1, 0].message)["items"]] == ["c", "b", "a"] and got[1, 0].level == 2


def test_large_conversations_go_by_rounds(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = []
    for conv in range(3):
        for i in range(14):
            refs = {f"r{k}": {"$ref": f"c{rng.randrange(14)}" if conv == 2 else f"c{rng.randrange(i)}"} for k in range(2)} if i else {}
            rows.append((conv, i, "assistant", call((f"c{i}", "t", refs))))
    solo = linked(spark, rows, schemas=False)
    monkeypatch.setattr(toolchat, "SOLO_EDGES", 3)
    assert linked(spark, rows, schemas=False) == solo
    assert toolchat.depths([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x")]) == {"a": 0, "b": 1, "c": 2}


def test_unreadable_and_repeated_schemas(spark):
    turns = spark.createDataFrame([(1, 0, "a", call(("x", "bad", {}), ("y", "two", {"v": 1}), ("z", "none", {})))], "conv_id long, turn int, role string, text string")
    known = spark.createDataFrame([("bad", "{"), ("two", '{"type":"object"}'), ("two", '{"type":"string"}'), (None, "{}"), ("n", None)], "name string, schema string")
    faults = [x.get("fault") for x in json.loads(toolchat.link(turns, known).first().message)["items"]]
    assert faults == ["its schema can't be read", None, "unknown tool"]
