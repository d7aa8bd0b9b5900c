"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bloomlm, crf, decontam, packing, pii, quality, simhash, sql, toolchat, toxicity, warc
from tideline.llm.common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    model = toxicity.learn(docs.where("not held_out"), read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


#: The tools that calls may name, with their arguments' schemas.
TOOLS = {
    "find": {
        "type": "object", "required": ["n", "q"], "additionalProperties": False,
        "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1, "maximum": 100}, "after": {"type": "object"}},
    },
    "run": {"type": "object", "required": ["code"], "properties": {"code": {"type": "string"}, "seconds": {"type": "number", "minimum": 0}}},
}


def _tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in TOOLS.items()], "name string, schema string")


def op3_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolchat.link(read_table(spark, sf_dir, "conversations"), _tools(spark))


def made_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator on calls made of the conversations, which hold none.

    Of three turns the first calls a tool (each call referring to the one three turns before), the second is the result and
    the third plain text. Tools of every fifth conversation are unknown, some numbers out of range, some results come for calls that there are not.
    """
    turns = read_table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "length(coalesce(text, '')) as n")
    call = """concat('{"tool_calls":[{"id":"c', turn, '","name":"', if(conv_id % 5 = 4, 'nosuch', 'find'), '","arguments":{"q":"w', n, '","n":', n % 7,
        if(turn >= 3, concat(',"after":{"$ref":"c', turn - 3, '"}'), ''), '}}]}')"""
    answer = """concat('{"tool_call_id":"', if(n % 11 = 0, 'x', 'c'), turn - 1, '","content":"', n, '"}')"""
    made = f"case turn % 3 when 0 then {call} when 1 then {answer} else concat('plain ', n) end"
    return toolchat.link(turns.selectExpr("conv_id", "turn", "role", f"{made} as text"), _tools(spark))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(_remainder(7) == 2, F.lit(False)))
    return bloomlm.score_marked(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    field = crf.learn(docs.where("not held_out"))
    return crf.identify(docs.drop("lang"), field, keep=["doc_id", "held_out"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(read_table(spark, sf_dir, "pages")).df)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("span_list")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontam.digest(found)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_tool_chat, op4_bloom_lm, op5_language, op6_packing, op7_warc, op8_pii, op9_decontamination, op10_quality, made_tool_calls)}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": sql.OP7, "op9_decontamination": sql.OP9, "made_tool_calls": sql.MADE_TOOL_CALLS}
