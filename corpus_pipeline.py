"""The corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import crf, decontam, packing, pii, simhash
from tideline.llm.common import Stored, quoted, read_table

#: Least mean, over a document's words, of the greatest posterior: how well the learned languages explain it. Code-switched texts stay,
#: and single words that two languages share evenly (0.5) do, too.
LANGUAGE_CERTAINTY = 0.4


def _whole(docs: DataFrame) -> DataFrame:
    """A document's columns as one, d, beside its text: what an operator adds can't clash with them."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("d"), "text")


def _parts(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of d again."""
    return found.select(*[F.col("d")[c].alias(c) for c in columns])


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that the learned languages don't explain (LANGUAGE_CERTAINTY), go."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*map(quoted, others)).alias("d"), "text")  # texts go to Python and back once, not twice
    told = crf.identify(rows, crf.learn(docs), keep=["d", "text"])
    told = told.where((F.col("lang_pred") != crf.UNDETERMINED) & (F.col("certainty") >= LANGUAGE_CERTAINTY))
    return told.select(*[F.col("text") if c == "text" else F.col("d")[c].alias(c) for c in docs.columns])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest doc_id stays."""
    return simhash.distinct_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words 1 in 20 or more lie in benchmark passages go."""
    found = decontam.find_contamination(_whole(docs), read_table(spark, sf_dir, "benchmark"), keep=["d"])
    return _parts(found.where("not contaminated"), docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets, and n_chars follows."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*map(quoted, others), F.lit(0).alias("__")).alias("d"), "text")
    clean = pii.redact(pii.detect(rows, keep=["d", "text"]))
    whole = F.col("d").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        size = F.when(F.size("span_list") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
        whole = whole.withField("n_chars", size)
    return _parts(clean.select(whole.alias("d")), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays is packed into sequences: a row per piece."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("personal_data", redacted),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over documents; each stage's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = Stored(stage(spark, docs, sf_dir)).df
    return docs
