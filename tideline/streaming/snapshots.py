"""The current ranked snapshot of each strategy, kept by a stream of results and read by the snapshot service.

A snapshot is a numbered folder, folder/strategy/v<number>, of state (a row an instrument), ranked and header. header is written
last, so a folder with it is whole; readers take the newest whole one, and a batch that is run again writes the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.operators import evaluation
from tideline.plans.strategies import Strategy

#: Whole snapshots that stay for readers who have begun on them.
KEPT = 3


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of a strategy's whole snapshots, upwards."""
    store, where = _files(spark, folder)
    if not store.exists(where):
        return []
    names = [x.getPath().getName() for x in store.listStatus(where)]
    numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return [n for n in numbers if store.exists(_files(spark, f"{folder}/v{n}/header/_SUCCESS")[1])]


def merge(batch: DataFrame, strategy: Strategy, universe: DataFrame, folder: str, number: int) -> None:
    """Brings a strategy's snapshot up to a batch of results; instruments that the batch is silent on stay as they are.

    batch: arrival, strategy_id, strategy_version, config_version, instrument, exchange, symbol, context_version, trading_date, status and
    the strategy's metric; universe: instrument. The state is a row an instrument, whatever the stream's length.
    """
    spark, base = batch.sparkSession, f"{folder}/{strategy.id}"
    held = versions(spark, base)
    if held and held[-1] >= number:
        return
    known = batch.where(batch["strategy_id"] == strategy.id)
    if held:
        known = spark.read.parquet(f"{base}/v{held[-1]}/state").unionByName(known.select(*spark.read.parquet(f"{base}/v{held[-1]}/state").columns))
    policy = spark.createDataFrame([(strategy.id,)], "strategy_id string")
    at = f"{base}/v{number}"
    evaluation.collapse(known, universe, policy).write.mode("overwrite").parquet(f"{at}/state")
    state = spark.read.parquet(f"{at}/state")
    if not state.limit(1).count():
        return
    evaluation.rank_candidates(state, strategy.rank_by, strategy.descending).write.mode("overwrite").parquet(f"{at}/ranked")
    evaluation.snapshot_header(state, strategy.rank_by, universe).write.mode("overwrite").parquet(f"{at}/header")
    for old in held[: 1 - KEPT]:
        store, where = _files(spark, f"{base}/v{old}")
        store.delete(where, True)


def keep(results: DataFrame, strategies: list[Strategy], universe: DataFrame, folder: str, checkpoint: str, **trigger):
    """Starts a stream that keeps the snapshots of strategies under folder; trigger as DataStreamWriter.trigger takes it (default: what there is now)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for strategy in strategies:
            merge(batch, strategy, universe, folder, number)
        batch.unpersist()

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
