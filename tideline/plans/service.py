"""Reading ranked snapshots: what an endpoint calls, with its three kinds of absence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tideline.operators.evaluation import project
from tideline.plans.strategies import CATALOG
from tideline.streaming.snapshots import versions


class Unavailable(RuntimeError):
    """There is no scanner to read from."""


class UnknownStrategy(KeyError):
    """No strategy of that id."""


@dataclass(frozen=True)
class Snapshot:
    header: dict
    candidates: list[dict]


def read_snapshot(spark: SparkSession, folder: str | None, strategy_id: str, limit: int = 50) -> Snapshot | None:
    """The newest whole snapshot under folder/strategy_id (as streaming.snapshots keeps them, or bare ranked and header tables), its first limit candidates; None before there is one.

    Counts are the whole snapshot's whatever the limit. At most 500 rows reach the driver.
    """
    if folder is None:
        raise Unavailable("no scanner runs")
    try:
        strategy = CATALOG[strategy_id]
    except KeyError as error:
        raise UnknownStrategy(strategy_id) from error
    base = f"{folder}/{strategy_id}"
    if held := versions(spark, base):
        base = f"{base}/v{held[-1]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/header")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    header = spark.read.parquet(f"{base}/header").orderBy(F.desc("trading_date")).first()
    if header is None:
        return None
    ranked = spark.read.parquet(f"{base}/ranked").where(F.col("trading_date") == header.trading_date)
    rows = project(ranked, limit, strategy.rank_by).orderBy("rank").collect()
    return Snapshot(header.asDict(), [r.asDict() for r in rows])
