"""Shared plumbing: shared-folder tables, Arrow appends and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that an appending function sees at once, which bounds what it holds of results.
ROWS_AT_ONCE = 1000


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_tables: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_tables.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; what is left lies in the cluster's scratch folder
            return


class Stored:
    """A DataFrame written as Parquet to the shared folder: lineage ends there, so lost executors cost no recomputation."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/tideline-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _tables[self.path] = self.spark
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _tables.pop(self.path, None)


_slot: dict[str, object] = {}
_asked: set[str] = set()


def held_by_worker(token: str, build: Callable[[], object]):
    """What build gives, made once for a token in this Python worker.

    A worker serves task after task, of any operator, and holds one such thing: what an earlier token held is given up.
    """
    _asked.add(token)
    if token not in _slot:
        _slot.clear()
        _slot[token] = build()
    return _slot[token]


def begun(make: Callable[[], Callable]) -> Callable:
    """A task's function; one that holds nothing in its worker makes that give up what an earlier operator held."""
    _asked.clear()
    function = make()
    if not _asked:
        _slot.clear()
    return function


def append_arrow(
    df: DataFrame,
    inputs: Sequence[Column | str],
    schema: str,
    make: Callable[[], Callable[..., list[pa.Array]]],
    keep: Sequence[str] | None = None,
    rows_at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """df's columns in keep (default: all) plus those of schema, computed batch by batch.

    make() runs once per task and returns a function from the input arrays, of rows_at_once rows at most, to the new ones.
    An input given by the name of a kept column is sent to Python once, as that column.
    A kept column whose name is in schema gives way to the new column.
    """
    fields = T.StructType.fromDDL(schema).fields
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    # within, columns go by their places: mapInArrow resolves names as they stand, and theirs may hold dots
    sent = [quoted(c) if isinstance(c, str) else c for c in inputs if not (isinstance(c, str) and c in kept)]
    places, extra = [], len(kept)
    for c in inputs:
        shared = isinstance(c, str) and c in kept
        places.append(kept.index(c) if shared else extra)
        extra += not shared
    chosen = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)], *[c.alias(f"in{i}") for i, c in enumerate(sent)])
    out = T.StructType([T.StructField(c, chosen.schema[i].dataType) for i, c in enumerate(kept)] + fields)
    names, first = out.names, len(kept)

    def run(batches):
        function = begun(make)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                made = function(*[batch.columns[i] for i in places])
                yield pa.RecordBatch.from_arrays([*batch.columns[:first], *made], names=names)
            whole = batch = made = None  # not held while the next one is read

    return chosen.mapInArrow(run, out)


def least(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n rows of df that come first by the columns of order (none of them null).

    Their keys are found first, so whole rows move for few but these. Rows equal in all of order may stand for one another.
    """
    kinds = T.StructType([df.schema[c] for c in order])
    keys = df.select(*map(quoted, order)).orderBy(*map(quoted, order)).limit(n).collect()
    if not keys:
        return df.limit(0)
    mine = F.struct(*map(quoted, order))
    last = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(keys[-1], kinds, strict=True)])
    return df.where(mine <= last).orderBy(*map(quoted, order)).limit(n)


def connected_components(edges: DataFrame) -> Stored:
    """(node, root) for every node of edges (a, b; long): one root per component.

    Each round maps every node to its neighbour (or itself) of least hashed rank and contracts the graph, so
    the number of nodes falls by a constant factor a round in expectation, on chains as on stars. Sums and
    minima are combined before they are shuffled; joins on hubs are left to adaptive skew splitting.
    """
    spark = edges.sparkSession
    current = Stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[Stored] = []
    while current.df.limit(1).count():
        salt = len(maps)
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), c.alias("v"))  # noqa: E731, B023
        both = current.df.unionByName(current.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("r"))
        best = F.least(F.col("r"), rank(F.col("a")))
        maps.append(Stored(least.select(F.col("a").alias("node"), best["v"].alias("parent"))))
        up = maps[-1].df
        moved = (
            current.df.join(up.withColumnsRenamed({"node": "a", "parent": "pa"}), "a")
            .join(up.withColumnsRenamed({"node": "b", "parent": "pb"}), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        following = Stored(moved)
        current.drop()
        current = following
    current.drop()
    roots = Stored(spark.createDataFrame([], "node long, root long"))
    for up in reversed(maps):
        later = roots.df.withColumnsRenamed({"node": "parent"})
        mapped = up.df.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
        following = Stored(mapped)
        roots.drop()
        up.drop()
        roots = following
    return roots

