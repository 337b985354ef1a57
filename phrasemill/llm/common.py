"""Helpers that the operators share: worker set-up, the shared folder, components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BATCH_ROWS = 1000
ROOT = str(Path(__file__).resolve().parents[2])
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small enough for long texts: at most BATCH_ROWS rows,
    the same for every operator, so that no frame depends on which of them was called last."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only in a local session."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="phrasemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What drop_written() hasn't deleted goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_at_end)
    _made[path] = spark
    return path


def _at_end() -> None:
    for path, spark in list(_made.items()):
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may have ended before
            return


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write as soon as it is over; its result is a table, so they aren't read again."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcasting if it is known to have few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files behind tables made by written(); only once nothing reads them any more."""
    for df in frames:
        under = {x.rsplit("/", 1)[0].replace("file:///", "file:/") for x in df.inputFiles()}
        for path in [p for p in _made if p.replace("file:///", "file:/") in under]:
            delete_path(df.sparkSession, path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (node, component), component = smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Every step shuffles edges on a node
    and aggregates a minimum before the shuffle; a node with very many edges is split by AQE's skew join. Each round is
    written to the shared folder. Self loops, repeated and null edges are harmless; no edges give an empty table.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    cur = written(e, "cc")
    last = _signature(cur)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = written(small, "cc")
        drop_written(cur)
        cur, now = new, _signature(new)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(r)
