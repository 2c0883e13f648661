"""Session helpers: scratch tables in the shared folder.

Every intermediate result is a parquet table in the folder that the cluster
names in ``spark.checkpoint.dir``: it cuts lineage, survives the loss of
executors, and Spark knows its size in bytes, so a join with it is broadcast
only when it is small (``spark.sql.autoBroadcastJoinThreshold``) and shuffled
otherwise, where AQE splits hot keys.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FOLDER = "basketry-scratch"
TABLES = "basketry_"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path (on a
    cluster the package is installed or shipped; the path is then unused)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([x for x in (have, root) if x])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it.

    Where it names none, only a session of one process (master ``local`` or
    ``local[...]``, as in tests) gets a fresh folder of its own.
    """
    sc = spark.sparkContext
    conf = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that the driver "
                               "and all executors share")
        conf = tempfile.mkdtemp(prefix="basketry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{FOLDER}"


#: Folder of the innermost open work() block of this thread or task.
_work: ContextVar[str | None] = ContextVar("basketry_work", default=None)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{_work.get() or _root(spark)}/{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def work(spark: SparkSession):
    """Scratch tables written inside the block are deleted at its end.  Yields
    ``keep(df, tag)``, which writes a table that stays."""
    outer = _work.get() or _root(spark)
    folder = f"{outer}/work-{uuid.uuid4().hex}"
    token = _work.set(folder)
    try:
        yield lambda df, tag: _write(df, f"{outer}/{tag}-{uuid.uuid4().hex}")
    finally:
        _work.reset(token)
        delete_path(spark, folder)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside the block a query's shuffle files go when the query ends, not
    when the driver happens to collect its garbage: for queries whose results
    are written and read, never computed again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this session has written as scratch, results
    included: call it when they are no longer read."""
    for t in spark.catalog.listTables():
        if t.name.startswith(TABLES):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    delete_path(spark, _root(spark))


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df`` as a parquet table in the shared folder."""
    return _write(df, scratch_path(df.sparkSession, tag))


def write_counted(df: DataFrame, tag: str = "table") -> tuple[DataFrame, int]:
    """``write_table`` and the row count, observed while it is written."""
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    out = write_table(df.observe(obs, F.count(F.lit(1)).alias("n")), tag)
    return out, int(obs.get["n"])


def write_bucketed(df: DataFrame, keys, buckets: int, tag: str = "occ") -> DataFrame:
    """``df`` as a parquet table bucketed on ``keys`` in the shared folder: a
    join or grouping on ``keys`` needs no shuffle of it.  A ``df`` already
    hash-partitioned on ``keys`` into ``buckets`` partitions is written
    without a shuffle, one file per bucket."""
    spark = df.sparkSession
    name = f"{TABLES}{tag}_{uuid.uuid4().hex[:16]}"
    (df.write.mode("error").bucketBy(buckets, *keys)
       .option("path", scratch_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
