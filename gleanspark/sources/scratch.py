"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a scratch table is written: shuffle files go once it is done, Arrow batches stay small, and small shuffle
#: partitions are joined up to Spark's own default size, so that scratch tables have few files.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
}
#: Stashes that are being written in each session, and what its settings were before the first of them.
_writing: dict[int, tuple[int, dict[str, str]]] = {}
_lock = threading.Lock()


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines share.

    Where that is unset, a local folder if Spark runs in this process alone (as in tests); an error on a cluster,
    whose machines would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="gleanspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """The path and its store, as Spark's readers and writers resolve it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, with its scheme; removed when the application ends."""
    at, store = _hadoop(spark, f"{scratch_dir(spark)}/gleanspark/{name}-{uuid.uuid4().hex}")
    store.deleteOnExit(at)
    return store.makeQualified(at).toString()


def free(*stashed: DataFrame) -> None:
    """Remove stored tables that no later step reads."""
    for df in stashed:
        at, store = _hadoop(df.sparkSession, df.scratch)
        store.delete(at, True)


def _tuned(spark: SparkSession, more: int) -> None:
    """Hold the settings of ``_WHILE_WRITING`` from the first of several simultaneous writes to the last."""
    with _lock:
        n, before = _writing.pop(id(spark), (0, {}))
        if not n:
            before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
        if n + more:
            _writing[id(spark)] = n + more, before
        for k, v in (_WHILE_WRITING if n + more else before).items():
            spark.conf.set(k, v)


def stash(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``free`` removes it.

    Cuts the lineage: a lost executor later costs a read, not a recomputation.  The shuffle files of the
    write go as soon as it is done, so that steps do not pile up on disk.  Settings of the session that it holds
    meanwhile change sizes of files and batches, never results.  A table that is stored ``by`` a column, in as many buckets as
    there are shuffle partitions, is not shuffled where it is grouped or joined by it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"gleanspark_{uuid.uuid4().hex}"
    _tuned(spark, 1)
    try:
        if by:
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.bucketBy(buckets, by).option("path", path).saveAsTable(table, format="parquet")
        else:
            df.write.parquet(path)
    finally:
        _tuned(spark, -1)
    if by:
        stored = spark.table(table)
        spark.sql(f"drop table {table}")  # the files stay, and the plan has their buckets
    else:
        stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


#: Rows of a stored table that is broadcast at most.
BROADCAST_ROWS = 1_000_000


def near(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of short rows for a join: broadcast up to ``limit`` rows, shuffled beyond."""
    return F.broadcast(stored) if stored.count() <= limit else stored
