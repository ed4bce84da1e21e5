"""Shared-storage helpers: written intermediate tables and size-checked broadcasts.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (which
every executor can read), so a lost executor costs a re-read and nothing more.
Only where the session has no such setting, as in tests, is a temporary folder
of this machine chosen.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: An estimate of so many bytes is none.
UNKNOWN = 1 << 55
#: Paths of the tables written by this process.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else (on one machine only) a folder set once per session."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="panelforge-")
    sc.setCheckpointDir(path)
    return path


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once (an action) to the shared folder and return a reader of the written rows.

    Cuts the lineage: what follows reads files that outlive any executor. The
    files are removed by :func:`drop_tables`, at the latest when the session's
    file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Remove all tables written so far; how many. For sessions of many queries, once their results have been used."""
    n = len(_written)
    while _written:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    return n


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` over a fixed number of partitions, for groups that cost much time and hold few rows.

    Adaptive execution would join small partitions to one and run all groups in
    one task; a partition number that is asked for is kept.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def partitions_for(df: DataFrame, bytes_each: int = 128 << 20, most: int = 20_000) -> int:
    """How many partitions hold ``df`` in parts of about ``bytes_each``, by the planner's estimate of its size (no action); at least the session's shuffle partitions.

    For shuffles whose partition number is fixed and which adaptive execution therefore leaves alone. Rows that
    come from no file have no estimate (the planner takes them to be endless) and get the session's number.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-size // bytes_each)) if size < UNKNOWN else 0)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``max_rows`` rows; otherwise leave the join to shuffle.

    Runs a bounded count (an action that stops at ``max_rows + 1`` rows). Give it
    a table that is cheap to read, such as one from :func:`write_table`.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
