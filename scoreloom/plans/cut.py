"""Cutting lineage where a plan is used more than once or grows by rounds."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ensure_folder(spark: SparkSession) -> None:
    """The cluster names a shared folder in ``spark.checkpoint.dir``; only where
    that is unset (a local test session) is a temporary folder made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scoreloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as named by the cluster."""
    _ensure_folder(spark)
    return spark.sparkContext.getCheckpointDir()


def kept_folder(spark: SparkSession) -> str:
    """Where tables outlive the application: the shared folder as the cluster names it,
    without the part that a session adds for its own checkpoints."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{named.rstrip('/')}/scoreloom" if named else f"{shared_folder(spark)}/scoreloom"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    The files outlive executors, so a lost executor costs no recomputation of
    what came before, and a plan read twice is computed once.
    """
    _ensure_folder(df.sparkSession)
    return df.checkpoint(eager)


def size_checked(df: DataFrame, rows: int, mb: int = 24):
    """``broadcast(df)`` if it has at most ``rows`` rows and, written out as text, at
    most ``mb`` megabytes, else ``df`` itself, so that the join falls back to a shuffle
    when the small side turns out large. No more than ``rows`` + 1 rows are looked at."""
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))
    n, letters = df.limit(rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= rows and letters <= mb << 20 else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than there are cores: a
    single small file would otherwise keep a costly Python step in one task. A table of
    many files is left as it is and not shuffled."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have < want else df
