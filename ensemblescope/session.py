"""Spark session defaults and the shared scratch location.

Nothing here is needed when the caller brings a session: every operator works
on the session of the DataFrames it is given.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "ensemblescope", master: str | None = None) -> SparkSession:
    """A session with adaptive execution and skew handling switched on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``, or the caller has set a
    checkpoint folder. Only a local session, where driver and executors are one
    process, may fall back to a temporary folder; anything else raises, early.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder or context.getCheckpointDir() is not None:
        return folder or context.getCheckpointDir()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ensemblescope-"))
    return context.getCheckpointDir()


#: Paths made inside ``scratch``, innermost block last.
_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the scratch tables made inside; nothing that reads them may be used after it."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def materialise(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Compute ``df`` once for several later readers.

    The rows are written as Parquet to the shared folder and read back: that
    cuts the lineage, survives the loss of executors, keeps column pruning and
    filter pushdown for the readers, and tells the planner the true size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
