"""Where operators keep what they must write between jobs.

A cluster names a folder that the driver and all executors share in
``spark.checkpoint.dir``.  Intermediate tables go there, so a lost executor
costs the tasks it ran and never the data.  Only where the setting is absent
and the master is local (tests) a temporary folder takes its place.  What a
session has written stays until ``clear`` is called, as results are read lazily.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a query's shuffle files when it ends; without it they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared one, as a URI."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.get(app)
        if base is None:
            base = _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="canvass-")
    path = f"{base.rstrip('/')}/canvass-{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(app, []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete what this session's operators have written; call it when their results are read."""
    for folder in _MADE.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and the shuffle files of the write go with it."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` has written and that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
