"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites of every column expression cost more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "faultline", **overrides: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only on a local master with the setting
    absent, which is the case in tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster.")
        folder = tempfile.mkdtemp(prefix="faultline-")
    if not context.getCheckpointDir():
        # Also for streams and MLlib, and so that one session keeps one folder.
        context.setCheckpointDir(folder)
    return folder


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process has put into the shared folder; returns the number of paths.

    For the end of a run, when its results are written elsewhere: frames that still
    read a stored table fail afterwards.
    """
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    deleted = 0
    while _made:
        path = path_of(_made.pop())
        deleted += bool(path.getFileSystem(conf).delete(path, True))
    return deleted


def materialise(frame: DataFrame) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back.

    Later steps see exactly the same rows again, also after an executor is
    lost, and the planner knows the true size of the table: a join broadcasts
    it only when that size is below Spark's limit.
    """
    path = scratch_path(frame.sparkSession, "table")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
