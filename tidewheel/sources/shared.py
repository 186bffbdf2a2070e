"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths made inside the scratch blocks that are open, innermost last.
_OPEN: list[list[str]] = []
#: Lets Spark drop an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidewheel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder that fresh_path() named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored inside it: nothing that outlives it may still read that."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def write(df: DataFrame, path: str) -> None:
    """Writes df as Parquet; the shuffle files behind it go when it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = fresh_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
