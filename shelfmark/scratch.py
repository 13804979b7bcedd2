"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A folder for this application under spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder and any other master the warehouse,
    which a cluster shares.
    """
    conf = spark.sparkContext.getConf()
    app = spark.sparkContext.applicationId
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            if app not in _OWN:
                _OWN[app] = tempfile.mkdtemp(prefix="shelfmark-")
            root = f"file://{_OWN[app]}"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/shelfmark-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path under scratch_dir() that no one uses; the passing() around, if there is one, deletes what is there in the end."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    noted = _PASSING.get()
    if noted is not None:
        noted.append(path)
    return path


def saved(df: DataFrame, path: str) -> DataFrame:
    """df written as parquet to path and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as parquet under scratch_dir() and read again.

    Later stages restart from the files when executors are lost, and several readers share one
    computation. The files stay until the passing() around ends, if there is one, until drop_scratch(), or until
    the cluster empties the folder.
    """
    return saved(df, new_path(df.sparkSession, name))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What written() writes inside goes when the block ends, so what is to outlast it has to be saved() to a path made before."""
    token = _PASSING.set([])
    try:
        yield
    finally:
        paths = _PASSING.get()
        _PASSING.reset(token)
        for path in paths:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what written() has left for this application."""
    drop(spark, scratch_dir(spark))
