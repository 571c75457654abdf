"""Session settings the library relies on, and tables written between steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Where ``spark.checkpoint.dir`` is unset, steps go below the warehouse, which
    must then be a folder that all machines share.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/finframe-steps"


def step_root(spark: SparkSession) -> str:
    """The folder of this application's steps, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/steps-{spark.sparkContext.applicationId}"


@contextmanager
def steps(name: str) -> Iterator[None]:
    """Tables written inside lie in a folder of this name, which ``clear_steps`` can delete alone."""
    before = _SCOPE.set(f"{_SCOPE.get()}{name}/")
    try:
        yield
    finally:
        _SCOPE.reset(before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a table written mid-job."""
    return f"{step_root(spark)}/{_SCOPE.get()}{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read back.

    The write runs at once, while the plan is being built.  Later readers see
    one fixed set of rows, survive lost executors without redoing the work,
    read only the columns they need, and know the size.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_steps(spark: SparkSession, name: str = "") -> None:
    """Delete the tables this application wrote between steps, or those of one name.

    To be called when a job has written its results; frames that still read a
    step cannot be used afterwards.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{step_root(spark)}/{name}".rstrip("/"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
