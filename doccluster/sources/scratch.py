"""Written intermediate tables in the cluster's shared checkpoint folder.

Iterative plans and inputs that several branches read are cut here: the table
is written as Parquet and read back, so a lost executor only re-reads files and
the optimizer sees the real size of the table.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Folders of the jobs that are running, the outermost first.
_scopes: list[str] = []
# Shuffle files go when the execution that made them ends, not when the driver happens
# to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.lru_cache(maxsize=None)
def _local_root(application_id: str) -> str:
    root = tempfile.mkdtemp(prefix="doccluster-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, or the context's own setting.

    A temporary folder is used only where neither is set and Spark runs in
    local mode, and goes with the process; a cluster without a shared folder is
    an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_root(spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return "/".join([checkpoint_root(spark), "doccluster", *_scopes])


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made inside when a job ends or fails.

    DataFrames that read them are of no use afterwards: write results inside.
    """
    _scopes.append(f"job-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _scopes.pop()


def turns(spark: SparkSession, name: str) -> Iterator[str]:
    """Two scratch paths taking turns: a loop's last table is read while the next is written."""
    return itertools.cycle([scratch_path(spark, name), scratch_path(spark, name)])


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` is ``value`` inside, and what it was afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_scratch(df: DataFrame, path: str, **options) -> DataFrame:
    """Write ``df`` to ``path`` and return a DataFrame that reads it back."""
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return write_scratch(df, scratch_path(df.sparkSession, name))
