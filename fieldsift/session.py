"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Paths that the innermost scope deletes; None outside of any.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def local_session(cores: int | str = "*", app_name: str = "fieldsift") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="fieldsift-")


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary
    folder of its process.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
    return _local_root()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/fieldsift/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what :func:`stage` wrote within it, in this thread.

    For steps whose result needs none of it any more: numbers on the driver, a
    fitted model, rows that were written elsewhere. A table that outlives the
    step is staged with ``keep``. After an error nothing is deleted but by the
    scope around, if there is one.
    """
    outer, paths = _scratch.get(), []
    mark = _scratch.set(paths)
    try:
        yield
    except BaseException:
        if outer is not None:
            outer.extend(paths)
        raise
    finally:
        _scratch.reset(mark)
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A :func:`shared_path` that the scope around deletes at its end."""
    path, paths = shared_path(spark, name), _scratch.get()
    if paths is not None and not keep:
        paths.append(path)
    return path


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage durably: later scans read columns they need from the
    files, and a lost executor costs a re-read instead of a recomputation. The
    files stay, or go with the :func:`scratch` scope that they are written in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
