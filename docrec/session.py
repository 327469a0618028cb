"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PACKAGE = os.path.basename(os.path.dirname(os.path.abspath(__file__)))


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so see the same local folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Only where one process does all the work may it be one of our own; elsewhere its absence is an error, since each machine would write to its own disk."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. What is written there is scratch, and may be removed when the job has ended."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: what follows neither recomputes it nor depends on the executors that made it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: by their path where they run on this machine, as an archive elsewhere."""
    context = spark.sparkContext
    env = context.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *paths]))
    if not is_local(spark) and not any(os.path.basename(f).startswith(f"{PACKAGE}-code-") for f in context._python_includes):
        handle, path = tempfile.mkstemp(prefix=f"{PACKAGE}-code-", suffix=".zip")
        with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(os.path.join(ROOT, PACKAGE)):
                for name in names:
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        archive.write(whole, os.path.relpath(whole, ROOT))
        context.addPyFile(os.path.realpath(path))


def with_code(f: Callable) -> Callable:
    """``f(spark, ...)`` with this package sent to the executors' Python workers."""

    @wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        ship_code(spark)
        return f(spark, *args, **kwargs)

    return run
