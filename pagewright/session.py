"""Settings of a session that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_dir() -> str:
    sc = SparkSession.getActiveSession().sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewright-"))
    return sc.getCheckpointDir()


def shared_folder(name: str) -> str:
    """A new folder below the shared one."""
    return f"{_checkpoint_dir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder that the session names in spark.checkpoint.dir, so that an executor's loss costs no
    recomputation. Only where none is named and all runs on one machine, as in tests, a folder of our own is set; a cluster must name one."""
    _checkpoint_dir()
    return df.checkpoint()


#: Rows of a table that is sent to every executor at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def sent(table: DataFrame) -> DataFrame:
    """A written table, marked to be sent to every executor if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


@cache
def _archive(application: str) -> str:
    """The package as a zip archive on the driver's machine, from where Spark hands it to the executors."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pagewright-code-"), "pagewright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    return path


@cache
def _ship(application: str) -> None:
    SparkSession.getActiveSession().sparkContext.addPyFile(_archive(application))


def ship(spark: SparkSession) -> None:
    """Makes the package known to the Python workers of all executors, wherever they run; once for each application."""
    _ship(spark.sparkContext.applicationId)
