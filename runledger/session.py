"""Session settings, and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording a Python call site for every column expression dominates plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
SHARED_FOLDER = "spark.checkpoint.dir"


def build(master: str | None = None, name: str = "runledger", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder() -> str:
    """A folder of this process, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="runledger-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, root: str | None = None) -> str:
    """A fresh folder below ``root``, or else the one the cluster names.

    Where neither is given and all executors are threads of this process, a folder of the process
    does, as in tests; on a cluster that is an error.
    """
    root = root or spark.conf.get(SHARED_FOLDER, None) or spark.sparkContext.getConf().get(SHARED_FOLDER)
    if root is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {SHARED_FOLDER} to a folder that every executor can reach")
        root = _own_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
