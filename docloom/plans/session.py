"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_docloom_shipped"


def ship(spark: SparkSession) -> None:
    """Gives the package to the session's Python workers, once, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="docloom-"), "docloom_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    setattr(context, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the session sets it. Only a local master may go without: it gets a temporary
    folder of its own, since there all executors are this process.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="docloom-")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()
