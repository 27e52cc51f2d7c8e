"""Folders for files that one job writes and a later one reads."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that the cluster shares (`spark.checkpoint.dir`).

    Where that is unset, a temporary folder that goes when the program ends
    takes its place, in local mode only: the executors of a cluster would each
    write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        made = tempfile.mkdtemp(prefix="schemaloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = f"file://{made}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
