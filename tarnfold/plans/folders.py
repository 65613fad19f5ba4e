"""The folder for an application's intermediate tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder of this application below the one that all executors share.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only where the driver is the one machine
    (``local[...]``, as in tests) and it is unset is one chosen here; elsewhere executors would write to disks of their own.
    The folder goes when the session ends.
    """
    jvm = spark._jvm
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tarnfold-"))
    path = f"{base.rstrip('/')}/tarnfold-{spark.sparkContext.applicationId}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
