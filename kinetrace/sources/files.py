"""Files wherever they lie: paths and URIs, and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+]*:/", path) else (pafs.LocalFileSystem(), path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a temporary one only where that is unset and all runs in one process."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="kinetrace-")
    folder = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, own = filesystem(folder)
    fs.create_dir(own, recursive=True)
    return folder
