"""Folders for tables that a query writes on its way, below the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, one of our own, which is set.

    On a cluster that is below the warehouse, which all executors reach too, and on a
    single machine a fresh folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        base = f"file://{tempfile.mkdtemp(prefix='tarn-shared-')}" if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tarn"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder's path, without a scheme for local folders."""
    return re.sub(r"^file:/+", "/", f"{shared(spark)}/{label}-{uuid.uuid4().hex}")
