"""Scratch folders of a session, and indexes kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which all executors share; a local session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_lodestone_work", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = spark._lodestone_work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, key: tuple, build) -> str:
    """The folder that build(path) filled for this key, made once in a session."""
    held = spark.__dict__.setdefault("_lodestone_kept", {})
    if key not in held:
        path = scratch(spark, key[0])
        build(path)
        held[key] = path
    return held[key]
