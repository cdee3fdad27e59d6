"""Sessions and tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", cores: int | None = None) -> SparkSession:
    """A local session: UTC, adaptive plans, a shuffle partition for each core."""
    n = cores or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; without it, on a local master only, in a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = tempfile.mkdtemp(prefix="tessera-streams-")
            atexit.register(shutil.rmtree, _folders[app], ignore_errors=True)
        shared = f"file://{_folders[app]}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
