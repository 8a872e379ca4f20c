"""Session settings that the library relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; a cluster ships it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def build(app: str = "pegtrail", cores: int | str = "*", partitions: int = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A local session with UTC times and adaptive execution."""
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.driver.memory": memory, "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    session = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=base | settings).getOrCreate()
    importable(session)
    return session
