"""A session with the settings that the engine wants; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "ledgerloom", cores: int | None = None) -> SparkSession:
    cores = cores or os.cpu_count() or 8
    build = SparkSession.builder.appName(name)
    for key, value in {
        "spark.master": f"local[{cores}]",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        build = build.config(key, value)
    return build.getOrCreate()
