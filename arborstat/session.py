"""Spark session with the settings that the engine assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, shared_folder: str | None = None) -> SparkSession:
    """A session with adaptive execution; master, partitions and shared folder are left to the cluster where they are None."""
    builder = SparkSession.builder.appName("arborstat").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("ARBORSTAT_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared_folder:
        builder = builder.config("spark.checkpoint.dir", shared_folder)
    return builder.getOrCreate()
