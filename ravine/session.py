"""The session that the engine's queries expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "ravine", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session with the engine's settings; a running session is returned as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("RAVINE_DRIVER_MEMORY", memory))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
