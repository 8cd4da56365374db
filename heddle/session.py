"""Session defaults: UTC, adaptive execution, ANSI arithmetic."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "heddle", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local work; on a cluster the submitter's settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return builder.config(map=defaults | conf).getOrCreate()
