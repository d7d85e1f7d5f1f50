"""A SparkSession with what the library relies on: UTC and adaptive execution. An existing session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "segmill", **conf: str) -> SparkSession:
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name).config(map=fixed | {k.replace("_", "."): v for k, v in conf.items()})
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    return builder.getOrCreate()


def setting(spark: SparkSession, name: str, default: str = "") -> str:
    """A setting from the session (``spark.segmill.<name>``), else from the environment (``SEGMILL_<NAME>``), else the default."""
    return spark.conf.get(f"spark.segmill.{name}", None) or os.environ.get(f"SEGMILL_{name.upper()}") or default
