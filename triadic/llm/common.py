"""Shared plumbing: scratch tables and the worker path."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from triadic import scratch

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where they see the same path.

    A cluster without that path gets the package from ``--py-files``.
    """
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)
    return spark


class Scratch(scratch.Scratch):
    """Scratch tables of a session whose workers can import this package."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(ship(spark), name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
