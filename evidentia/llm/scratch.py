"""Intermediate tables of the corpus operators, in the folder that the session names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from evidentia.sources.scratch import shared_folder, written

__all__ = ["shared_folder", "tasks", "written"]


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
