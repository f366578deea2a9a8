"""Quarantine, and the latest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarantine(df: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that are ``sound`` and the rest; a null verdict counts as unsound."""
    verdict = F.coalesce(sound, F.lit(False))
    return df.filter(verdict), df.filter(~verdict)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; null is a key like any other.

    The rank is cut inside every task before rows move, so a key with many rows sends one per task. Rows
    that tie in all of ``order`` are alike to it and any one stays.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
