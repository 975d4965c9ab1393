"""Shared helpers of the subpackage: stored intermediates, tables, the held-out rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtspark.session import materialise as store  # noqa: F401


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_rest(col: str, by: int = 4):
    """crc32 of the column's text, modulo ``by``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % by
