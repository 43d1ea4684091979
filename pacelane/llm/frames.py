"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelane.session import settle, ship_package

__all__ = ["Tables", "fresh", "plain", "settle", "ship_package"]


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(stem: str) -> str:
    """A column name that no input has."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"


class Tables:
    """Reader of the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
