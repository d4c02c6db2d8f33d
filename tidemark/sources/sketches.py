"""Sketches and hash trees on disk: saved by kind and name with their parameters, loaded with the same ones, merged."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells the cells of a kind apart, and how two of one place become one.
KEYS = {"bloom": ["bit"], "cms": ["row", "bucket"], "hll": ["register"], "merkle": ["slot"]}
MERGES = {"cms": ("count", F.sum), "hll": ("rho", F.max)}


def save(sketch: DataFrame, path: str, kind: str, name: str, **params: float) -> None:
    """Write a sketch, replacing one of that name. What it was made with is written along."""
    if kind not in KEYS:
        raise ValueError(f"unknown kind {kind}")
    sketch.withColumn("params", F.lit(json.dumps(params, sort_keys=True))).write.mode("overwrite").parquet(f"{path}/{kind}/{name}")


def load(spark: SparkSession, path: str, kind: str, name: str, **params: float) -> DataFrame:
    """A saved sketch; an error if it was made with other parameters, for cells would mean something else."""
    found = spark.read.parquet(f"{path}/{kind}/{name}")
    other = found.where(F.col("params") != json.dumps(params, sort_keys=True)).select("params").head()
    if other:
        raise ValueError(f"{kind} {name} was made with {other['params']}")
    return found.drop("params")


def merge(kind: str, *sketches: DataFrame) -> DataFrame:
    """The sketch of all that the sketches saw."""
    both = sketches[0]
    for other in sketches[1:]:
        both = both.unionByName(other)
    if kind not in MERGES:
        return both.distinct()
    value, how = MERGES[kind]
    return both.groupBy(*(c for c in both.columns if c != value)).agg(how(value).alias(value))
