"""Set operations of two variant tables on the exact allele."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["chrom", "pos", "ref", "alt"]


def isec(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """Rows private to a or b, shared (a's or b's rows), or of either.

    Semi and anti joins on the allele; repeated rows come back as often as they
    came. A union lists a's rows, then b's private ones. Null keys match nothing.
    """
    if mode == "private_a":
        return a.join(b.select(KEY), KEY, "left_anti").select(a.columns)
    if mode == "private_b":
        return b.join(a.select(KEY), KEY, "left_anti").select(b.columns)
    if mode == "shared":
        return a.join(b.select(KEY), KEY, "left_semi").select(a.columns)
    if mode == "shared_b":
        return b.join(a.select(KEY), KEY, "left_semi").select(b.columns)
    if mode == "union":
        more = b.join(a.select(KEY), KEY, "left_anti").select(b.columns)
        return a.withColumn("_seq", F.struct(F.lit(0).alias("part"), F.col("_seq").alias("at"))).unionByName(more.withColumn("_seq", F.struct(F.lit(1).alias("part"), F.col("_seq").alias("at"))))
    raise ValueError(f"unknown mode {mode}")
