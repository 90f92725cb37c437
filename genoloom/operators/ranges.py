"""Point-in-interval joins as equi joins on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 16_384


def point_join(points: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Every pair of a point (chrom, pos) and a span (chrom, start, end; both ends inside) that holds it.

    A span appears once in each bin it touches and a point is in one bin, so no
    pair comes twice and the join is a hash or merge join, never a nested loop.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    held = spans.where("start <= end").withColumn("_bin", bins).withColumnRenamed("chrom", "_chrom")
    asked = points.withColumn("_bin", F.floor(F.col("pos") / width))
    on = (asked.chrom == held._chrom) & (asked._bin == held._bin) & (F.col("start") <= F.col("pos")) & (F.col("pos") <= F.col("end"))
    return asked.join(held, on).drop(held._bin).drop("_chrom", "_bin")
