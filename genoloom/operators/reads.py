"""Read records and their depth by a sweep over starts and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bases a task sweeps on its own.
STRIPE = 1_000_000


def depth_at_start(reads: DataFrame) -> DataFrame:
    """``reads`` (chrom, pos, len, ...) with ``depth``: reads with start <= p < start + len at its start.

    +1 at starts and -1 past ends, summed by position. The running sum is cut
    into stripes: each stripe's total is added up ahead of it, so a chromosome
    is swept by many tasks.
    """
    steps = reads.select("chrom", F.col("pos").alias("p"), F.lit(1).alias("d")).unionByName(reads.select("chrom", (F.col("pos") + F.col("len")).alias("p"), F.lit(-1).alias("d")))
    at = steps.groupBy("chrom", "p").agg(F.sum("d").alias("d")).withColumn("stripe", F.floor(F.col("p") / STRIPE))
    sums = at.groupBy("chrom", "stripe").agg(F.sum("d").alias("d"))
    ahead = Window.partitionBy("chrom").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("chrom", "stripe", F.coalesce(F.sum("d").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("chrom", "stripe").orderBy("p")
    depth = at.withColumn("run", F.sum("d").over(inside)).join(sums, ["chrom", "stripe"]).select("chrom", F.col("p").alias("pos"), (F.col("run") + F.col("base")).alias("depth"))
    return reads.join(depth, ["chrom", "pos"])


def read_records(alignments: DataFrame) -> DataFrame:
    """Alignments as records with depth and flag fields; the CIGAR doesn't matter here."""
    flagged = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    rows = depth_at_start(alignments.withColumn("len", F.char_length("seq")))
    return rows.select(
        "chrom", "pos", "mapq", "flag", F.col("depth").cast("long"), F.when(flagged(0x10), "-").otherwise("+").alias("strand"), flagged(0x10).alias("is_reverse"),
        flagged(0x400).alias("is_duplicate"), flagged(0x100).alias("is_secondary"), "_seq")
