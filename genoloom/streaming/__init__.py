"""Record-by-record delivery of a result, and queries over arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genoloom import sinks


def each(planned, callback: Callable[[dict], object]) -> int:
    """Call back with every record as a dict, in order, a partition in memory at a time; how many there were.

    A callback that returns False ends it early.
    """
    n = 0
    for row in sinks.rows(planned):
        n += 1
        if callback(sinks.record(planned, row)) is False:
            break
    return n


def variants_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Variants of VCF files as they arrive in a folder, as a streaming DataFrame."""
    from pyspark.sql import functions as F

    from genoloom.sources.text import info

    body = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    c = F.split("value", "\t")
    about = F.get(c, F.lit(7))
    return body.select(
        F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).try_cast("long").alias("pos"), F.get(c, F.lit(3)).alias("ref"), F.get(F.split(F.get(c, F.lit(4)), ","), F.lit(0)).alias("alt"),
        F.coalesce(F.get(c, F.lit(5)).try_cast("double"), F.lit(0.0)).alias("qual"), info(about, "DP").try_cast("long").alias("depth"), F.get(F.split(info(about, "AF"), ","), F.lit(0)).try_cast("double").alias("allele_freq"))
