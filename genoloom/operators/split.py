"""Multi-allelic rows to one row per allele in its shortest form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared(a: Column, b: Column, most: Column, take) -> Column:
    """How many characters, up to ``most``, the two texts share at one end."""
    steps = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
    return F.aggregate(steps, F.lit(0), lambda k, j: F.when((k == j - 1) & (j <= most) & (take(a, j) == take(b, j)), j).otherwise(k))


def trimmed(rows: DataFrame) -> DataFrame:
    """Trim what ref and alt share, from the end and then from the start, a base at least staying."""
    ref, alt = F.col("ref"), F.col("alt")
    tail = shared(ref, alt, F.least(F.char_length(ref), F.char_length(alt)) - 1, F.right)
    out = rows.withColumn("_tail", tail)
    for c in ("ref", "alt"):
        out = out.withColumn(c, F.substr(F.col(c), F.lit(1), F.char_length(c) - F.col("_tail")))
    out = out.withColumn("_head", shared(F.col("ref"), F.col("alt"), F.least(F.char_length("ref"), F.char_length("alt")) - 1, F.left))
    for c in ("ref", "alt"):
        out = out.withColumn(c, F.substr(F.col(c), F.col("_head") + 1))
    return out.withColumn("pos", F.col("pos") + F.col("_head")).drop("_tail", "_head")


def split_alleles(multi: DataFrame) -> DataFrame:
    """``multi`` (chrom, pos, id, ref, alts, qual, filter, dp, afs, _seq) as variants, alleles in order."""
    from genoloom.sources.text import variant_columns

    rows = multi.select("*", F.posexplode("alts").alias("_n", "alt")).withColumn("af", F.get("afs", F.col("_n")).try_cast("double"))
    rows = rows.withColumn("_seq", F.struct("_seq", "_n"))
    return variant_columns(trimmed(rows))
