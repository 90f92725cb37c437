"""Regions cut into shards, and operators run shard by shard.

Spark deals rows to tasks itself; shards are for callers that want a region's
result in pieces, or cuts of equal work.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A shard shorter than this isn't worth its start.
LEAST_SPAN = 50_000
#: Width of the bins that density is counted in.
BIN = 16_384


def split_region(start: int, end: int, n: int) -> list[tuple[int, int]]:
    """``n`` spans, both ends inside, that cover start to end once, as even as can be, longer ones first."""
    size = end - start + 1
    n = max(1, min(n, size))
    each, more = divmod(size, n)
    cuts = [start + i * each + min(i, more) for i in range(n + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])] if size > 0 else [(start, end)]


def plan_shard_count(span: int, cores: int) -> int:
    """Shards worth having for a region of ``span`` bases."""
    return 1 if cores <= 1 or span < LEAST_SPAN else max(1, min(span // LEAST_SPAN, cores))


def split_by_density(reads: DataFrame, chrom: str, start: int, end: int, n: int) -> list[tuple[int, int]]:
    """``n`` spans at most that cover start to end once and hold about equally many reads (chrom, pos).

    Cuts lie on bin borders; the driver gets a count for each bin of the region.
    Without reads the spans are even.
    """
    bins = reads.where((F.col("chrom") == chrom) & F.col("pos").between(start, end)).groupBy(F.floor(F.col("pos") / BIN).alias("bin")).count().orderBy("bin").collect()
    total = sum(r["count"] for r in bins)
    if not total:
        return split_region(start, end, n)
    cuts, seen = [start], 0
    for r in bins:
        seen += r["count"]
        border = (r["bin"] + 1) * BIN
        if seen * n >= total * len(cuts) and cuts[-1] < border <= end and len(cuts) < n:
            cuts.append(border)
    return list(zip(cuts, [c - 1 for c in cuts[1:]] + [end]))


def shard_and_merge(records: DataFrame, chrom: str, shards: list[tuple[int, int]], run: Callable[[DataFrame], DataFrame], halo: int = 0) -> DataFrame:
    """``run`` on the records (chrom, pos) of each shard, its rows clamped to the shard, in shard order.

    ``halo``: how far before a shard records are given to ``run`` too, for
    those that reach into it. The result has ``run``'s columns, with ``_seq``
    led by the shard's number where there is one.
    """
    here = records.where(F.col("chrom") == chrom)
    parts = []
    for i, (a, b) in enumerate(shards):
        out = run(here.where(F.col("pos").between(a - halo, b))).where(F.col("pos").between(a, b))
        if "_seq" in out.columns:
            out = out.withColumn("_seq", F.struct(F.lit(i).alias("shard"), F.col("_seq").alias("at")))
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)
