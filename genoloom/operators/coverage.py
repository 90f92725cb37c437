"""Coverage windows and copy-number segments."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SIZE = 10_000
AMPLIFIED, DELETED, MIN_WINDOWS = 1.5, 0.5, 3
#: Adaptive (amplified, deleted) by coverage class: noisier data need wider limits.
ADAPTIVE = {"low": (1.75, 0.35), "medium": (1.6, 0.4), "high": (1.5, 0.5)}


def coverage_windows(reads: DataFrame, width: int = WINDOW_SIZE) -> DataFrame:
    """Reads counted by start in windows of ``width`` bases, empty ones between included.

    ``normalized`` divides by the median of non-empty windows (0.0 if there is
    none); windows start at multiples of ``width``, end exclusive.
    """
    width = max(1, width)
    counts = reads.groupBy("chrom", F.floor((F.col("pos") - 1) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy("chrom").agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    bins = span.select("chrom", F.explode(F.sequence("a", "b")).alias("bin"))
    middle = counts.agg(F.median("n").alias("m"))
    rows = bins.join(counts, ["chrom", "bin"], "left").join(F.broadcast(middle))  # one row
    n = F.coalesce("n", F.lit(0))
    return rows.select("chrom", (F.col("bin") * width).alias("start"), ((F.col("bin") + 1) * width).alias("end"), n.cast("long").alias("coverage"), F.coalesce(F.try_divide(n.cast("double"), F.col("m")), F.lit(0.0)).alias("normalized"), F.lit(False).alias("masked"))


def coverage_class(windows: DataFrame) -> str:
    """low, medium or high by the median of non-empty windows; high if there is none."""
    m = windows.where("coverage > 0").agg(F.median("coverage")).first()[0]
    return "high" if m is None else "low" if m < 15 else "medium" if m < 30 else "high"


def segments(states: DataFrame, min_windows: int) -> DataFrame:
    """Runs of at least ``min_windows`` neighbouring windows of one state (amplification or deletion)."""
    along = Window.partitionBy("chrom").orderBy("start")
    fresh = (F.lag("state").over(along).eqNullSafe(F.col("state"))) & (F.lag("end").over(along) == F.col("start"))
    marked = states.withColumn("island", F.sum(F.when(F.coalesce(fresh, F.lit(False)), 0).otherwise(1)).over(along))
    runs = marked.where("state is not null").groupBy("chrom", "island", F.col("state").alias("type")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("num_windows"), F.avg("coverage").alias("avg_coverage"), F.avg("normalized").alias("ratio"), F.stddev_samp("normalized").alias("spread"))
    t = F.when(F.col("spread") > 0, F.abs(F.col("ratio") - 1) / (F.col("spread") / F.sqrt("num_windows"))).otherwise(F.lit(0.0))
    confidence = F.least(F.lit(1.0), F.abs(F.col("ratio") - 1) * F.col("num_windows") / 10)
    return runs.where(F.col("num_windows") >= min_windows).select("chrom", "start", "end", (F.col("end") - F.col("start")).alias("length"), "type", (2 * F.col("ratio")).alias("copy_number"), "avg_coverage", confidence.alias("confidence"), "num_windows", t.alias("t_statistic"))


def by_threshold(windows: DataFrame, amp: float, dele: float) -> DataFrame:
    state = F.when(F.col("normalized") >= amp, "amplification").when(F.col("normalized") <= dele, "deletion")
    return windows.where("not masked").withColumn("state", state)


def _binary(pdf: pd.DataFrame, amp: float, dele: float, min_t: float, min_windows: int) -> pd.DataFrame:
    """Circular-binary-style segmentation of one chromosome's windows by greatest mean shift."""
    import numpy as np

    pdf = pdf.sort_values("start")
    x = pdf["normalized"].to_numpy(float)
    level = x.copy()
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        part = x[a:b]
        n = len(part)
        level[a:b] = part.mean() if n else 0.0
        if n < 2 * min_windows:
            continue
        left = np.cumsum(part)[:-1]
        k = np.arange(1, n)
        gap = np.abs(left / k - (part.sum() - left) / (n - k))
        t = gap / (max(part.std(), 1e-9) * np.sqrt(1 / k + 1 / (n - k)))
        t[: min_windows - 1] = t[n - min_windows :] = 0
        at = int(t.argmax())
        if t[at] >= min_t:
            todo += [(a, a + at + 1), (a + at + 1, b)]
    state = np.where(level >= amp, "amplification", np.where(level <= dele, "deletion", None))
    return pdf.assign(state=state)


def call_cnv(windows: DataFrame, amp: float | None = None, dele: float | None = None, min_windows: int | None = None, method: str = "adaptive") -> DataFrame:
    """Copy-number segments: by given thresholds, by binary segmentation, or adaptive to the coverage class."""
    least = min_windows if min_windows is not None else MIN_WINDOWS
    if amp is not None or dele is not None:
        return segments(by_threshold(windows, AMPLIFIED if amp is None else amp, DELETED if dele is None else dele), least)
    limits = ADAPTIVE[coverage_class(windows)]
    if method in ("cbs", "cbs_lite"):
        run = partial(_binary, amp=limits[0], dele=limits[1], min_t=3.0, min_windows=3)

        def per_chrom(pdf: pd.DataFrame) -> pd.DataFrame:
            return run(pdf)

        shape = windows.where("not masked")
        states = shape.groupBy("chrom").applyInPandas(per_chrom, "chrom string, start long, end long, coverage long, normalized double, masked boolean, state string")
        return segments(states, 3)
    return segments(by_threshold(windows, *limits), MIN_WINDOWS)
