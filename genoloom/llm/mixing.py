"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key of its id and text. Within a source the
documents are sorted by key range (bucket of leading key bits, then key), a
distributed prefix sum of their word counts runs over the buckets and inside
each bucket, and the source is cut at its exact budget. A budget above the
source's size takes whole epochs first and cuts the last one.

There are about as many buckets in a source as rows in a bucket: the prefix sum
over the buckets and the one inside a bucket both see the square root of the
rows, so a hot source is spread over many tasks. Sources are ranked and summed
by range partitions too, so there may be many of them; the driver gets sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, need, text_hash

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(column: Column) -> Column:
    """Number of maximal runs of non-blank characters; null counts as empty."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A hash-random, reproducible sort key; rows share one only if they share id and text."""
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), body))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], space: Workspace, name: str) -> DataFrame:
    """``rows`` with, for each entry of ``sums``, the sum of an expression over all rows before, by ``order``.

    Rows are range-partitioned; a partition sums its own rows, and one row per
    partition is summed by itself.
    """
    ranged = space.put(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*[F.sum(F.expr(x)).alias(f"_{k}") for k, x in sums.items()])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    own = ranged.select("*", *[F.coalesce(F.sum(F.expr(x)).over(inside), F.lit(0)).alias(k) for k, x in sums.items()])
    joined = own.join(parts, "_part")
    return joined.select(*rows.columns, *[(F.col(k) + F.col(f"_{k}")).cast("long").alias(k) for k in sums])


def targets(sizes: DataFrame, space: Workspace, weights=WEIGHTS, share=(3, 2), epochs: int = 2) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target.

    All targets sum to ``share`` (a fraction) of all words unless every source
    is exhausted. A target stops at ``epochs`` times its source's size and the
    excess is shared again by weight: the fixed point is a common level L with
    target = min(cap, weight * L), found by sorting sources by cap / weight.
    Sources order by code point (UTF-8 bytes), null last.
    """
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    named = running(sizes, by_name, {"nth": "1"}, space, "by-name")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    # ascending cap / weight, ties by name
    filled = space.put(running(named, [F.col("cap") / F.col("weight"), F.col("nth")], {"cap_before": "cap", "weight_before": "weight"}, space, "by-fill"), "filled")
    told = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    # in parts of 1 / share[1] word, so that all stays whole numbers
    total = (told.words or 0) * share[0]
    weight_left = F.lit(told.weight or 0) - F.col("weight_before")
    # a source is full when the level it would get, with all before it full, exceeds its cap
    full = F.col("cap") * weight_left * share[1] <= (F.lit(total) - F.col("cap_before") * share[1]) * F.col("weight")
    open_ = filled.where(~full).orderBy(F.col("cap") / F.col("weight"), "nth").select("cap_before", weight_left.alias("weight_left")).first()
    if open_ is None:
        return filled.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    share_of = (F.col("weight") * F.lit(total - open_.cap_before * share[1])).cast("double") / F.lit(open_.weight_left * share[1])
    return filled.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(share_of).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share=(3, 2), epochs: int = 2, seed: int = 17, bucket_bits: int | None = None) -> DataFrame:
    """How many words the mix takes of each document.

    Input columns: doc_id, text, source; others are ignored. Output: doc_id,
    source, size, source_size, target, taken (long, epoch parts included) and
    text_hash, which tells texts of one doc_id apart.

    A null text has size 0; null sources form one source, last in order. A
    repeated row counts as a document of its own; only rows equal in id and text
    tie, and for these it doesn't matter which comes first, so reruns agree over
    any partitioning. ``bucket_bits``: a source has 2 to that power buckets; by
    default the square root of all rows. A source without words has target 0.
    An empty table gives an empty result. No document exceeds ``epochs`` times
    its size.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    sized = space.put(
        need(docs, "doc_id", "text", "source").select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), text_hash().alias("text_hash"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key")),
        "sized")
    bits = min(31, sized.count().bit_length() // 2 + 1 if bucket_bits is None else bucket_bits)
    bucket = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits)
    sized = sized.withColumn("bucket", bucket)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    aims = targets(space.put(sizes, "sizes"), space, weights, share, epochs)
    ordered = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(ordered), F.lit(0)).alias("bucket_start"))
    offsets = space.put(
        offsets.alias("o").join(aims.alias("a"), F.col("o.source").eqNullSafe(F.col("a.source")))
        .select("o.source", "o.bucket", "bucket_start", "source_size", "target"), "offsets")
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("p").join(
        offsets.alias("o"), F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.bucket") == F.col("o.bucket")))
    budget = F.floor("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    cut = budget - turns * F.col("source_size") - F.col("bucket_start") - F.col("inside")
    taken = turns * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), cut))
    return joined.select(F.col("p.doc_id"), F.col("p.source"), "size", "source_size", "target", taken.alias("taken"), "text_hash")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nth FROM sizes),
weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM named),
ranked AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sizes) * 3 AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS cap_before,
         CAST((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_left
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, cap * weight_left * 2 <= (total - 2 * cap_before) * weight AS is_full FROM ranked),
opened AS (SELECT cap_before AS ocap, weight_left AS oleft FROM filled WHERE NOT is_full ORDER BY cap / weight, nth LIMIT 1),
aims AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * (total - 2 * (SELECT ocap FROM opened)) AS DOUBLE) / (2 * (SELECT oleft FROM opened)) END AS target
  FROM filled),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CAST(floor(a.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
turned AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS turns FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(turns * size + greatest(0, least(size, budget - turns * source_size - start)) AS BIGINT) AS taken
FROM turned
"""
