"""Near copies by shingle similarity, for the pipeline's stage.

Texts are sets of word shingles; two are near copies if the sets' exact Jaccard
similarity reaches a bound. Two ways propose pairs, and each proposed pair is
then held against the texts' shingles.

SimHash: the Gray-order index of ``simhash`` gives spanning forests of the
fingerprints, over the same shingles, that differ in at most three bits. Pairs
of similarity 0.8 differ in about ten, where no half of 64 bits is selective.

So MinHash bands propose too: texts that share all
minima of a band meet in a bucket, and a pair of similarity 0.8 shares none of
the BANDS with a chance of (1 - 0.8 ** ROWS) ** BANDS, about 7e-5.

In a bucket of at most ALL texts every pair is compared. In a larger one, all
are compared with its most central text, the one whose buckets are fullest, so a
group of copies of any size costs some rows for each text, not the square. Texts
of large buckets that are still in different classes are then joined exactly.
Shingles that a single class holds can't link two; of its other shingles, a text
must share one of the rarest with any text of another class like it (a prefix
filter), so only pairs that do are compared. No pair that shares a bucket is lost.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm import simhash
from genoloom.llm.common import Workspace, need, text_bytes, text_hash
from genoloom.llm.graph import components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
ALL = 8
SEED = 42


def distinct(raw: bytes) -> np.ndarray:
    """A set of shingles from their hashes; a text without words is one empty shingle."""
    import xxhash

    return np.unique(np.frombuffer(raw or xxhash.xxh64_digest(b"", SEED), ">u8").astype(np.uint64))


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    return distinct(simhash.digests(text, words))


def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)


def bands(found: np.ndarray, factors: np.ndarray) -> list[int]:
    """A signed 64-bit key of each band; it tells the band too."""
    import xxhash

    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(found), 2048):
        np.minimum(least, (found[at : at + 2048, None] * factors).min(0), out=least)
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _prints(batches, words: int):
    factors = _factors()
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        n, fps, keys = [], [], []
        for text in batch.column(2):
            raw = simhash.digests(text.as_py(), words)
            found = distinct(raw)
            n.append(len(found))
            fps.append(simhash.majority(raw))
            keys.append(bands(found, factors))
        fp = pa.array(np.array(fps, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), fp, pa.array(keys, pa.list_(pa.int64()))], schema=schema)


def _sets(batches, words: int):
    """Each text's shingles, a few megabytes of them together."""
    schema = pa.schema([("id", pa.int64()), ("found", pa.list_(pa.int64()))])
    for batch in batches:
        ids, found, size = [], [], 0
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(name)
            found.append(shingles(text.as_py(), words).view(np.int64))
            size += len(found[-1])
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)
                ids, found, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)


def close_prints(prints: DataFrame, space: Workspace) -> DataFrame:
    """Pairs (a, b) of text hashes that SimHash proposes: a text with the first of its fingerprint, and firsts as the index links them."""
    each = prints.select("fp", F.col("text_hash").alias("id")).distinct()
    first = space.put(each.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    same = each.join(first, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    named = lambda end: first.select(F.col("fp").alias(f"fp_{end}"), F.col("first").alias(end))
    linked = simhash.links(first.select("fp"), space).toDF("fp_a", "fp_b").where("fp_a <> fp_b").distinct()
    met = linked.join(named("a"), "fp_a").join(named("b"), "fp_b")
    return same.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike; a pair of sets at a time, inside the join's own stage."""
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("found").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("found").alias("of_a")), "a").select("a", "b", "of_a", "of_b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(shared / (F.size("of_a") + F.size("of_b") - shared) >= least).select("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), the lesser first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def across(texts: DataFrame, sets: DataFrame, space: Workspace, least: float) -> DataFrame:
    """Pairs (a, b) of ``texts`` (id, n, class) of different classes, all that can be alike and few more.

    Sets of n_a and n_b shingles are alike if they share ``least`` / (1 + ``least``)
    of n_a + n_b; these lie among the shingles that several classes hold. So if each
    text's are put in one order, rarest first, the two share one early enough in
    both that so many can follow.
    """
    sized = texts.join(texts.groupBy("class").agg(F.count(F.lit(1)).alias("size")), "class")
    each = sized.join(sets, "id").select("id", "n", "class", "size", F.explode("found").alias("shingle"))
    held, own = Window.partitionBy("shingle"), Window.partitionBy("id")
    # top: the largest class that holds the shingle
    marks = {"df": F.count(F.lit(1)), "low": F.min("class"), "high": F.max("class"), "top": F.max(F.struct("size", "class"))}
    shared = each.select("*", *[x.over(held).alias(name) for name, x in marks.items()]).where("low <> high")
    placed = shared.select("id", "n", "class", "shingle", F.col("top.class").alias("top"), F.row_number().over(own.orderBy("df", "shingle")).alias("place"), F.count(F.lit(1)).over(own).alias("all"))
    # how many shingles remain from the place on; the slack is for rounding and only adds pairs
    rare = placed.withColumn("rest", F.col("all") - F.col("place") + 1).where(F.col("rest") >= least * F.col("n") - 1e-6)
    rare = space.put(rare.select("shingle", "id", "n", "class", "top", "rest"), "rare")
    # pairs within a shingle's largest class are never formed
    one = rare.where("class <> top").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "class", "rest")])
    two = rare.select("shingle", "top", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "class", "rest")])
    met = one.join(two, "shingle").where("class_b = top or class_a < class_b").where(F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= least)
    met = met.where(F.least("rest_a", "rest_b") >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    return ordered(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def links(bare: DataFrame, prints: DataFrame, space: Workspace, words: int, least: float) -> DataFrame:
    """Pairs (a, b) of text hashes of near copies; their components are the classes."""
    entries = prints.dropDuplicates(["text_hash"]).select(F.col("text_hash").alias("id"), "n", F.explode("bands").alias("bucket"))
    left = space.put(entries.join(entries.groupBy("bucket").count().where("count > 1"), "bucket"), "entries")
    close = space.put(close_prints(prints, space), "close")
    wanted = left.select("id").unionByName(close.select(F.col("a").alias("id"))).unionByName(close.select(F.col("b").alias("id"))).distinct()
    texts = bare.select(F.col("text_hash").alias("id"), "text").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    sets = space.put(texts.mapInArrow(partial(_sets, words=words), "id long, found array<long>"), "sets")
    small = left.where(F.col("count") <= ALL).select("bucket", "id", "n")
    large = left.where(F.col("count") > ALL).select("bucket", "id", "n")
    other = small.select("bucket", F.col("id").alias("head"), F.col("n").alias("head_n"))
    central = large.join(left.groupBy("id").agg(F.sum("count").alias("fill")), "id")
    heads = central.groupBy("bucket").agg(F.max(F.struct("fill", "id", "n")).alias("head")).select("bucket", F.col("head.id").alias("head"), F.col("head.n").alias("head_n"))
    met = small.join(other, "bucket").where("head < id").unionByName(large.join(heads, "bucket").where("head <> id"))
    # sets of sizes further apart can't be alike
    near = met.where(F.least("n", "head_n") / F.greatest("n", "head_n") >= least)
    pairs = ordered(near.select(F.col("head").alias("a"), F.col("id").alias("b")).unionByName(close))
    found = space.put(alike(pairs, sets, least), "links-met")
    if large.isEmpty():
        return found
    known = large.join(components(found, space), F.col("id") == F.col("node"), "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("class"))
    known = space.put(known, "known")
    mixed = known.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    apart = space.put(known.join(mixed, "bucket", "left_semi").select("id", "n", "class").distinct(), "apart")
    return found.unionByName(space.put(alike(across(apart, sets, space, least), sets, least), "links-across"))


def near_copies(docs: DataFrame, words: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Classes of near copies of ``docs`` (doc_id, text): doc_id, text_hash, root, one row per row.

    Two texts are linked when the Jaccard similarity of their shingles of
    ``words`` words, ASCII letters in lower case, is ``least`` or more; a class
    is what links reach, ``root`` its least text hash. Null and empty texts
    are alike. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "near-copies")
    bare = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), text_bytes().alias("text"))
    prints = space.put(bare.mapInArrow(partial(_prints, words=words), "doc_id long, text_hash long, n long, fp long, bands array<long>"), "prints")
    found = components(links(bare, prints, space, words, least), space)
    return prints.join(found, F.col("text_hash") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))
