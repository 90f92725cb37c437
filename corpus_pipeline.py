"""The corpus pipeline: stages over ``documents``, each on what the one before kept.

Every stage but the last returns the columns of ``documents``. A decision finds
its row again by doc_id and the text's hash, so rows without an id, and rows
that share one, keep their own fates; rows equal in both are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, text_hash
from genoloom.llm.exact_dedup import digest_of, exact_dedup
from genoloom.llm.mixing import mix
from genoloom.llm.near_copies import near_copies
from genoloom.llm.packing import pack
from genoloom.llm.toxicity import toxicity


def _chosen(docs: DataFrame, picked: DataFrame, how: str, hash_of=text_hash) -> DataFrame:
    """Rows of ``docs`` with (or, by ``how``, without) their doc_id and hash in ``picked`` (pick_id, pick_hash)."""
    marked = docs.withColumn("_hash", hash_of())
    same = F.col("doc_id").eqNullSafe(F.col("pick_id")) & (F.col("_hash") == F.col("pick_hash"))
    return marked.join(picked, same, how)


def _picks(found: DataFrame, hash_column: str) -> DataFrame:
    return found.select(F.col("doc_id").alias("pick_id"), F.col(hash_column).alias("pick_hash")).distinct()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity scoring rejects go."""
    bad = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1")
    return _chosen(docs, _picks(bad, "text_hash"), "left_anti").drop("_hash")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    kept = _picks(exact_dedup(docs).where("kept"), "digest")
    return _chosen(docs, kept, "left_semi", digest_of).dropDuplicates(["doc_id", "_hash"]).drop("_hash")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class stays; links are five-word similarities of 0.8 or more."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = near_copies(docs).groupBy("root").agg(first).select("first.doc_id", "first.text_hash")
    return _chosen(docs, _picks(kept, "text_hash"), "left_semi").dropDuplicates(["doc_id", "_hash"]).drop("_hash")


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last time cut after the words it takes.

    A document of which the mix takes 1.4 times its words comes whole and once
    more as its first 0.4; one it takes nothing of goes.
    """
    plan = mix(docs).groupBy(F.col("doc_id").alias("pick_id"), F.col("text_hash").alias("pick_hash")).agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    joined = _chosen(docs, plan, "inner")
    taken, size = F.col("_taken"), F.col("_size")
    whole = F.floor(taken / F.greatest(size, F.lit(1))).cast("int")
    left = (taken - whole * size).cast("int")
    turns = F.when(taken > 0, F.sequence(F.lit(1), whole + (left > 0).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = F.when(F.col("_turn") > whole, left)
    # pieces of blanks and the word after them, so that their first ones are the text's beginning as it is
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, 1, F.greatest(F.col("_part"), F.lit(1))), "")
    rows = joined.withColumn("_turn", F.explode(turns)).withColumn("_part", part).withColumn("_text", F.when(F.col("_part").isNull(), F.col("text")).otherwise(cut))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast(docs.schema["n_chars"].dataType)}
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, as pieces of documents."""
    return pack(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", take_mix),
    ("packing", pack_windows),
]
#: SQL can't express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back before the next."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = space.put(docs, f"stage-{i}")
    return docs
