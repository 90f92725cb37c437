"""Exact deduplication as a stateful stream.

Arrivals (digest, stable identifier, content locator) are a log in the shared
folder. A Structured Streaming query reads the log in micro-batches and keeps
one state row per digest in a RocksDB state store, without watermark or
expiry: how often the digest came, and the identifier and locator of the row
that stays. State is on disk and recovers from the query's checkpoint.

A digest match is only a candidate. Hits, arrivals whose digest the state has
seen more than once, are found again by a filter of fixed size over those
digests, and their full normalised bytes are compared (aggregated before the
shuffle, so a hot group sends one row per task); where one digest covers several
texts, the groups come from the bytes instead of from the state. Texts whose
digest came once are not read for this beyond the filter, nor shuffled.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, lower_ascii, need

#: State on disk; no space is set aside ahead of need, as there may be many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


FILTER_BITS = 26


def digest_of(column="text"):
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(column), F.lit(""))).cast("binary"), 256))


def arrivals_of(docs: DataFrame) -> DataFrame:
    """Each row's digest, identifier and locator. ``row`` tells repeated rows apart."""
    return need(docs, "doc_id", "text").select(
        digest_of().alias("digest"),
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("file"),
    )


def state_of(arrivals: DataFrame, path: str, space: Workspace, files_per_batch: int) -> DataFrame:
    """Run the stream over the log at ``path``; the latest state of every digest."""
    spark = space.spark
    out = space.path("updates")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
            .groupBy("digest")
            .agg(F.count(F.lit(1)).alias("seen"), F.max(F.struct("doc_id", "row", "file")).alias("stays"))
        )
        query = (
            state.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", space.path("stream")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    empty = spark.createDataFrame([], state.schema)
    if not spark.read.parquet(path).limit(1).count():
        return empty
    updates = spark.read.schema(state.schema).option("basePath", out).parquet(f"{out}/batch=*")
    # counts only grow, so a digest's last update is the one with the highest count
    last = updates.groupBy("digest").agg(F.max(F.struct("seen", "stays")).alias("last"))
    return last.select("digest", "last.seen", "last.stays")


def _filter(hits: DataFrame) -> np.ndarray:
    """Bits of the hashes of these digests; of fixed size, however many there are."""
    low = F.xxhash64("digest").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = hits.select(F.shiftright(low, 3).alias("at"), F.expr("shiftleft(1, cast(xxhash64(digest) & 7 as int))").alias("bit"))
    table = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[table["at"].to_numpy()] = table["bits"].to_numpy()
    return out


def _told(batches, bits: np.ndarray):
    """The rows whose hash (the first column) the filter has."""
    import pyarrow as pa

    for batch in batches:
        low = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
        keep = bits[low >> 3] >> (low & 7).astype(np.uint8) & 1
        yield batch.filter(pa.array(keep.astype(bool)))


def exact_dedup(docs: DataFrame, files_per_batch: int = 256) -> DataFrame:
    """Groups of equal texts, equal meaning identical once A-Z are lower-cased.

    Input: doc_id, text; others are ignored. Output, one row per input row:
    doc_id, row (a number that tells repeated rows apart), digest, keep_id,
    keep_row, group_size, kept.

    A null text is an empty text. The row with the largest doc_id stays; null
    is smaller than any id; of rows with the same id and text exactly one
    stays. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "exact-dedup")
    arrivals = space.put(arrivals_of(docs), "arrivals")
    state = space.put(state_of(arrivals, space.path("arrivals"), space, files_per_batch), "state")
    numbered = arrivals.select("digest", "doc_id", "row")
    found = numbered.join(state.select("digest", "seen", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row")), "digest")

    # full bytes of the hits: digests that stand for more than one text
    hits = state.where("seen > 1").select("digest")
    body = lower_ascii(F.coalesce("text", F.lit("")))
    texts = need(docs, "doc_id", "text").select(body.alias("body"), "doc_id", F.monotonically_increasing_id().alias("row"))
    texts = texts.withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    texts = texts.select(F.xxhash64("digest").alias("hash"), "digest", "body", "doc_id", "row")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)
    variants = texts.mapInArrow(partial(_told, bits=_filter(hits)), schema).drop("hash")
    bodies = variants.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    clashes = space.put(bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "clashes")
    if clashes.limit(1).count():
        torn = variants.join(clashes.select("digest"), "digest", "left_semi")
        own = torn.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("seen"), F.max(F.struct("doc_id", "row")).alias("stays"))
        again = torn.select("digest", "body", "doc_id", "row").join(own, ["digest", "body"]).select(
            "digest", "doc_id", "row", "seen", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row"))
        found = found.join(clashes.select("digest"), "digest", "left_anti").unionByName(again)
    return found.select(
        "doc_id", "row", "digest", "keep_id", "keep_row", F.col("seen").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""
