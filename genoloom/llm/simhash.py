"""Near-duplicates by SimHash with a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so neighbours share most bits,
and cut into shards. Within a shard, groups of neighbours form the leaves of a
tree; a node stores the bits all its fingerprints agree on, less what its
ancestors already store (a mask and the bits under it). A search adds up the
differences to the shared patterns on its way down and drops a whole group as
soon as the sum exceeds the distance. The shards' own patterns are the tree's
top; a query visits only the shards it passes there.

Two fingerprints that differ in at most three bits agree up to one bit in one
of their halves. So there are two indexes, each sorted by one half first, and a
search drops a group once its first half differs in more than one bit: the
number of shards a query visits grows with the logarithm of the data.

Tasks return spanning forests, not pairs, so a large group of near copies costs
one row per fingerprint and shard it reaches.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, need, text_bytes, text_hash
from genoloom.llm.graph import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
FAN = 16
FIRST_HALF = np.uint64(0xFFFFFFFF00000000)
SHARD_ROWS = 4096
#: At most so many shards, whose patterns the driver holds (24 bytes each); beyond, shards grow.
MOST_SHARDS = 200_000
#: Queries searched together.
BLOCK = 1024


def digests(text: bytes, words: int = SHINGLE) -> bytes:
    """The 64-bit hashes of a text's word shingles, repeats included; none of a text without words."""
    import xxhash

    w = text.lower().split()
    if not w:
        return b""
    grams = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
    return b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED)))


def majority(raw: bytes) -> int:
    """The 64 bits that over half of these hashes have; zero of none."""
    n = len(raw) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, 8 * min(65_536, n - at), 8 * at))
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted."""
    return majority(digests(text, words))


def _fingerprints(batches, words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], schema=schema)


def turned(fp: np.ndarray, half: int) -> np.ndarray:
    """Fingerprints with the given half (0: upper, 1: lower) first."""
    return (fp << np.uint64(32)) | (fp >> np.uint64(32)) if half else fp


def gray_rank(column):
    """Place in Gray order as a signed long that sorts like the unsigned rank."""
    x = column
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


class GrayTree:
    """The index over values sorted by Gray rank; leaves hold FAN values."""

    def __init__(self, both: np.ndarray, any_: np.ndarray | None = None) -> None:
        """``both`` and ``any_``: the bits that all and that any of each item's fingerprints have."""
        any_ = both if any_ is None else any_
        self.levels = []  # from the items up: (mask, bits)
        levels = [(both, any_)]
        while len(levels[-1][0]) > FAN:
            at = np.arange(0, len(levels[-1][0]), FAN)
            levels.append((np.bitwise_and.reduceat(levels[-1][0], at), np.bitwise_or.reduceat(levels[-1][1], at)))
        for i, (low, high) in enumerate(levels):
            mask = ~(low ^ high)
            if i + 1 < len(levels):
                up = ~(levels[i + 1][0] ^ levels[i + 1][1])
                mask = mask & ~np.repeat(up, FAN)[: len(mask)]
            self.levels.append((mask, low & mask))

    def search(self, queries: np.ndarray, distance: int = DISTANCE):
        """(query, item) numbers that may be within the distance; exact where items are single values."""
        mask, bits = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        total = np.zeros(len(q), np.uint8)
        first = np.zeros(len(q), np.uint8)
        for i in range(len(self.levels) - 1, -1, -1):
            mask, bits = self.levels[i]
            differ = (queries[q] ^ bits[node]) & mask[node]
            total = total + np.bitwise_count(differ)
            first = first + np.bitwise_count(differ & FIRST_HALF)
            keep = np.nonzero((total <= distance) & (first <= distance // 2))[0]
            q, node, total, first = q[keep], node[keep], total[keep], first[keep]
            if i:
                below = len(self.levels[i - 1][0])
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = np.nonzero(node < below)[0]
                node = node[inside]
                q, total, first = (np.repeat(x, FAN)[inside] for x in (q, total, first))
        return q, node


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of each a and b in place; a set's label is its least member."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = np.nonzero(la != lb)[0]
        if not len(apart):
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _route(batches, tops: dict, distance: int):
    """Each fingerprint with the later shards of its index that may hold neighbours."""
    schema = pa.schema([("half", pa.int32()), ("shard", pa.int32()), ("fp", pa.int64())])
    trees = {half: (GrayTree(low, high), shards) for half, (shards, low, high) in tops.items()}
    for batch in batches:
        halves, own, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for half in np.unique(halves).tolist():
            tree, shards = trees[half]
            mine = np.nonzero(halves == half)[0]
            for at in range(0, len(mine), BLOCK):
                part = mine[at : at + BLOCK]
                q, item = tree.search(turned(fps[part].view(np.uint64), half), distance)
                later = shards[item] > own[part][q]
                q, item = q[later], item[later]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), half, np.int32)), pa.array(shards[item].astype(np.int32)), pa.array(fps[part][q])], schema=schema)


def _search_shard(key, members, visitors, distance: int):
    half = key[0].as_py()
    own = members.column("fp").to_numpy().view(np.uint64)
    own = turned(own, half)
    x = own.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    own = own[np.argsort(x, kind="stable")]
    guests = turned(visitors.column("fp").to_numpy().view(np.uint64), half)
    nodes = np.concatenate([own, guests])
    labels = np.arange(len(nodes))
    if len(own):
        tree = GrayTree(own)
        for at in range(0, len(nodes), BLOCK):
            q, item = tree.search(nodes[at : at + BLOCK], distance)
            unite(labels, q + at, item)
    moved = np.nonzero(labels != np.arange(len(nodes)))[0]
    back = turned(nodes, half)
    return pa.table({"a": pa.array(back[moved].view(np.int64)), "b": pa.array(back[labels[moved]].view(np.int64))})


def links(distinct: DataFrame, space: Workspace, distance: int = DISTANCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` (fp) within ``distance``.

    ``distance`` of at most 3: the halves' bound is distance // 2 of one half.
    """
    count = distinct.count()
    shards = max(1, -(-count // max(shard_rows, -(-count // MOST_SHARDS))))
    parts = []
    for half in (0, 1):
        value = F.col("fp") if not half else F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
        ranked = distinct.select("fp", gray_rank(value).alias("rank")).repartitionByRange(shards, "rank")
        parts.append(ranked.select(F.lit(half).alias("half"), F.spark_partition_id().alias("shard"), "fp"))
        space.put(parts[-1], f"half={half}")
    held = space.spark.read.schema("half int, shard int, fp long").parquet(space.path("half=0"), space.path("half=1"))
    # one row per shard of about shard_rows fingerprints: the index's top
    value = F.when(F.col("half") == 0, F.col("fp")).otherwise(F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32)))
    rows = held.groupBy("half", "shard").agg(F.bit_and(value).alias("low"), F.bit_or(value).alias("high")).orderBy("half", "shard").collect()
    tops = {}
    for half in (0, 1):
        mine = [r for r in rows if r.half == half]
        if mine:
            tops[half] = (np.array([r.shard for r in mine]), *(np.array([getattr(r, x) for r in mine], np.int64).view(np.uint64) for x in ("low", "high")))
    routed = held.mapInArrow(partial(_route, tops=tops, distance=distance), "half int, shard int, fp long")
    found = held.groupBy("half", "shard").cogroup(routed.groupBy("half", "shard")).applyInArrow(_search_with(distance), "a long, b long")
    return space.put(found, "links")


def _search_with(distance: int):
    def search(key, members, visitors):
        return _search_shard(key, members, visitors, distance)

    return search


def near_duplicates(docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Classes of near-duplicates of ``docs`` (doc_id, text): doc_id, fp (signed 64-bit), component_id, root, text_hash.

    Two documents are linked when their fingerprints differ in at most
    ``distance`` bits (3 at most); a class is what links reach, and its id is
    its smallest doc_id; ``root`` is the class's least fingerprint. A text of fewer words than a shingle is one shingle; a
    null or empty text has fingerprint zero and links like any other. Null
    doc_ids take part but are nobody's id, unless the class has no other.
    Repeated rows come back as often as they came. An empty table gives an
    empty result.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    space = Workspace(docs.sparkSession, "simhash")
    bare = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_bytes().alias("text"), text_hash().alias("text_hash"))
    prints = space.put(bare.mapInArrow(partial(_fingerprints, words=words), "doc_id long, fp long, text_hash long"), "prints")
    distinct = space.put(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), space, distance), space)
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = space.put(rooted.join(names, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def op5_simhash_gray(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
