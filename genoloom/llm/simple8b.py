"""Token ids in files of Simple-8b words.

A file holds whole documents in ascending doc_id order. Ids are packed into
64-bit words, a 4-bit selector and as many ids of one width as fit; the longest
run that fits is taken each time. Ids are cut into blocks of ``BLOCK``, packed
on their own, so blocks decode independently.

Layout, little-endian:
  magic "S8B1", u32 documents, u64 ids, u32 blocks, u32 escapes
  i64 doc_id and u8 null flag per document, u64 first id of each document and the end
  u64 word offset of each block and the end
  u64 position and u64 value per escape (a value of 61 bits or more; its slot packs as 0)
  u64 words

Spark writes one such file image per row of a Parquet table, because executors
reach a cluster's store only through Spark's writers; ``export`` puts plain
files into a folder where the driver can write.
"""

from __future__ import annotations

import os
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, need, text_hash
from genoloom.llm.tokens import default_vocabulary, encoder

MAGIC = b"S8B1"
BLOCK = 65_536
#: (ids in a word, bits each), by selector; fixed values of the format.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
IDS_PER_FILE = 1_000_000


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, as uint8."""
    out = np.zeros(len(ids), np.uint8)
    rest = ids.copy()
    while rest.any():
        np.add(out, rest > 0, out=out, casting="unsafe")
        rest >>= np.uint64(1)
    return out


_WIDTH16 = widths(np.arange(1 << 16, dtype=np.uint64))


def pack_block(ids: np.ndarray) -> np.ndarray:
    """The words of one block of ids (uint64, below 2**60)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    small = int(ids.max()) < 1 << 16
    bits = _WIDTH16[ids.astype(np.int64)] if small else widths(ids)
    # most[k][i]: widest of the k ids from i on; longest run that fits wins
    selector = np.full(n, 15, np.uint8)
    most, span = bits, 1
    for code in range(14, -1, -1):
        count, width = SELECTORS[code]
        if count > n:
            break
        while span < count:
            step = min(span, count - span)
            most = np.maximum(most[: len(most) - step], most[step:])
            span += step
        fits = most <= width
        if not fits.any():
            if width < 2:
                break
            continue
        np.putmask(selector[: len(most)], fits, code)
    lengths = bytes(np.array([c for c, _ in SELECTORS], np.uint8)[selector])
    starts, i = [], 0
    add = starts.append
    while i < n:
        add(i)
        i += lengths[i]
    at = np.array(starts, np.int64)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for code in np.unique(chosen):
        count, width = SELECTORS[code]
        if not width:
            continue
        where = np.nonzero(chosen == code)[0]
        first = at[where]
        packed = np.zeros(len(where), np.uint64)
        for k in range(count):
            packed |= ids[first + k] << np.uint64(k * width)
        words[where] |= packed
    return words


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The ids of any number of whole blocks, all words at once."""
    codes = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[codes]
    ends = np.cumsum(counts)
    out = np.zeros(n, np.uint64)
    for code in np.unique(codes):
        count, width = SELECTORS[code]
        if not width:
            continue
        where = np.nonzero(codes == code)[0]
        first = ends[where] - count
        body = words[where]
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[first + k] = (body >> np.uint64(k * width)) & mask
    return out


def write_image(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """One file image for whole documents and their ids."""
    flat = np.concatenate(ids).astype(np.uint64) if ids else np.zeros(0, np.uint64)
    big = np.nonzero(flat >> np.uint64(60))[0]
    escapes = np.stack([big.astype(np.uint64), flat[big]], 1) if len(big) else np.zeros((0, 2), np.uint64)
    flat[big] = 0
    blocks = [pack_block(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)]
    starts = np.cumsum([0] + [len(x) for x in ids]).astype("<u8")
    offsets = np.cumsum([0] + [len(b) for b in blocks]).astype("<u8")
    head = MAGIC + np.array([len(ids)], "<u4").tobytes() + np.array([len(flat)], "<u8").tobytes() + np.array([len(blocks), len(big)], "<u4").tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return b"".join([head, names, starts.tobytes(), offsets.tobytes(), escapes.astype("<u8").tobytes(), *[b.astype("<u8").tobytes() for b in blocks]])


def _header(image: bytes) -> tuple[int, int, int, int]:
    """(documents, ids, blocks, escapes) of a file image."""
    if image[:4] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    return int(np.frombuffer(image, "<u4", 1, 4)[0]), int(np.frombuffer(image, "<u8", 1, 8)[0]), *(int(x) for x in np.frombuffer(image, "<u4", 2, 16))


def read_range(image: bytes, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a file image; only the blocks they lie in are decoded."""
    docs, n, blocks, big = _header(image)
    end = min(end, n)
    if start >= end:
        return np.zeros(0, np.uint64)
    at = 24 + 9 * docs + 8 * (docs + 1)
    offsets = np.frombuffer(image, "<u8", blocks + 1, at).astype(np.int64)
    at += 8 * (blocks + 1)
    escapes = np.frombuffer(image, "<u8", 2 * big, at).reshape(-1, 2)
    at += 16 * big
    first, last = start // BLOCK, (end - 1) // BLOCK
    words = np.frombuffer(image, "<u8", int(offsets[last + 1] - offsets[first]), at + 8 * int(offsets[first])).astype(np.uint64)
    base = first * BLOCK
    ids = unpack_words(words, min(n, (last + 1) * BLOCK) - base)
    here = escapes[np.searchsorted(escapes[:, 0], base) : np.searchsorted(escapes[:, 0], base + len(ids))]
    ids[here[:, 0].astype(np.int64) - base] = here[:, 1]
    return ids[start - base : end - base]


def read_image(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, first id of each document and the end, all ids) of a file image."""
    docs, n, blocks, big = _header(image)
    at = 24
    names = np.frombuffer(image, "<i8", docs, at)
    at += 8 * docs
    nulls = image[at : at + docs]
    at += docs
    starts = np.frombuffer(image, "<u8", docs + 1, at)
    at += 8 * (docs + 1)
    offsets = np.frombuffer(image, "<u8", blocks + 1, at)
    at += 8 * (blocks + 1)
    escapes = np.frombuffer(image, "<u8", 2 * big, at).reshape(-1, 2)
    at += 16 * big
    ids = unpack_words(np.frombuffer(image, "<u8", int(offsets[-1]), at).astype(np.uint64), n)
    if big:
        ids[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return [None if nulls[i] else int(names[i]) for i in range(docs)], starts.astype(np.int64), ids


IMAGES = "part int, file int, n_ids long, image binary"


def _encode(batches, vocabulary: str, end_id: int, per_file: int):
    from pyspark import TaskContext

    part, file = TaskContext.get().partitionId(), 0
    bpe = encoder(vocabulary)
    end = np.array([end_id], "<u4")
    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_ids", pa.int64()), ("image", pa.binary())])
    names: list = []
    held: list[np.ndarray] = []
    size = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([size], pa.int64()), pa.array([write_image(names, held)], pa.binary())], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids = np.concatenate([np.frombuffer(bpe.encode_one(text.as_py() or ""), bpe.dtype), end])
            if held and size + len(ids) > per_file:
                yield flush()
                names, held, size, file = [], [], 0, file + 1
            names.append(doc_id.as_py())
            held.append(ids)
            size += len(ids)
    if held:
        yield flush()


def _decode(batches):
    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for part, file, image in zip(*(batch.column(i) for i in range(3))):
            names, starts, ids = read_image(image.as_py())
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            n = len(names)
            yield pa.RecordBatch.from_arrays([
                pa.array([part.as_py()] * n, pa.int32()), pa.array([file.as_py()] * n, pa.int32()), pa.array(names, pa.int64()),
                pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], schema=schema)


def write_ids(docs: DataFrame, space: Workspace, vocabulary: str | None = None, end_id: int = 0, per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the file images; the table of images.

    Documents are range-partitioned by doc_id and their texts' hash, so that rows
    without an id, or with the same one, spread too, and sorted, so (part, file)
    order is doc_id order. A null text is empty, a null doc_id comes first. A
    document is never split over files; every document ends with ``end_id``. A
    document whose ids need 2 GB or more doesn't fit a file's row and raises an
    error. An empty table writes none.
    """
    ordered = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash"))
    ordered = ordered.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text")
    run = partial(_encode, vocabulary=vocabulary or default_vocabulary(), end_id=end_id, per_file=per_file)
    return space.put(ordered.mapInArrow(run, IMAGES), "images")


def read_ids(images: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files' own starts are prefix-summed in two steps, over a part's files
    and over the parts, so no task sees more than one part's files or one row per part.
    """
    from pyspark.sql import Window

    docs = images.select("part", "file", "image").mapInArrow(_decode, "part int, file int, doc_id long, start long, n_tokens long, ids_crc32 long")
    files = images.select("part", "file", "n_ids")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("file_start")).join(parts, "part")
    return docs.join(files, ["part", "file"]).select("doc_id", (F.col("part_start") + F.col("file_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def export(images: DataFrame, folder: str) -> list[str]:
    """Write each image as a plain file into a folder of the driver, one at a time."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in images.orderBy("part", "file").toLocalIterator():
        out.append(os.path.join(folder, f"ids-{row.part:05d}-{row.file:05d}.s8b"))
        with open(out[-1], "wb") as f:
            f.write(row.image)
    return out


def op3_simple8b(spark, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "simple8b")
    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), space))
