"""BAM: block-gzipped binary alignments, decoded in Arrow batches.

Spark lists the files with its ``binaryFile`` source. A file larger than a
split, in a store that Arrow's file systems open, is read by many tasks: each
takes a range of blocks, guesses where its first record begins, walks the
records to the range's end and says where the next range must begin. The ends
are then held against the guesses, one row per range, so a wrong guess is found
and walked again from the right place; the counts give every record its number
in the file. Other files are read whole, by one task each.

A query of one contig or region reads only the blocks that a file's index (its
path with ``.bai``) names, where there is one; ``_seq`` is then a record's place
instead of its number, which orders alike.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes a task reads.
SPLIT_BYTES = 32 << 20
#: Bytes fetched at once.
RUN = 4 << 20
#: Records in a row that must look right where a range's first one is guessed.
CHAIN = 12
# Fixed values of the format.
MAGIC = b"BAM\1"
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
_BY_DIGIT = str.maketrans("0123456789abcdef", BASES)
RECORD = "chrom string, pos long, mapq long, flag long, seq string, qual binary, cigar array<struct<op:string,len:int>>, _seq long"


def block_size(data: bytes, at: int = 0) -> int:
    """Length of the gzip block at ``at`` by its BC field; 0 if none begins there or its head is cut off."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or at + 12 > len(data):
        return 0
    p = at + 12
    end = p + struct.unpack_from("<H", data, at + 10)[0]
    while p + 6 <= min(end, len(data)):
        if data[p : p + 4] == b"BC\2\0":
            return struct.unpack_from("<H", data, p + 4)[0] + 1
        p += 4 + struct.unpack_from("<H", data, p + 2)[0]
    return 0


def blocks(f, at: int, length: int):
    """(place, inflated bytes) of a file's blocks from ``at`` on, empty ones left out."""
    held, p = b"", 0
    while True:
        size = block_size(held, p)
        if not size or p + size > len(held):
            held, at, p = held[p:], at + p, 0
            if at + len(held) >= length:
                if held:
                    raise ValueError("the file ends inside a block, or isn't block-gzipped")
                return
            if size == 0 and len(held) >= 1 << 17:
                raise ValueError("not block-gzipped")
            f.seek(at + len(held))
            held += f.read(RUN)
            continue
        raw = zlib.decompress(held[p : p + size], 31)
        if raw:
            yield at + p, raw
        p += size


def inflate(data: bytes) -> bytes:
    """All members of a (block-)gzip file."""
    out, view = [], memoryview(data)
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        if size := block_size(data, at):
            out.append(d.decompress(view[at : at + size]) + d.flush())
            at += size
        else:
            out.append(d.decompress(view[at:]) + d.flush())
            at = len(data) - len(d.unused_data)
    return b"".join(out)


def header(raw: bytes) -> tuple[list[tuple[str, int]], int]:
    """Contigs and where the records start."""
    if raw[:4] != MAGIC:
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    n = struct.unpack_from("<i", raw, at)[0]
    at += 4
    contigs = []
    for _ in range(n):
        size = struct.unpack_from("<i", raw, at)[0]
        name = raw[at + 4 : at + 3 + size].decode()
        contigs.append((name, struct.unpack_from("<i", raw, at + 4 + size)[0]))
        at += 8 + size
    return contigs, at


def record(raw: bytes, at: int, contigs, number: int) -> tuple:
    _, ref, pos, name_len, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiiBBHHHi", raw, at)
    p = at + 36 + name_len
    cigar = [{"op": OPS[c & 15], "len": c >> 4} for c in struct.unpack_from(f"<{n_cigar}I", raw, p)]
    p += 4 * n_cigar
    packed = raw[p : p + (n_seq + 1) // 2]
    seq = packed.hex().translate(_BY_DIGIT)[:n_seq]
    p += (n_seq + 1) // 2
    return (contigs[ref][0] if ref >= 0 else None, pos + 1, mapq, flag, seq, raw[p : p + n_seq], cigar, number)


def records(raw: bytes):
    contigs, at = header(raw)
    number = 0
    while at + 4 <= len(raw):
        yield record(raw, at, contigs, number)
        number += 1
        at += 4 + struct.unpack_from("<i", raw, at)[0]


class Span:
    """(buffer, offset) of the records from a place (block, byte) on that begin before block ``stop``.

    ``end`` is then the place of the next record, (length, 0) if there is none.
    """

    def __init__(self, f, length: int, start: tuple[int, int], stop: int) -> None:
        self.f, self.length, self.start, self.stop, self.end = f, length, start, stop, start

    def __iter__(self):
        source = blocks(self.f, self.start[0], self.length)
        held, at, marks, k = b"", self.start[1], [], 0
        while True:
            parts, size = [held], len(held)
            for place, raw in source:
                marks.append((size, place))
                parts.append(raw)
                size += len(raw)
                if size - len(held) >= RUN:
                    break
            last = len(parts) == 1
            held = b"".join(parts)
            while at < len(held):
                while k + 1 < len(marks) and marks[k + 1][0] <= at:
                    k += 1
                self.end = (marks[k][1], at - marks[k][0])
                if self.end[0] >= self.stop:
                    return
                size = struct.unpack_from("<i", held, at)[0] + 4 if at + 4 <= len(held) else 1 << 40
                if size < 36:
                    raise ValueError("damaged record")
                if at + size > len(held):
                    break
                yield held, at
                at += size
            if last:
                if at < len(held):
                    raise ValueError("the file ends inside a record")
                self.end = (self.length, 0)
                return
            held, marks, k, at = held[at:], [(o - at, place) for o, place in marks[k:]], 0, 0


def opened(path: str):
    """A file by Arrow's file systems, or None where they can't open it."""
    from pyarrow import fs

    try:
        if path.startswith("file:"):
            return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
        system, inside = fs.FileSystem.from_uri(path)
        return system.open_input_file(inside)
    except (OSError, ValueError, NotImplementedError):
        return None


@lru_cache(maxsize=8)
def head(path: str, length: int) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """A file's contigs and the place of its first record."""
    raw, sizes, tried = b"", [], 0
    with opened(path) as f:
        for place, part in blocks(f, 0, length):
            sizes.append((len(raw), place))
            raw += part
            if len(raw) < 2 * tried:
                continue
            tried = len(raw)
            try:
                contigs, at = header(raw)
            except struct.error:
                continue
            if at < len(raw):
                return contigs, next((place, at - o) for o, place in reversed(sizes) if o <= at)
    return header(raw)[0], (length, 0)


def _likely(raw: bytes, at: int, n: int) -> bool:
    """Whether records of a file of ``n`` contigs may begin at ``at``, as far as ``raw`` goes."""
    for i in range(CHAIN):
        if at + 36 > len(raw):
            return i > 0
        size, ref, pos, name_len, _, _, n_cigar, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", raw, at)
        if not (-1 <= ref < n and -1 <= mate < n and pos >= -1 and mate_pos >= -1 and name_len and 0 <= n_seq and 32 + name_len + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size):
            return False
        if at + 36 + name_len <= len(raw) and raw[at + 35 + name_len]:
            return False
        at += 4 + size
    return True


def guess(f, length: int, low: int, n: int) -> tuple[int, int] | None:
    """The likely place of the first record in blocks from ``low`` on."""
    f.seek(low)
    data = f.read(1 << 18)
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        size = block_size(data, at)
        if size and (low + at + size == length or block_size(data, at + size)):
            break
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    if at < 0:
        return None
    raw, marks = b"", []
    for place, part in blocks(f, low + at, length):
        marks.append((len(raw), place))
        raw += part
        if len(raw) > 1 << 18:
            break
    found = next((u for u in range(len(raw)) if _likely(raw, u, n)), None)
    return None if found is None else next((place, found - o) for o, place in reversed(marks) if o <= found)


def walk(path: str, length: int, start: tuple[int, int], stop: int) -> tuple[tuple[int, int], int]:
    """The place after the records that begin before ``stop``, and their number."""
    with opened(path) as f:
        span = Span(f, length, start, stop)
        n = sum(1 for _ in span)
        return span.end, n


WALKED = ("path", "length", "low", "high", "block", "byte", "end_block", "end_byte", "n")
WALKED_TYPE = "path string, " + ", ".join(f"{c} long" for c in WALKED[1:])


def _walk(batches):
    for batch in batches:
        for r in batch.to_pylist():
            path, length, low, high = r["path"], r["length"], r["low"], r["high"]
            contigs, first = head(path, length)
            if low:
                with opened(path) as f:
                    first = guess(f, length, low, len(contigs))
            try:
                end, n = walk(path, length, first, high) if first else ((None, None), None)
            except (ValueError, zlib.error):
                # a wrong guess; a file that is really damaged fails again from the right place
                first, end, n = None, (None, None), None
            row = (path, length, low, high, *(first or (None, None)), *end, n)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if c == "path" else pa.int64()) for c, x in zip(WALKED, row)], names=list(WALKED))


def _spread(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """One row a task."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "task int, " + schema).repartitionById(max(1, len(rows)), "task").drop("task")


def ranges(spark: SparkSession, files_: list[tuple[str, int]], split_bytes: int) -> list[tuple]:
    """(path, length, block, byte, stop, number) of every range with records, places exact."""
    parts = [(path, length, low, min(length, low + split_bytes)) for path, length in files_ for low in range(0, length, split_bytes)]
    walked = _spread(spark, parts, "path string, length long, low long, high long").mapInArrow(_walk, WALKED_TYPE).collect()
    found, place, number = [], None, 0
    for r in sorted(walked, key=lambda r: (r.path, r.low)):
        if not r.low:
            place, number = head(r.path, r.length)[1], 0
        if place[0] >= r.high:
            continue
        end, n = ((r.end_block, r.end_byte), r.n) if (r.block, r.byte) == place and r.n is not None else walk(r.path, r.length, place, r.high)
        found.append((r.path, r.length, *place, r.high, number))
        place, number = end, number + n
    return found


def index_spans(index: bytes, ref: int, start: int, end: int) -> list[tuple[tuple[int, int], int]]:
    """((block, byte), last block) of the stretches that may hold records overlapping 0-based [start, end) of a contig.

    Stretches that share a block are one, so no record is in two.
    """
    if index[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    at, n_ref = 8, struct.unpack_from("<i", index, 4)[0]
    if not 0 <= ref < n_ref or end <= start:
        return []
    end = min(end, 1 << 29)
    # bins of 512 Mb, 64 Mb, 8 Mb, 1 Mb, 128 kb and 16 kb, numbered level by level
    wanted = set()
    for level in range(6):
        first, width = ((1 << 3 * level) - 1) // 7, 29 - 3 * level
        wanted.update(range(first + (start >> width), first + ((end - 1) >> width) + 1))
    chunks: list[tuple[int, int]] = []
    least = 0
    for i in range(ref + 1):
        n_bin = struct.unpack_from("<i", index, at)[0]
        at += 4
        for _ in range(n_bin):
            number, n_chunk = struct.unpack_from("<Ii", index, at)
            at += 8
            if i == ref and number in wanted:
                flat = struct.unpack_from(f"<{2 * n_chunk}Q", index, at)
                chunks += zip(flat[::2], flat[1::2])
            at += 16 * n_chunk
        n_intv = struct.unpack_from("<i", index, at)[0]
        if i == ref and n_intv:
            # no record that reaches the first 16 kb wanted begins before this
            least = struct.unpack_from("<Q", index, at + 4 + 8 * min(start >> 14, n_intv - 1))[0] if start >> 14 < n_intv else 0
        at += 4 + 8 * n_intv
    out: list[list] = []
    for a, b in sorted((max(a, least), b) for a, b in chunks if b > least):
        if out and a >> 16 <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b >> 16)
        else:
            out.append([a, b >> 16])
    return [((a >> 16, a & 0xFFFF), last) for a, last in out]


def indexed(spark: SparkSession, path: str, region: tuple, split_bytes: int) -> tuple[list[str], list[tuple]] | None:
    """Files under ``path`` with an index, and the (path, length, block, byte, stop, number) of what the region needs of them."""
    chrom, start, end = region
    done, found = [], []
    for r in files(spark, path).select("path", "length").collect():
        f, index = opened(r.path), opened(r.path + ".bai")
        if f is None or index is None:
            continue
        with f, index:
            names = [n for n, _ in head(r.path, r.length)[0]]
            spans = index_spans(index.read(), names.index(chrom), max(0, (start or 1) - 1), end if end is not None else 1 << 29) if chrom in names else []
        done.append(r.path)
        found += [(r.path, r.length, *place, last + 1, place[0] << 16 | place[1]) for place, last in spans]
    return done, found


SCHEMA = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int64()), ("flag", pa.int64()), ("seq", pa.string()), ("qual", pa.binary()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("_seq", pa.int64())])


def _batched(rows):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)


def _decode(batches):
    for batch in batches:
        for content in batch.column(0):
            yield from _batched(records(inflate(content.as_py())))


def _decode_range(batches):
    for batch in batches:
        for r in batch.to_pylist():
            contigs, _ = head(r["path"], r["length"])
            with opened(r["path"]) as f:
                span = Span(f, r["length"], (r["block"], r["byte"]), r["stop"])
                yield from _batched(record(raw, at, contigs, r["number"] + i) for i, (raw, at) in enumerate(span))


def _contigs(batches):
    for batch in batches:
        for content in batch.column(0):
            found, _ = header(inflate(content.as_py()))
            yield _contig_rows(found)


def _contigs_of_head(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield _contig_rows(head(r["path"], r["length"])[0])


def _contig_rows(found):
    return pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in found], pa.string()), "length": pa.array([x for _, x in found], pa.int64()), "_seq": pa.array(range(len(found)), pa.int64())})


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(~F.endswith("path", F.lit(".bai")))


def large(spark: SparkSession, path: str, split_bytes: int) -> list[tuple[str, int]]:
    """Paths and lengths of block-gzipped files above ``split_bytes`` that tasks can open in the middle."""
    found = []
    for r in files(spark, path).where(F.col("length") > split_bytes).select("path", "length").collect():
        f = opened(r.path)
        if f is not None:
            with f:
                if block_size(f.read(1 << 16)):
                    found.append((r.path, r.length))
    return found


def _whole(spark: SparkSession, path: str, apart: list, decode, schema: str) -> DataFrame:
    found = files(spark, path)
    if apart:
        found = found.where(~F.col("path").isin([p for p, _ in apart]))
    return found.select("content").mapInArrow(decode, schema)


def bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, region: tuple | None = None) -> DataFrame:
    """Alignments with 1-based positions; ``_seq`` orders a file's records.

    ``region`` (contig, first and last position or None): files with an index
    give only the blocks it may be in, a task for each stretch; the caller
    still filters. Other files above ``split_bytes`` are walked once, when this
    is called, and then decoded by a task for each range.
    """
    done, parts = indexed(spark, path, region, split_bytes) if region else ([], [])
    apart = [x for x in large(spark, path, split_bytes) if x[0] not in set(done)]
    out = _whole(spark, path, [*apart, *((p, 0) for p in done)], _decode, RECORD)
    if apart:
        parts = parts + ranges(spark, apart, split_bytes)
    if not parts:
        return out
    spread = _spread(spark, parts, "path string, length long, block long, byte long, stop long, number long").mapInArrow(_decode_range, RECORD)
    return out.unionByName(spread)


def contigs(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Contigs by the headers; of a large file only the head is read."""
    schema = "name string, length long, _seq long"
    apart = large(spark, path, split_bytes)
    whole = _whole(spark, path, apart, _contigs, schema)
    if not apart:
        return whole
    return whole.unionByName(_spread(spark, apart, "path string, length long").mapInArrow(_contigs_of_head, schema))


def bam_bytes(contigs: list[tuple[str, int]], rows) -> bytes:
    """A BAM of (chrom, 1-based pos, mapq, flag, seq, qualities, cigar text), for tests and examples."""
    import re

    ids = {n: i for i, (n, _) in enumerate(contigs)}
    out = [MAGIC, struct.pack("<i", 0), struct.pack("<i", len(contigs))]
    for name, size in contigs:
        out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size))
    for chrom, pos, mapq, flag, seq, qual, cigar in rows:
        ops = [(int(n) << 4) | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        codes = [BASES.index(b) for b in seq] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", ids.get(chrom, -1), pos - 1, 2, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + b"r\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(qual)
        out.append(struct.pack("<i", len(body)) + body)
    raw, packed_blocks = b"".join(out), []
    for i in range(0, max(1, len(raw)), 60_000):
        part = raw[i : i + 60_000]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        packed_blocks.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join([*packed_blocks, bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")])


def write_bam(path: str, contigs: list[tuple[str, int]], rows) -> None:
    """The same as a file of the driver."""
    with open(path, "wb") as f:
        f.write(bam_bytes(contigs, rows))
