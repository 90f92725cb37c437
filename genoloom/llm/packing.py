"""Packing by lexical retrieval.

Documents are tokenised once and written to the shared folder. Token ids are the
terms; their document frequencies, the number of documents and the mean length
are counted over all documents. A fixed random order of the terms, in which
telling ones (by inverse document frequency) come first, gives each document two
sketches: its first terms in two such orders. Two documents share a sketch with
the chance of their weighted Jaccard similarity, so sorted by sketch, documents
that share telling words lie near each other. Tasks get ranges of about equal
numbers of ids, cut anywhere between two rows, so long documents, and a sketch
that a third of all documents share, spread over tasks like anything else.

Consecutive documents of a task up to a bound of ids and of postings are a shard with a BM25
inverted index of its own. A seed document opens a window; all its terms query
the index, and the best unused neighbours that fit go in; when none fits, the
best one is cut and what is left of it is the next seed. Windows run on from
shard to shard, so only a partition's last window is short; it is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, need
from genoloom.llm.tokens import default_vocabulary, encoder, forget

WINDOW = 2048
#: Ids of a shard, 16 MB, and postings (distinct ids of each document), which take some 50 bytes each; a shard may hold one longer document.
SHARD_IDS, SHARD_POSTINGS = 4_000_000, 1_000_000
#: Ids a task packs; beyond MOST_TASKS tasks they get more each.
TASK_IDS = 4_000_000
MOST_TASKS = 50_000
#: Marks the driver holds for each task when it looks for the tasks' bounds.
MARKS = 4
#: A null doc_id's place in order.
FIRST_ID = -(1 << 63)
#: Neighbours put in order at first, and looked at together.
NEAREST, LOOK = 256, 256
K1, B = 1.2, 0.75

#: A document; or with n_ids 0, in ``df``, in how many of a task's documents each id occurs.
TOKENISED = "doc_id long, n_ids long, wide boolean, ids binary, df binary"
ORDER = ("sketch", "place", "row")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_IDS = PIECES + ", ids binary"


class Stats:
    """What all documents together say about terms: document frequencies, documents, mean length."""

    def __init__(self, df: np.ndarray, documents: int, ids: int) -> None:
        self.df, self.documents, self.mean = df.astype(float), documents, ids / max(1, documents)
        self.idf = np.log1p((documents - self.df + 0.5) / (self.df + 0.5))
        self.ranks = [self._rank(salt) for salt in (1, 2)]

    def _rank(self, salt: int) -> np.ndarray:
        """Each term's place in a random order where a term comes early in proportion to its idf."""
        x = np.arange(1, len(self.df) + 1, dtype=np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        chance = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
        out = np.zeros(len(self.df), np.int32)
        out[np.argsort(-np.log(np.maximum(chance, 1e-300)) / np.maximum(self.idf, 1e-9), kind="stable")] = np.arange(len(self.df))
        return out


def _tokenise(batches, vocabulary: str, end_id: int):
    pa.default_memory_pool().release_unused()  # a worker may come from an earlier stage
    bpe = encoder(vocabulary)
    narrow = bpe.dtype == "<u2" and end_id < 1 << 16
    kind = "<u2" if narrow else "<u4"
    end = np.array([end_id], kind).tobytes()
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in TOKENISED.split(", ")]
    df = np.zeros(1 << 16, np.int64)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    out: list = []
    size = 0
    for batch in batches:
        for doc_id, raw in zip(batch.column(0), bpe.encode_many(text.as_py() or "" for text in batch.column(1))):
            if kind != bpe.dtype:
                raw = np.frombuffer(raw, bpe.dtype).astype(kind).tobytes()
            raw += end
            ids = np.frombuffer(raw, kind)
            terms = np.unique(ids)
            if terms[-1] >= len(df):
                df = np.concatenate([df, np.zeros(2 * int(terms[-1]), np.int64)])
            df[terms] += 1
            out.append((doc_id.as_py(), len(ids), not narrow, raw, None))
            size += len(raw)
            if size > 8_000_000:
                yield batch_of(out)
                out, size = [], 0
    if out:
        yield batch_of(out)
    if df.any():
        yield batch_of([(None, 0, False, b"", df.astype("<i8").tobytes())])


def flat_ids(wide, ids) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an Arrow column of documents, and where each document begins."""
    wide = wide.to_numpy(zero_copy_only=False).astype(bool)
    if len(wide) and not wide.any():
        # one buffer, two bytes an id
        offsets = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, 4 * ids.offset) // 2
        return np.frombuffer(ids.buffers()[2], "<u2", int(offsets[-1]))[offsets[0] :], offsets[:-1] - offsets[0]
    parts = [np.frombuffer(x.as_py(), "<u4" if w else "<u2").astype("<u4") for x, w in zip(ids, wide)]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4"), np.cumsum([0] + [len(p) for p in parts])[: len(parts)]


def _added(table: pa.Table) -> pa.Table:
    """Counts of a group of tasks as one."""
    total = np.zeros(max(len(x.as_py()) for x in table.column("df")) // 8, np.int64)
    for x in table.column("df"):
        one = np.frombuffer(x.as_py(), "<i8")
        total[: len(one)] += one
    return pa.table({"df": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def stats_of(tokenised: DataFrame) -> Stats:
    """Counted over all documents; the driver gets a count for each id of the vocabulary, of 16 groups of tasks."""
    group = F.shiftrightunsigned("row", 33) % 16
    rows = tokenised.where("n_ids = 0").select(group.alias("grp"), "df").groupBy("grp").applyInArrow(_added, "df binary").collect()
    df = np.zeros(max([len(r.df) // 8 for r in rows], default=1), np.int64)
    for r in rows:
        one = np.frombuffer(bytes(r.df), "<i8")
        df[: len(one)] += one
    told = tokenised.where("n_ids > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("n_ids").alias("ids")).first()
    return Stats(df, told.n, told.ids or 0)


def _sketches(stats: Stats, wide, ids) -> pa.Array:
    """The documents' sketches."""
    flat, starts = flat_ids(wide, ids)
    if not len(starts):
        return pa.array([], pa.int64())
    one, two = (np.minimum.reduceat(rank[flat], starts) for rank in stats.ranks)
    return pa.array(one.astype(np.int64) << 31 | two)


def _sketch(batches, stats: Stats):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_sketches(stats, batch.column(0), batch.column(1)), *batch.columns[2:]], names=["sketch", *batch.schema.names[2:]])


def _marks(batches, step: int):
    """Of rows in order, the last of every run of ``step`` ids with the number of ids in the run."""
    schema = pa.schema([(n, pa.int64()) for n in (*ORDER, "n")])
    size, last = 0, None
    for batch in batches:
        out = []
        for *key, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            size, last = size + n, key
            if size >= step:
                out.append((*key, size))
                size, last = 0, None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (*last, size)], schema=schema)


def bounds(rows: DataFrame, task_ids: int = TASK_IDS, most_tasks: int = MOST_TASKS) -> list[tuple]:
    """Last keys (ORDER) of all tasks but the last, by the ids of ``rows`` (ORDER, n_ids).

    A task gets at most its even share, a mark's run and a row of ids.
    """
    total = rows.agg(F.sum("n_ids")).head()[0] or 0
    tasks = min(most_tasks, -(-total // task_ids))
    if tasks < 2:
        return []
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    marks = ordered.mapInArrow(partial(_marks, step=max(1, total // (tasks * MARKS))), ", ".join(f"{n} long" for n in (*ORDER, "n")))
    found, size, full = [], 0, 0
    for *key, n in sorted(tuple(r) for r in marks.collect()):
        size += n
        if full < size * tasks // total < tasks:
            full = size * tasks // total
            found.append(tuple(key))
    return found


def _deal(batches, ends: list, stats: Stats):
    """The task of each row and its sketch, before its order, doc_id and ids."""
    for batch in batches:
        sketch = _sketches(stats, batch.column("wide"), batch.column("ids"))
        keys = zip(sketch.to_pylist(), batch.column("place").to_pylist(), batch.column("row").to_pylist())
        task = pa.array([bisect_left(ends, k) for k in keys], pa.int32())
        yield pa.RecordBatch.from_arrays([task, sketch, *batch.columns], names=["task", "sketch", *batch.schema.names])


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct ids without its end, and how often it holds each."""
    terms, counts = np.unique(ids[:-1], return_counts=True)
    return terms, counts.astype(np.int32)


class Shard:
    """A BM25 inverted index over some documents' token ids, weighed by the statistics of all documents."""

    def __init__(self, docs: list[np.ndarray], stats: Stats, terms: list | None = None) -> None:
        """``terms``: (distinct ids but the end, their counts) of each document, where they are known already."""
        self.n = n = len(docs)
        self.terms, self.counts = zip(*(terms or map(terms_of, docs)))
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts).astype(np.float32)
        norm = (K1 * (1 - B + B * np.array([len(d) for d in docs]) / stats.mean)).astype(np.float32)
        weight = stats.idf.astype(np.float32)[term] * tf * np.float32(K1 + 1) / (tf + norm[owner])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = owner[order], weight[order]
        self.vocabulary, self.first, self.df = np.unique(term[order], return_index=True, return_counts=True)
        # postings that hold many of the documents are rows of a matrix
        common = np.flatnonzero(8 * self.df > n)
        self.row = np.full(len(self.vocabulary), -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), n), np.float32)
        for i, t in enumerate(common):
            at = slice(self.first[t], self.first[t] + self.df[t])
            self.matrix[i, self.doc[at]] = self.weight[at]
        self.columns = np.arange(n)

    def shrink(self, alive: np.ndarray) -> None:
        """Once half of the documents are gone, only those ``alive`` are scored in full."""
        if 2 * np.count_nonzero(alive) > len(self.columns):
            return
        self.matrix = self.matrix[:, alive[self.columns]]
        self.columns = np.flatnonzero(alive)
        keep = alive[self.doc]
        at = np.concatenate([[0], np.cumsum(keep)])
        self.first, self.df = at[self.first], at[self.first + self.df] - at[self.first]
        self.doc, self.weight = self.doc[keep], self.weight[keep]

    def scores(self, seed: int) -> np.ndarray:
        """Every document's BM25 score for all terms of the seed, as often as it holds them."""
        at, times = np.searchsorted(self.vocabulary, self.terms[seed]), self.counts[seed].astype(np.float32)
        row = self.row[at]
        query = np.zeros(len(self.matrix), np.float32)
        query[row[row >= 0]] = times[row >= 0]
        at, times = at[row < 0], times[row < 0]
        many = self.df[at]
        places = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        rest = np.bincount(self.doc[places], self.weight[places] * np.repeat(times, many), minlength=self.n).astype(float, copy=False)  # of nothing, whole numbers
        rest[self.columns] += query @ self.matrix
        return rest

    def neighbours(self, seed: int, first: int = NEAREST, wanted=None):
        """All documents by falling score, ties in shard order: the ``first`` ones (and their ties), then the rest, as they are asked for.

        ``wanted``: gives, from the scores, a mask of the documents still worth a place; asked before each of the two.
        """
        scores = self.scores(seed)
        for most in (first, self.n):
            some = np.arange(self.n) if wanted is None else np.flatnonzero(wanted(scores))
            some = some[scores[some] >= 0]
            best = scores[some]
            if len(some) > 2 * most:
                near = best >= np.partition(best, len(some) - most)[len(some) - most]
                some, best = some[near], best[near]
            yield some[np.argsort(-best, kind="stable")]
            scores[some] = -1


def arrange(docs: list[np.ndarray], gap: int, window: int, stats: Stats, terms: list | None = None):
    """Pieces (document, start, length) of one shard in packing order.

    ``gap``: room in the window left open by the shard before. Yields every
    piece once; the caller lays them end to end.
    """
    left = np.array([len(d) for d in docs])
    done = [0] * len(docs)
    index = Shard(docs, stats, terms) if len(docs) > 1 else None
    first = 0  # no document before it is unused

    def take(d: int, length: int):
        piece = (d, done[d], length)
        done[d] += length
        left[d] -= length
        return piece

    seed = None

    def wanted(scores: np.ndarray) -> np.ndarray:
        """What fits and, while no next seed is known, the best of what doesn't."""
        mask = (left > 0) & (left <= gap)
        if seed is None:
            larger = np.flatnonzero(left > gap)
            if len(larger):
                mask[larger[np.argmax(scores[larger])]] = True
        return mask

    while True:
        if seed is None or not left[seed]:
            while first < len(docs) and not left[first]:
                first += 1
            if first == len(docs):
                return
            seed = first
        if left[seed] >= gap:
            yield take(seed, gap)
            gap = window
            continue
        piece_of = seed
        gap -= int(left[seed])
        yield take(seed, int(left[seed]))
        seed = None
        if index:
            index.shrink(left > 0)
        for ranked in index.neighbours(piece_of, wanted=wanted) if index else ():
            for at in range(0, len(ranked), LOOK):
                look = ranked[at : at + LOOK]
                look = look[left[look] > 0]
                if seed is None and len(look):
                    # the best neighbour; cut if none is left that fits
                    seed = int(look[0])
                # room only shrinks, so what doesn't fit now won't
                for d in look[left[look] <= gap].tolist():
                    if left[d] <= gap:
                        gap -= int(left[d])
                        yield take(d, int(left[d]))
                        if not gap:
                            break
                if seed is not None and not left[seed]:
                    rest = look[left[look] > 0]
                    seed = int(rest[0]) if len(rest) else None
                if not gap:
                    break
            # the best one left is known, and nothing fits any more
            if not gap or seed is not None and left[left > 0].min(initial=window) > gap:
                break
        if not gap:
            gap, seed = window, None
        elif seed is not None:
            # nothing fits: the best neighbour is cut, and leads the next window
            yield take(seed, gap)
            gap = window
        else:
            return


def _pack(batches, window: int, with_ids: bool, stats: Stats, shard_ids: int):
    from pyspark import TaskContext

    forget()  # a worker may have tokenised before
    base = TaskContext.get().partitionId() << 33
    names = [x.split()[0] for x in (PIECES_IDS if with_ids else PIECES).split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])
    sequence, used = 0, 0
    open_window: list = []  # the pieces of the window being filled
    out: list = []

    def row(piece, number, offset):
        name, ids, start, length, total = piece
        raw = ids[start : start + length].astype("<u4").tobytes()
        return (name, start, length, zlib.crc32(raw), total, base + number, offset) + ((raw,) if with_ids else ())

    def lay(pieces):
        nonlocal sequence
        offset = 0
        for p in pieces:
            out.append(row(p, sequence, offset))
            offset += p[3]
        sequence += 1

    def flush():
        nonlocal out
        ready, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)

    def shard(rows):
        nonlocal used, open_window
        docs = [ids for _, ids, _ in rows]
        for d, start, length in arrange(docs, window - used, window, stats, [terms for _, _, terms in rows]):
            open_window.append((rows[d][0], docs[d], start, length, len(docs[d])))
            used += length
            if used == window:
                lay(open_window)
                open_window, used = [], 0

    held: list = []
    size = postings = 0
    for batch in batches:
        for name, wide, stored in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
            ids = np.frombuffer(stored.as_py(), "<u4" if wide else "<u2")
            held.append((name.as_py(), ids, terms_of(ids)))
            size += len(ids)
            postings += len(held[-1][2][0])
            if size >= shard_ids or postings >= SHARD_POSTINGS:
                shard(held)
                held, size, postings = [], 0, 0
                if out:
                    yield flush()
    if held:
        shard(held)
    # the rest: powers of two, largest first
    while used:
        part = 1 << (used.bit_length() - 1)
        used -= part
        taken = []
        while part:
            name, ids, start, length, total = open_window.pop(0)
            if length > part:
                open_window.insert(0, (name, ids, start + part, length - part, total))
                length = part
            taken.append((name, ids, start, length, total))
            part -= length
        lay(taken)
    if out:
        yield flush()


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, with_ids: bool = True, task_ids: int = TASK_IDS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``window`` ids.

    ``window`` is a power of two; ``task_ids``, ``shard_ids``: ids of a task and
    of a shard. Output, one row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, unless ``with_ids`` is False, the
    piece's ids (little-endian unsigned 32-bit). Every id lies in exactly one
    piece. Sequences are full or, at a partition's end, a power of two long, so
    none needs padding.

    A null text is empty and packs as its end id alone; null doc_ids are
    documents like others; repeated rows are packed each; equal sketches order
    by doc_id, then by place in the tokenised table. An empty table gives an
    empty result. Extra columns are ignored.
    """
    space = Workspace(docs.sparkSession, "packing")
    bare = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = bare.mapInArrow(partial(_tokenise, vocabulary=vocabulary or default_vocabulary(), end_id=end_id), TOKENISED)
    written = space.put(ids.withColumn("row", F.monotonically_increasing_id()), "tokenised")
    stats = stats_of(written)
    tokenised = written.where("n_ids > 0").withColumn("place", F.coalesce("doc_id", F.lit(FIRST_ID)))
    keys = tokenised.select("wide", "ids", "place", "row", "n_ids").mapInArrow(partial(_sketch, stats=stats), "sketch long, place long, row long, n_ids long")
    ends = bounds(space.put(keys, "keys"), task_ids)
    dealt = tokenised.select("place", "row", "doc_id", "wide", "ids").mapInArrow(partial(_deal, ends=ends, stats=stats), "task int, sketch long, place long, row long, doc_id long, wide boolean, ids binary")
    ordered = dealt.repartitionById(len(ends) + 1, "task").sortWithinPartitions(*ORDER)
    return ordered.select("doc_id", "wide", "ids").mapInArrow(partial(_pack, window=window, with_ids=with_ids, stats=stats, shard_ids=shard_ids), PIECES_IDS if with_ids else PIECES)


def op7_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
