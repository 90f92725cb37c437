"""Language-model scoring with a probabilistic suffix tree over words.

A context of one to ``MAX_WORDS`` words is a candidate if it occurs
``LEAST_CONTEXT`` times in the training texts; being frequent passes from a
context to its suffixes, so candidates grow a word at a time. A candidate becomes a
state if its next-symbol distribution diverges from that of its longest shorter
state: the log-likelihood ratio of its own occurrences, each predicted from the
others, reaches ``LEAST_TOTAL`` nats. A state's distribution is smoothed with
the shorter one's (weight ``KAPPA``), down to the root, the add-half unigram
model. A token is scored in the longest suffix of its history that is a state.
All thresholds are counts, so what the tree holds grows with the corpus.

The tree is never in one place. Each position of each text (its context words,
its next symbol, its text) goes once to the task that owns the subtree of its
last word; there the subtree grows level by level over sorted arrays, and the
positions are scored in it. A last word of ``hot`` occurrences or more would
overfill a task; its positions are dealt by two words, or by more, and the
contexts above are fitted first. All counts of their successors, by
last word and successor, are dealt over tasks (``_counted``); the driver gets one number a
hot context, whether it is a state. Each subtree's task is then sent the counts of just the
pairs of a hot context and a successor that its positions hold, so scores are
the same whatever is hot.

Symbols. Words with ``SYMBOL_SHARE`` of the tokens are numbered, a million at
most; which ones doesn't change a score. Words that occur less often than a context must can't be part of one and are one symbol,
RARE, which a fixed-size filter over the vocabulary tells; all others have a
32-bit code (two of V share one with a chance of V / 2**32; the third and later
words back are told apart by 16 bits within the two nearest ones). Counts of
words that aren't numbered stay distributed; documents meet them in joins.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, give_back, need, text_bytes

#: Words with this share of all tokens are numbered, so a million at most; their numbers end at NUMBERED.
SYMBOL_SHARE = 1e-6
NUMBERED = 1 << 20
#: Contexts of HOT occurrences and of this share of all tokens are hot (a million at most, each depth), which doesn't change a score.
HOT, HOT_SHARE = 500_000, 1e-6
MAX_WORDS = 4
LEAST_CONTEXT = 3
LEAST_TOTAL = 2.0
KAPPA = 5.0
RARE, END = 0, 1
#: Stands for the end among words; no word holds a blank.
LINE = b"\n"
#: Positions a task grows and scores together, about.
GROUP = 750_000
#: Tokens handled together.
CHUNK = 1_000_000
FILTER_BITS = 26
SEED = 42


def _words(batches):
    """Counts of the words of training texts, one row per word and stretch of input."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    total: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            total.update(text.as_py().lower().split())
        if len(total) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], schema=schema)
            total = Counter()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit values (the splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_of(digest: int) -> int:
    """The code of a word that isn't numbered, from its 64-bit hash."""
    return NUMBERED + digest % ((1 << 32) - NUMBERED)


class Symbols:
    """What tasks are told of the vocabulary: the numbered words, by falling count, and the filter."""

    def __init__(self, words: pa.Array, bits: bytes) -> None:
        self.words, self.filter, self.name = words, bits, uuid.uuid4().hex

    def codes(self) -> Codes:
        """This worker's table of them."""
        if self.name not in _CODES:
            _CODES.clear()
            _CODES[self.name] = Codes(self)
        return _CODES[self.name]


_CODES: dict = {}


class Codes(dict):
    """Word to symbol; of a word that isn't numbered, found when asked for."""

    def __init__(self, symbols: Symbols) -> None:
        import xxhash

        super().__init__(zip(symbols.words.to_pylist(), range(2, len(symbols.words) + 2)))
        self[LINE] = END
        self.digest = xxhash.xxh64_intdigest
        self.filter = symbols.filter
        self.met: list[int] | None = None  # where the hashes of words that aren't numbered go, as they come

    def __missing__(self, word: bytes) -> int:
        d = self.digest(word, SEED)
        if self.met is not None:
            self.met.append(d)
        bit = d & ((1 << FILTER_BITS) - 1)
        return code_of(d) if self.filter[bit >> 3] >> (bit & 7) & 1 else RARE


def chains(sym: np.ndarray, max_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each position the words before it, nearest first, and how many of them can form contexts.

    ``sym`` holds whole texts, each with its END; a text's end and a rare word
    end the history. The third and later words are reduced to 16 bits.
    """
    n = len(sym)
    place = np.arange(n)
    run = place - np.maximum.accumulate(np.where(sym > END, -1, place))
    length = np.minimum(max_words, np.r_[0, run[:-1]]).astype(np.uint8)
    back = []
    for d in range(1, max_words + 1):
        c = np.r_[np.zeros(min(d, n), np.uint32), sym[: max(0, n - d)]]
        if d > 2:
            c = (mixed(c.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
        back.append(np.where(length >= d, c, 0).astype(c.dtype))
    return back, length


def context_hashes(back: list[np.ndarray]) -> list[np.ndarray]:
    """The 64-bit key of each position's context of one word, two words and so on."""
    out, h = [], np.uint64(0)
    for c in back:
        h = mixed(c.astype(np.uint64) ^ h)
        out.append(h)
    return out


def hot_depth(hashes: list[np.ndarray], length: np.ndarray, hot: list[np.ndarray]) -> np.ndarray:
    """How many of a position's contexts, from the shortest, are hot."""
    out = np.zeros(len(length), np.uint8)
    alive = np.arange(len(length))
    for d, (h, known) in enumerate(zip(hashes, hot), 1):
        if not len(known):
            break
        alive = alive[length[alive] >= d]
        at = np.minimum(np.searchsorted(known, h[alive]), len(known) - 1)
        alive = alive[known[at] == h[alive]]
        out[alive] = d
    return out


def _flushes(batches, code, columns: tuple[int, ...]):
    """Runs of whole texts as (symbols, number of tokens of each text, lists of the other columns).

    ``code``: what gives a word's symbol.
    """
    held: list[np.ndarray] = []
    others: list[list] = [[] for _ in columns]
    size = 0
    for batch in batches:
        text = batch.column(0)
        for i in range(batch.num_rows):
            words = text[i].as_py().lower().split()
            words.append(LINE)
            held.append(np.fromiter(map(code, words), np.uint32, len(words)))
            for o, c in zip(others, columns):
                o.append(batch.column(c)[i].as_py())
            size += len(words)
            if size > CHUNK:
                yield np.concatenate(held), np.array([len(h) for h in held]), others
                held, others, size = [], [[] for _ in columns], 0
    if held:
        yield np.concatenate(held), np.array([len(h) for h in held]), others


def hot_counts(sym: np.ndarray, hot_words: int, max_words: int):
    """(depth, contexts, the contexts a word shorter, counts) of contexts made of hot words only."""
    hot = (sym > END) & (sym < 2 + hot_words)
    place = np.arange(len(sym))
    run = place - np.maximum.accumulate(np.where(hot, -1, place))
    run = np.r_[0, run[:-1]]
    use, h = place, np.zeros(len(sym), np.uint64)
    for d in range(1, max_words + 1):
        alive = run[use] >= d
        use, shorter = use[alive], h[alive]
        if not len(use):
            return
        word = sym[use - d].astype(np.uint64)
        h = mixed((mixed(word) & np.uint64(0xFFFF) if d > 2 else word) ^ shorter)
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        yield d, u.view(np.int64), shorter[first].view(np.int64), n


def _hot_counts(batches, words: list[bytes], max_words: int):
    """Counts of contexts made of hot words only, one row per context and stretch of input."""
    schema = pa.schema([("depth", pa.int32()), ("context", pa.int64()), ("shorter", pa.int64()), ("n", pa.int64())])
    number = dict(zip(words, range(2, len(words) + 2)))
    counts: dict = {}
    for sym, _, _ in _flushes(batches, lambda word, get=number.get: get(word, RARE), ()):
        for d, *found in hot_counts(sym, len(words), max_words):
            counts.setdefault(d, []).append(found)
            if sum(len(c) for c, _, _ in counts[d]) > 2 * CHUNK:
                counts[d] = [_added(counts[d])]
    for d, parts in counts.items():
        context, shorter, n = _added(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d), pa.int32()), pa.array(context), pa.array(shorter), pa.array(n)], schema=schema)


class Hot:
    """The hot contexts, numbered by depth, then by hash: their hashes, totals, which are states, and each one's suffixes."""

    def __init__(self, found: list[tuple], max_words: int) -> None:
        """``found``: (depth, context, the context a word shorter, count) of each hot context."""
        depth, context, shorter, n = (np.array(c, kind) for c, kind in zip(list(zip(*found)) or [()] * 4, (np.int64, np.int64, np.int64, np.float64)))
        context, shorter = context.view(np.uint64), shorter.view(np.uint64)
        self.contexts, self.begin, totals, chains_of = [], [], [], []
        for d in range(1, max_words + 1):
            mine = np.flatnonzero(depth == d)
            mine = mine[np.argsort(context[mine])]
            self.begin.append(sum(map(len, self.contexts)))
            self.contexts.append(context[mine])
            chain = np.full((len(mine), max_words), -1)
            if d > 1 and len(mine):
                chain[:, : d - 1] = chains_of[-1][np.searchsorted(self.contexts[d - 2], shorter[mine]), : d - 1]
            chain[:, d - 1] = self.begin[-1] + np.arange(len(mine))
            totals.append(n[mine])
            chains_of.append(chain)
        self.total, self.chain = np.concatenate(totals), np.concatenate(chains_of)
        self.state = np.zeros(len(self.total), bool)
        #: depths that have hot contexts
        self.depths = sum(len(c) > 0 for c in self.contexts)

    def number(self, hashes: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """The longest hot context of positions that have one."""
        out = np.zeros(len(depth), np.int64)
        for d in range(self.depths):
            mine = np.flatnonzero(depth == d + 1)
            out[mine] = self.begin[d] + np.searchsorted(self.contexts[d], hashes[d][mine])
        return out

    def weights(self, number: np.ndarray, k: np.ndarray, depths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, depth of the state) in the states of at most ``depths`` words, of successors that occur ``k`` times after each suffix."""
        a, b, deep = np.zeros(len(number)), np.ones(len(number)), np.zeros(len(number), np.uint8)
        for d in range(depths):
            own = self.chain[number, d]
            use = np.flatnonzero((own >= 0) & self.state[own])
            n = self.total[own[use]] + KAPPA
            a[use] = (k[use, d] + KAPPA * a[use]) / n
            b[use] = KAPPA * b[use] / n
            deep[use] = d + 1
        return a, b, deep


class Upper:
    """States from counts in one place: for each depth sorted (context, symbol) keys with counts, totals and back-off factors.

    Successors left out share the rest. No query uses it any more, as ``Hot`` needs none left out.
    """

    def __init__(self, max_words: int) -> None:
        none = np.zeros(0, np.uint64)
        self.contexts = [none] * max_words  # hot contexts, states or not
        self.total = [np.zeros(0)] * max_words  # 0: not a state
        self.factor = [np.zeros(0)] * max_words
        self.symbol = [none] * max_words  # kept successors: mixed key of context and symbol, sorted
        self.count = [np.zeros(0)] * max_words

    @staticmethod
    def key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return mixed(context ^ mixed(symbol.astype(np.uint64)))

    def add(self, depth: int, context: np.ndarray, total: np.ndarray, of: np.ndarray, symbol: np.ndarray, n: np.ndarray, hashes_of: dict, root: np.ndarray) -> None:
        """Fit the hot contexts of one depth. ``of``: the context's number for each kept (symbol, n).

        ``hashes_of``: by context, the keys of its suffixes, shortest first.
        """
        d = depth - 1
        self.contexts[d] = context
        self.total[d], self.factor[d] = np.zeros(len(context)), np.ones(len(context))
        keys, counts = [], []
        for i in range(len(context)):
            mine = np.flatnonzero(of == i)
            s, k, all_ = symbol[mine], n[mine].astype(float), float(total[i])
            above = [np.full(len(s), h, np.uint64) for h in hashes_of.get(int(context[i]), ())][: depth - 1]
            a, b, _ = self.weights(above, s, np.full(len(s), depth - 1, np.uint8))
            up = a + b * root[s]
            p = (k + KAPPA * up) / (all_ + KAPPA)
            rest, rest_up = max(1e-9, 1 - p.sum()), max(1e-9, 1 - up.sum())
            others = max(0.0, all_ - k.sum())
            gain = (k * np.log(np.maximum(1e-300, (k - 1 + KAPPA * up) / (all_ - 1 + KAPPA) / np.maximum(up, 1e-300)))).sum() + others * np.log(rest / rest_up)
            if gain >= LEAST_TOTAL:
                self.total[d][i], self.factor[d][i] = all_, rest / rest_up
                keys.append(self.key(context[i], s))
                counts.append(k)
        if keys:
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            self.symbol[d], self.count[d] = key[order], count[order]

    def weights(self, hashes: list[np.ndarray], symbol: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, depth of the state): a symbol's probability is a + b times its root probability."""
        a, b, deep = np.zeros(len(symbol)), np.ones(len(symbol)), np.zeros(len(symbol), np.uint8)
        for d, h in enumerate(hashes):
            if not len(self.contexts[d]):
                break
            use = np.flatnonzero(depth > d)
            at = np.minimum(np.searchsorted(self.contexts[d], h[use]), len(self.contexts[d]) - 1)
            state = (self.contexts[d][at] == h[use]) & (self.total[d][at] > 0)
            use, at = use[state], at[state]
            if not len(use):
                continue
            key = self.key(h[use], symbol[use])
            found = np.minimum(np.searchsorted(self.symbol[d], key), max(0, len(self.symbol[d]) - 1))
            hit = self.symbol[d][found] == key if len(self.symbol[d]) else np.zeros(len(use), bool)
            k = np.where(hit, self.count[d][found] if len(self.symbol[d]) else 0.0, 0.0)
            total, factor = self.total[d][at], self.factor[d][at]
            a[use] = np.where(hit, (k + KAPPA * a[use]) / (total + KAPPA), factor * a[use])
            b[use] = np.where(hit, KAPPA * b[use] / (total + KAPPA), factor * b[use])
            deep[use] = d + 1
        return a, b, deep


def _planes(column: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first, which compresses better."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), column.itemsize).T).tobytes()


def _unplaned(raw: memoryview, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def _kinds(max_words: int) -> list:
    return [np.uint32] * min(2, max_words) + [np.uint16] * max(0, max_words - 2) + [np.uint8, np.uint32, np.uint32]


def _dealt(hashes: list[np.ndarray], length: np.ndarray, depth: np.ndarray, after: np.ndarray, block: int, groups: int) -> np.ndarray:
    """The group of each position: by its shortest context that isn't hot; if all are, any group will do."""
    owner = hashes[0].copy()
    use = np.flatnonzero(depth)
    many, most = depth[use], length[use]
    for d in range(len(hashes)):
        last = use[(many == d + 1) & (most == d + 1)]
        owner[last] = hashes[d][last] ^ mixed(after[last].astype(np.uint64) + (np.uint64(block) << np.uint64(32)))
        mine = use[(many == d) & (most > d)]
        owner[mine] = hashes[d][mine]
    return (mixed(owner) % np.uint64(groups)).astype(np.int32)


def _packed(columns) -> bytes:
    return pa.compress(b"".join(map(_planes, columns)), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, *parts: tuple) -> list[np.ndarray]:
    """Columns from ``_packed``, of (kind, length) each."""
    sizes = [np.dtype(kind).itemsize * n for kind, n in parts]
    plain, at, out = memoryview(pa.decompress(raw, decompressed_size=sum(sizes), codec="zstd")), 0, []
    for (kind, n), size in zip(parts, sizes):
        out.append(_unplaned(plain[at : at + size], kind, n))
        at += size
    return out


ASKS = "bucket int, pairs int, asks int, packed binary"


def _asks(sym: np.ndarray, train: np.ndarray, block: int, hot: Hot, groups: int, buckets: int, max_words: int) -> dict:
    """Pairs of a position's longest hot context and its next symbol, with their training counts, and the groups that ask for each; by bucket.

    All pairs with a last word and a next symbol lie in one bucket.
    """
    back, length = chains(sym, max_words)
    hashes = context_hashes(back[: hot.depths + 1])
    depth = hot_depth(hashes, length, hot.contexts)
    use = np.flatnonzero(depth)
    hashes, length, depth, after = [h[use] for h in hashes], length[use], depth[use], sym[use]
    group = _dealt(hashes, length, depth, after, block, groups)
    pair, of = np.unique(hot.number(hashes, depth).astype(np.uint64) << np.uint64(32) | after, return_inverse=True)
    n = np.bincount(of[train[use]], minlength=len(pair))
    number, symbol = (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)
    bucket = (mixed(hot.chain[number, 0].astype(np.uint64) << np.uint64(32) | symbol) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    place = np.zeros(len(pair), np.uint64)
    place[order] = np.arange(len(pair), dtype=np.uint64)
    number, symbol, n, bucket = number[order], symbol[order], n[order].astype(np.uint32), bucket[order]
    ask = np.unique(place[of] << np.uint64(32) | group.astype(np.uint64))
    asker, asked = ask.astype(np.uint32), (ask >> np.uint64(32)).astype(np.int64)
    found, first = np.unique(bucket, return_index=True)
    ends = np.r_[first[1:], len(pair)] if len(first) else first
    edges = np.searchsorted(asked, np.r_[first, len(pair)])
    packed = [_packed((number[a:b], symbol[a:b], n[a:b], (asked[c:d] - a).astype(np.uint32), asker[c:d])) for a, b, c, d in zip(first, ends, edges, edges[1:])]
    return {"bucket": found, "pairs": ends - first, "asks": np.diff(edges), "packed": packed}


def _counted(table: pa.Table, hot: Hot) -> pa.Table:
    """One bucket: its pairs with the successor's counts after the hot context and each of its suffixes, and who asks for them."""
    pairs, counts, asked, askers, size = [], [], [], [], 0
    for p, q, packed in zip(table.column("pairs").to_pylist(), table.column("asks").to_pylist(), table.column("packed")):
        number, symbol, n, of, group = _unpacked(packed.as_py(), *[(np.uint32, p)] * 3, *[(np.uint32, q)] * 2)
        pairs.append(number.astype(np.uint64) << np.uint64(32) | symbol)
        counts.append(n)
        asked.append(of.astype(np.uint64) + np.uint64(size))
        askers.append(group)
        size += p
    pair, of = np.unique(np.concatenate(pairs), return_inverse=True)
    n = np.bincount(of, np.concatenate(counts), minlength=len(pair))
    ask = np.unique(np.concatenate(askers).astype(np.uint64) << np.uint64(32) | of[np.concatenate(asked).astype(np.int64)].astype(np.uint64))
    number, symbol = (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)
    columns = []
    for d in range(hot.depths):
        own = hot.chain[number, d]
        use = np.flatnonzero(own >= 0)
        _, inv = np.unique(own[use].astype(np.uint64) << np.uint64(32) | symbol[use], return_inverse=True)
        k = np.zeros(len(pair), np.uint64)
        k[use] = np.bincount(inv, n[use])[inv].astype(np.uint64) if len(use) else 0
        columns.append(k)
    packed = _packed((number, symbol, *columns, (ask >> np.uint64(32)).astype(np.uint32), ask.astype(np.uint32)))
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "pairs": pa.array([len(pair)], pa.int32()), "asks": pa.array([len(ask)], pa.int32()), "packed": pa.array([packed], pa.binary())})


def _bucket(batch, i: int, hot: Hot) -> tuple:
    """(numbers, symbols, counts by depth, groups in order, the pairs they ask for) of one bucket."""
    p, q = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
    number, symbol, *k, group, of = _unpacked(batch.column(2)[i].as_py(), *[(np.uint32, p)] * 2, *[(np.uint64, p)] * hot.depths, *[(np.uint32, q)] * 2)
    return number.astype(np.int64), symbol, np.stack(k, 1), group, of


def _hot_gains(batches, hot: Hot, d: int, chance: np.ndarray, other: float):
    """What the hot contexts of ``d`` + 1 words gain over their longest shorter states, by bucket."""
    schema = pa.schema([("number", pa.int64()), ("gain", pa.float64())])
    for batch in batches:
        for i in range(batch.num_rows):
            number, symbol, k, _, _ = _bucket(batch, i, hot)
            use = np.flatnonzero((hot.chain[number, d] >= 0) & (k[:, d] > 0))
            _, first = np.unique(hot.chain[number[use], d].astype(np.uint64) << np.uint64(32) | symbol[use], return_index=True)
            one = use[first]
            a, b, _ = hot.weights(number[one], k[one], d)
            up = a + b * root_of(symbol[one], chance, other)
            own, n = hot.chain[number[one], d], k[one, d].astype(float)
            gain = n * np.log((n - 1 + KAPPA * up) / ((hot.total[own] - 1 + KAPPA) * up))
            here, inv = np.unique(own, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(np.bincount(inv, gain, minlength=len(here)), pa.float64())], schema=schema)


def _told(batches, hot: Hot):
    """What each group asks for: numbers, symbols and counts, packed."""
    schema = pa.schema([("grp", pa.int32()), ("pairs", pa.int32()), ("told", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):
            number, symbol, k, group, of = _bucket(batch, i, hot)
            found, first = np.unique(group, return_index=True)
            ends = [*first[1:].tolist(), len(group)]
            told = [_packed((number[w].astype(np.uint32), symbol[w], *k[w].T.copy())) for w in (of[a:b] for a, b in zip(first.tolist(), ends))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.array(ends) - first, pa.int32()), pa.array(told, pa.binary())], schema=schema)


def root_of(symbol: np.ndarray, chance: np.ndarray, other: float) -> np.ndarray:
    """Root probabilities, an estimate for words that aren't numbered."""
    numbered = symbol < NUMBERED
    return np.where(numbered, chance[np.where(numbered, symbol, 0)], other)


def _positions(batches, symbols: Symbols, hot: list[np.ndarray], groups: int, max_words: int):
    """Positions with a context, packed by group: of each its context words, their number, next symbol and text."""
    schema = pa.schema([("grp", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])
    for sym, sizes, (rows, held) in _flushes(batches, symbols.codes().__getitem__, (1, 2)):
        back, length = chains(sym, max_words)
        text = np.repeat((np.array(rows, np.int64) - rows[0]).astype(np.uint32), sizes)
        flag = np.repeat(np.array(held, np.uint8) << 7, sizes)
        use = np.flatnonzero(length)
        back, length = [c[use] for c in back], length[use]
        text, flag, after = text[use], flag[use], sym[use]
        hashes = context_hashes(back[: max(2, 1 + sum(len(h) > 0 for h in hot))])
        depth = hot_depth(hashes, length, hot)
        group = _dealt(hashes, length, depth, after, rows[0], groups)
        # by group, then by contexts, as far as 64 bits go, which compresses well
        order = np.argsort(group.astype(np.uint64) << np.uint64(32) | hashes[0] >> np.uint64(48) << np.uint64(16) | hashes[min(1, len(hashes) - 1)] >> np.uint64(48), kind="stable")
        edges = np.searchsorted(group[order], np.arange(groups + 1)) if groups < 4 * len(order) + 4 else None
        if edges is None:
            found, first = np.unique(group[order], return_index=True)
            spans = list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]))
        else:
            spans = [(g, a, b) for g, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
        columns = [c[order] for c in (*back, length | flag, after, text)]
        out: list = [[], [], []]
        for g, a, b in spans:
            out[0].append(g)
            out[1].append(b - a)
            out[2].append(pa.compress(b"".join(_planes(c[a:b]) for c in columns), codec="zstd", asbytes=True))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([rows[0]] * len(out[0]), pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], schema=schema)


def grow(hashes: list[np.ndarray], length: np.ndarray, after: np.ndarray, train: np.ndarray, start: np.ndarray, weights: tuple, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grow the subtrees of all contexts of these positions; (a, b, depth) of each position's longest state.

    ``start``: the depth from which a position's contexts are all here;
    ``weights``: (a, b, depth) from the states above; ``root``: each next
    symbol's root probability (an estimate for words that aren't numbered,
    which only the test uses). Only ``train`` positions are counted.
    """
    a, b, deep = weights
    alive = np.zeros(0, np.int64)
    for d in range(1, len(hashes) + 1):
        alive = np.concatenate([alive, np.flatnonzero(start == d)])
        alive = alive[length[alive] >= d]
        if not len(alive):
            continue
        alive = _deeper(hashes[d - 1], d, alive, after, train, a, b, deep, root)
    return a, b, deep


def _deeper(hashes: np.ndarray, d: int, alive: np.ndarray, after: np.ndarray, train: np.ndarray, a: np.ndarray, b: np.ndarray, deep: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Grow the contexts of ``d`` words: updates a, b and deep, returns the positions whose contexts are frequent.

    A function of its own, so that one depth's arrays go before the next depth's come.
    """
    contexts, of = np.unique(hashes[alive], return_inverse=True)
    total = np.bincount(of[train[alive]], minlength=len(contexts))
    frequent = (total >= LEAST_CONTEXT)[of]
    alive, of = alive[frequent], of[frequent]
    if not len(alive):
        return alive
    pairs, first, pair = np.unique(of.astype(np.uint64) << np.uint64(32) | after[alive], return_index=True, return_inverse=True)
    k = np.bincount(pair[train[alive]], minlength=len(pairs)).astype(float)
    owner = (pairs >> np.uint64(32)).astype(np.int64)
    one = alive[first]
    up = a[one] + b[one] * root[one]
    # each occurrence predicted from the others, against the shorter state
    gain = np.zeros(len(pairs))
    seen = k > 0
    gain[seen] = k[seen] * np.log((k[seen] - 1 + KAPPA * up[seen]) / ((total[owner[seen]] - 1 + KAPPA) * up[seen]))
    state = np.bincount(owner, gain, minlength=len(contexts)) >= LEAST_TOTAL
    del pairs, first, owner, one, up, gain, seen
    mine = state[of]
    at, n = alive[mine], total[of[mine]] + KAPPA
    a[at] = (k[pair[mine]] + KAPPA * a[at]) / n
    b[at] = KAPPA * b[at] / n
    deep[at] = d
    return alive


def _weights_above(hashes: list[np.ndarray], depth: np.ndarray, after: np.ndarray, told: pa.Table | None, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, depth) of each position from the states of hot contexts."""
    a, b, deep = np.zeros(len(depth)), np.ones(len(depth)), np.zeros(len(depth), np.uint8)
    use = np.flatnonzero(depth)
    if not len(use):
        return a, b, deep
    parts = [_unpacked(raw.as_py(), *[(np.uint32, n)] * 2, *[(np.uint64, n)] * hot.depths) for n, raw in zip(told.column("pairs").to_pylist(), told.column("told"))]
    number, symbol, *k = (np.concatenate(c) for c in zip(*parts))
    pair = number.astype(np.uint64) << np.uint64(32) | symbol
    order = np.argsort(pair)
    pair, k = pair[order], np.stack(k, 1)[order]
    own = hot.number([h[use] for h in hashes], depth[use])
    asked = own.astype(np.uint64) << np.uint64(32) | after[use]
    at = np.minimum(np.searchsorted(pair, asked), len(pair) - 1)
    if (pair[at] != asked).any():
        raise ValueError("a group lacks counts of its hot contexts")
    a[use], b[use], deep[use] = hot.weights(own, k[at], hot.depths)
    return a, b, deep


GAINS = "block long, n int, packed binary, word array<long>, word_row array<long>, word_a array<double>, word_b array<double>"


def _grow_and_score(table: pa.Table, told: pa.Table | None, hot: Hot, chance: np.ndarray, other: float, max_words: int) -> pa.Table:
    """One group: what each text's positions here gain over the root, by block of texts.

    ``told``: the counts of its pairs of hot contexts and next symbols.
    A position whose next symbol isn't numbered and has a count here needs its
    word's own root probability; it is returned with (a, b).
    """
    kinds = _kinds(max_words)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, packed in zip(table.column("n").to_pylist(), table.column("packed")):
        raw = memoryview(pa.decompress(packed.as_py(), decompressed_size=n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd"))
        at = 0
        for part, kind in zip(parts, kinds):
            size = n * np.dtype(kind).itemsize
            part.append(_unplaned(raw[at : at + size], kind, n))
            at += size
    columns = []
    while parts:
        columns.append(np.concatenate(parts.pop(0)))
    *back, length, after, text = columns
    sizes = table.column("n").to_numpy()
    train, length = length < 128, length & 127
    hashes = context_hashes(back)
    del columns, back, part
    depth = hot_depth(hashes, length, hot.contexts)
    root = root_of(after, chance, other)
    a, b, deep = grow(hashes, length, after, train, depth + 1, _weights_above(hashes, depth, after, told, hot), root)
    del hashes, depth, train, length
    wait = (after >= NUMBERED) & (a > 0)
    gain = np.where(wait, 0.0, np.log10(np.where(wait, 1.0, a / root + b)))
    # positions come by block; within a block sum by text
    out: dict = {name.split()[0]: [] for name in GAINS.split(", ")}
    blocks = table.column("block").to_numpy()
    edges = np.cumsum(np.r_[0, sizes])
    for i in range(len(sizes)):
        s = slice(edges[i], edges[i + 1])
        here, inv = np.unique(text[s], return_inverse=True)
        most = np.zeros(len(here), np.uint8)
        np.maximum.at(most, inv, deep[s])
        w = np.flatnonzero(wait[s]) + edges[i]
        out["block"].append(int(blocks[i]))
        out["n"].append(len(here))
        out["packed"].append(pa.compress(_planes(here.astype("<u4")) + _planes(np.bincount(inv, gain[s]).astype("<f4")) + most.tobytes(), codec="zstd", asbytes=True))
        out["word"].append(after[w].astype(np.int64))
        out["word_row"].append(text[w].astype(np.int64) + int(blocks[i]))
        out["word_a"].append(a[w])
        out["word_b"].append(b[w])
    types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.table([pa.array(c, t) for c, t in zip(out.values(), types)], names=list(out))


def _sum_block(table: pa.Table) -> pa.Table:
    """(row, gain, deepest) of the texts of one block, over all groups."""
    parts = []
    for n, packed in zip(table.column("n").to_pylist(), table.column("packed")):
        raw = memoryview(pa.decompress(packed.as_py(), decompressed_size=9 * n, codec="zstd"))
        parts.append((_unplaned(raw, "<u4", n), _unplaned(raw[4 * n :], "<f4", n), np.frombuffer(raw[8 * n :], np.uint8)))
    text, gain, deep = (np.concatenate(p) for p in zip(*parts))
    # in an order that doesn't depend on how rows came, so reruns agree
    order = np.lexsort((deep, gain, text))
    here, inv = np.unique(text[order], return_inverse=True)
    most = np.zeros(len(here), np.uint8)
    np.maximum.at(most, inv, deep[order])
    return pa.table({"row": pa.array(here.astype(np.int64) + table.column("block")[0].as_py()), "gain": pa.array(np.bincount(inv, gain[order].astype(float))), "deepest": pa.array(most.astype(np.int64))})


ROOTS = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<long>, " + ASKS


def _score_root(batches, symbols: Symbols, chance: np.ndarray, hot: Hot, groups: int, buckets: int, max_words: int):
    """One row a text: its tokens, those numbered, their log10 root probability, the hashes of its other words.

    And rows of their own (with a bucket) for what is counted of hot contexts.
    """
    codes = symbols.codes()
    unigram = np.log10(np.maximum(chance, 1e-300))
    unigram[RARE] = 0.0
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("rare", pa.list_(pa.int64())), ("bucket", pa.int32()), ("pairs", pa.int32()), ("asks", pa.int32()), ("packed", pa.binary())]
    schema = pa.schema(fields)

    def rows(n, found):
        return pa.RecordBatch.from_arrays([pa.array(found[name], kind) if name in found else pa.nulls(n, kind) for name, kind in fields], schema=schema)

    # words are dealt with in the runs' own order, so a run's rare words can be taken from the end of this list
    codes.met = rare = []
    try:
        for sym, sizes, (row, doc_id, held) in _flushes(batches, codes.__getitem__, (1, 2, 3)):
            starts = np.cumsum(np.r_[0, sizes])
            other = (sym == RARE) | (sym >= NUMBERED)
            unknown = np.concatenate([[0], np.cumsum(np.add.reduceat(other.astype(np.int64), starts[:-1]))])
            hashes = np.array(rare, np.uint64).view(np.int64)
            rare.clear()
            yield rows(len(row), {
                "row": row, "doc_id": doc_id, "held_out": held, "n_tokens": sizes, "known": sizes - np.diff(unknown), "base": np.add.reduceat(unigram[np.where(other, RARE, sym)], starts[:-1]),
                "rare": pa.ListArray.from_arrays(pa.array(unknown.astype(np.int32)), pa.array(hashes))})
            if hot.depths:
                asks = _asks(sym, ~np.repeat(np.array(held, bool), sizes), row[0], hot, groups, buckets, max_words)
                if asks["packed"]:
                    yield rows(len(asks["packed"]), asks)
    finally:
        codes.met = None


def _added(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by context, added up."""
    context, shorter, n = (np.concatenate(p) for p in zip(*parts))
    found, first, of = np.unique(context, return_index=True, return_inverse=True)
    return found, shorter[first], np.bincount(of, n).astype(np.int64)


def held_out_column(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _filter(vocabulary: DataFrame) -> bytes:
    """Bits of the hashes of all words that can be part of a context; of fixed size."""
    low = F.xxhash64("word").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = vocabulary.where(F.col("n") >= LEAST_CONTEXT).select(F.shiftright(low, 6).alias("at"), F.expr("shiftleft(1L, cast(xxhash64(word) & 63 as int))").alias("bit"))
    table = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out.astype("<u8").tobytes()


def _hot(counted: DataFrame, hot: int, max_words: int) -> Hot:
    """The hot contexts among ``counted`` ones: a million at most, each depth."""
    rows = counted.groupBy("depth", "context").agg(F.min("shorter").alias("shorter"), F.sum("n").alias("n")).where(F.col("n") >= hot)
    return Hot([tuple(r) for r in rows.collect()], max_words)


def _fit(asked: DataFrame, hot: Hot, chance: np.ndarray, other: float) -> None:
    """Find the states among hot contexts, from all their successors; a depth after the other."""
    pairs = asked.select("pairs", "asks", "packed")
    for d in range(hot.depths):
        gains = pairs.mapInArrow(partial(_hot_gains, hot=hot, d=d, chance=chance, other=other), "number long, gain double")
        # decimals add up to the same in any order
        total = gains.groupBy("number").agg(F.sum(F.col("gain").cast("decimal(38,10)")).cast("double").alias("gain"))
        for r in total.where(F.col("gain") >= LEAST_TOTAL).collect():
            hot.state[r.number] = True


def score_documents(docs: DataFrame, max_words: int = MAX_WORDS, hot: int | None = None, group: int = GROUP) -> DataFrame:
    """Each document's log10 probability under a suffix tree trained on the others' tokens.

    Input: doc_id, text. Training rows: crc32(doc_id as text) mod 5 is not 1.
    ``max_words``: the longest context; ``hot``: occurrences from which a
    context's positions are spread over tasks (by default by HOT); ``group``: positions a task
    handles together. Output: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, deepest (the longest state used).

    A null text is empty, so it is one end token; a null doc_id counts as an
    empty one for the split; repeated rows train and score each. Without
    training rows every token is unknown and scores log10(0.5 / 0.5). An empty
    table gives an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "suffix-tree")
    rows = need(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out_column().alias("held_out"), text_bytes().alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    vocabulary = space.put(train.mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    ends = need(docs, "doc_id").where(~held_out_column()).count()
    few = F.when(F.col("n") < LEAST_CONTEXT, F.col("n"))
    told = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(few).alias("few"), F.count(few).alias("few_words")).first()
    tokens, distinct = (told.n or 0) + ends, told.v + (ends > 0)
    norm = tokens + 0.5 * (distinct + 1)
    numbered = max(LEAST_CONTEXT, math.ceil(SYMBOL_SHARE * tokens))
    frequent = vocabulary.where(F.col("n") >= numbered).orderBy(F.desc("n"), "word").toArrow().combine_chunks()
    counts = frequent["n"].to_numpy().astype(float)
    symbols = Symbols(pa.chunked_array(frequent["word"], pa.binary()).combine_chunks(), _filter(vocabulary))
    # of RARE: all words that can't be part of a context, and the unknown one
    chance = (np.r_[(told.few or 0) + 0.5 * told.few_words, ends, counts] + 0.5) / norm
    mid_words, mid = told.v - told.few_words - len(counts), (told.n or 0) - (told.few or 0) - counts.sum()
    other = (mid / mid_words + 0.5) / norm if mid_words else 0.5 / norm

    hot = max(hot or HOT, LEAST_CONTEXT, int(HOT_SHARE * tokens))
    hot_words = int((counts >= hot).sum())
    above = Hot([], max_words)
    if hot_words:
        hottest = frequent["word"][:hot_words].to_pylist()
        above = _hot(train.mapInArrow(partial(_hot_counts, words=hottest, max_words=max_words), "depth int, context long, shorter long, n long"), hot, max_words)
    groups = max(1, -(-tokens * 5 // (4 * group)))
    buckets = max(1, groups // 4)
    roots = space.put(rows.select("text", "row", "doc_id", "held_out").mapInArrow(partial(_score_root, symbols=symbols, chance=chance, hot=above, groups=groups, buckets=buckets, max_words=max_words), ROOTS), "roots")
    asked = None
    if above.depths:
        asks = roots.where(F.col("bucket").isNotNull()).select("bucket", "pairs", "asks", "packed")
        asked = space.put(asks.groupBy("bucket").applyInArrow(lambda table: _counted(table, above), ASKS), "asked", free=True)
        _fit(asked, above, chance, other)
    sent = rows.select("text", "row", "held_out").mapInArrow(partial(_positions, symbols=symbols, hot=above.contexts, groups=groups, max_words=max_words), "grp int, block long, n int, packed binary")
    grown = _grown(sent, asked, above, chance, other, max_words)
    gains = space.put(grown, "gains", free=True)
    space.drop("asked")

    scored = roots.where(F.col("bucket").isNull()).select("row", "doc_id", "held_out", "n_tokens", "known", "base", "rare")
    less = vocabulary.where(F.col("n") < numbered)
    hashed = less.groupBy(F.xxhash64("word").alias("hash")).agg(F.sum("n").alias("n"))
    met = roots.where(F.col("bucket").isNull()).select("row", F.explode("rare").alias("hash")).join(hashed, "hash", "left")
    share = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(norm))
    zero = F.lit(0.0)
    rest = met.groupBy("row").agg(F.sum(share).alias("base"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("known"), F.lit(0.0).alias("gain"), F.lit(0).cast("long").alias("deepest"))
    # the code of a word that isn't numbered, as Codes has it, from the unsigned hash
    size = (1 << 32) - NUMBERED
    signed = F.xxhash64("word")
    code = F.pmod(F.pmod(signed, F.lit(size)) + F.when(signed < 0, F.lit((1 << 64) % size)).otherwise(0), F.lit(size)) + NUMBERED
    coded = less.where(F.col("n") >= LEAST_CONTEXT).groupBy(code.alias("word")).agg(F.sum("n").alias("n"))
    zipped = F.explode(F.arrays_zip("word_row", "word", "word_a", "word_b")).alias("w")
    waiting = gains.select(zipped).select(F.col("w.word_row").alias("row"), F.col("w.word").alias("word"), F.col("w.word_a").alias("a"), F.col("w.word_b").alias("b")).join(coded, "word", "left")
    own = (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(norm)
    late = waiting.groupBy("row").agg(zero.alias("base"), F.lit(0).cast("long").alias("known"), F.sum(F.log10(F.col("a") / own + F.col("b"))).alias("gain"), F.lit(0).cast("long").alias("deepest"))
    soon = gains.select("block", "n", "packed").groupBy("block").applyInArrow(_sum_block, "row long, gain double, deepest long").select("row", zero.alias("base"), F.lit(0).cast("long").alias("known"), "gain", "deepest")
    more = rest.unionByName(late).unionByName(soon).groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"), F.sum("gain").alias("gain"), F.max("deepest").alias("deepest"))
    both = scored.drop("rare").join(more, "row", "left")
    base = F.col("base") + F.coalesce("more_base", zero)
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") - F.lit(0 if ends else 1) + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.coalesce("gain", zero)).alias("score"), F.coalesce("deepest", F.lit(0)).alias("deepest"))


def _grown(sent: DataFrame, asked: DataFrame | None, hot: Hot, chance: np.ndarray, other: float, max_words: int) -> DataFrame:
    """All groups grown and scored, with what they ask for of the hot contexts."""

    def alone(table):
        return both(table, None)

    def both(table, told):
        _CODES.clear()  # no later pass reads texts
        try:
            return _grow_and_score(table, told, hot, chance, other, max_words)
        finally:
            give_back()

    if asked is None:
        return sent.groupBy("grp").applyInArrow(alone, GAINS)
    told = asked.select("pairs", "asks", "packed").mapInArrow(partial(_told, hot=hot), "grp int, pairs int, told binary")
    return sent.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(both, GAINS)


def op1_suffix_tree_scores(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
