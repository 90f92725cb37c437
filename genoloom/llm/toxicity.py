"""Toxicity by noisy-channel deobfuscation.

Words that may be disguised (letters mixed with digits or signs, parted or
doubled letters, letters set apart by blanks, letters of other alphabets or with
accents) become character lattices: each character may stand for letters it
resembles, a repeated one or a separator may be noise. A Viterbi search under a
character trigram model restores the likeliest readings, in time linear in the
word. The language model is counted over all texts.

The restored text, its words as they stand and their readings, is scored by a
logistic classifier over words and character n-grams (their presence). Its
features are those whose texts are toxic more often than chance allows. It is
fitted on at most ``most_rows`` labelled training rows, those with the smallest
hash of their doc_id; near copies among them share the weight of one row. Every
document is scored.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, need, text_hash
from genoloom.llm.pii import TABLE as LOOKALIKES

#: Labelled rows and features of the classifier, at most.
MOST_ROWS = 30_000
MOST_FEATURES = 1_000
#: Lengths of character n-grams; a word has a mark at either end.
GRAMS = (3, 4, 5)
#: Lengths of word beginnings beyond those.
BEGINNINGS = (6, 7, 8, 9)
MIN_SUPPORT = 4
CHANCE = 1e-8
MIN_PRECISION = 0.5
RIDGE = 0.1
READINGS = 5
PER_STATE = 3
#: Characters decoded together; a longer word is decoded in pieces that share OVERLAP characters.
PIECE, OVERLAP = 48, 12
#: Patterns whose features the fit spreads out together.
STRETCH = 500
#: Words whose features a task remembers.
CACHE = 300_000

# Letters that a sign can stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "#": "h",
}
SEPARATORS = frozenset(".-_*~'`^/\\, ")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_STRIP = ".,;:!?\"'()[]{}*#%&=-_~<>/\\|`^$+"
_TAIL = _STRIP
_HEAD = _STRIP.replace("$", "").replace("|", "").replace("+", "").replace("(", "")
_DOUBLED = re.compile(r"(.)\1+")
_JOINTS = re.compile(r"[.\-_*~'`^/\\,]+")
_LATTICE = re.compile(r"(?=.*[a-z])[a-z0-9@$!|+(<€£¡¢#.\-_*~'`^/\\,]{2,}")
_MASK = (1 << 61) - 1
_SPACED = re.compile(r"(?<!\S)[^\s](?: [^\s]){3,}(?!\S)")
# Costs of the channel, in nats.
COST_SIGN, COST_REPEAT, COST_SEPARATOR, COST_WILD, COST_KEEP_REPEAT = 0.7, 0.2, 0.2, 1.0, 0.7


class CharModel:
    """Interpolated character trigrams over a-z and a word mark."""

    def __init__(self, counts: dict[str, int]) -> None:
        two, one, all_ = Counter(), Counter(), Counter()
        last = Counter()
        for gram, n in counts.items():
            two[gram[:2]] += n
            one[gram[1]] += n
            last[gram[1:]] += n
            all_[gram[2]] += n
        total = sum(all_.values()) or 1
        marks = LETTERS + " "
        self.log: dict[str, float] = {}
        self.counts, self.two, self.one, self.last = counts, two, one, last
        self.base = {c: (all_[c] + 1) / (total + len(marks)) for c in marks}

    def cost(self, state: str, c: str) -> float:
        key = state + c
        found = self.log.get(key)
        if found is None:
            b = self.base.get(c, 1e-4)
            p2 = (self.last[state[1] + c] + 4 * b) / (self.one[state[1]] + 4)
            p3 = (self.counts.get(key, 0) + 4 * p2) / (self.two[state] + 4)
            self.log[key] = found = -math.log(p3)
        return found


def options(word: str) -> list[list[tuple[str, float]]]:
    """The lattice: what each character may stand for (nothing: "") and at what cost."""
    out = []
    before = ""
    for c in word:
        if c in SEPARATORS:
            arcs = [("", COST_SEPARATOR)]
            if c == "*":
                arcs += [(x, COST_WILD) for x in LETTERS]
        else:
            arcs = [(x, COST_SIGN) for x in LEET.get(c, "")] or [(c, 0.0)]
            if c == before:
                arcs = [(x, k + COST_KEEP_REPEAT) for x, k in arcs] + [("", COST_REPEAT)]
        out.append(arcs)
        before = c
    return out


def restore(word: str, model: CharModel, readings: int = READINGS) -> list[str]:
    """The likeliest readings of a disguised word, best first.

    A path is a cost, its last letter and the path before, so a step costs the
    same however long the word is. Paths to a state that spell the same are one.
    """
    states: dict[str, list[tuple]] = {"  ": [(0.0, 0, "", None)]}
    for arcs in options(word):
        after: dict[str, list[tuple]] = {}
        for state, held in states.items():
            for c, k in arcs:
                if c:
                    step = k + model.cost(state, c)
                    after.setdefault(state[1] + c, []).extend((p[0] + step, (p[1] * 31 + ord(c)) & _MASK, c, p) for p in held)
                else:
                    after.setdefault(state, []).extend((p[0] + k, *p[1:]) for p in held)
        states = {state: _best(held, PER_STATE) for state, held in after.items()}
    final = [(p[0] + model.cost(state, " "), *p[1:]) for state, held in states.items() for p in held]
    return [_spelled(p) for p in _best(final, readings)]


def _best(paths: list[tuple], most: int) -> list[tuple]:
    """The cheapest paths, of those that spell the same the first."""
    kept: dict[int, tuple] = {}
    for p in sorted(paths, key=lambda p: p[:2]):
        if p[1] not in kept:
            kept[p[1]] = p
            if len(kept) == most:
                break
    return list(kept.values())


def _spelled(path: tuple) -> str:
    out = []
    while path is not None:
        out.append(path[2])
        path = path[3]
    return "".join(reversed(out))


def folded(word: str) -> str:
    """Look-alike letters as Latin ones, accents off."""
    plain = unicodedata.normalize("NFKD", word.translate(LOOKALIKES))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def grams(word: str):
    """A word's features: itself, its character n-grams, ends marked, and its longer beginnings."""
    marked = f"^{word}$"
    yield marked
    for n in BEGINNINGS:
        if n < len(marked):
            yield marked[:n]
    for n in GRAMS:
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


class Reader:
    """A text's features: those of its words and of the restored readings of those that look disguised.

    ``names``: only these features count, by number, found by an Aho-Corasick
    automaton; without them all do, as text.
    """

    def __init__(self, counts: dict[str, int], names: list[str] | None = None) -> None:
        self.model = CharModel(counts)
        self.matches = None
        if names is not None:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, name in enumerate(names):
                automaton.add_word(name, i)
            if names:
                automaton.make_automaton()
            self.matches = automaton.iter if names else lambda text: ()
        self.cache: dict[str, set[str]] = {}

    def found(self, words, out: set) -> None:
        """Add the features of whole words."""
        if self.matches is None:
            for w in words:
                out.update(grams(w))
        else:
            # ends are marked, so no feature reaches from one word into the next
            out.update([i for _, i in self.matches("^" + "$^".join(words) + "$")])

    def readings(self, word: str) -> set[str]:
        """What a word in lower case that isn't plain letters may be: itself without outer marks, and what it may disguise."""
        core = word.rstrip(_TAIL).lstrip(_HEAD)
        found: set[str] = set()
        if core.isalpha():
            found.add(core)
            if _DOUBLED.search(core):
                found.add(_DOUBLED.sub(r"\1", core))
                if re.search(r"(.)\1(?:\1|.*(.)\2)", core):
                    found |= self._decoded(core)
            return found
        parts = _JOINTS.split(core)
        if len(parts) > 1 and all(p.isalpha() for p in parts):
            found |= {*parts, "".join(parts)}
            if min(map(len, parts)) > 2 and "*" not in core:
                return found
        return found | self._decoded(core)

    def _decoded(self, core: str) -> set[str]:
        if not _LATTICE.fullmatch(core):
            return set()
        pieces = [core] if len(core) <= PIECE else [core[i : i + PIECE] for i in range(0, len(core) - OVERLAP, PIECE - OVERLAP)]
        return {r for p in pieces for r in restore(p, self.model)}

    def remembered(self, word: str) -> set[str]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = self.readings(word)
            if len(word) <= PIECE:
                self.cache[word] = found
        return found

    def read(self, text: str) -> set:
        """All features of a text."""
        low = text.lower()
        words = set(low.split())
        if not low.isascii():
            words.update(folded(low).split())
        plain, odd = [], []
        for w in words:
            core = w if w.isalpha() else w.rstrip(_TAIL).lstrip(_HEAD)
            if core.isalpha():
                plain.append(core)
                if _DOUBLED.search(core):
                    odd.append(core)
            elif core:
                odd.append(w)
        for w in odd:
            plain += self.remembered(w)
        out: set = set()
        self.found(plain, out)
        for m in _SPACED.finditer(low):
            letters = m[0].replace(" ", "")
            if any(c in LETTERS for c in letters):
                for i in range(0, max(1, len(letters) - OVERLAP), PIECE - OVERLAP):
                    for r in restore(letters[i : i + PIECE], self.model):
                        self.found([r], out)
        return out


#: A byte's letter, 1 to 26, or 0.
_LETTER = np.zeros(256, np.int32)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)


def _trigrams(batches):
    """Trigrams of all runs of letters a-z, two marks before and one after, as often as they occur."""
    total = np.zeros(27**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            raw = text.as_buffer() if text.is_valid else None
            for at in range(0, len(raw) if raw is not None else 0, 1 << 22):
                # pieces share two letters, so that each trigram ends in one piece
                part = np.frombuffer(raw, np.uint8)[max(0, at - 2) : at + (1 << 22) + (1 if at + (1 << 22) >= len(raw) else 0)]
                c = np.r_[np.zeros(0 if at else 2, np.int32), _LETTER[part], np.zeros(1 if at + (1 << 22) >= len(raw) else 0, np.int32)]
                first, second, third = c[:-2], c[1:-1], c[2:]
                code = (np.where(second > 0, first, 0) * 27 + second) * 27 + third
                total += np.bincount(code[(second > 0) | (third > 0)], minlength=27**3)
    found = np.flatnonzero(total)
    marks = " " + LETTERS
    names = [marks[i // 729] + marks[i // 27 % 27] + marks[i % 27] for i in found.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total[found])], names=["gram", "n"])


def _features(batches, counts: dict):
    """In how many rows a feature occurs, by the rows' weights."""
    reader = Reader(counts)
    schema = pa.schema([("feature", pa.string()), ("n", pa.float64())])
    total: dict[str, float] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], schema=schema)
        total.clear()
        return out

    for batch in batches:
        for text, weight in zip(batch.column(0), batch.column(1).to_pylist()):
            for f in reader.read(text.as_py() or ""):
                total[f] = total.get(f, 0.0) + weight
            if len(total) > 400_000:
                yield flush()
    if total:
        yield flush()


def _held(batches, counts: dict, names: pa.Array):
    """In how many rows each of the named features occurs, by the rows' weights."""
    reader = Reader(counts, names.to_pylist())
    total = np.zeros(len(names))
    for batch in batches:
        for text, weight in zip(batch.column(0), batch.column(1).to_pylist()):
            total[list(reader.read(text.as_py() or ""))] += weight
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["i", "n"])


def _rows(batches, counts: dict, names: list):
    """Each labelled row's features by number."""
    reader = Reader(counts, names)
    for batch in batches:
        found = [sorted(reader.read(t.as_py() or "")) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "weight", "found"])


def chosen(items: Iterable[tuple[str, float, float]], bad_rows: float, good_rows: float) -> list[str]:
    """Features whose rows could hardly be so often toxic by chance, the most telling first.

    By chance: the probability of a feature's counts at the overall share of
    toxic rows is below ``CHANCE``.
    """
    share = bad_rows / max(1e-9, bad_rows + good_rows)
    if not 0 < share < 1:
        return []

    def chance(bad: float, good: float) -> float:
        ways = math.lgamma(bad + good + 1) - math.lgamma(bad + 1) - math.lgamma(good + 1)
        return bad * math.log(share) + good * math.log(1 - share) + ways

    rated = ((chance(bad, good), item) for item, bad, good in items)
    return [item for _, item in heapq.nsmallest(MOST_FEATURES, (x for x in rated if x[0] < math.log(CHANCE)))]


def _rounded(n: pa.ChunkedArray) -> np.ndarray:
    """Sums of weights, rounded, as they depend on their order in the last places."""
    return np.fromiter((round(x, 6) for x in map(float, n.to_numpy())), float, len(n))


def logistic(patterns: list[tuple[tuple, float, float]], features: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the constant last) of a ridge logistic fit; ``patterns``: (features, weight of toxic rows, of others).

    Newton sums go over stretches of patterns, so memory doesn't grow with their number times that of the features.
    """
    bad, all_ = np.array([p[1] for p in patterns]), np.array([p[1] + p[2] for p in patterns])
    w = np.zeros(features + 1)
    keep = np.full(features + 1, ridge)
    keep[features] = 1e-3
    for _ in range(25):
        gradient, curve = -keep * w, np.diag(keep)
        for at in range(0, len(patterns), STRETCH):
            part = slice(at, at + STRETCH)
            x = np.zeros((len(patterns[part]), features + 1))
            x[:, features] = 1
            for row, (held, _, _) in zip(x, patterns[part]):
                row[np.asarray(held, np.int64)] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (bad[part] - all_[part] * p)
            x *= np.sqrt(all_[part] * p * (1 - p))[:, None]
            curve += x.T @ x
        step = np.linalg.solve(curve, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return w


def held_out_column(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, space: Workspace, most_rows: int = MOST_ROWS) -> dict:
    """The channel's language model from all texts; the classifier from labelled training rows only."""
    found = need(docs, "text").mapInArrow(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = {r.gram: r.n for r in found.collect()}  # a-z and a mark: at most 27 ** 3 rows
    marked = need(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out_column())
    # at most most_rows rows of two numbers, so it may be broadcast
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    train = need(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", (F.col("toxic") != 0).alias("toxic"))
    # near copies mostly share the least hashes of their words; together they weigh as much as one row
    hashes = F.array_sort(F.array_distinct(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.xxhash64(w))))
    train = space.put(train.withColumn("sketch", F.slice(hashes, 1, 4)), "train")
    sizes = train.groupBy("sketch", "toxic").agg((1 / F.count(F.lit(1))).alias("weight"))
    train = space.put(train.join(sizes, ["sketch", "toxic"]).select("text", "toxic", "weight"), "weighed")
    told = {r.toxic: r.weight for r in train.groupBy("toxic").agg(F.sum("weight").alias("weight")).collect()}
    bad_rows, good_rows = told.get(True, 0.0), told.get(False, 0.0)
    if not bad_rows or not good_rows:
        return {"counts": counts, "weights": np.array([30.0 if bad_rows else -30.0]), "names": []}
    # features of enough toxic rows, then their counts in the others; the sample bounds how many there are.
    # They stay Arrow columns, as rows of Python objects would take the driver several times their size
    bad = train.where("toxic").select("text", "weight").mapInArrow(partial(_features, counts=counts), "feature string, n double").groupBy("feature").agg(F.sum("n").alias("n"))
    items = bad.where(F.col("n") >= MIN_SUPPORT - 1e-9).orderBy("feature").toArrow().combine_chunks()
    every = pa.chunked_array(items["feature"], pa.string()).combine_chunks()
    good = train.where("not toxic").select("text", "weight").mapInArrow(partial(_held, counts=counts, names=every), "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    in_bad, in_good = _rounded(items["n"]), np.zeros(len(every))
    in_good[good["i"].to_numpy()] = _rounded(good["n"])
    telling = np.flatnonzero(in_bad >= MIN_PRECISION * (in_bad + in_good))
    names = chosen(((every[i].as_py(), float(in_bad[i]), float(in_good[i])) for i in telling.tolist()), bad_rows, good_rows)
    rows = train.mapInArrow(partial(_rows, counts=counts, names=names), "toxic boolean, weight double, found array<int>")
    sums = rows.groupBy("found").agg(*[F.sum(F.when(F.col("toxic") == kind, F.col("weight")).otherwise(0.0)).alias(name) for kind, name in ((True, "bad"), (False, "good"))])
    sums = sums.orderBy("found").toArrow().combine_chunks()
    found = pa.chunked_array(sums["found"], pa.list_(pa.int32())).combine_chunks()
    edges, held = found.offsets.to_numpy(), found.values.to_numpy()
    patterns = [(held[a:b], *n) for a, b, *n in zip(edges[:-1].tolist(), edges[1:].tolist(), _rounded(sums["bad"]).tolist(), _rounded(sums["good"]).tolist())]
    weights = logistic(patterns, len(names))
    return {"counts": counts, "weights": weights, "names": names}


def _score(batches, model: dict):
    reader = Reader(model["counts"], model["names"])
    weights, names = model["weights"], model["names"]
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("found", pa.string()), ("text_hash", pa.int64())])
    for batch in batches:
        scores, found = [], []
        for text in batch.column(1):
            held = sorted(reader.read(text.as_py() or ""))
            z = float(weights[held].sum() + weights[-1])
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            found.append(",".join(names[i] for i in held))
        n = len(scores)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, pa.string()), batch.column(3)], schema=schema)


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Scores of ``docs`` (doc_id, text) for what ``labels`` (doc_id, toxic) marks.

    Output: doc_id, held_out, score (0 to 1), predicted, found (the features
    it has), text_hash.
    Learns from rows whose crc32(doc_id as text) mod 5 is not 0. A null text is
    empty and gets the score of a text without features; a null doc_id counts
    as an empty one for the split and has no label. A document labelled more
    than once is toxic if any label says so; null labels are none. Without
    toxic labels the score is next to 0, without others next to 1. Repeated
    rows score alike; an empty table gives an empty result. Extra columns are
    ignored.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    model = fit(docs, labels, space, most_rows)
    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", held_out_column().alias("held_out"), text_hash().alias("text_hash"))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, score double, predicted int, found string, text_hash long")


def op10_noisy_channel_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
