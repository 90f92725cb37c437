"""Operators against plain versions of what they compute."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import same
from hypothesis import given, settings
from hypothesis import strategies as st

from genoloom.llm import cotraining, exact_dedup, mixing, packing, pii, queries, simhash, simple8b, suffix_tree, tokens, topk, toxicity
from genoloom.llm.common import Workspace


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    same(queries.queries()[name](spark, duck.base).toPandas(), duck(queries.oracle_sql()[name]))


@pytest.fixture(scope="module")
def texts(duck):
    return {r.doc_id: r.text for r in duck("select doc_id, text from documents").itertuples()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    e = Tokenizer.from_file(tokens.default_vocabulary())
    return {d: np.array(e.encode(t, add_special_tokens=False).ids, "<u4") for d, t in texts.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "a", "B", "é", ".", "1", "'s", "\u3000", "\u4e2d", "\u00a0", "  ", "<|endoftext|>", "x" * 40, "!"]), max_size=14).map("".join))
def test_encoder_is_the_library(text):
    from tokenizers import Tokenizer

    if "library" not in _LIBRARY:
        _LIBRARY["library"] = Tokenizer.from_file(tokens.default_vocabulary())
    e = tokens.encoder(tokens.default_vocabulary())
    got = np.frombuffer(e.encode_one(text), e.dtype).tolist()
    assert got == _LIBRARY["library"].encode(text, add_special_tokens=False).ids


_LIBRARY: dict = {}


@pytest.mark.parametrize("together, known", [(20_000, 400_000), (300, 40), (2_000, 300)])
def test_many_texts_are_the_library(monkeypatch, together, known):
    """Texts encoded together, while pieces are met again and forgotten, have the library's ids each, in order."""
    monkeypatch.setattr(tokens, "TOGETHER", together)
    monkeypatch.setattr(tokens, "KNOWN", known)
    rng = np.random.default_rng(together)
    odd = [" ", "\n", "\n\n", "\t", "a", "Bé", "été.", ".", "1", "don't", "\u3000", "中文", "\u00a0", "à", "<|endoftext|>", "\x85", "end.\nStart"]
    words = [*odd, *[f"{rng.choice(odd)}{'abcdefg'[i % 7] * (i % 5)}{'xyzé'[i % 4]}" for i in range(300)]]
    texts = [rng.choice(["", " ", "  "], p=[0.1, 0.85, 0.05]).join(rng.choice(words, rng.integers(0, 30))) for _ in range(1500)]
    texts += ["", "\n", "one", " a", "a ", "a\n", "a\n\nb c"]
    e = tokens.Encoder(tokens.default_vocabulary())
    assert e.apart
    for _ in range(2):
        assert list(e.encode_many(texts)) == [e.whole(x) for x in texts]
    assert len(e.known) == len(e.ids) == len(e.again) <= known


def test_encoder_keeps_few_of_the_words_met_once():
    e = tokens.Encoder(tokens.default_vocabulary())
    for at in range(0, 600_000, 5_000):
        e.encode_one("again and " + " ".join(f"w{i}" for i in range(at, at + 5_000)))
    kept = [e.words, *(x for x in vars(e.words).values() if isinstance(x, dict))]
    assert sum(map(len, kept)) < 360_000 and "and" in e.words
    text = "again and w0 w599999 w0 w0"
    assert e.encode_one(text) == e.whole(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60).flatmap(lambda b: st.integers(0, 2**b)) | st.integers(0, 2**64 - 1), max_size=300), max_size=6))
def test_simple8b_round_trip(docs):
    arrays = [np.array(d, np.uint64) for d in docs]
    names, starts, got = simple8b.read_image(simple8b.write_image(list(range(len(docs))), arrays))
    assert names == list(range(len(docs))) and got.tolist() == [x for d in docs for x in d]
    assert starts.tolist() == np.cumsum([0] + [len(d) for d in docs]).tolist()


def test_simple8b_long_runs():
    n = 3 * simple8b.BLOCK + 5
    a = np.where(np.arange(n) % 1000 < 500, 0, np.arange(n) % 50_000).astype(np.uint64)
    image = simple8b.write_image([1], [a])
    assert (simple8b.read_image(image)[2] == a).all() and len(image) < 4 * n


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3), st.integers(0, 3 * simple8b.BLOCK), st.integers(0, 3 * simple8b.BLOCK))
def test_simple8b_ranges(seed, blocks, a, b):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 50_000, blocks * simple8b.BLOCK - 7).astype(np.uint64)
    ids[rng.integers(0, len(ids), 5)] = 2**63 + 1
    image = simple8b.write_image([3], [ids])
    assert (simple8b.read_range(image, min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


def test_op3(spark, duck, ids, tmp_path):
    space = Workspace(spark, "test")
    images = simple8b.write_ids(spark.read.parquet(f"{duck.base}/documents.parquet"), space, per_file=5000)
    got = {r.doc_id: r for r in simple8b.read_ids(images).collect()}
    start = 0
    for d in sorted(ids):
        want = np.append(ids[d], 0).astype("<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    files = simple8b.export(images, str(tmp_path))
    back = np.concatenate([simple8b.read_image(open(f, "rb").read())[2] for f in files])
    assert len(back) == start


def test_op7(spark, duck, ids):
    got = packing.pack(spark.read.parquet(f"{duck.base}/documents.parquet")).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, pieces in by_doc.items():
        want = np.append(ids[d], 1).astype("<u4").tobytes()
        pieces.sort(key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == want and all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens * 4 == len(want) for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert n <= 2048 and n & (n - 1) == 0
    assert len(by_doc) == len(ids)


def test_packing_deals_by_ids(spark):
    from pyspark.sql import functions as F

    # a third of all rows share a sketch and an id, and a few rows are very long
    rows = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id"))).alias("sketch"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("place"), F.col("id").alias("row"), F.when(F.col("id") % 500 == 1, 2000).otherwise(F.col("id") % 50 + 1).alias("n_ids"))
    ends = packing.bounds(rows, task_ids=5000)
    keys = sorted((r.sketch, r.place, r.row, r.n_ids) for r in rows.collect())
    total = sum(k[3] for k in keys)
    shares = [0] * (len(ends) + 1)
    for k in keys:
        shares[packing.bisect_left(ends, k[:3])] += k[3]
    even = total / -(-total // 5000)
    assert sum(shares) == total and len(shares) >= 12 and max(shares) <= even * 1.25 + 4000
    assert packing.bounds(rows.limit(0)) == [] and packing.bounds(rows, task_ids=10**9) == []
    packed = packing.pack(spark.createDataFrame([(i % 7, "some words " * (i % 90)) for i in range(200)], "doc_id long, text string"), task_ids=1000).collect()
    assert len({p.sequence_id >> 33 for p in packed}) > 5 and sum(p.length for p in packed) == sum(len(tokens.encoder(tokens.default_vocabulary()).whole("some words " * (i % 90))) // 2 + 1 for i in range(200))


def corpus_of_topics(n=40):
    random.seed(2)
    topics = [[random.randrange(100 * t, 100 * t + 60) for _ in range(400)] for t in range(4)]
    docs = [np.array(random.sample(topics[i % 4], random.randint(60, 140)) + [1], np.uint32) for i in range(n)]
    df = Counter(x for d in docs for x in set(d.tolist()))
    return docs, packing.Stats(np.array([df[x] for x in range(max(df) + 1)]), n, sum(map(len, docs)))


def brute_bm25(docs, seed):
    """Every document's score by the formula, term by term."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(x for d in docs for x in set(d.tolist()))
    out = []
    for d in docs:
        tf = Counter(d[:-1].tolist())
        out.append(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in docs[seed][:-1].tolist()))
    return out


def test_bm25_is_the_brute_force_one():
    docs, stats = corpus_of_topics()
    shard = packing.Shard(docs, stats)
    for seed in range(len(docs)):
        want = brute_bm25(docs, seed)
        assert shard.scores(seed).tolist() == pytest.approx(want, rel=1e-4)
        for first in (5, 1000):
            found = np.concatenate(list(shard.neighbours(seed, first))).tolist()
            assert sorted(found) == list(range(len(docs))) and all(want[a] >= want[b] - 1e-3 for a, b in zip(found, found[1:]))


def test_shards_shrink_to_documents_left():
    """Used documents leave the index; the scores of those left stay."""
    docs, stats = corpus_of_topics()
    shard = packing.Shard(docs, stats)
    size = len(shard.doc)
    alive = np.arange(len(docs)) % 3 == 0
    shard.shrink(alive)
    assert len(shard.doc) < size / 2 and shard.matrix.shape[1] == alive.sum()
    for seed in range(0, len(docs), 5):
        want = np.array(brute_bm25(docs, seed))
        assert shard.scores(seed)[alive].tolist() == pytest.approx(want[alive].tolist(), rel=1e-4)
        found = np.concatenate(list(shard.neighbours(seed, 5, lambda scores: alive))).tolist()
        assert sorted(found) == np.flatnonzero(alive).tolist() and all(want[a] >= want[b] - 1e-3 for a, b in zip(found, found[1:]))


def test_packing_keeps_every_id_of_large_shards():
    docs, stats = corpus_of_topics(3000)
    docs = [d[-(i % 37) - 1 :] for i, d in enumerate(docs)]
    done = [0] * len(docs)
    used = 0
    for d, start, length in packing.arrange(docs, 64, 64, stats):
        assert start == done[d] and 0 < length <= 64 - used % 64
        done[d] += length
        used += length
    assert done == [len(d) for d in docs]


def test_packing_fills_with_best_neighbours():
    docs, stats = corpus_of_topics()
    pieces = list(packing.arrange(docs, 505, 505, stats))
    assert sum(length for _, _, length in pieces) == sum(map(len, docs))
    used, gap, seed, right, seen = {}, 505, None, 0, 0
    for d, start, length in pieces:
        assert start == used.get(d, 0)
        if seed is not None and gap < 505 and length < gap:
            # of those that fit and are unused, the best for the seed
            want = brute_bm25(docs, seed)
            fit = [x for x in range(len(docs)) if not used.get(x, 0) and len(docs[x]) <= gap]
            seen += 1
            right += want[d] >= max(want[x] for x in fit) - 1e-3
        seed = d if gap == 505 or seed is None else seed
        used[d] = start + length
        gap -= length
        if not gap:
            gap, seed = 505, None
    assert seen > 20 and right / seen >= 0.9
    order = [d % 4 for d, _, _ in pieces]
    assert sum(a == b for a, b in zip(order, order[1:])) > 25


def test_op5(spark, duck, texts):
    import xxhash

    got = {r.doc_id: r for r in simhash.op5_simhash_gray(spark, duck.base).collect()}
    fps = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert got[d].fingerprint == f"{fps[d]:016x}"
    check_components(fps, {d: r.component_id for d, r in got.items()})


def check_components(fps, found):
    names, u = list(fps), np.array(list(fps.values()), np.uint64)
    label = np.arange(len(u))
    a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u) <= 3, 1))
    simhash.unite(label, a, b)
    least = {}
    for n, c in zip(names, label.tolist()):
        least[c] = min(least.get(c, n), n)
    assert {n: least[c] for n, c in zip(names, label.tolist())} == found


def test_gray_index_finds_all(spark):
    random.seed(5)
    fps = {}
    for i in range(60):
        f = random.getrandbits(64)
        for _ in range(random.choice([1, 1, 5, 30])):
            fps[len(fps)] = f
            for _ in range(random.randint(0, 4)):
                f ^= 1 << random.randrange(64)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in set(fps.values())]
    space = Workspace(spark, "test")
    links = simhash.links(spark.createDataFrame(signed, "fp long"), space, shard_rows=40)
    roots = {r.node: r.root for r in simhash.components(links, space).collect()}
    place = {d: roots.get(s, s) for d, s in ((d, f - 2**64 if f >= 2**63 else f) for d, f in fps.items())}
    least = {}
    for d, c in place.items():
        least[c] = min(least.get(c, d), d)
    check_components(fps, {d: least[c] for d, c in place.items()})


def test_op1(spark, duck, texts):
    rows = suffix_tree.op1_suffix_tree_scores(spark, duck.base).collect()
    words = {d: t.encode().lower().split() + [b"\n"] for d, t in texts.items()}
    c = Counter()
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(w)
    total, norm = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for r in rows:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / norm) for x in w))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_tree(texts, held, k=suffix_tree.KAPPA, longest=suffix_tree.MAX_WORDS):
    """The log10 probability of each text, from dictionaries of all contexts."""
    words = [t.lower().split() + ["\n"] for t in texts]
    train = [w for w, h in zip(words, held) if not h]
    c = Counter(x for w in train for x in w)
    norm = sum(c.values()) + 0.5 * (len(c) + 1)
    least = suffix_tree.LEAST_CONTEXT
    rare = {x for x in c if c[x] < least and x != "\n"}
    rare_mass = (sum(c[x] for x in rare) + 0.5 * len(rare) + 0.5) / norm
    sym = lambda x: "?" if x in rare or x not in c else x
    root = lambda s: rare_mass if s == "?" else (c[s] + 0.5) / norm
    after, known = {}, {}
    for many, ws in ((after, train), (known, words)):
        for w in ws:
            for i, x in enumerate(w):
                for d in range(1, min(longest, i) + 1):
                    ctx = tuple(w[i - d : i])
                    if any(sym(y) == "?" for y in ctx):
                        break
                    many.setdefault(ctx, Counter())[sym(x)] += 1
    states = {}

    def p(ctx, s):
        if not ctx:
            return root(s)
        up = p(ctx[1:], s)
        return (after[ctx][s] + k * up) / (sum(after[ctx].values()) + k) if states.get(ctx) else up

    for ctx in sorted(after, key=len):
        n = sum(after[ctx].values())
        gain = sum(m * math.log((m - 1 + k * p(ctx[1:], s)) / ((n - 1 + k) * p(ctx[1:], s))) for s, m in after[ctx].items())
        states[ctx] = n >= least and gain >= suffix_tree.LEAST_TOTAL
    out = []
    for w in words:
        total, deepest = 0.0, 0
        for i, x in enumerate(w):
            d = 0
            while d < min(longest, i) and sym(w[i - d - 1]) != "?":
                d += 1
            ctx = tuple(w[i - d : i])
            total += math.log10(p(ctx, sym(x)) / root(sym(x)) * (c[x] + 0.5) / norm)
            deepest = max([deepest] + [j for j in range(1, d + 1) if states.get(ctx[d - j :])])
        out.append((total, deepest))
    return out


@pytest.fixture(scope="module")
def phrases(spark):
    random.seed(4)
    parts = ["the quick fox runs", "a slow dog sleeps", "of the old town hall", "in a big red house", "he said that she", "rare{}", "the the the the"]
    texts = [" ".join(random.choice(parts).format(random.randrange(40)) for _ in range(random.randint(0, 25))) for _ in range(120)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_suffix_tree_is_the_brute_force_one(spark, phrases):
    texts, docs = phrases
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    want = brute_tree(texts, held)
    for group in (50, 10**6):
        got = {r.doc_id: r for r in suffix_tree.score_documents(docs.repartition(3), group=group).collect()}
        for i, (score, deepest) in enumerate(want):
            assert got[i].score == pytest.approx(score, abs=1e-4) and got[i].deepest == deepest
    assert max(d for _, d in want) == suffix_tree.MAX_WORDS


def test_hot_contexts_change_little(spark, phrases):
    texts, docs = phrases
    plain = suffix_tree.score_documents(docs).toPandas()
    hot = suffix_tree.score_documents(docs, hot=60, group=50).toPandas()
    # successors that a hot context has once share what is left; on so few texts that is some of the mass
    assert hot.score.sum() == pytest.approx(plain.score.sum(), rel=0.05)
    assert hot.score.sum() - hot.base_score.sum() > 0.8 * (plain.score.sum() - plain.base_score.sum())


@pytest.mark.parametrize("hot", [5, 60])
def test_hot_contexts_are_the_brute_force_ones(spark, phrases, hot):
    texts, docs = phrases
    want = brute_tree(texts, [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))])
    got = {r.doc_id: r for r in suffix_tree.score_documents(docs.repartition(3), hot=hot, group=50).collect()}
    for i, (score, deepest) in enumerate(want):
        assert got[i].score == pytest.approx(score, abs=1e-4) and got[i].deepest == deepest


def test_states_of_hot_contexts_sum_to_one():
    n = 40
    root = np.random.default_rng(0).random(n)
    root /= root.sum()
    upper = suffix_tree.Upper(2)
    one = np.sort(suffix_tree.mixed(np.array([5, 6], np.uint64)))
    upper.add(1, one, np.array([200, 150]), np.repeat([0, 1], 10), np.tile(np.arange(2, 12), 2), np.array([90, 3, 3, 3, 3, 3, 3, 3, 3, 3] * 2), {}, root)
    two = suffix_tree.mixed(np.array([5], np.uint64) ^ one[:1])
    upper.add(2, two, np.array([90]), np.zeros(4, int), np.array([2, 7, 8, 9]), np.array([3, 60, 5, 5]), {int(two[0]): [one[0]]}, root)
    assert (upper.total[0] > 0).all() and (upper.total[1] > 0).all()
    every = np.arange(n)
    for depth in (0, 1, 2):
        hashes = [np.full(n, one[0]), np.full(n, two[0])]
        a, b, deep = upper.weights(hashes, every, np.full(n, depth, np.uint8))
        assert (a + b * root).sum() == pytest.approx(1.0) and (deep == depth).all()


def test_op6(spark, duck, texts):
    import re

    patterns = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return (True, all(int(x) <= 255 for x in m.split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[kind]

    def brute(t):
        return sorted(((m.start(), m.end(), k) for k, p in enumerate(patterns) for m in p.finditer(t) if good(k, m[0])), key=lambda x: (x[0], x[2]))

    for t in texts.values():
        assert pii.plain(t) == brute(t)
    random.seed(0)
    for _ in range(3000):
        t = "".join(random.choices("a1@.+- ()29%b0é", k=40))
        assert pii.plain(t) == brute(t)
    assert pii.op6_deobfuscated_pii(spark, duck.base).count() == len(texts)


@pytest.mark.parametrize("text, kind, span", [
    ("write to john [at] example (dot) com now", "email", "john [at] example (dot) com"), ("john dot smith at mail dot example dot com ok", "email", "john dot smith at mail dot example dot com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("to a​b@c​d.com", "email", "a​b@c​d.com"), ("ip １９２.168.0.1!", "ip", "１９２.168.0.1"), ("at 192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
    ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one")])
def test_disguises(text, kind, span):
    base, spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for a, b, k in spans] == [(kind, span)] and base == []


@pytest.mark.parametrize("text, span", [
    ("ask alice at gmail dot in today", "alice at gmail dot in"), ("frank@mail dot me", "frank@mail dot me"), (f"to {'x' * 70} at example dot com", f"{'x' * 70} at example dot com"), ("john dot smith at firma dot it ok", "john dot smith at firma dot it"),
    ("please mail jane at firma dot shop", "jane at firma dot shop"), ("jane_2 at firma dot us", "jane_2 at firma dot us"), ("contact me: jane at example.com now", "jane at example.com"), ("j @ example dot org", "j @ example dot org"),
    ("it is bob at mail dot firma dot travel and more", "bob at mail dot firma dot travel"), ("Jane AT Example DOT Com", "Jane AT Example DOT Com"), ("j@firma dot co dot uk is", "j@firma dot co dot uk")])
def test_spelled_addresses(text, span):
    base, spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for a, b, k in spans] == [("email", span)]


def test_long_texts_are_linear():
    import time

    for text in ("a dot " * 200_000, "x at y dot " * 100_000, "a" * 1_000_000 + " at b dot com", "at " * 300_000, "one " * 250_000, "a@ " * 300_000, "mail " * 200_000, "mail at " * 150_000):
        began = time.process_time()
        pii.find(text)
        assert time.process_time() - began < 10


@pytest.mark.parametrize("text", ["we looked at example.com today", "look at the dot on the page", "he was at home dot and then left", "we met at noon. dot", "one two three go", "look at the dot on it", "he was at home (at last) [1]", "(at) all"])
def test_clean_prose_has_no_identifiers(text):
    assert pii.find(text) == ([], [])


def test_op10_held_out(spark):
    base = "/root/testdata/sf0.01"
    found = toxicity.op10_noisy_channel_toxicity(spark, base).toPandas().merge(spark.read.parquet(f"{base}/labels.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert ((found.score >= 0) & (found.score <= 1)).all()


@pytest.mark.parametrize("word, want", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("iidiooot", "idiot"), ("st*pid", "stupid"), ("m0r0n", "moron"), ("tr@sh", "trash")])
def test_restore(word, want):
    words = ["idiot", "stupid", "moron", "trash", "this", "that", "and", "the", "thing", "other"]
    counts = Counter()
    for w in words:
        p = f"  {w} "
        counts.update({p[i : i + 3]: 20 for i in range(len(p) - 2)})
    assert want in toxicity.restore(word, toxicity.CharModel(counts))


def toy_model():
    counts = Counter()
    for w in ["idiot", "stupid", "moron", "trash", "this", "that", "and", "the", "thing", "other"]:
        p = f"  {w} "
        counts.update({p[i : i + 3]: 20 for i in range(len(p) - 2)})
    return toxicity.CharModel(counts)


@settings(max_examples=150, deadline=None)
@given(st.text("io1td.$s3a", min_size=1, max_size=5))
def test_restore_is_the_exhaustive_search(word):
    import itertools

    model = toy_model()
    best: dict = {}
    for arcs in itertools.product(*toxicity.options(word)):
        state, cost = "  ", 0.0
        for c, k in arcs:
            cost += k + (model.cost(state, c) if c else 0.0)
            state = state[1] + c if c else state
        text = "".join(c for c, _ in arcs)
        best[text] = min(best.get(text, 1e9), cost + model.cost(state, " "))
    found = toxicity.restore(word, model, 1)
    assert best[found[0]] == pytest.approx(min(best.values()))


def test_long_disguises_take_linear_time_and_memory():
    import time
    import tracemalloc

    reader = toxicity.Reader({"  i": 5, " id": 5, "idi": 5}, ["^idiot$"])
    for text in ("1" + "a4b0" * 25_000, " ".join("s t u p i d" for _ in range(20_000)), "a" * 200_000, "a.b-" * 50_000, "x1 " * 100_000):
        tracemalloc.start()
        began = time.process_time()
        reader.read(text)
        assert time.process_time() - began < 30 and tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()


@pytest.mark.parametrize("text, word", [("such an idiot!", "idiot"), ("an 1d10t", "idiot"), ("an id-iot", "idiot"), ("so st.upid", "stupid"), ("so stuupid", "stupid"), ("a m o r o n", "moron"), ("ìdìöt", "idiot"), ("die", "die"), ("so ѕtupіd", "stupid"), ("tr*sh", "trash")])
def test_features_of_disguises(text, word):
    reader = toxicity.Reader(toy_model().counts)
    got = reader.read(text)
    assert f"^{word}$" in got or word[1:4] in got
    named = toxicity.Reader(toy_model().counts, sorted(got))
    assert named.read(text) == set(range(len(got)))


def test_named_features_are_the_same():
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abio1.é$", k=rng.randint(1, 7))) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    plain = toxicity.Reader(toy_model().counts)
    every = sorted(set().union(*(plain.read(t) for t in texts)))
    named = toxicity.Reader(toy_model().counts, every[::3])
    for t in texts:
        assert {every[::3][i] for i in named.read(t)} == plain.read(t) & set(every[::3])


def test_trigrams_are_counted():
    import pyarrow as pa

    texts = ["abc d", None, "", "x", "Aé9bb c", "a" * 9]
    want = Counter()
    import re

    for t in texts:
        for w in re.findall("[a-z]+", (t or "").lower()):
            p = f"  {w} "
            want.update(p[i : i + 3] for i in range(len(p) - 2))
    batch = next(iter(toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) == want


def test_logistic_is_the_plain_fit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.5] - 0.7)))).astype(float)
    sums: dict = {}
    for row, t in zip(x, y):
        both = sums.setdefault(tuple(np.flatnonzero(row).tolist()), [0.0, 0.0])
        both[0 if t else 1] += 1
    w = toxicity.logistic([(k, *v) for k, v in sums.items()], 3, ridge=0.01)
    p = 1 / (1 + np.exp(-(np.c_[x, np.ones(300)] @ w)))
    # at the best fit the gradient, with the ridge, is nought
    assert np.abs(np.c_[x, np.ones(300)].T @ (y - p) - np.array([0.01, 0.01, 0.01, 1e-3]) * w).max() < 1e-2


def test_calibration_is_the_plain_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(i, False, int(rng.random() < 0.5), True, [float(x) for x in rng.normal(size=cotraining.N_TEXT)], [float(x) for x in rng.normal(size=cotraining.N_META)]) for i in range(200)]
    viewed = spark.createDataFrame(rows, cotraining.VIEWED).repartition(3)
    guides = {"text": np.round(rng.normal(size=cotraining.N_TEXT) / 9, 3), "meta": np.round(rng.normal(size=cotraining.N_META) / 9, 3)}
    scales, told = cotraining.newton(viewed, {v: np.array([0.0, 1.0]) for v in guides}, guides, calibrate=True, steps=20)
    y = np.array([r[2] for r in rows], float)
    for v, i in (("text", 4), ("meta", 5)):
        x = np.c_[np.ones(200), np.clip(np.array([r[i] for r in rows], np.float32).astype(float) @ guides[v], -15, 15)]
        p = 1 / (1 + np.exp(-(x @ scales[v])))
        assert np.abs(x.T @ (y - p) - cotraining.RIDGE * (scales[v] - [0.0, 1.0])).max() < 1e-2
        assert told[v] == (200, y.sum())


def test_op4_held_out(spark):
    base = "/root/testdata/sf0.01"
    found = cotraining.op4_cotrained_quality(spark, base).toPandas().merge(spark.read.parquet(f"{base}/labels.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.keep == (held.quality == 1)).mean() > 0.95


def test_stream_in_many_batches(spark, duck):
    docs = spark.read.parquet(f"{duck.base}/documents.parquet").repartition(5)
    one = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, files_per_batch=1).collect()}
    assert one == {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}


def test_clashing_digests_are_told_apart(spark, monkeypatch):
    # a digest of one byte, so that many texts share it
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits: F.substring(F.md5(c), 1, 2))
    texts = [f"text number {i % 150}" if i % 3 else f"TEXT Number {i % 150}" for i in range(600)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t.lower(), []).append(i)
    assert len(got) == 600 and len({r.digest for r in got}) < 150
    for r in got:
        mine = groups[texts[r.doc_id].lower()]
        assert (r.keep_id, r.group_size, r.kept) == (max(mine), len(mine), r.doc_id == max(mine))


def test_mix_in_small_buckets(spark, duck):
    docs = spark.read.parquet(f"{duck.base}/documents.parquet")
    few, many = (sorted(map(tuple, mixing.mix(docs, bucket_bits=n).collect())) for n in (7, 0))
    assert few == many


def test_mix_agrees_over_partitionings(spark):
    rows = [(None if i % 3 else i % 5, f"some text {i % 40} " * (i % 4), "abc"[i % 3] if i % 7 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plans = [sorted(map(repr, mixing.mix(docs.repartition(n)).collect())) for n in (1, 7)]
    assert plans[0] == plans[1]


def brute_targets(sizes, weights=(3, 1, 2)):
    """Targets by sharing the excess again until none is above its cap."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    full, left = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [n for n in names if n not in full]
        rest = left - sum(2 * sizes[n] for n in full)
        over = [n for n in open_ if rest * weight[n] / sum(weight[m] for m in open_) >= 2 * sizes[n]]
        if not over:
            return {n: 2 * sizes[n] if n in full else rest * weight[n] / sum(weight[m] for m in open_) for n in names}
        full |= set(over)


def test_targets_are_the_brute_force_ones(spark):
    random.seed(6)
    for n in (1, 2, 5, 60):
        sizes = {(f"s{i}é" if i else None): int(10 ** random.uniform(0, 5)) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, Workspace(spark, "test")).collect()}
        want = brute_targets(sizes)
        assert got == {k: pytest.approx(v) for k, v in want.items()}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-90, 90) | st.just(0), min_size=4, max_size=4), min_size=1, max_size=40), st.integers(1, 8), st.integers(1, 50))
def test_accumulate_and_select(rows, k, cut):
    m = np.array(rows)
    asked, names = m[:7], np.arange(min(7, len(m)))
    assert (topk.accumulate(asked, topk.Postings.of(m)) == m @ asked.T).all()
    best = topk.Best(names, k)
    for at in range(0, len(m), cut):
        part = topk.Postings(np.arange(at, min(len(m), at + cut)), np.full(len(m[at : at + cut]), 4), m[at : at + cut].ravel(), np.int64)
        best.add(0, part.ids, topk.accumulate(asked, part))
    for q in names.tolist():
        want = sorted((i for i in range(len(m)) if i != q), key=lambda i: (-int(m[i] @ m[q]), i))[:k]
        assert best.id[best.query == q].tolist() == want


def test_search_from_many_partitions(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(-128, 128, (400, 6)) / 64
    docs = spark.createDataFrame([(i, m[i].tolist()) for i in range(400)], "vec_id long, embedding array<double>").repartition(200)
    q = np.floor(m * 64).astype(int)
    for kw in ({}, {"range_cells": 100, "query_cells": 30}):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(docs, **kw).collect()}
        for i in range(0, 400, 20):
            want = sorted((j for j in range(400) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:20]
            assert [got[i, r + 1] for r in range(20)] == [(j, int(q[i] @ q[j])) for j in want]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e12])], "vec_id long, embedding array<double>"))
