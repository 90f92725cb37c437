"""The near-copy stage against all pairs."""

import random

import corpus_pipeline
import numpy as np

from genoloom.llm import near_copies, simhash


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def survivors(docs):
    """Smallest id of each class of pairs of similarity 0.8 or more."""
    sets = [grams(t) for _, t in docs]
    label = np.arange(len(docs))
    pairs = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len(x & y) >= 4 * len(x | y)]
    if pairs:
        simhash.unite(label, *map(np.array, zip(*pairs)))
    least = {}
    for (d, _), c in zip(docs, label.tolist()):
        least[c] = min(least.get(c, d), d)
    return sorted(least.values())


def test_stage_drops_copies_beyond_three_bits(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    docs, far = [], 0
    for size, copies, edits in [(120, 1, 3), (200, 2, 5), (90, 1, 2), (300, 1, 6), (150, 40, 1), (100, 3, 9), (40, 1, 0), (4, 1, 0), (80, 1, 8)] * 3:
        text = [word() for _ in range(size)]
        docs.append(text)
        for _ in range(copies):
            copy = list(text)
            for at in rng.sample(range(size), edits):
                copy[at] = word()
            docs.append(copy)
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    prints = [simhash.fingerprint(t.encode()) for _, t in docs]
    sets = [grams(t) for _, t in docs]
    far = sum((prints[i] ^ prints[i - 1]).bit_count() > 3 and 5 * len(sets[i] & sets[i - 1]) >= 4 * len(sets[i] | sets[i - 1]) for i in range(1, len(docs)))
    assert far > 5
    frame = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()) == [*survivors(docs), 1000]


def test_large_buckets_take_rounds(spark):
    """More texts than a bucket compares in pairs share bands; only alike ones are linked."""
    rng = random.Random(4)
    stem = [f"s{i}" for i in range(100)]
    docs = [(g * 100 + i, " ".join([*stem, *[f"g{g}w{j}" for j in range(40)], f"x{rng.random()}"])) for g in range(12) for i in range(4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()) == survivors(docs) == [g * 100 for g in range(12)]
    assert near_copies.near_copies(frame.limit(0)).count() == 0


def test_fingerprints_propose_and_sets_decide(spark, monkeypatch):
    """Without any band in common, near copies within three bits are still found through the SimHash index, and only alike ones."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = []
    for i in range(40):
        words = [f"t{i}w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join(words + ["more"]), " ".join(words * 2), " ".join(words[:200])]
    frame = spark.createDataFrame(list(enumerate([*texts, "", "one"])), "doc_id long, text string")
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    sets = [grams(t) for t in texts]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = {(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 30
    # bands of their own for every text, so only fingerprints propose
    put = near_copies.Workspace.put

    def apart(self, df, name):
        if name == "prints":
            df = df.withColumn("bands", F.array(F.xxhash64("doc_id", "text_hash")))
        return put(self, df, name)

    monkeypatch.setattr(near_copies.Workspace, "put", apart)
    root = {r.doc_id: r.root for r in near_copies.near_copies(frame).collect()}
    label = np.arange(len(texts) + 2)
    simhash.unite(label, *map(np.array, zip(*want)))
    assert len(root) == len(label)
    assert [[root[i] == root[j] for j in range(i)] for i in range(len(label))] == [[bool(label[i] == label[j]) for j in range(i)] for i in range(len(label))]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Chains and clouds whose ends aren't alike, in buckets of many texts: the classes of all pairs, without comparing all pairs."""
    rng = random.Random(6)
    texts = []
    for c in range(3):
        stem, run = ([f"{k}{c}w{i}" for i in range(200)] for k in "sr")
        texts += [[*stem, *(run * 2)[4 * i : 4 * i + 60]] for i in range(40)]
    stem = [f"s{i}" for i in range(140)]
    for i in range(300):
        copy = list(stem)
        for at in rng.sample(range(140), 1 + i % 9):
            copy[at] = f"e{rng.randrange(60)}"
        texts.append(copy)
    rng.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    asked = []
    alike = near_copies.alike

    def counted(pairs, sets, least):
        asked.append(pairs.count())
        return alike(pairs, sets, least)

    monkeypatch.setattr(near_copies, "alike", counted)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()) == survivors(docs)
    assert sum(asked) < len(docs) * (len(docs) - 1) / 2 / 4
