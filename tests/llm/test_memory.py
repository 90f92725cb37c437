"""What operators hold in memory at once."""

import random
import tracemalloc
import zlib

import numpy as np

from genoloom.llm import suffix_tree, toxicity
from genoloom.llm.common import Workspace


def peak_mb(work):
    """MB of Python objects and NumPy arrays that ``work`` holds at its peak, with its result."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_logistic_holds_few_patterns_at_once():
    draw = random.Random(1)
    patterns = [(tuple(sorted({draw.randrange(800) for _ in range(20)})), float(i % 5 == 0), 1.0) for i in range(5_000)]
    w, most = peak_mb(lambda: toxicity.logistic(patterns, 800))
    assert most < 40  # all patterns at once are 32 MB, three times over in the Newton sums
    x = np.zeros((len(patterns), 801))
    for i, (held, _, _) in enumerate(patterns):
        x[i, [*held, 800]] = 1
    bad, every = np.array([p[1] for p in patterns]), np.array([p[1] + p[2] for p in patterns])
    slope = x.T @ (bad - every / (1 + np.exp(-x @ w)))
    assert np.abs(slope - np.r_[np.full(800, toxicity.RIDGE), 1e-3] * w).max() < 1e-3


def test_toxicity_fit_keeps_features_off_the_drivers_heap(spark, tmp_path, monkeypatch):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(12_000)]
    texts = [" ".join(w for w in words if draw.random() < 0.6) + f" fine{i}" for i in range(12)]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:24]
    docs = spark.createDataFrame([*zip(ids, texts), *((i, f"a quiet day {i}") for i in ids[12:])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n < 12)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    model, most = peak_mb(lambda: toxicity.fit(docs, labels, Workspace(spark, "toxicity")))
    assert most < 40  # some 150,000 features, of which rows of Python objects take over 60 MB
    assert len(model["weights"]) == len(model["names"]) + 1


def test_grow_holds_one_depth_at_once():
    rng = np.random.default_rng(3)
    n = 200_000
    sym = rng.integers(1, 40, n).astype(np.uint32)
    back, length = suffix_tree.chains(sym, 4)
    hashes, train, root = suffix_tree.context_hashes(back), rng.random(n) < 0.8, np.full(n, 1 / 40)
    weights = np.zeros(n), np.ones(n), np.zeros(n, np.uint8)
    (_, _, deep), most = peak_mb(lambda: suffix_tree.grow(hashes, length, sym, train, np.ones(n, np.uint8), weights, root))
    assert deep.max() > 1
    assert most * 1e6 < 87 * n  # 93 bytes a position with the depth before still held
