"""Quality by co-training a text view and a metadata view.

The text view has hashed words (what a text is about) and numbers about its
make-up, the metadata view what is known of the page without its text. Each has
its own logistic classifier, fitted on labelled rows. In every round a view's
confident predictions on unlabelled rows become pseudo-labels for the other one,
and both are fitted again. At the end each view is calibrated (Platt scaling) on
labelled rows kept apart from all fitting, and the calibrated views, taken as
independent given the quality, are combined: their log-odds add up, less the
prior's, which both contain.

Nothing is sampled: rows become a table of numbers, and a fit is Newton's method
with sums of gradients and curvatures over the whole table, added up per task
and then by key. The driver sees a matrix of fixed size. Weights are rounded
after each step, so the order of sums doesn't show in them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, need, text_bytes

ROUNDS = 3
STEPS = 5
#: A view's prediction is confident above the one or below the other.
SURE_GOOD, SURE_BAD = 0.97, 0.03
PSEUDO_WEIGHT = 0.25
RIDGE = 1.0
SOURCES, LANGS = 32, 8
#: Places of hashed words, and numbers about a text's make-up.
WORDS, MAKE_UP = 112, 16
N_TEXT, N_META = MAKE_UP + WORDS, SOURCES + LANGS + 5
#: One labelled training row in so many is kept for calibration.
FOLD = 4
#: Decimal places of weights.
PLACES = 6
_PLACE: dict[bytes, int] = {}
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOPS = np.zeros(256, bool)
_STOPS[[44, 46, 39, 59]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~(_UPPER | _LOWER | _DIGIT | _STOPS)


def text_view(text: bytes) -> list[float]:
    """Numbers about a text's make-up, then the root shares of its hashed words; an empty text has zeros beside the constant."""
    words = text.split()
    if not words:
        return [1.0] + [0.0] * (N_TEXT - 1)
    n = len(words)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    letters = max(1, int(kinds[_UPPER].sum() + kinds[_LOWER].sum()))
    lines = text.split(b"\n")
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    signs = float(kinds[_SIGN].sum()) / n
    upper = float(kinds[_UPPER].sum()) / letters
    marked = sum(w[-1] in b"!#$%&*|" for w in words) / n
    distinct = len(set(words)) / n
    held = np.bincount([_place(w) for w in text.lower().split()], minlength=WORDS)
    return [
        1.0, np.log1p(n), np.log1p(size / n), repeats, np.sqrt(repeats), min(3.0, signs), np.sqrt(min(3.0, signs)), upper, np.sqrt(upper), marked, np.sqrt(marked),
        float(kinds[_DIGIT].sum()) / size, distinct, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), float(kinds[128:].sum()) / size,
        *np.sqrt(held / n).tolist()]


def _place(word: bytes) -> int:
    """A word's place, by a hash; words are remembered up to a number."""
    import zlib

    found = _PLACE.get(word)
    if found is None:
        if len(_PLACE) > 500_000:
            _PLACE.clear()
        _PLACE[word] = found = zlib.crc32(word) % WORDS
    return found


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Numbers about a page's metadata; missing values have places of their own."""
    import zlib

    out = [0.0] * N_META
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    out[SOURCES + LANGS :] = [1.0, size / 10, size * size / 100, float(n_chars is None), float(source is None)]
    return out


VIEWED = "doc_id long, held_out boolean, label int, fold boolean, text_view array<float>, meta_view array<float>"


def _views(batches):
    for batch in batches:
        text = [text_view(t.as_py()) for t in batch.column(4)]
        meta = [meta_view(*x) for x in zip(*(batch.column(i).to_pylist() for i in (5, 6, 7)))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(text, pa.list_(pa.float32())), pa.array(meta, pa.list_(pa.float32()))], names=["doc_id", "held_out", "label", "fold", "text_view", "meta_view"])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 1))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _targets(label: np.ndarray, held: np.ndarray, fold: np.ndarray, other: np.ndarray | None):
    """(target, weight) of each row: its label, or the other view's confident guess."""
    has = ~np.isnan(label) & ~held & ~fold
    y = np.where(has, label, 0.0)
    w = has.astype(float)
    if other is not None:
        # held-out rows and those of the fold lend neither their labels nor themselves
        free = np.isnan(label) & ~held
        good, bad = free & (other >= SURE_GOOD), free & (other <= SURE_BAD)
        y = np.where(good, 1.0, y)
        w = np.where(good | bad, PSEUDO_WEIGHT, w)
    return y, w


def _sums(batches, weights: dict, guides: dict | None, calibrate: bool):
    """One Newton step's sums for both views: gradients and the upper triangles of curvatures.

    To ``calibrate``, a view is its classifier's log-odds (``guides``) on the
    labelled rows of the fold.
    """
    total: dict = {}
    for batch in batches:
        held, fold = (np.array(batch.column(i).to_pylist(), bool) for i in (1, 3))
        label = np.array([np.nan if v is None else float(v != 0) for v in batch.column(2).to_pylist()])
        views = {"text": _matrix(batch.column(4)), "meta": _matrix(batch.column(5))}
        odds = {v: np.clip(x @ guides[v], -15, 15) for v, x in views.items()} if guides is not None else {}
        for view, x in views.items():
            if calibrate:
                x = np.stack([np.ones(len(held)), odds[view]], 1)
                w = (~np.isnan(label) & ~held & fold).astype(float)
                y = np.where(w > 0, label, 0.0)
            else:
                y, w = _targets(label, held, fold, _sigmoid(odds["meta" if view == "text" else "text"]) if odds else None)
            used = np.flatnonzero(w)
            x, y, w = x[used], y[used], w[used]
            p = _sigmoid(x @ weights[view])
            curve = (x * (w * p * (1 - p))[:, None]).T @ x
            total[view] = total.get(view, 0) + np.concatenate([x.T @ (w * (y - p)), curve[np.triu_indices(x.shape[1])], [w.sum(), (w * y).sum()]])
    for view, flat in total.items():
        yield pa.RecordBatch.from_pydict({"view": pa.array([view] * len(flat)), "i": pa.array(range(len(flat)), pa.int32()), "x": pa.array(flat)})


def newton(viewed: DataFrame, weights: dict, guides: dict | None, calibrate: bool = False, steps: int = STEPS, ridge: float = RIDGE) -> tuple[dict, dict]:
    """Fit by Newton's method with a ridge towards the given weights (towards zero unless calibrating); also (rows, good rows) of each view.

    ``guides`` are the other views' last weights.
    """
    aim = {v: w if calibrate else np.zeros(len(w)) for v, w in weights.items()}
    weights = {v: w.copy() for v, w in weights.items()}
    told: dict = {}
    for _ in range(steps):
        run = partial(_sums, weights=weights, guides=guides, calibrate=calibrate)
        rows = viewed.mapInArrow(run, "view string, i int, x double").groupBy("view", "i").agg(F.sum("x").alias("x")).toArrow()
        names, places, values = (rows[c].to_numpy() for c in ("view", "i", "x"))
        moved = 0.0
        for view, w in weights.items():
            d = len(w)
            flat = np.zeros(d + d * (d + 1) // 2 + 2)
            mine = names == view
            flat[places[mine]] = values[mine]
            told[view] = (flat[-2], flat[-1])
            curve = np.zeros((d, d))
            curve[np.triu_indices(d)] = flat[d:-2]
            curve = curve + np.triu(curve, 1).T
            step = np.linalg.solve(curve + ridge * np.eye(d), flat[:d] - ridge * (w - aim[view]))
            w[:] = np.round(w + step, PLACES)
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-3:
            break
    return weights, told


def fit(viewed: DataFrame, rounds: int = ROUNDS) -> dict:
    """Both views' weights, their calibration (constant, slope), and the prior's log-odds."""
    zero = {"text": np.zeros(N_TEXT), "meta": np.zeros(N_META)}
    weights, _ = newton(viewed, zero, None)
    for _ in range(rounds):
        weights, _ = newton(viewed, weights, weights, steps=2)
    scales, told = newton(viewed, {v: np.array([0.0, 1.0]) for v in weights}, weights, calibrate=True)
    n, good = told["text"]
    return {"weights": weights, "scales": scales, "prior": float(np.log((good + 1) / (n - good + 1)))}


def _apply(batches, model: dict):
    for batch in batches:
        odds = []
        for i, v in ((4, "text"), (5, "meta")):
            z = np.clip(_matrix(batch.column(i)) @ model["weights"][v], -15, 15) if batch.num_rows else np.zeros(0)
            odds.append(model["scales"][v][0] + model["scales"][v][1] * z)
        score = _sigmoid(odds[0] + odds[1] - model["prior"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array(_sigmoid(odds[0])), pa.array(_sigmoid(odds[1])), pa.array(score >= 0.5)],
            names=["doc_id", "held_out", "score", "text_score", "meta_score", "keep"])


def held_out_column(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Quality of ``docs`` (doc_id, text, lang, source, n_chars) as ``labels`` (doc_id, quality) marks it.

    Output: doc_id, held_out, score (probability of good), text_score and
    meta_score (the calibrated views), keep (score of at least 0.5). Rows whose
    crc32(doc_id as text) mod 5 is 0 are held out of all fitting; of the others
    one in ``FOLD`` is for calibration only.

    A null text is empty; null metadata is a value of its own; a null doc_id
    has no label. A document labelled more than once is good if any label says
    so; null labels are none. Without labels every score is 0.5 and all is
    kept. Repeated rows count each. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "co-training")
    marks = need(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    fold = F.pmod(F.crc32(F.concat(F.lit("fold:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), F.lit(FOLD)) == 0
    rows = need(docs, "doc_id", "text", "source", "lang", "n_chars").select(
        F.col("doc_id").cast("long"), held_out_column().alias("held_out"), F.lit(None).cast("int").alias("label"), fold.alias("fold"), text_bytes().alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    bare = space.put(rows.mapInArrow(_views, VIEWED), "bare")
    viewed = space.put(bare.drop("label").join(marks, "doc_id", "left").select("doc_id", "held_out", "label", "fold", "text_view", "meta_view"), "viewed")
    model = fit(viewed, rounds)
    return viewed.mapInArrow(partial(_apply, model=model), "doc_id long, held_out boolean, score double, text_score double, meta_score double, keep boolean")


def op4_cotrained_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels)
