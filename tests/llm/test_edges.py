"""Every operator and stage on nulls, empty and very long texts, repeats, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from genoloom.llm import cotraining, exact_dedup, mixing, packing, pii, simhash, simple8b, suffix_tree, topk, toxicity
from genoloom.llm.common import Workspace

CLASH = "row long, n long, key string, word string, fp long, score double, file string, ids string, bucket int, size int, taken int, label int, held_out string, item string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
REST = (1, 2, "k", "w", 3, 0.5, "f", "i", 4, 5, 6, 7, "h", "t")
LONG = "lorem ipsum dolor " * 20_000


def documents(spark, empty=False):
    rows = [
        (1, "Alpha beta gamma", "en", "a", 16), (1, "Alpha beta gamma", "en", "a", 16), (2, "alpha BETA gamma", "en", None, None), (3, "", "en", "b", 0), (4, None, None, None, None),
        (None, "no id at all here", "de", "b", 17), (None, None, "de", "a", 0), (5, LONG, "fr", "c", len(LONG)), (6, "  \n\t ", "fr", "c", 5), (7, "1d10t, mail a@b.example now é ü", "xx", "ß", 30), (8, "alpha beta gamma delta " * 30, "en", "a", 700),
    ]
    return spark.createDataFrame([] if empty else [r + REST for r in rows], DOCS)


def labels(spark, empty=False):
    rows = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (3, 0, 0), (8, 1, 0), (7, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1)]
    return spark.createDataFrame([] if empty else rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "scores": lambda s, e: suffix_tree.score_documents(documents(s, e)),
    "mixing": lambda s, e: mixing.mix(documents(s, e)),
    "simple8b": lambda s, e: simple8b.read_ids(simple8b.write_ids(documents(s, e), Workspace(s, "test"))),
    "quality": lambda s, e: cotraining.quality(documents(s, e), labels(s, e)),
    "simhash": lambda s, e: simhash.near_duplicates(documents(s, e)),
    "pii": lambda s, e: pii.personal_data(documents(s, e)),
    "exact": lambda s, e: exact_dedup.exact_dedup(documents(s, e)),
    "toxicity": lambda s, e: toxicity.toxicity(documents(s, e), labels(s, e)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, name):
    assert OPERATORS[name](spark, False).count() == 11
    assert OPERATORS[name](spark, True).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_repeated_rows_agree(spark, name):
    found = [r.asDict() for r in OPERATORS[name](spark, False).where("doc_id = 1").collect()]
    for r in found:
        for k in ("start", "row", "kept", "taken"):
            r.pop(k, None)
    assert len(found) == 2 and found[0] == found[1]


def test_packing(spark):
    pieces = packing.pack(documents(spark)).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, None, 5, 6, 7, 8}
    assert packing.pack(documents(spark, True)).count() == 0
    # an empty text is its end id alone
    assert [(p.length, p.ids) for p in pieces if p.doc_id == 3] == [(1, b"\1\0\0\0")]


def test_exact_kept_once(spark):
    found = exact_dedup.exact_dedup(documents(spark)).collect()
    by = {}
    for r in found:
        by.setdefault(r.digest, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    same = next(g for g in by.values() if any(r.doc_id == 2 for r in g))
    assert {r.keep_id for r in same} == {2} and len(same) == 3
    empty = next(g for g in by.values() if any(r.doc_id == 3 for r in g))
    assert {r.keep_id for r in empty} == {4} and len(empty) == 3


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (1, [0.5, -0.25]), (20, [0.1, 0.2]), (0, [9.0, 9.0])]
    v = spark.createDataFrame([r + (1, 2.0) for r in rows], "vec_id long, embedding array<float>, row int, score double")
    got = [tuple(r) for r in topk.top_k(v).orderBy("query_id", "rank").collect()]
    q = {r[0] for r in got}
    assert q == {0, 20} and not {2, 3, 4, 5} & {r[2] for r in got}
    assert [r[2] for r in got if r[0] == 0] == [7, 1, 1, 6, 20]
    assert topk.top_k(v.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    out = {}
    for empty in (False, True):
        out[empty] = str(tmp_path_factory.mktemp("sf"))
        labels(spark, empty).write.parquet(f"{out[empty]}/labels.parquet")
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, labelled, empty):
    docs = documents(spark, empty)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, labelled[empty])
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        assert (out.count() == 0) == empty
        if name in ("exact dedup", "near dedup"):
            kept = out.collect()
            assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
        docs = out if i + 1 < len(corpus_pipeline.STAGES) else docs


def test_stages_decide_by_row(spark, labelled):
    """Rows that share an id, or have none, are kept or dropped each on its own."""
    docs = spark.createDataFrame([(1, "same text here"), (2, "Same text HERE"), (2, "another thing altogether"), (None, "third"), (None, "third"), (None, "fourth")], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_exact_copies(spark, docs, "").collect())
    assert kept == [(0, "fourth"), (0, "third"), (2, "Same text HERE"), (2, "another thing altogether")]
    near = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert near == [(0, "fourth"), (0, "third"), (1, "same text here"), (2, "another thing altogether")]


def test_mix_cuts_texts(spark):
    docs = spark.createDataFrame([(i, " a b\nc  d " * (i + 1), "x" if i % 3 else "y", "en", 5) for i in range(9)], "doc_id long, text string, source string, lang string, n_chars long")
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = {}
    for r in corpus_pipeline.take_mix(spark, docs, "").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert (" a b\nc  d " * (r.doc_id + 1)).startswith(r.text) and r.n_chars == len(r.text)
    assert got == {d: n for d, n in plan.items() if n}
