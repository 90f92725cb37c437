"""Each stage of the pipeline against a plain version of what it decides, and over two partitionings."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from test_methods import brute_targets

import corpus_pipeline
from genoloom.llm import tokens, toxicity

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, duck):
    return spark.read.parquet(f"{duck.base}/documents.parquet")


def rows_of(df):
    return sorted(((r.doc_id, r.text or "", r.lang, r.source, r.n_chars) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def plain(docs):
    return rows_of(docs)


def test_toxicity(spark):
    base = "/root/testdata/sf0.01"  # the smallest tables hold too few toxic rows
    docs = spark.read.parquet(f"{base}/documents.parquet")
    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{base}/labels.parquet")).collect() if r.score >= 0.5}
    assert bad and rows_of(STAGE["toxicity"](spark, docs, base)) == [r for r in rows_of(docs) if r[0] not in bad]


def brute_exact(rows):
    last = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        key = r[1].translate(low)
        if key not in last or last[key][0] < r[0]:
            last[key] = r
    return sorted(last.values(), key=repr)


def test_exact_dedup(spark, duck, docs, plain):
    more = docs.unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "upper(text) as text", "lang", "source", "n_chars").where("doc_id % 3 = 0"))
    rows = rows_of(more)
    assert rows_of(STAGE["exact dedup"](spark, more, duck.base)) == brute_exact(rows)


def brute_near(rows):
    """All pairs by the sets of five-word shingles."""
    sets = []
    for r in rows:
        w = r[1].encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    first = {}
    for i, r in enumerate(rows):
        c = root(i)
        if c not in first or first[c][0] > r[0]:
            first[c] = r
    return sorted(first.values(), key=repr)


def test_near_dedup(spark, duck, docs):
    # every third text again with a word changed, some of them twice
    more = docs.unionByName(docs.where("doc_id % 3 = 0").selectExpr("doc_id + 100000 as doc_id", "regexp_replace(text, '^[^ ]+', 'changed') as text", "lang", "source", "n_chars"))
    more = more.unionByName(docs.where("doc_id % 6 = 0").selectExpr("doc_id + 200000 as doc_id", "concat(text, ' and more') as text", "lang", "source", "n_chars"))
    rows = rows_of(more)
    want = brute_near(rows)
    assert len(want) < len(rows) and rows_of(STAGE["near dedup"](spark, more, duck.base)) == want


def brute_mix(rows):
    """The rows that the mix gives, by walking each source in key order."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    key = lambda r: hashlib.md5(f"17:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    aims = brute_targets({s: sum(map(size, rs)) for s, rs in sources.items()})
    out = []
    for s, rs in sources.items():
        left, order = int(aims[s] + 1e-6), sorted(rs, key=key)
        while left > 0 and any(map(size, rs)):
            for r in order:
                n = min(left, size(r))
                left -= n
                if n == size(r) and n:
                    out.append(r)
                elif n:
                    cut = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r[1])][n - 1]
                    out.append((r[0], r[1][:cut], *r[2:4], cut))
    return sorted(out, key=repr)


def test_mixing(spark, duck, docs, plain):
    got = rows_of(STAGE["mixing"](spark, docs, duck.base))
    # whole documents keep the n_chars they came with, but for what the table says of it
    strip = lambda rows: sorted((r[:4] for r in rows), key=repr)
    assert strip(got) == strip(brute_mix(plain))


def test_packing(spark, duck, docs, plain):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    pieces = {}
    for p in STAGE["packing"](spark, docs, duck.base).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    for r in plain:
        ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[r[0]], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


@pytest.mark.parametrize("name", ["toxicity", "exact dedup", "near dedup", "mixing"])
def test_partitions_do_not_matter(spark, duck, docs, name):
    odd = docs.selectExpr("if(doc_id % 5 = 0, null, doc_id % 50) as doc_id", "text", "lang", "source", "n_chars")
    one, many = (rows_of(STAGE[name](spark, odd.repartition(n), duck.base)) for n in (1, 6))
    assert one == many
