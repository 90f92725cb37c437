"""Known small inputs with known results, readers of odd files, sinks, shards and the command line."""

import gzip
import json
import random
import struct

import pytest
from test_engine import vcf

from genoloom import __main__ as cli
from genoloom import engine, sinks
from genoloom.lang.analyzer import analyze
from genoloom.lang.parser import parse
from genoloom.operators import coverage, shards
from genoloom.operators.variants import indel_events, walk
from genoloom.plans.lower import plan
from genoloom.sources import bam as bam_source
from genoloom.sources import text as text_source

# Records whose results are known.
IMPACT = [
    (7, 55019021, "rs1", "G", "A", "60.0", "PASS", "DP=100;AF=0.50"), (7, 55142285, ".", "C", "T", "35.5", "LowQual", "DP=40;AF=0.10"), (7, 55174772, "cosm6240", "T", "G", "120.0", "PASS", "DP=200;AF=0.45"),
    (7, 55181378, ".", "A", "ATTG", "80.0", "PASS", "DP=150;AF=0.30"), (7, 55191822, "rs2", "G", "GA", "22.0", "LowQual", "DP=25;AF=0.08"), (7, 55249071, "rs3", "C", "T", "999.0", "PASS", "DP=300;AF=0.49"),
    (7, 55259515, ".", "T", "C", "45.0", "PASS", "DP=60;AF=0.20"), (12, 25245350, "rs4", "C", "T", "75.0", "PASS", "DP=90;AF=0.35")]
ALLELES = [(7, 55019021, "rsA", "C", "A,G,T", 60, "PASS", "DP=100;AF=0.3,0.2,0.1"), (7, 55019024, ".", "A", "C,T", 55, "PASS", "DP=90;AF=0.4,0.15"), (7, 55181380, "rsB", "G", "A", 40, "PASS", "DP=80;AF=0.5"), (7, 55249060, ".", "GC", "G,GTC", 70, "PASS", "DP=120;AF=0.25,0.35")]
LEFT = [(7, 55019021, "G", "A"), (7, 55181378, "A", "ATTG"), (7, 55241707, "G", "T"), (7, 55249100, "A", "T"), (7, 55259515, "T", "G")]
RIGHT = [(7, 55241707, "G", "T"), (7, 55249100, "A", "C"), (7, 55259515, "T", "G"), (7, 55260000, "C", "A"), (12, 25000, "G", "A")]


def rows(spark, text, **variables):
    return engine.run(spark, text, variables).rows()


@pytest.fixture(scope="module")
def impact(tmp_path_factory):
    return vcf(tmp_path_factory.mktemp("i") / "impact.vcf", IMPACT)


def test_impact(spark, impact):
    got = rows(spark, f'FROM vcf "{impact}" CALL variants')
    assert len(got) == 8 and (got[0]["chrom"], got[0]["pos"], got[0]["qual"], got[0]["depth"], got[0]["allele_freq"], got[0]["filter"], got[0]["id"]) == ("7", 55019021, 60.0, 100, 0.5, "PASS", "rs1")
    one = rows(spark, f'FROM vcf "{impact}" CALL variants WHERE pos = 55181378')
    assert [(r["ref"], r["alt"], r["type"]) for r in one] == [("A", "ATTG", "INDEL")]
    assert len(rows(spark, f'FROM vcf "{impact}" CALL variants WHERE chrom = "7" AND pos >= 55140000 AND pos <= 55200000')) == 4
    assert len(rows(spark, f'FROM vcf "{impact}" CALL variants WHERE af >= 0.4 AND filter = "PASS"')) == 3
    assert [r["qual"] for r in rows(spark, f'FROM vcf "{impact}" CALL variants SELECT qual ORDER BY qual DESC LIMIT 3')] == [999.0, 120.0, 80.0]
    assert rows(spark, f'FROM vcf "{impact}" CALL variants SELECT gene LIMIT 1') == [{"gene": None}]


def test_alleles(spark, tmp_path):
    path = vcf(tmp_path / "m.vcf", ALLELES)
    got = [(r["pos"], r["ref"], r["alt"], r["af"]) for r in rows(spark, f'FROM vcf "{path}" SPLIT CALL variants SELECT pos, ref, alt, af')]
    assert got == [(55019021, "C", "A", 0.3), (55019021, "C", "G", 0.2), (55019021, "C", "T", 0.1), (55019024, "A", "C", 0.4), (55019024, "A", "T", 0.15), (55181380, "G", "A", 0.5), (55249060, "GC", "G", 0.25), (55249060, "G", "GT", 0.35)]
    assert len(rows(spark, f'FROM vcf "{path}" CALL variants')) == 4


def test_partitions_of_two(spark, tmp_path):
    a, b = (vcf(tmp_path / f"{n}.vcf", [(c, p, ".", r, x, 1, "PASS", "DP=9") for c, p, r, x in side]) for n, side in (("a", LEFT), ("b", RIGHT)))
    got = lambda clause: [(r["chrom"], r["pos"], r["alt"]) for r in rows(spark, f'FROM vcf "{a}" {clause}')]
    shared = [("7", 55241707, "T"), ("7", 55259515, "G")]
    private = [("7", 55019021, "A"), ("7", 55181378, "ATTG"), ("7", 55249100, "T")]
    assert got(f'ISEC vcf "{b}" MODE shared') == shared == got(f'PAIRED WITH vcf "{b}" MODE germline CALL variants')
    assert got(f'ISEC vcf "{b}" MODE private_a') == private == got(f'PAIRED WITH vcf "{b}" CALL variants')
    assert got(f'ISEC vcf "{b}" MODE private_b') == [("7", 55249100, "C"), ("7", 55260000, "A"), ("12", 25000, "A")]
    assert len(got(f'ISEC vcf "{b}" MODE union')) == 8


def test_cigar_walks(spark):
    import re

    cases = [("4M2I4M", 100, "ACGTCCACGT"), ("8M3D9M", 200, "ACGTACGTACGTACGTA"), ("5S20M1I4M", 300, "A" * 5 + "C" * 20 + "T" + "G" * 4), ("5=10N5X", 400, "ACGTACGTAC"), ("2I10M", 500, "GGACGTACGTAC")]
    data = [("7", p, 0, s, [(o, int(n)) for n, o in re.findall(r"(\d+)(\D)", c)]) for c, p, s in cases]
    df = spark.createDataFrame(data, "chrom string, pos long, flag long, seq string, cigar array<struct<op:string,len:int>>")
    got = sorted((r.pos, r.op, r.len, r.text) for r in indel_events(walk(df)).collect())
    assert got == [(103, "I", 2, "CC"), (207, "D", 3, None), (319, "I", 1, "T")]


@pytest.mark.parametrize("name", ["x.vcf.gz", "x.bgz", "x"])
def test_gzip_by_first_bytes(spark, impact, tmp_path, name):
    raw = open(impact, "rb").read()
    # several members, as block gzip has
    (tmp_path / name).write_bytes(b"".join(gzip.compress(raw[i : i + 100]) for i in range(0, len(raw), 100)))
    got = rows(spark, f'FROM vcf "{tmp_path / name}" CALL variants SELECT pos')
    assert [r["pos"] for r in got] == [r[1] for r in IMPACT]


def test_packed_and_plain_files_together(spark, impact, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(open(impact).read())
    (tmp_path / "in" / "b.vcf").write_bytes(gzip.compress(open(impact, "rb").read()))
    assert text_source.vcf(spark, str(tmp_path / "in")).count() == 16


def test_fasta_over_partitions(spark, tmp_path):
    random.seed(9)
    seqs = {f"c{i}": "".join(random.choices("acgtn", k=random.choice([0, 1, 59, 3000]))) for i in range(12)}
    (tmp_path / "r.fa").write_text("".join(f">{n} about\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in seqs.items()) + ">7:101-160\nACGT\n\nGG\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = text_source.fasta(spark, str(tmp_path / "r.fa"))
            assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
            got: dict = {}
            for r in df.collect():
                got.setdefault(r.contig, {})[r.offset] = r.seq
            for n, s in seqs.items():
                parts = got.pop(n, {})
                assert "".join(parts[o] for o in sorted(parts)) == s.upper()
                assert sorted(parts) == list(range(0, len(s), 60))
            assert got == {"7": {100: "ACGT", 104: "GG"}}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def index_of(path, contigs):
    """A BAM index of a sorted file, by the format's description."""
    import os

    size = os.path.getsize(path)
    _, first = bam_source.head(path, size)
    bins = [{} for _ in contigs]
    linear = [[] for _ in contigs]
    with bam_source.opened(path) as f:
        span = bam_source.Span(f, size, first, 1 << 60)
        places = []
        for raw, at in span:
            _, ref, pos, _, _, _, n_cigar, _, n = struct.unpack_from("<iiiBBHHHi", raw, at)
            places.append((span.end, ref, pos, max(1, n)))
        ends = [p for p, *_ in places[1:]] + [span.end]
    for (start, ref, pos, n), end in zip(places, ends):
        if ref < 0:
            continue
        a, b = start[0] << 16 | start[1], end[0] << 16 | end[1]
        last = pos + n - 1
        number = next((((1 << (29 - s)) - 1) // 7 + (pos >> s) for s in (14, 17, 20, 23, 26) if pos >> s == last >> s), 0)
        bins[ref].setdefault(number, []).append((a, b))
        while len(linear[ref]) <= last >> 14:
            linear[ref].append(0)
        for w in range(pos >> 14, (last >> 14) + 1):
            linear[ref][w] = linear[ref][w] or a
    out = [b"BAI\1", struct.pack("<i", len(contigs))]
    for b, l in zip(bins, linear):
        out.append(struct.pack("<i", len(b)))
        for number, chunks in b.items():
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<2Q", *c) for c in chunks))
        out.append(struct.pack("<i", len(l)) + struct.pack(f"<{len(l)}Q", *l))
    return b"".join(out)


def test_index_prunes(spark, tmp_path):
    rng = random.Random(2)
    reads = sorted((rng.choice(["1", "2"]), rng.randrange(1, 3_000_000)) for _ in range(8000))
    path = str(tmp_path / "x.bam")
    bam_source.write_bam(path, [("1", 3_000_000), ("2", 3_000_000), ("3", 10)], [(c, p, 30, 0, "".join(rng.choices("ACGT", k=80)), [30] * 80, "80M") for c, p in reads])
    plain = bam_source.bam(spark, path)
    with open(path + ".bai", "wb") as f:
        f.write(index_of(path, ["1", "2", "3"]))
    assert bam_source.bam(spark, path).count() == 8000
    for region in (("1", None, None), ("2", 1_000_000, 1_000_500), ("2", 16385, 16385), ("1", 2_999_000, None), ("3", None, None), ("x", None, None)):
        found = bam_source.bam(spark, path, region=region)
        inside = lambda r: r.chrom == region[0] and (region[1] or 0) <= r.pos <= (region[2] or 1 << 40)
        key = lambda df: [(r.chrom, r.pos, r.seq) for r in sorted(df.collect(), key=lambda r: r._seq) if inside(r)]
        assert key(found) == key(plain)
        if region[1] == 1_000_000:
            assert found.count() < 3000
    got = rows(spark, f'FROM bam "{path}" CALL reads WHERE chrom = "2" AND pos >= 500000 AND pos <= 600000 SELECT pos')
    assert [r["pos"] for r in got] == [p for c, p in reads if c == "2" and 500000 <= p <= 600000]


def test_shards(spark):
    assert shards.split_region(100, 199, 4) == [(100, 124), (125, 149), (150, 174), (175, 199)]
    assert shards.split_region(1, 10, 3) == [(1, 4), (5, 7), (8, 10)]
    assert sum(a <= 55220177 <= b for a, b in shards.split_region(55220127, 55220227, 2)) == 1
    assert [len(shards.split_region(*x)) for x in ((100, 100, 4), (100, 200, 1), (200, 100, 4), (1, 3, 10))] == [1, 1, 1, 3]
    least = shards.LEAST_SPAN
    assert [shards.plan_shard_count(*x) for x in ((10_000_000, 1), (least - 1, 16), (least * 4, 16), (least * 100, 8), (0, 16))] == [1, 1, 4, 8, 1]
    # most reads lie in a tenth of the region
    reads = spark.range(10_000).selectExpr("'7' as chrom", "case when id % 10 > 0 then id * 10 else id * 100 end as pos")
    spans = shards.split_by_density(reads, "7", 1, 1_000_000, 4)
    assert spans[0][0] == 1 and spans[-1][1] == 1_000_000 and all(b + 1 == c for (_, b), (c, _) in zip(spans, spans[1:])) and len(spans) > 2
    held = [reads.where(f"pos between {a} and {b}").count() for a, b in spans]
    assert max(held) < 6000
    assert shards.split_by_density(reads, "8", 1, 100, 4) == shards.split_region(1, 100, 4)
    merged = shards.shard_and_merge(reads, "7", spans, lambda part: part.where("pos % 2 = 0"))
    assert sorted(r.pos for r in merged.collect()) == sorted(r.pos for r in reads.where("pos % 2 = 0 and pos >= 1").collect())


def test_binary_segmentation_finds_a_shift(spark):
    random.seed(8)
    level = [1.0] * 40 + [2.5] * 12 + [1.0] * 30 + [0.1] * 10 + [1.0] * 20
    data = [("7", i * 100, i * 100 + 100, round(20 * x), x + random.uniform(-0.05, 0.05), False) for i, x in enumerate(level)]
    df = spark.createDataFrame(data, "chrom string, start long, end long, coverage long, normalized double, masked boolean")
    want = [(4000, 5200, "amplification", 12), (8200, 9200, "deletion", 10)]
    for method in ("cbs", "adaptive"):
        got = sorted((r.start, r.end, r.type, r.num_windows) for r in coverage.call_cnv(df, method=method).collect())
        assert got == want


@pytest.mark.parametrize("fmt, clauses", [("vcf", ""), ("vcf", "SELECT pos, af AS f, depth, kind"), ("bed", ""), ("bed", "SELECT chrom, pos, qual, af"), ("vcf", "WHERE pos = 1 SELECT pos, gene")])
def test_parts_are_the_file(spark, impact, tmp_path, fmt, clauses):
    """The parallel writers' parts one after another are what the single file holds."""
    text = f'FROM vcf "{impact}" CALL variants {clauses} INTO {fmt} "{tmp_path}/one"'
    engine.run(spark, text)
    q = parse(text)
    analyze(q)
    sinks.directory(plan(spark, q), fmt, str(tmp_path / "many"))
    parts = "".join(p.read_text() for p in sorted((tmp_path / "many").glob("part-*")))
    assert parts.splitlines()[1:] == (tmp_path / "one").read_text().splitlines()[1:] or "gene" in clauses


def test_nothing_is_written_as_variants_are(spark, impact, tmp_path):
    summary = engine.run(spark, f'FROM vcf "{impact}" CALL variants WHERE pos = 1 SELECT pos, gene INTO vcf "{tmp_path}/none"').text
    assert summary.startswith("wrote 0 record(s)")
    assert '##INFO=<ID=DP,Number=1,Type=Integer,Description="Read depth">' in (tmp_path / "none").read_text()


def test_files_of_other_stores(spark, impact, tmp_path):
    engine.run(spark, f'FROM vcf "{impact}" CALL variants SELECT pos, qual > 50 AND filter AS mark INTO json "file://{tmp_path}/o.json"')
    got = [json.loads(x) for x in (tmp_path / "o.json").read_text().splitlines()]
    assert [r["mark"] for r in got] == [r[6] if float(r[5]) > 50 else False for r in IMPACT]
    engine.run(spark, f'FROM vcf "{impact}" CALL variants SELECT pos INTO fasta "{tmp_path}/o.fa"')
    assert [r["pos"] for r in json.loads((tmp_path / "o.fa").read_text())] == [r[1] for r in IMPACT]


def test_command_line(capsys, tmp_path):
    assert cli.flags(["--min-depth=3", "--name", "a b", "x", "--last"]) == {"min_depth": "3", "name": "a b", "last": ""}
    assert cli.main(["compile", 'FROM vcf "a" CALL variants LIMIT 3']) == 0
    assert engine.from_json(capsys.readouterr().out) == engine.compile_query('FROM vcf "a" CALL variants LIMIT 3')
    cli.warn_without_reference('FROM bam "a" CALL variants')
    assert "no reference" in capsys.readouterr().err
    cli.warn_without_reference('FROM bam "a" CALL variants WITH reference = "r"')
    assert capsys.readouterr().err == ""
    assert cli.main(["check", "FROM"]) == 1
