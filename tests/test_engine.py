"""Whole queries on small files written here."""

import gzip
import json
import os
import random

import pytest

from genoloom import engine
from genoloom.lang.errors import EngineError
from genoloom.sources.bam import write_bam

HEAD = "##fileformat=VCFv4.2\n##contig=<ID=7,length=159138663>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


def vcf(path, rows):
    path.write_text(HEAD + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return str(path)


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    return vcf(tmp_path_factory.mktemp("v") / "small.vcf", [
        (7, 100, "rs1", "G", "A", 60.0, "PASS", "DP=100;AF=0.50"), (7, 250, ".", "C", "T", 35.5, "LowQual", "DP=40;AF=0.10"), (7, 300, "c1", "T", "G", 120.0, "PASS", "DP=200;AF=0.45"),
        (7, 350, ".", "A", "ATTG", ".", "PASS", "DP=150;AF=0.30"), (12, 90, "rs4", "C", "T", 75.0, "PASS", "DP=90;AF=0.35")])


def rows(spark, text, **variables):
    return engine.run(spark, text, variables).rows()


def test_read(spark, small):
    got = rows(spark, f'FROM vcf "{small}" CALL variants')
    assert len(got) == 5
    assert got[0] == {"chrom": "7", "pos": 100, "ref": "G", "alt": "A", "qual": 60.0, "type": "SNV", "depth": 100, "ref_count": 0, "alt_count": 0, "allele_freq": 0.5, "strand_bias": 0.0, "filter": "PASS", "id": "rs1"}
    assert (got[3]["type"], got[3]["qual"]) == ("INDEL", 0.0)


def test_clauses(spark, small):
    assert [r["pos"] for r in rows(spark, f'FROM vcf "{small}" CALL variants WHERE af >= 0.4 AND filter = "PASS"')] == [100, 300]
    assert [r["qual"] for r in rows(spark, f'FROM vcf "{small}" CALL variants SELECT qual ORDER BY qual DESC LIMIT 3')] == [120.0, 75.0, 60.0]
    assert [r["pos"] for r in rows(spark, f'FROM vcf "{small}" CALL variants WHERE chr = "7" AND pos >= $a AND pos <= 300 SELECT pos', a=250)] == [250, 300]
    assert rows(spark, f'FROM vcf "{small}" CALL variants SELECT gene, len(id) LIMIT 1') == [{"gene": None, "len_id": 3}]
    assert rows(spark, f'FROM vcf "{small}"') == []
    assert len(rows(spark, f'FROM vcf "{small}" CALL variants LIMIT 2')) == 2


def test_gzip_and_callback(spark, small, tmp_path):
    packed = tmp_path / "small.vcf.gz"
    packed.write_bytes(gzip.compress(open(small, "rb").read()))
    seen = []
    assert engine.run(spark, f'FROM vcf "{packed}" CALL variants').each(seen.append) == 5 == len(seen)


def test_split(spark, tmp_path):
    path = vcf(tmp_path / "m.vcf", [(7, 10, ".", "C", "A,G,T", 60, "PASS", "DP=9;AF=0.3,0.2,0.1"), (7, 60, ".", "GC", "G,GTC", 70, "PASS", "DP=9;AF=0.25,0.35"), (7, 90, ".", "AT", "CT", 1, "PASS", "DP=9")])
    got = [tuple(r.values()) for r in rows(spark, f'FROM vcf "{path}" SPLIT CALL variants SELECT pos, ref, alt, af')]
    assert got == [(10, "C", "A", 0.3), (10, "C", "G", 0.2), (10, "C", "T", 0.1), (60, "GC", "G", 0.25), (60, "G", "GT", 0.35), (90, "A", "C", 0.0)]


def test_set_operations(spark, tmp_path):
    a = vcf(tmp_path / "a.vcf", [(7, p, ".", "A", x, 1, "PASS", "DP=1") for p, x in ((1, "C"), (2, "C"), (3, "C"), (4, "T"), (5, "G"))])
    b = vcf(tmp_path / "b.vcf", [(7, p, ".", "A", x, 1, "PASS", "DP=2") for p, x in ((3, "C"), (4, "C"), (5, "G"), (6, "C"), (7, "C"))])
    pos = lambda clause: [r["pos"] for r in rows(spark, f'FROM vcf "{a}" {clause}')]
    assert pos(f'ISEC vcf "{b}" MODE shared') == [3, 5]
    assert pos(f'ISEC vcf "{b}" MODE private_a') == [1, 2, 4] == pos(f'PAIRED WITH vcf "{b}"')
    assert pos(f'ISEC vcf "{b}" MODE private_b') == [4, 6, 7]
    assert pos(f'ISEC vcf "{b}" MODE union') == [1, 2, 3, 4, 5, 4, 6, 7]
    assert pos(f'PAIRED WITH vcf "{b}" MODE germline CALL variants') == [3, 5]
    assert {r["depth"] for r in rows(spark, f'FROM vcf "{a}" ISEC vcf "{b}" MODE shared_b')} == {2}


def gff_line(kind, a, b, strand, about):
    return f"7\tx\t{kind}\t{a}\t{b}\t.\t{strand}\t0\t{about}\n"


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    """A gene with two coding exons on either strand; the reverse gene reads the same bases backwards."""
    d = tmp_path_factory.mktemp("g")
    random.seed(3)
    seq = "".join(random.choices("ACGT", k=400))
    (d / "r.fa").write_text(">7 test\n" + "\n".join(seq[i : i + 50] for i in range(0, 400, 50)) + "\n")
    text = "##gff-version 3\n"
    for name, strand, lift in (("FWD", "+", 0), ("REV", "-", 200)):
        text += gff_line("gene", 11 + lift, 120 + lift, strand, f"ID=gene:{name};Name={name}")
        for t, ccds in ((f"{name}1", ""), (f"{name}2", ";ccdsid=C1")):
            text += gff_line("mRNA", 11 + lift, 120 + lift, strand, f"ID=transcript:{t};transcript_id={t}{ccds}")
            text += gff_line("exon", 11 + lift, 30 + lift, strand, f"Parent=transcript:{t};rank=1;exon_id=E{t}1") + gff_line("exon", 81 + lift, 120 + lift, strand, f"Parent=transcript:{t};rank=2;exon_id=E{t}2")
            text += gff_line("CDS", 11 + lift, 30 + lift, strand, f"Parent=transcript:{t}") + gff_line("CDS", 81 + lift, 120 + lift, strand, f"Parent=transcript:{t}")
    (d / "g.gff3").write_text(text)
    (d / "c.vcf").write_text("7\t12\t5\t" + seq[11] + "\t" + ("A" if seq[11] != "A" else "C") + "\t.\t.\tCLNSIG=old\n" + "7\t12\t6\t" + seq[11] + "\t" + ("A" if seq[11] != "A" else "C") + "\t.\t.\tCLNSIG=new;MC=SO:1|missense;RS=9\n")
    return d, seq


def expected_change(seq, strand, lift, pos, alt):
    from genoloom.functions.sequence import AMINO_ACIDS, BASES, THREE

    comp = dict(zip("ACGT", "TGCA"))
    places = [*range(11 + lift, 31 + lift), *range(81 + lift, 121 + lift)]
    if strand == "-":
        places = places[::-1]
    coding = [seq[p - 1] if strand == "+" else comp[seq[p - 1]] for p in places]
    i = places.index(pos)
    new = coding[:]
    new[i] = alt if strand == "+" else comp[alt]
    aa = lambda c: THREE[AMINO_ACIDS[BASES.index(c[0]) * 16 + BASES.index(c[1]) * 4 + BASES.index(c[2])]]
    k = i // 3 * 3
    old, fresh = aa(coding[k : k + 3]), aa(new[k : k + 3])
    return f"p.{old}{k // 3 + 1}{'=' if old == fresh else fresh}", f"c.{i + 1}{coding[i]}>{new[i]}"


def test_annotate_both_strands(spark, genome, tmp_path):
    d, seq = genome
    asked = [11, 12, 29, 30, 81, 82, 119, 211, 230, 281, 283, 318, 50, 150]
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    path = vcf(tmp_path / "v.vcf", [(7, p, ".", seq[p - 1], other[seq[p - 1]], 1, "PASS", "DP=1") for p in asked])
    got = rows(spark, f'FROM vcf "{path}" CALL variants WITH reference = "{d}/r.fa" ANNOTATE WITH genes = "{d}/g.gff3", clinvar = "{d}/c.vcf" SELECT pos, alt, gene, transcript, exon, region, aa_change, hgvs_c')
    assert [r["pos"] for r in got] == asked
    for r in got:
        p = r["pos"]
        if p in (50,):
            assert (r["gene"], r["region"], r["exon"], r["aa_change"]) == ("FWD", "intron", ".", ".")
        elif p == 150:
            assert (r["gene"], r["region"]) == (".", ".")
        else:
            name, strand, lift = ("FWD", "+", 0) if p < 200 else ("REV", "-", 200)
            assert (r["gene"], r["transcript"], r["region"], r["exon"]) == (name, f"{name}2", "exon", "1" if p - lift <= 30 else "2")
            assert (r["aa_change"], r["hgvs_c"]) == expected_change(seq, strand, lift, p, r["alt"])
    alt = "A" if seq[11] != "A" else "C"
    path = vcf(tmp_path / "w.vcf", [(7, 12, ".", seq[11], alt, 1, "PASS", "DP=1"), (7, 13, ".", seq[12], "N", 1, "PASS", "DP=1")])
    got = rows(spark, f'FROM vcf "{path}" CALL variants ANNOTATE WITH clinvar = "{d}/c.vcf" SELECT clinvar_significance, consequence, rsid, clinvar_id, gene')
    assert [tuple(r.values()) for r in got] == [("new", "missense", "rs9", "6", "."), (".", ".", ".", ".", ".")]


@pytest.fixture(scope="module")
def alignments(tmp_path_factory):
    d = tmp_path_factory.mktemp("b")
    random.seed(1)
    ref = "".join(random.choices("ACGT", k=1000))
    other = "A" if ref[499] != "A" else "C"
    reads = []
    for i in range(300):
        p = random.randint(1, 940)
        s = list(ref[p - 1 : p + 49])
        if p <= 500 < p + 50 and i % 2:
            s[500 - p] = other
        if p <= 700 < p + 40 and p > 665:
            k = 700 - p + 1
            reads.append(("7", p, 60, 0, "".join(s[:k]) + "GATTA" + "".join(s[k:45]), [35] * 50, f"{k}M5I{45 - k}M"))
        elif p <= 800 < p + 40 and p > 765:
            k = 800 - p + 1
            body = "".join(s[:k]) + ref[802:802 + 50 - k]
            reads.append(("7", p, 60, 16, body, [35] * len(body), f"{k}M2D{len(body) - k}M"))
        else:
            reads.append(("7", p, 60, 16 * (i % 2), "".join(s), [35] * 50, "50M"))
    reads.append(("7", 100, 60, 0x400, ref[99:149], [35] * 50, "50M"))
    reads.sort(key=lambda r: r[1])
    write_bam(str(d / "x.bam"), [("7", 1000)], reads)
    (d / "x.fa").write_text(">7\n" + "\n".join(ref[i : i + 70] for i in range(0, 1000, 70)) + "\n")
    return d, ref, reads, other


def test_bam_ranges(spark, tmp_path):
    from genoloom.sources import bam as source

    rng = random.Random(4)
    reads = []
    for i in range(30_000):
        n = rng.choice([0, 1, 50, 101, 150]) if i % 5000 else 100_000  # some records span blocks and ranges
        reads.append((rng.choice(["1", "2", "*"]), i + 1, rng.randrange(60), 0, "".join(rng.choices("ACGT", k=n)), [rng.randrange(40)] * n, f"{n}M"))
    path = str(tmp_path / "large.bam")
    write_bam(path, [("1", 10**6), ("2", 10**6)], reads)
    whole = source.bam(spark, path, 1 << 40)
    key = lambda df: sorted((r._seq, r.chrom, r.pos, r.mapq, r.flag, r.seq, bytes(r.qual), str(r.cigar)) for r in df.collect())
    want = key(whole)
    assert [(w[0], w[2], w[5]) for w in want] == [(i, r[1], r[4]) for i, r in enumerate(reads)]
    for split in (20_000, 100_000, 700_000):
        assert len(source.ranges(spark, source.large(spark, path, split), split)) > 1
        assert key(source.bam(spark, path, split)) == want
        assert source.contigs(spark, path, split).count() == 2
    # a wrong guess is found out
    place = source.head(path, os.path.getsize(path))[1]
    assert source.walk(path, os.path.getsize(path), place, 1 << 60)[1] == len(reads)
    with open(path, "rb") as f:
        cut = f.read()[:-2000]
    (tmp_path / "cut.bam").write_bytes(cut)
    with pytest.raises(Exception, match="ends inside"):
        source.bam(spark, str(tmp_path / "cut.bam"), 100_000).count()


def test_bam(spark, alignments):
    d, ref, reads, other = alignments
    assert engine.run(spark, f'FROM bam "{d}/x.bam" CALL header').text == "reference sequences:\n  7\t1000"
    got = rows(spark, f'FROM bam "{d}/x.bam" CALL reads')
    assert [r["pos"] for r in got] == [r[1] for r in reads]
    for r in got:
        assert r["depth"] == sum(a[1] <= r["pos"] < a[1] + len(a[4]) for a in reads)
    got = rows(spark, f'FROM bam "{d}/x.bam" CALL variants WITH reference = "{d}/x.fa", min_depth = 4, min_allele_freq = 0.3')
    snv = next(r for r in got if r["pos"] == 500 and r["type"] == "SNV")
    assert (snv["ref"], snv["alt"], snv["depth"]) == (ref[499], other, snv["ref_count"] + snv["alt_count"])
    assert any(r["pos"] == 700 and r["ref"] == ref[699] and r["alt"] == ref[699] + "GATTA" for r in got)
    assert any(r["pos"] == 800 and r["ref"] == ref[799:802] and r["alt"] == ref[799] for r in got)


def test_coverage_and_cnv(spark, alignments):
    d, _, reads, _ = alignments
    got = rows(spark, f'FROM bam "{d}/x.bam" CALL coverage WITH window_size = 100')
    assert [r["coverage"] for r in got] == [sum((r[1] - 1) // 100 == i for r in reads) for i in range(10)][: len(got)]
    assert rows(spark, f'FROM bam "{d}/x.bam" CALL cnv WITH window_size = 100, amp_threshold = 99.0, del_threshold = -1.0') == []
    assert rows(spark, f'FROM bam "{d}/x.bam" CALL cnv WITH window_size = 100, segmentation_method = "cbs"') == []


def test_sinks(spark, small, tmp_path):
    run = lambda clause, fmt: (engine.run(spark, f'FROM vcf "{small}" CALL variants {clause} INTO {fmt} "{tmp_path}/o"').text, (tmp_path / "o").read_text().splitlines())
    text, lines = run("", "vcf")
    assert text == f"wrote 5 record(s) to {tmp_path}/o (vcf)"
    assert "7\t250\t.\tC\tT\t35.5\tLowQual\tDP=40;AF=0.1000" in lines and "##contig=<ID=7>" in lines
    assert [r["pos"] for r in rows(spark, f'FROM vcf "{tmp_path}/o" CALL variants')] == [100, 250, 300, 350, 90]
    _, lines = run("SELECT pos, af AS f, depth", "vcf")
    assert lines[-1] == "12\t90\t.\tC\tT\t.\tPASS\tf=0.35;depth=90" and '##INFO=<ID=f,Number=1,Type=Float,Description="f">' in lines
    _, lines = run("LIMIT 1", "bed")
    assert lines == ["7\t99\t100\tA"]
    _, lines = run("SELECT chrom, pos, qual LIMIT 1", "bed")
    assert lines == ["#chrom\tstart\tend\tqual", "7\t99\t100\t60.0"]
    _, lines = run("SELECT pos, gene, log(0) AS bad LIMIT 1", "json")
    assert json.loads(lines[0]) == {"pos": 100, "gene": None, "bad": None}
    _, lines = run("SELECT pos, gene LIMIT 1", "tsv")
    assert lines == ["pos\tgene", "100\t"]
    with pytest.raises(EngineError):
        run("", "bam")


def test_refusals(spark, small):
    for text in ('FROM cram "x" CALL reads', 'FROM tsv "x"', f'FROM vcf "{small}" CALL reads', f'FROM vcf "{small}" CALL variants LIMIT "x"', "FROM vcf $p CALL variants"):
        with pytest.raises(EngineError):
            rows(spark, text)


def test_streamed_files(spark, small, tmp_path):
    from genoloom.streaming import variants_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(open(small).read())
    q = variants_stream(spark, str(tmp_path / "in")).where("depth > 95").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 3


def test_records_without_call_can_be_written(spark, small, tmp_path):
    """No CALL gives no records, but a frame with the format's columns, which files can hold."""
    found = engine.run(spark, f'FROM vcf "{small}"').df
    found.write.parquet(f"{tmp_path}/none")
    back = spark.read.parquet(f"{tmp_path}/none")
    assert back.columns == engine.run(spark, f'FROM vcf "{small}" CALL variants').df.columns and back.count() == 0
    assert rows(spark, f'FROM vcf "{small}" WHERE pos > 100 SELECT pos, af') == []


def test_array_in_a_store_is_written_by_tasks(spark, tmp_path, monkeypatch):
    """The same array as row by row, none of it through the driver's iterator, and read back whole."""
    from genoloom import queries, sinks
    from genoloom.plans.lower import Planned

    odd = [(i, name, x) for i, (name, x) in enumerate([("a", 1.5), ('},{"id":', 0.0), ('"},{"id":"', None), ("[", float("nan")), ("}]", float("inf")), ("é\n", -2.0), (None, 3.25)] * 30)]
    frame = spark.createDataFrame(odd, "id long, name string, x double").repartitionByRange(7, "id").sortWithinPartitions("id")
    planned = Planned(frame, "row", ["id", "name", "x"], True)
    sinks.write(planned, "fasta", f"{tmp_path}/one.json")
    want = json.load(open(f"{tmp_path}/one.json"))
    monkeypatch.setattr(sinks, "rows", None)
    assert sinks.write(planned, "fasta", f"file://{tmp_path}/many.json").startswith("wrote 210 record(s)")
    assert json.load(open(f"{tmp_path}/many.json")) == want and open(f"{tmp_path}/many.json").read().count("\n") == 1
    back = queries.array_rows(spark, f"{tmp_path}/many.json", "id", "id long, name string, x double").orderBy("id").collect()
    assert [r.asDict() for r in back] == want
    sinks.write(Planned(frame.limit(0), "row", ["id"], True), "fasta", f"file://{tmp_path}/none.json")
    assert open(f"{tmp_path}/none.json").read() == "[]\n"
    assert queries.array_rows(spark, f"{tmp_path}/none.json", "id", "id long").count() == 0
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["many.json", "none.json", "one.json"]
