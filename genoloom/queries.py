"""Queries over the driver's tables, one for each operator, with the same result as SQL.

The tables hold no genomes, so views make records of them; each view is written
once for Spark and once for DuckDB. Queries of readers and writers put files of
such records into the shared folder, in the formats' own text, and read them
back with the engine.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom import sinks

from genoloom.lang.analyzer import analyze
from genoloom.lang.parser import parse
from genoloom.operators import annotate as ann
from genoloom.operators import coverage as cov
from genoloom.operators import shards as cuts
from genoloom.operators.ranges import point_join
from genoloom.operators.reads import depth_at_start
from genoloom.operators.setops import isec
from genoloom.operators.split import trimmed
from genoloom.operators.variants import Options, call_variants, indel_events, walk
from genoloom.plans.lower import Planned, plan
from genoloom.sources import bam as bam_source
from genoloom.sources import text as text_source

VARIANTS = """SELECT l_returnflag AS chrom, l_orderkey * 8 + l_linenumber AS pos, '.' AS id,
  substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS ref,
  substr('ACGT', CAST((l_partkey % 4 + 1 + l_suppkey % 3) % 4 AS INT) + 1, 1) AS alt,
  l_quantity AS qual, CASE WHEN l_linestatus = 'O' THEN 'PASS' ELSE 'LowQual' END AS filter,
  CAST(l_quantity AS BIGINT) AS depth, l_discount * 5 AS allele_freq, CAST(0 AS BIGINT) AS ref_count, CAST(l_linenumber AS BIGINT) AS alt_count,
  l_tax AS strand_bias, 'SNV' AS kind, l_linenumber AS ln FROM lineitem"""
READS = "SELECT event_type AS chrom, event_id AS pos, 20 + user_id % 50 AS len FROM events"
GENES = "SELECT 'g' AS chrom, s_suppkey * 600 AS start, s_suppkey * 600 + 900 AS \"end\", s_name AS name, s_suppkey AS ordinal FROM supplier"
POINTS = "SELECT DISTINCT 'g' AS chrom, o_orderkey AS pos FROM orders"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace('"end"', "`end`").replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf, name))


def variants(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, VARIANTS, "lineitem").withColumn("_seq", F.struct("chrom", "pos"))


def over(clauses: str, variables: dict | None = None):
    """A query of the language over the variant view."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = parse(f'FROM vcf "lineitem" CALL variants {clauses}')
        analyze(q)
        p = plan(spark, q, variables, variants(spark, sf))
        return p.df.select(*p.columns)

    return run


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = variants(spark, sf)
    shifted = F.when(F.col("ln") == 4, F.translate("alt", "ACGT", "CGTA")).otherwise(F.col("alt"))
    return v.where("ln <= 4"), v.where("ln >= 3").withColumn("alt", shifted)


SIDES = f"""WITH v AS ({VARIANTS}), a AS (SELECT * FROM v WHERE ln <= 4),
b AS (SELECT * REPLACE (CASE WHEN ln = 4 THEN translate(alt, 'ACGT', 'CGTA') ELSE alt END AS alt) FROM v WHERE ln >= 3)
"""
SAME = "(SELECT 1 FROM {o} o WHERE o.chrom = {s}.chrom AND o.pos = {s}.pos AND o.ref = {s}.ref AND o.alt = {s}.alt)"
KEYS = "chrom, pos, ref, alt, depth"


def pair(mode: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return isec(*sides(spark, sf), mode).select("chrom", "pos", "ref", "alt", "depth")

    return run


def pair_sql(mode: str) -> str:
    a_not, b_not = (f"SELECT {KEYS} FROM {s} WHERE NOT EXISTS {SAME.format(o=o, s=s)}" for s, o in (("a", "b"), ("b", "a")))
    return SIDES + {
        "private_a": a_not, "private_b": b_not, "union": f"SELECT {KEYS} FROM a UNION ALL {b_not}",
        "shared": f"SELECT {KEYS} FROM a WHERE EXISTS {SAME.format(o='b', s='a')}", "shared_b": f"SELECT {KEYS} FROM b WHERE EXISTS {SAME.format(o='a', s='b')}"}[mode]


def gene_points(spark, sf):
    return view(spark, sf, POINTS, "orders"), view(spark, sf, GENES, "supplier")


def annotate_gene(spark, sf):
    points, genes = gene_points(spark, sf)
    return points.join(ann.first_gene(points, genes), ["chrom", "pos"], "left").select("pos", F.coalesce("gene", F.lit(".")).alias("gene"))


def range_pairs(spark, sf):
    points, genes = gene_points(spark, sf)
    return point_join(points, genes).select("pos", "name")


def annotate_exon(spark, sf):
    points, genes = gene_points(spark, sf)
    s = F.col("ordinal")
    exons = genes.select("chrom", "start", "end", F.concat(F.lit("t"), (s % 7).cast("string")).alias("transcript"), s.cast("string").alias("rank"), "name", s.alias("ordinal")).withColumnRenamed("name", "exon_id")
    transcripts = spark.range(7).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("transcript"), (F.col("id") * 37 % 5).alias("span"), (F.col("id") % 3 == 0).alias("has_ccds"))
    return ann.best_exon(points, exons, transcripts).select("pos", "transcript", "exon", "exon_id")


def annotate_clinical(spark, sf):
    v = variants(spark, sf)
    known = v.where("pos % 5 = 0").select("chrom", "pos", "ref", "alt", F.lit("Pathogenic").alias("clinvar_significance"), F.lit(None).cast("string").alias("clinvar_oncogenic"), F.lit("missense_variant").alias("consequence"), F.col("pos").cast("string").alias("clinvar_id"), F.lit(None).cast("string").alias("rsid")).dropDuplicates(["chrom", "pos", "ref", "alt"])
    return ann.annotate(v, None, known, None).select("chrom", "pos", "ref", "alt", "clinvar_significance", "clinvar_id", "rsid", "gene")


def cds_offsets(spark, sf):
    s = view(spark, sf, "SELECT s_suppkey AS k, s_nationkey AS n FROM supplier", "supplier")
    cds = s.select(F.col("n").cast("string").alias("transcript"), F.lit("g").alias("chrom"), (F.col("k") * 100).alias("start"), (F.col("k") * 100 + F.col("k") % 60).alias("end"), F.when(F.col("n") % 2 == 0, "+").otherwise("-").alias("strand"))
    return ann.cds_offsets(cds).select("transcript", "start", F.col("before").cast("long"))


def split_alleles(spark, sf):
    p = view(spark, sf, "SELECT p_partkey AS k, p_size AS n FROM part", "part")
    k = F.col("k").cast("int")
    dna = lambda x, n: F.substr(F.lit("ACGTTGCAACCGGTTAACGT"), x % 8 + 1, n)
    rows = p.select(F.col("k").alias("k"), (F.col("k") * 50).alias("pos"), dna(k, k % 4 + 1).alias("ref"), F.array(dna(k, k % 5 + 1), F.concat(dna(k, F.lit(1)), dna(k + 3, k % 3 + 1)), dna(k + 1, F.lit(1))).alias("alts"))
    each = rows.select("k", "pos", "ref", F.posexplode("alts").alias("n", "alt"))
    return trimmed(each).select("k", "n", F.col("pos").cast("long"), "ref", "alt")


def reads_depth(spark, sf):
    return depth_at_start(view(spark, sf, READS, "events")).select("chrom", "pos", "len", F.col("depth").cast("long"))


def windows(spark, sf, width: int) -> DataFrame:
    return cov.coverage_windows(view(spark, sf, READS, "events"), width)


def coverage(spark, sf):
    return windows(spark, sf, 1000).select("chrom", "start", "end", "coverage", "normalized", "masked")


def cnv(spark, sf):
    return cov.segments(cov.by_threshold(windows(spark, sf, 40), 1.15, 0.85), 3).select("chrom", "start", "end", "length", "type", "num_windows", F.round("avg_coverage", 6).alias("avg_coverage"), F.round("copy_number", 6).alias("copy_number"))


def region_coverage(spark, sf):
    from genoloom.plans.lower import Region, within

    reads = within(view(spark, sf, READS, "events"), Region("click", 2000, 6000))
    return cov.coverage_windows(reads, 500).select("chrom", "start", "coverage", "normalized")


def shards(spark, sf):
    """Shared variants found shard by shard, in the shards that equal work gives, and merged."""
    a, b = sides(spark, sf)
    last = a.agg(F.max("pos")).first()[0] or 1
    out = []
    for chrom in ("A", "N", "R"):
        spans = cuts.split_by_density(a, chrom, 1, last, 5)
        out.append(cuts.shard_and_merge(a, chrom, spans, lambda part: isec(part, b, "shared")).select("chrom", "pos", "ref", "alt", "depth"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def folder(spark) -> str:
    """A new folder for a query's files, where all machines see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/genoloom/files-{uuid.uuid4().hex}"


def records(spark, sf, order=("pos", "chrom")) -> Planned:
    """All variants as the engine plans them."""
    q = parse('FROM vcf "lineitem" CALL variants')
    return plan(spark, q, None, variants(spark, sf).withColumn("_seq", F.struct(*order)))


def written(fmt: str, clauses: str = ""):
    """The lines, header lines apart, of variants written by the engine's parallel writer."""
    def run(spark, sf):
        q = parse(f'FROM vcf "lineitem" CALL variants {clauses} INTO {fmt} "out"')
        analyze(q)
        path = folder(spark)
        sinks.directory(plan(spark, q, None, variants(spark, sf)), fmt, path)
        return spark.read.text(path).where(~F.startswith("value", F.lit("#"))).withColumnRenamed("value", "line")

    return run


def sink_vcf(spark, sf):
    path = folder(spark)
    sinks.directory(records(spark, sf), "vcf", path)
    return text_source.vcf(spark, path).select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "depth", "allele_freq", "kind")


def sink_vcf_header(spark, sf):
    """Contigs in the order of their first records, from the written header."""
    path = folder(spark)
    sinks.directory(records(spark, sf), "vcf", path)
    head = text_source.vcf_contigs(spark, path).orderBy("_seq").collect()
    return spark.createDataFrame([(i + 1, r["name"]) for i, r in enumerate(head)], "place long, chrom string")


def sink_bed_windows(spark, sf):
    path = folder(spark)
    found = windows(spark, sf, 1000).withColumn("_seq", F.struct("chrom", "start"))
    sinks.directory(Planned(found, "window", ["chrom", "start", "end", "coverage", "normalized"], False), "bed", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def sink_json(spark, sf):
    path = folder(spark)
    sinks.directory(records(spark, sf), "json", path)
    return spark.read.schema("chrom string, pos long, ref string, alt string, qual double, type string, depth long, alt_count long, filter string").json(path)


def sink_tsv(spark, sf):
    path = folder(spark)
    sinks.directory(records(spark, sf), "tsv", path)
    found = spark.read.csv(path, sep="\t", header=True)
    return found.select("chrom", F.col("pos").cast("long"), "ref", "alt", F.col("qual").cast("double"), "type", F.col("allele_freq").cast("double"))


def sink_array(spark, sf):
    """One file with a JSON array."""
    path = folder(spark) + ".json"
    sinks.write(records(spark, sf), "fasta", path if "://" in path else "file://" + path)
    return array_rows(spark, path, "chrom", "chrom string, pos long, ref string, alt string, depth long")


def array_rows(spark, path: str, first: str, schema: str) -> DataFrame:
    """The objects of a JSON array of flat objects that begin with the key ``first``; a file is read by many tasks.

    Rows are cut at ``},{"first":``, which no text can hold: inside one a quote
    is escaped, and the quote that ends one isn't followed by a letter.
    """
    key = f'{{"{first}":'
    value = F.col("value")
    rows = spark.read.text(path, lineSep="}," + key).where(value != "[]\n")
    begun = F.when(F.startswith(value, F.lit("[" + key)), F.substr(value, F.lit(2))).otherwise(F.concat(F.lit(key), value))
    ended = F.when(F.endswith(begun, F.lit("}]\n")), F.substr(begun, F.lit(1), F.char_length(begun) - 2)).otherwise(F.concat(begun, F.lit("}")))
    return rows.select(F.from_json(ended, schema).alias("r")).select("r.*")


def paired(mode: str):
    """The PAIRED clause on two files."""
    def run(spark, sf):
        base = folder(spark)
        for name, side in zip("ab", sides(spark, sf)):
            sinks.directory(Planned(side, "variant", ["chrom"], False), "vcf", f"{base}/{name}")
        q = parse(f'FROM vcf "{base}/a" PAIRED WITH vcf "{base}/b" MODE {mode} CALL variants SELECT chrom, pos, ref, alt, depth')
        analyze(q)
        p = plan(spark, q)
        return p.df.select(*p.columns)

    return run


def from_file(clauses: str):
    """A query of the language over a VCF file of the variants."""
    def run(spark, sf):
        path = folder(spark)
        sinks.directory(records(spark, sf), "vcf", path)
        q = parse(f'FROM vcf "{path}" {clauses}')
        analyze(q)
        p = plan(spark, q)
        return p.df.select(*p.columns)

    return run


def put_lines(spark, rows: DataFrame, order: list[str]) -> str:
    """A file of the column ``line``, one part, as order counts in these formats."""
    path = folder(spark)
    rows.repartition(1).sortWithinPartitions(*order).select("line").write.text(path)
    return path


GFF = """SELECT s_suppkey AS k, 0 AS n, concat_ws('\t', 'g', 'x', 'gene', CAST(s_suppkey * 600 AS STRING), CAST(s_suppkey * 600 + 900 AS STRING), '.', '+', '.', concat('ID=gene:G', s_suppkey, ';Name=', s_name)) AS line FROM supplier
UNION ALL SELECT s_suppkey, 1, concat_ws('\t', 'g', 'x', 'mRNA', CAST(s_suppkey * 600 AS STRING), CAST(s_suppkey * 600 + 500 + s_nationkey AS STRING), '.', '+', '.', concat('ID=transcript:T', s_suppkey, ';Parent=gene:G', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ';ccdsid=C1' ELSE '' END, ';transcript_id=T', s_suppkey)) FROM supplier
UNION ALL SELECT s_suppkey, 2, concat_ws('\t', 'g', 'x', 'exon', CAST(s_suppkey * 600 + 50 AS STRING), CAST(s_suppkey * 600 + 200 AS STRING), '.', '+', '.', concat('Parent=transcript:T', s_suppkey, ';Name=E', s_suppkey, ';rank=', s_nationkey)) FROM supplier
UNION ALL SELECT s_suppkey, 3, concat_ws('\t', 'g', 'x', 'CDS', CAST(s_suppkey * 600 + 60 AS STRING), CAST(s_suppkey * 600 + 190 AS STRING), '.', CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END, CAST(s_suppkey % 3 AS STRING), concat('ID=CDS:P', s_suppkey, ';Parent=transcript:T', s_suppkey)) FROM supplier
UNION ALL SELECT 0, 0, '##gff-version 3'"""


def gff_of(part: str, *columns: str):
    def run(spark, sf):
        rows = spark.sql(GFF.replace("FROM supplier", "FROM {t}"), t=table(spark, sf, "supplier"))
        return text_source.gff(spark, put_lines(spark, rows, ["k", "n"]))[part].select(*columns)

    return run


CLINICAL = """SELECT p_partkey AS k, concat_ws('\t', 'g', CAST(p_partkey % 500 AS STRING), concat('V', p_partkey), 'A', concat('C', CASE WHEN p_size % 2 = 0 THEN ',G' ELSE '' END), '.', '.',
  concat('CLNSIG=', p_brand, CASE WHEN p_size % 3 = 0 THEN ';ONC=Oncogenic' ELSE '' END, ';MC=SO:1|', p_size, '_variant', ';RS=', p_partkey)) AS line FROM part"""


def read_clinvar(spark, sf):
    rows = spark.sql(CLINICAL.replace("FROM part", "FROM {t}"), t=table(spark, sf, "part"))
    return text_source.clinvar(spark, put_lines(spark, rows, ["k"]))


def read_fasta(spark, sf):
    """Sequences of all documents, 60 bases a line, placed by the reader."""
    seqs = sequences(spark, sf).where("doc_id is not null")
    body = seqs.select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0))).alias("n", "line"))
    rows = body.unionByName(seqs.select("doc_id", F.lit(-1).alias("n"), F.concat(F.lit(">d"), "doc_id", F.lit(":101-9999999 text")).alias("line")))
    found = text_source.fasta(spark, put_lines(spark, rows, ["doc_id", "n"]))
    return found.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("seq")).alias("bases"), F.min("offset").alias("first"), F.sum("offset").alias("places"))


def read_vcf_split(spark, sf):
    """A VCF with several alleles a row, split by the engine."""
    rows = spark.sql("SELECT p_partkey AS k, concat_ws('\t', 'g', CAST(p_partkey * 10 AS STRING), '.', 'AC', concat('AG,TC,A', CASE WHEN p_size % 2 = 0 THEN ',ACT' ELSE '' END), '.', '.', concat('DP=', p_size, ';AF=0.5,0.25,0.125')) AS line FROM {t}", t=table(spark, sf, "part"))
    return text_source.vcf(spark, put_lines(spark, rows, ["k"]), True).select("pos", "ref", "alt", "depth", "allele_freq", "kind", "filter", "qual")


BASES_AT = "substr('ACGTTGCAAC', CAST(({p}) * 7 % 10 + 1 AS INT), 1)"
ALIGNED = """SELECT event_id AS e, 'p' AS chrom, 1 + event_id % 300 AS pos, 10 + event_id % 40 AS mapq, CASE WHEN user_id % 3 = 0 THEN 16 WHEN user_id % 11 = 0 THEN 1024 ELSE 0 END AS flag FROM events"""


def alignments(spark, sf) -> DataFrame:
    """Reads of 12 bases that differ from a periodic reference in some places."""
    reads = view(spark, sf, ALIGNED, "events")
    at = lambda k: F.col("pos") + k
    shown = lambda k: F.when((F.col("e") % 4 == 0) & (at(k) % 7 == 0), (at(k) * 7 + 1) % 10).otherwise(at(k) * 7 % 10)
    seq = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.substr(F.lit("ACGTTGCAAC"), (shown(k) + 1).cast("int"), F.lit(1))), "")
    cigar = F.array(F.struct(F.lit("M").alias("op"), F.lit(12).alias("len")))
    return reads.select("chrom", "pos", F.col("mapq").cast("long"), F.col("flag").cast("long"), seq.alias("seq"), F.unhex(F.repeat(F.lit("1E"), F.lit(12))).alias("qual"), cigar.alias("cigar"), F.col("e").alias("_seq"))


def reference(spark, last: int) -> DataFrame:
    """The periodic reference, 50 bases a row."""
    bases = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.substr(F.lit("ACGTTGCAAC"), ((F.col("id") * 50 + k) * 7 % 10 + 1).cast("int"), F.lit(1))), "")
    return spark.range(-(-last // 50)).select(F.lit("p").alias("contig"), (F.col("id") * 50).alias("offset"), bases.alias("seq"))


def pileup(spark, sf):
    found = call_variants(alignments(spark, sf), reference(spark, 400), Options(min_allele_freq=0.01))
    return found.select("chrom", "pos", "ref", "alt", "depth", "ref_count", "alt_count", F.round("allele_freq", 9).alias("allele_freq"), F.round("strand_bias", 9).alias("strand_bias"), "kind")


def cigar_walk(spark, sf):
    """Insertions and deletions of five alignments at every place of an event."""
    texts = ["4M2I4M", "8M3D9M", "5S20M1I4M", "5=10N5X", "2I10M"]
    steps = [[(int(n), op) for n, op in re.findall(r"(\d+)(\D)", t)] for t in texts]
    lists = [F.array(*[F.struct(F.lit(op).alias("op"), F.lit(n).alias("len")) for n, op in s]) for s in steps]
    reads = table(spark, sf, "events").select(F.col("event_type").alias("chrom"), (F.col("event_id") + 100).alias("pos"), (F.col("event_id") % 5).alias("n"), F.lit(0).alias("flag"), F.lit("ACGTCCACGTACGTACGTACGTACGTTACGT").alias("seq"))
    cigar = lists[4]
    for i in range(4):
        cigar = F.when(F.col("n") == i, lists[i]).otherwise(cigar)
    return indel_events(walk(reads.withColumn("cigar", cigar))).select("chrom", "pos", "op", "len", "text")


def coding(spark, sf):
    """Changes of every base of one-segment genes on either strand of the periodic reference."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    cds = s.select(F.concat(F.lit("T"), "k").alias("transcript"), F.lit("p").alias("chrom"), (F.col("k") * 100 + 1).alias("start"), (F.col("k") * 100 + 60).alias("end"), F.when(F.col("k") % 2 == 0, "+").otherwise("-").alias("strand"))
    spots = s.select("k", F.explode(F.sequence(F.col("k") * 100 + 1, F.col("k") * 100 + 60)).alias("pos"))
    base = F.substr(F.lit("ACGTTGCAAC"), (F.col("pos") * 7 % 10 + 1).cast("int"), F.lit(1))
    snvs = spots.select(F.lit("p").alias("chrom"), "pos", base.alias("ref"), F.translate(base, "ACGT", "CGTA").alias("alt"), F.concat(F.lit("T"), "k").alias("transcript"))
    last = s.agg(F.max("k")).first()[0] or 0
    return ann.coding_changes(snvs, cds, reference(spark, last * 100 + 200)).select("pos", "ref", "alt", "transcript", "aa_change", "hgvs_c")


def bam_file(spark, sf) -> str:
    """A BAM of all events, in order of contig and place."""
    rows = view(spark, sf, READS, "events").withColumn("flag", F.when(F.col("pos") % 7 == 0, 16).otherwise(0)).orderBy("chrom", "pos")
    names = sorted(r.chrom for r in rows.select("chrom").distinct().collect())
    raw = bam_source.bam_bytes([(n, 1 << 28) for n in names], ((r.chrom, r.pos, 20 + r.pos % 40, r.flag, "ACGT" * (r.len // 4) + "ACGT"[: r.len % 4], bytes([30]) * r.len, f"{r.len}M") for r in rows.toLocalIterator()))
    path = folder(spark) + "/reads.bam"
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
    return path


def over_bam(clauses: str):
    """A query of the language over that BAM."""
    def run(spark, sf):
        q = parse(f'FROM bam "{bam_file(spark, sf)}" {clauses}')
        analyze(q)
        p = plan(spark, q)
        return p.df.select(*p.columns)

    return run


def adaptive_cnv(spark, sf):
    return cov.call_cnv(windows(spark, sf, 15)).select("chrom", "start", "end", "length", "type", "num_windows", F.round("copy_number", 6).alias("copy_number"))


def binary_cnv(spark, sf):
    return cov.call_cnv(windows(spark, sf, 15), method="cbs").select("chrom", "start", "end", "type", "num_windows")


def sequences(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def over_sequences(select: str):
    def run(spark, sf):
        from genoloom.functions.lower import Scope, lower
        from genoloom.functions.values import when_ok

        q = parse(f'FROM table "x" SELECT {select}')
        analyze(q)
        df = sequences(spark, sf)
        scope = Scope({"doc_id": (F.col("doc_id"), "int"), "seq": (F.col("seq"), "str")})
        return df.select(*[when_ok(lower(i.expr, scope)).alias(i.alias or i.expr.name) for i in q.select])

    return run


SEQ = "SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents"
WINDOWS = """r AS ({reads}), c AS (SELECT chrom, CAST(floor((pos - 1) / {w}) AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY 1, 2),
s AS (SELECT chrom, unnest(range(min(bin), max(bin) + 1)) AS bin FROM c GROUP BY chrom), m AS (SELECT median(n) AS m FROM c),
w AS (SELECT s.chrom, CAST(s.bin * {w} AS BIGINT) AS start, CAST((s.bin + 1) * {w} AS BIGINT) AS "end", CAST(coalesce(c.n, 0) AS BIGINT) AS coverage,
  CAST(coalesce(c.n, 0) AS DOUBLE) / (SELECT m FROM m) AS normalized, false AS masked FROM s LEFT JOIN c ON s.chrom = c.chrom AND s.bin = c.bin)"""
FOUND = f"WITH p AS ({POINTS}), g AS ({GENES})"


def queries() -> dict:
    out = {
        "flagship": over('WHERE af >= 0.2 AND filter = "PASS" SELECT chrom, pos, ref, alt, af ORDER BY pos LIMIT 100'),
        "where_and": over('WHERE af >= 0.2 AND filter = "PASS" SELECT chrom, pos, ref, alt'),
        "where_or_not": over('WHERE NOT qual > 10.0 OR chrom = "R" AND depth < 20 SELECT chrom, pos, depth'),
        "where_error_drops": over("WHERE 10 / (depth - 25) >= 1 SELECT chrom, pos, depth"),
        "where_text_order_drops": over('WHERE ref < "C" OR NOT (alt > "C") OR chrom = 7 SELECT chrom, pos'),
        "where_truthy": over("WHERE af AND depth - 30 SELECT chrom, pos, depth, af"),
        "select_arithmetic": over("SELECT chrom, pos, depth * 2 + 1 AS twice, depth / 7 AS seventh, -depth AS minus, qual / 4 AS quarter, concat(depth / (depth - 25)) AS maybe"),
        "select_star": over("WHERE depth = 7 SELECT *, depth"),
        "select_names": over("SELECT chrom, pos, upper(kind), floor(qual), depth + 1, gene"),
        "select_compare": over('SELECT chrom, pos, depth = qual AS same, filter != "PASS" AS other, missing = absent AS both_null, chrom = 7 AS crossed'),
        "order_limit": over("SELECT chrom, pos, depth, af ORDER BY af DESC, depth, pos LIMIT 7"),
        "order_alias": over("SELECT chrom, pos, qual * af AS score ORDER BY score DESC, pos, chrom LIMIT 25"),
        "limit_negative": over("WHERE depth = 3 SELECT chrom, pos LIMIT -1"),
        "limit_variable": over("SELECT chrom, pos ORDER BY pos, chrom LIMIT $n", {"n": 12}),
        "variables": over("WHERE depth >= $least AND chrom = $which SELECT chrom, pos, $least AS least", {"least": 40, "which": "N"}),
        "functions_numeric": over("SELECT chrom, pos, abs(depth - 25) AS a, floor(qual * 0.3) AS f, ceil(qual * 0.3) AS c, round(qual / 4) AS r, min(depth, 9) AS lo, max(depth, 9, 30) AS hi, pow(depth, 2) AS p, sqrt(qual) AS s"),
        "functions_rounding": over("SELECT chrom, pos, round(af, 1) AS r1, round(-qual / 2) AS half, round(log(depth), 6) AS ln0, round(log(qual, 2), 6) AS l2, coalesce(nothing, depth) AS co"),
        "functions_text": over('SELECT chrom, pos, len(filter) AS n, lower(filter) AS low, concat(chrom, ":", pos, nothing) AS spot, contains(filter, "Low") AS has, starts_with(filter, "P") AS st, ends_with(filter, "l") AS en, substr(filter, 1, 2) AS sub'),
        "functions_gc": over_sequences("doc_id, gc(seq) AS gc, len(seq) AS n"),
        "functions_revcomp": over_sequences("doc_id, revcomp(seq) AS rc"),
        "functions_codon": over_sequences("doc_id, codon_at(seq, 3) AS codon, substr(seq, 2, 5) AS part"),
        "functions_translate": over_sequences("doc_id, translate(seq) AS protein, translate(seq, 1) AS shifted"),
        "functions_mixed": over('SELECT chrom, pos, concat(alt_count - 3 AND chrom) AS both, concat(depth - 7 OR filter) AS either, concat(coalesce(nothing, alt_count, chrom), "/", coalesce(nothing, chrom, depth)) AS first, concat(qual * 100000000000000000000.0, " ", qual / 8) AS written, abs(0 - depth) AS size'),
        "sink_vcf": sink_vcf, "sink_vcf_header": sink_vcf_header, "sink_vcf_projected": written("vcf", "WHERE depth > 30 SELECT alt, pos, af, depth, upper(kind) AS what, chrom, ref"),
        "sink_bed": written("bed"), "sink_bed_projected": written("bed", "SELECT chrom, pos, alt, qual, af"), "sink_bed_windows": sink_bed_windows, "sink_json": sink_json, "sink_tsv": sink_tsv, "sink_array": sink_array,
        "read_vcf": from_file('CALL variants WHERE af >= 0.2 AND filter = "PASS" SELECT chrom, pos, ref, alt, af, id, kind'), "read_vcf_region": from_file('CALL variants WHERE chrom = "A" AND pos >= 2000 AND pos <= 30000 SELECT chrom, pos, ref, alt'),
        "read_vcf_without_call": from_file(""), "read_vcf_split": read_vcf_split,
        "read_gff_genes": gff_of("genes", "chrom", "start", "end", "name"), "read_gff_transcripts": gff_of("transcripts", "transcript", "span", "has_ccds"), "read_gff_exons": gff_of("exons", "chrom", "start", "end", "transcript", "rank", "exon_id"),
        "read_gff_cds": gff_of("cds", "transcript", "chrom", "start", "end", "strand", "phase"), "read_clinvar": read_clinvar, "read_fasta": read_fasta,
        "read_bam": over_bam("CALL reads SELECT chrom, pos, mapq, flag, depth, strand, is_reverse"), "read_bam_region": over_bam('CALL reads WHERE chrom = "click" AND pos >= 1000 AND pos <= 4000 SELECT chrom, pos, depth'),
        "read_bam_header": over_bam("CALL header"), "read_bam_coverage": over_bam("CALL coverage WITH window_size = 1000"),
        "pileup": pileup, "cigar_walk": cigar_walk, "hgvs": coding, "cnv_adaptive": adaptive_cnv, "cnv_binary": binary_cnv,
        "annotate_gene": annotate_gene, "range_join": range_pairs, "annotate_exon": annotate_exon, "annotate_clinical": annotate_clinical, "cds_offsets": cds_offsets,
        "split_alleles": split_alleles, "reads_depth": reads_depth, "coverage": coverage, "cnv_segments": cnv, "coverage_region": region_coverage, "shards_merge": shards,
        "paired_somatic": paired("somatic"), "paired_germline": paired("germline"),
    }
    return out | {f"isec_{m}": pair(m) for m in ("private_a", "private_b", "shared", "shared_b", "union")}


def oracle_sql() -> dict:
    v = f"WITH v AS ({VARIANTS}) "
    amino = "'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'"
    codes = f"substr({amino}, CAST((instr('TCAG', substr(t, i, 1)) - 1) * 16 + (instr('TCAG', substr(t, i + 1, 1)) - 1) * 4 + instr('TCAG', substr(t, i + 2, 1)) AS INT), 1)"
    protein = lambda start: f"coalesce(array_to_string(list_transform(range({start}, len(t) - 1, 3), lambda i: {codes}), ''), '')"
    whole = "CAST(round({x}) AS BIGINT)"  # halves away from zero
    out = {
        "flagship": v + "SELECT chrom, pos, ref, alt, allele_freq AS af FROM v WHERE allele_freq >= 0.2 AND filter = 'PASS' ORDER BY pos, chrom LIMIT 100",
        "where_and": v + "SELECT chrom, pos, ref, alt FROM v WHERE allele_freq >= 0.2 AND filter = 'PASS'",
        "where_or_not": v + "SELECT chrom, pos, depth FROM v WHERE NOT qual > 10.0 OR (chrom = 'R' AND depth < 20)",
        "where_error_drops": v + "SELECT chrom, pos, depth FROM v WHERE depth <> 25 AND trunc(10.0 / (depth - 25)) >= 1",
        "where_text_order_drops": v + "SELECT chrom, pos FROM v WHERE false",
        "where_truthy": v + "SELECT chrom, pos, depth, allele_freq AS af FROM v WHERE allele_freq <> 0 AND depth <> 30",
        "select_arithmetic": v + "SELECT chrom, pos, depth * 2 + 1 AS twice, depth // 7 AS seventh, -depth AS minus, qual / 4 AS quarter, CASE WHEN depth <> 25 THEN CAST(CAST(trunc(depth / (depth - 25)) AS BIGINT) AS VARCHAR) END AS maybe FROM v",
        "select_star": v + "SELECT chrom, pos, ref, alt, qual, depth, allele_freq FROM v WHERE depth = 7",
        "select_names": v + "SELECT chrom, pos, upper(kind) AS upper_kind, CAST(floor(qual) AS BIGINT) AS floor_qual, depth + 1 AS col5, NULL AS gene FROM v",
        "select_compare": v + "SELECT chrom, pos, CAST(depth AS DOUBLE) = qual AS same, filter <> 'PASS' AS other, true AS both_null, false AS crossed FROM v",
        "order_limit": v + "SELECT chrom, pos, depth, allele_freq AS af FROM v ORDER BY allele_freq DESC, depth, pos, chrom LIMIT 7",
        "order_alias": v + "SELECT chrom, pos, qual * allele_freq AS score FROM v ORDER BY score DESC, pos, chrom LIMIT 25",
        "limit_negative": v + "SELECT chrom, pos FROM v WHERE depth = 3",
        "limit_variable": v + "SELECT chrom, pos FROM v ORDER BY pos, chrom LIMIT 12",
        "variables": v + "SELECT chrom, pos, CAST(40 AS BIGINT) AS least FROM v WHERE depth >= 40 AND chrom = 'N'",
        "functions_numeric": v + f"SELECT chrom, pos, abs(depth - 25) AS a, CAST(floor(qual * 0.3::DOUBLE) AS BIGINT) AS f, CAST(ceil(qual * 0.3::DOUBLE) AS BIGINT) AS c, {whole.format(x='qual / 4')} AS r, least(depth, 9) AS lo, greatest(depth, 9, 30) AS hi, pow(depth, 2) AS p, sqrt(qual) AS s FROM v",
        "functions_rounding": v + f"SELECT chrom, pos, floor(allele_freq * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS r1, {whole.format(x='-qual / 2')} AS half, floor(ln(depth) * 1000000 + 0.5) / 1000000 AS ln0, floor(ln(qual) / ln(2) * 1000000 + 0.5) / 1000000 AS l2, depth AS co FROM v",
        "functions_text": v + "SELECT chrom, pos, length(filter) AS n, lower(filter) AS low, chrom || ':' || pos AS spot, contains(filter, 'Low') AS has, starts_with(filter, 'P') AS st, ends_with(filter, 'l') AS en, substr(filter, 2, 2) AS sub FROM v",
        "functions_gc": f"WITH q AS ({SEQ}) SELECT doc_id, CASE WHEN length(seq) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq) END AS gc, length(seq) AS n FROM q",
        "functions_revcomp": f"WITH q AS ({SEQ}) SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM q",
        "functions_codon": f"WITH q AS ({SEQ}) SELECT doc_id, CASE WHEN length(seq) >= 6 THEN substr(seq, 4, 3) END AS codon, substr(seq, 3, 5) AS part FROM q",
        "functions_translate": f"WITH q AS (SELECT doc_id, seq AS t FROM ({SEQ})) SELECT doc_id, {protein(1)} AS protein, {protein(2)} AS shifted FROM q",
        "annotate_gene": FOUND + " SELECT p.pos, coalesce((SELECT arg_min(name, ordinal) FROM g WHERE start <= p.pos AND p.pos <= \"end\"), '.') AS gene FROM p",
        "range_join": FOUND + ' SELECT p.pos, g.name FROM p JOIN g ON g.start <= p.pos AND p.pos <= g."end"',
        "annotate_exon": FOUND + """ , x AS (SELECT p.pos, 't' || (ordinal % 7) AS transcript, CAST(ordinal AS VARCHAR) AS exon, name AS exon_id,
            row_number() OVER (PARTITION BY p.pos ORDER BY (ordinal % 7) % 3 <> 0, -((ordinal % 7) * 37 % 5), 't' || (ordinal % 7), ordinal) AS r
            FROM p JOIN g ON g.start <= p.pos AND p.pos <= g."end") SELECT pos, transcript, exon, exon_id FROM x WHERE r = 1""",
        "annotate_clinical": v + "SELECT chrom, pos, ref, alt, CASE WHEN pos % 5 = 0 THEN 'Pathogenic' ELSE '.' END AS clinvar_significance, CASE WHEN pos % 5 = 0 THEN CAST(pos AS VARCHAR) ELSE '.' END AS clinvar_id, '.' AS rsid, '.' AS gene FROM v",
        "cds_offsets": """SELECT CAST(s_nationkey AS VARCHAR) AS transcript, s_suppkey * 100 AS start, CAST(coalesce(sum(s_suppkey % 60 + 1) OVER (PARTITION BY s_nationkey
            ORDER BY CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey ELSE -s_suppkey END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM supplier""",
        "reads_depth": f"WITH r AS ({READS}) SELECT a.chrom, a.pos, a.len, (SELECT count(*) FROM r b WHERE b.chrom = a.chrom AND b.pos <= a.pos AND a.pos < b.pos + b.len) AS depth FROM r a",
        "coverage": f'WITH {WINDOWS.format(reads=READS, w=1000)} SELECT chrom, start, "end", coverage, normalized, masked FROM w',
        "coverage_region": "WITH " + WINDOWS.format(reads=READS + " WHERE event_type = 'click' AND event_id BETWEEN 2000 AND 6000", w=500) + " SELECT chrom, start, coverage, normalized FROM w",
        "cnv_segments": f"""WITH {WINDOWS.format(reads=READS, w=40)},
            t AS (SELECT *, CASE WHEN normalized >= 1.15 THEN 'amplification' WHEN normalized <= 0.85 THEN 'deletion' END AS state FROM w),
            l AS (SELECT *, CASE WHEN lag(state) OVER o IS NOT DISTINCT FROM state AND lag("end") OVER o = start THEN 0 ELSE 1 END AS fresh FROM t WINDOW o AS (PARTITION BY chrom ORDER BY start)),
            i AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start) AS island FROM l)
            SELECT chrom, min(start) AS start, max("end") AS "end", max("end") - min(start) AS length, state AS type, count(*) AS num_windows, round(avg(coverage), 6) AS avg_coverage, round(2 * avg(normalized), 6) AS copy_number
            FROM i WHERE state IS NOT NULL GROUP BY chrom, island, state HAVING count(*) >= 3""",
        "split_alleles": SPLIT_SQL,
        "shards_merge": pair_sql("shared"),
        "paired_somatic": pair_sql("private_a"), "paired_germline": pair_sql("shared"),
        "functions_mixed": v + """SELECT chrom, pos, CASE WHEN alt_count = 3 THEN '0' ELSE chrom END AS both, CASE WHEN depth = 7 THEN filter ELSE CAST(depth - 7 AS VARCHAR) END AS either, alt_count || '/' || chrom AS first,
            CAST(CAST(qual AS BIGINT) AS VARCHAR) || repeat('0', 20) || ' ' || regexp_replace(CAST(CAST(qual AS DECIMAL(9, 3)) / 8 AS VARCHAR), '\\.?0+$', '') AS written, depth AS size FROM v""",
        "sink_vcf": v + "SELECT chrom, pos, id, ref, alt, qual, filter, depth, CAST(printf('%.4f', allele_freq) AS DOUBLE) AS allele_freq, kind FROM v",
        "sink_vcf_header": v + "SELECT row_number() OVER (ORDER BY min(pos), chrom) AS place, chrom FROM v GROUP BY chrom",
        "sink_vcf_projected": v + f"SELECT concat_ws(chr(9), chrom, pos, '.', ref, alt, '.', 'PASS', 'af=' || {SHORT.format(x='allele_freq')} || ';depth=' || depth || ';what=SNV') AS line FROM v WHERE depth > 30",
        "sink_bed": v + "SELECT concat_ws(chr(9), chrom, pos - 1, pos, alt) AS line FROM v",
        "sink_bed_projected": v + f"SELECT concat_ws(chr(9), chrom, pos - 1, pos, alt, {SHORT.format(x='qual')}, {SHORT.format(x='allele_freq')}) AS line FROM v",
        "sink_bed_windows": f"WITH {WINDOWS.format(reads=READS, w=1000)} SELECT concat_ws(chr(9), chrom, start, \"end\", printf('%.4f', normalized)) AS line FROM w",
        "sink_json": v + "SELECT chrom, pos, ref, alt, qual, kind AS type, depth, alt_count, filter FROM v",
        "sink_tsv": v + "SELECT chrom, pos, ref, alt, qual, kind AS type, allele_freq FROM v",
        "sink_array": v + "SELECT chrom, pos, ref, alt, depth FROM v",
        "read_vcf": v + "SELECT chrom, pos, ref, alt, CAST(printf('%.4f', allele_freq) AS DOUBLE) AS af, id, kind FROM v WHERE CAST(printf('%.4f', allele_freq) AS DOUBLE) >= 0.2 AND filter = 'PASS'",
        "read_vcf_region": v + "SELECT chrom, pos, ref, alt FROM v WHERE chrom = 'A' AND pos BETWEEN 2000 AND 30000",
        "read_vcf_without_call": v + "SELECT chrom, pos, ref, alt, qual, depth, allele_freq FROM v WHERE false",
        "read_vcf_split": """WITH a AS (SELECT p_partkey * 10 AS p, p_size AS d, p_size % 2 = 0 AS more FROM part)
            SELECT p + 1 AS pos, 'C' AS ref, 'G' AS alt, CAST(d AS BIGINT) AS depth, 0.5::DOUBLE AS allele_freq, 'SNV' AS kind, 'PASS' AS filter, 0.0::DOUBLE AS qual FROM a
            UNION ALL SELECT p, 'A', 'T', d, 0.25, 'SNV', 'PASS', 0.0 FROM a UNION ALL SELECT p, 'AC', 'A', d, 0.125, 'INDEL', 'PASS', 0.0 FROM a
            UNION ALL SELECT p + 1, 'C', 'CT', d, 0.0, 'INDEL', 'PASS', 0.0 FROM a WHERE more""",
        "read_gff_genes": "SELECT 'g' AS chrom, s_suppkey * 600 AS start, s_suppkey * 600 + 900 AS \"end\", s_name AS name FROM supplier",
        "read_gff_transcripts": "SELECT 'T' || s_suppkey AS transcript, CAST(500 + s_nationkey AS BIGINT) AS span, s_suppkey % 3 = 0 AS has_ccds FROM supplier",
        "read_gff_exons": "SELECT 'g' AS chrom, s_suppkey * 600 + 50 AS start, s_suppkey * 600 + 200 AS \"end\", 'T' || s_suppkey AS transcript, CAST(s_nationkey AS VARCHAR) AS rank, 'E' || s_suppkey AS exon_id FROM supplier",
        "read_gff_cds": "SELECT 'T' || s_suppkey AS transcript, 'g' AS chrom, s_suppkey * 600 + 60 AS start, s_suppkey * 600 + 190 AS \"end\", CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(s_suppkey % 3 AS INTEGER) AS phase FROM supplier",
        "read_clinvar": """SELECT 'g' AS chrom, p_partkey % 500 AS pos, 'A' AS ref, 'C' AS alt, p_brand AS clinvar_significance, CASE WHEN p_size % 3 = 0 THEN 'Oncogenic' END AS clinvar_oncogenic,
            p_size || '_variant' AS consequence, 'V' || p_partkey AS clinvar_id, 'rs' || p_partkey AS rsid FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_partkey DESC) = 1""",
        "read_fasta": f"""WITH q AS (SELECT doc_id, length(seq) AS n FROM ({SEQ})), l AS (SELECT doc_id, n, unnest(range(0, n, 60)) AS o FROM q)
            SELECT 'd' || doc_id AS contig, count(*) AS n, CAST(sum(least(60, n - o)) AS BIGINT) AS bases, CAST(100 AS BIGINT) AS first, CAST(sum(100 + o) AS BIGINT) AS places FROM l GROUP BY doc_id""",
        "read_bam": f"WITH r AS ({READS}) SELECT a.chrom, a.pos, 20 + a.pos % 40 AS mapq, CAST(CASE WHEN a.pos % 7 = 0 THEN 16 ELSE 0 END AS BIGINT) AS flag, (SELECT count(*) FROM r b WHERE b.chrom = a.chrom AND b.pos <= a.pos AND a.pos < b.pos + b.len) AS depth, CASE WHEN a.pos % 7 = 0 THEN '-' ELSE '+' END AS strand, a.pos % 7 = 0 AS is_reverse FROM r a",
        "read_bam_region": f"WITH r AS (SELECT * FROM ({READS}) WHERE chrom = 'click' AND pos BETWEEN 1000 AND 4000) SELECT a.chrom, a.pos, (SELECT count(*) FROM r b WHERE b.pos <= a.pos AND a.pos < b.pos + b.len) AS depth FROM r a",
        "read_bam_header": f"SELECT DISTINCT chrom AS name, CAST(268435456 AS BIGINT) AS length FROM ({READS})",
        "read_bam_coverage": f'WITH {WINDOWS.format(reads=READS, w=1000)} SELECT chrom, start, "end", coverage, normalized FROM w',
        "pileup": f"""WITH a AS ({ALIGNED}), u AS (SELECT * FROM a WHERE mapq >= 20 AND flag <> 1024), x AS (SELECT e, pos + k AS p, flag, CASE WHEN e % 4 = 0 AND (pos + k) % 7 = 0 THEN substr('ACGTTGCAAC', CAST(((pos + k) * 7 + 1) % 10 + 1 AS INT), 1) ELSE {BASES_AT.format(p='pos + k')} END AS base
              FROM u, range(0, 12) t(k)), c AS (SELECT p, base, count(*) AS n, sum(CASE WHEN flag = 16 THEN 0 ELSE 1 END) AS fwd FROM x GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY p) AS depth, {BASES_AT.format(p='p')} AS ref FROM c)
            SELECT 'p' AS chrom, p AS pos, ref, base AS alt, CAST(depth AS BIGINT) AS depth, CAST(coalesce((SELECT n FROM c WHERE c.p = d.p AND c.base = d.ref), 0) AS BIGINT) AS ref_count, n AS alt_count, round(n / depth, 9) AS allele_freq, round(abs(fwd / n - 0.5) * 2, 9) AS strand_bias, 'SNV' AS kind
            FROM d WHERE base <> ref AND depth >= 10 AND n >= 3 AND n / depth >= 0.01""",
        "cigar_walk": """SELECT event_type AS chrom, event_id + 100 + CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 19 END AS pos, CASE event_id % 5 WHEN 1 THEN 'D' ELSE 'I' END AS op,
            CAST(CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS len, CASE event_id % 5 WHEN 0 THEN 'CC' WHEN 2 THEN 'T' END AS text FROM events WHERE event_id % 5 < 3""",
        "hgvs": f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 2 = 1 AS back, s_suppkey * 100 + 1 AS a, s_suppkey * 100 + 60 AS b FROM supplier), x AS (SELECT k, back, a, b, a + i AS pos, CASE WHEN back THEN b - a - i ELSE i END AS o FROM s, range(0, 60) t(i)),
            y AS (SELECT *, {BASES_AT.format(p='pos')} AS ref, CASE WHEN back THEN b - (o // 3) * 3 ELSE a + (o // 3) * 3 END AS c0, CASE WHEN back THEN -1 ELSE 1 END AS d FROM x),
            z AS (SELECT *, {BASES_AT.format(p='c0')} || {BASES_AT.format(p='c0 + d')} || {BASES_AT.format(p='c0 + 2 * d')} AS plain, translate(ref, 'ACGT', 'CGTA') AS alt FROM y),
            w AS (SELECT *, CASE WHEN back THEN translate(plain, 'ACGT', 'TGCA') ELSE plain END AS codon, CASE WHEN back THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS r1, CASE WHEN back THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS a1 FROM z),
            n AS (SELECT *, left(codon, CAST(o % 3 AS INT)) || a1 || substr(codon, CAST(o % 3 AS INT) + 2) AS changed FROM w),
            p AS (SELECT *, {THREE_LETTERS.format(c='codon', amino=amino)} AS old_aa, {THREE_LETTERS.format(c='changed', amino=amino)} AS new_aa FROM n)
            SELECT pos, ref, alt, 'T' || k AS transcript, 'p.' || old_aa || (o // 3 + 1) || CASE WHEN old_aa = new_aa THEN '=' ELSE new_aa END AS aa_change, 'c.' || (o + 1) || r1 || '>' || a1 AS hgvs_c FROM p""",
        "cnv_adaptive": f"""WITH {WINDOWS.format(reads=READS, w=15)}, k AS (SELECT median(coverage) AS m FROM w WHERE coverage > 0), l AS (SELECT CASE WHEN m < 15 THEN 1.75 WHEN m < 30 THEN 1.6 ELSE 1.5 END AS hi, CASE WHEN m < 15 THEN 0.35 WHEN m < 30 THEN 0.4 ELSE 0.5 END AS lo FROM k),
            t AS (SELECT *, CASE WHEN normalized >= (SELECT hi FROM l) THEN 'amplification' WHEN normalized <= (SELECT lo FROM l) THEN 'deletion' END AS state FROM w),
            f AS (SELECT *, CASE WHEN lag(state) OVER o IS NOT DISTINCT FROM state AND lag("end") OVER o = start THEN 0 ELSE 1 END AS fresh FROM t WINDOW o AS (PARTITION BY chrom ORDER BY start)),
            i AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start) AS island FROM f)
            SELECT chrom, min(start) AS start, max("end") AS "end", max("end") - min(start) AS length, state AS type, count(*) AS num_windows, round(2 * avg(normalized), 6) AS copy_number FROM i WHERE state IS NOT NULL GROUP BY chrom, island, state HAVING count(*) >= 3""",
    }
    return out | {f"isec_{m}": pair_sql(m) for m in ("private_a", "private_b", "shared", "shared_b", "union")}


SHORT = "CASE WHEN {x} = floor({x}) THEN printf('%.1f', {x}) ELSE rtrim(rtrim(printf('%.4f', {x}), '0'), '.') END"
THREE_LETTERS = """['Ala','Arg','Asn','Asp','Cys','Gln','Glu','Gly','His','Ile','Leu','Lys','Met','Phe','Pro','Ser','Thr','Trp','Tyr','Val','Ter'][instr('ARNDCQEGHILKMFPSTWYV*',
  substr({amino}, CAST((instr('TCAG', substr({c}, 1, 1)) - 1) * 16 + (instr('TCAG', substr({c}, 2, 1)) - 1) * 4 + instr('TCAG', substr({c}, 3, 1)) AS INT), 1))]"""
_DNA = "substr('ACGTTGCAACCGGTTAACGT', CAST(({x}) % 8 + 1 AS INT), CAST({n} AS INT))"
_ALTS = f"[{_DNA.format(x='p_partkey', n='p_partkey % 5 + 1')}, {_DNA.format(x='p_partkey', n='1')} || {_DNA.format(x='p_partkey + 3', n='p_partkey % 3 + 1')}, {_DNA.format(x='p_partkey + 1', n='1')}]"
SPLIT_SQL = f"""WITH RECURSIVE r AS (
  SELECT p_partkey AS k, {_DNA.format(x='p_partkey', n='p_partkey % 4 + 1')} AS ref, unnest({_ALTS}) AS alt, unnest([0, 1, 2]) AS n, p_partkey * 50 AS pos FROM part),
tail AS (SELECT *, 0 AS done FROM r UNION ALL
  SELECT k, left(ref, length(ref) - 1), left(alt, length(alt) - 1), n, pos, done + 1 FROM tail WHERE length(ref) > 1 AND length(alt) > 1 AND right(ref, 1) = right(alt, 1)),
cut AS (SELECT * EXCLUDE (done), 0 AS moved FROM (SELECT *, row_number() OVER (PARTITION BY k, n ORDER BY done DESC) AS last FROM tail) WHERE last = 1),
head AS (SELECT k, ref, alt, n, pos, 0 AS moved FROM cut UNION ALL
  SELECT k, substr(ref, 2), substr(alt, 2), n, pos + 1, moved + 1 FROM head WHERE length(ref) > 1 AND length(alt) > 1 AND left(ref, 1) = left(alt, 1))
SELECT k, CAST(n AS INTEGER) AS n, CAST(pos AS BIGINT) AS pos, ref, alt FROM (SELECT *, row_number() OVER (PARTITION BY k, n ORDER BY moved DESC) AS last FROM head) WHERE last = 1"""
