"""Line-based genomic formats, read with Spark's text source.

Spark unpacks by suffix. A file that is gzip or block gzip by its first bytes
but not by its suffix is unpacked here, a task a file.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GZIP = b"\x1f\x8b"
#: Bytes unpacked together.
CHUNK = 1 << 20


def packed(spark: SparkSession, path: str) -> list[str]:
    """Files under ``path`` that are gzip by their first bytes but not by their suffix."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for r in spark.read.format("binaryFile").load(path).select("path").collect():
        if not r.path.endswith(".gz"):
            file = jvm.org.apache.hadoop.fs.Path(r.path)
            stream = file.getFileSystem(conf).open(file)
            try:
                if bytes(x & 0xFF for x in (stream.read(), stream.read()) if x >= 0) == GZIP:
                    found.append(r.path)
            finally:
                stream.close()
    return found


def _unpack(batches):
    """The lines of gzip files of any number of members, a chunk at a time."""
    for batch in batches:
        for content in batch.column(0):
            raw, rest = memoryview(content.as_py()), b""
            while len(raw):
                member = zlib.decompressobj(31)
                while len(raw) and not member.eof:
                    part = raw[:CHUNK]
                    text = rest + member.decompress(part)
                    raw = raw[len(part) - len(member.unused_data) :]
                    *whole, rest = text.split(b"\n")
                    if whole:
                        yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in whole], pa.string())], names=["value"])
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array([rest.decode("utf-8", "replace")], pa.string())], names=["value"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _seq): lines in order of ``_seq`` within a file."""
    odd = packed(spark, path)
    if not odd:
        out = spark.read.text(path)
    else:
        files = spark.read.format("binaryFile").load(path)
        out = files.where(F.col("path").isin(odd)).select("content").mapInArrow(_unpack, "value string")
        others = [r.path for r in files.where(~F.col("path").isin(odd)).select("path").collect()]
        if others:
            out = spark.read.text(others).select("value").unionByName(out)
    return out.select("value", F.monotonically_increasing_id().alias("_seq"))


def info(column: Column, key: str) -> Column:
    """A key's value in ``k=v;k=v``; null where it is missing or empty."""
    found = F.regexp_extract(column, f"(?:^|;){key}=([^;]*)", 1)
    return F.when(found != "", found)


def vcf(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Variants of a VCF; with ``split``, one row per alternate allele in its shortest form."""
    from genoloom.operators.split import split_alleles

    body = lines(spark, path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    c = F.split("value", "\t")
    qual = F.coalesce(F.get(c, F.lit(5)).try_cast("double"), F.lit(0.0))
    about = F.get(c, F.lit(7))
    multi = body.select(
        F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).try_cast("long").alias("pos"), F.get(c, F.lit(2)).alias("id"), F.get(c, F.lit(3)).alias("ref"),
        F.split(F.get(c, F.lit(4)), ",").alias("alts"), qual.alias("qual"), F.get(c, F.lit(6)).alias("filter"),
        info(about, "DP").try_cast("long").alias("dp"), F.split(info(about, "AF"), ",").alias("afs"), "_seq").where(F.col("pos").isNotNull())
    return split_alleles(multi) if split else variants_of(multi)


def variants_of(multi: DataFrame) -> DataFrame:
    """The variant columns of rows with allele lists, by their first allele."""
    return variant_columns(multi.withColumn("alt", F.get("alts", F.lit(0))).withColumn("af", F.get("afs", F.lit(0)).try_cast("double")))


def variant_columns(rows: DataFrame) -> DataFrame:
    short = (F.char_length("ref") == 1) & (F.char_length("alt") == 1)
    missing = lambda name, other: F.when(F.col(name).isNull() | (F.col(name) == "."), other).otherwise(F.col(name)).alias(name)
    return rows.select(
        "chrom", "pos", missing("id", "."), "ref", "alt", "qual", missing("filter", "PASS"), F.coalesce("dp", F.lit(0)).cast("long").alias("depth"), F.coalesce("af", F.lit(0.0)).alias("allele_freq"),
        F.lit(0).cast("long").alias("ref_count"), F.lit(0).cast("long").alias("alt_count"), F.lit(0.0).alias("strand_bias"), F.when(short, "SNV").otherwise("INDEL").alias("kind"), "_seq")


def vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    head = lines(spark, path).where(F.startswith("value", F.lit("##contig=")))
    return head.select(F.regexp_extract("value", "ID=([^,>]+)", 1).alias("name"), F.regexp_extract("value", "length=([0-9]+)", 1).try_cast("long").alias("length"), "_seq")


def bed(spark: SparkSession, path: str) -> DataFrame:
    body = lines(spark, path).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    c = F.split("value", "\t")
    return body.select(F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).try_cast("long").alias("start"), F.get(c, F.lit(2)).try_cast("long").alias("end"), F.slice(c, 4, 1000).alias("rest"), "_seq")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, offset, seq): each line of sequence at its 0-based place in the contig.

    A ``contig:start-end`` header places its lines from start - 1. Lines belong
    to the last header before them and start after the lines between; both are
    sums in two steps, inside a partition and over one row per partition (and
    header), so a contig is never in one task, nor one string.
    """
    rows = lines(spark, path).withColumn("part", F.shiftright("_seq", 33))
    rows = rows.withColumn("own", F.when(F.startswith("value", F.lit(">")), F.struct(F.col("_seq").alias("at"), F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("head"))))
    inside = Window.partitionBy("part").orderBy("_seq")
    rows = rows.withColumn("last", F.last("own", ignorenulls=True).over(inside))
    ends = rows.groupBy("part").agg(F.max("own").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("own", ignorenulls=True).over(before).alias("carried"))
    body = rows.where("own is null").withColumn("seq", F.upper(F.trim("value"))).where("seq <> ''").join(carried, "part")
    body = body.withColumn("head", F.coalesce("last", "carried")).where("head is not null").select("part", "_seq", "seq", F.col("head.at").alias("at"), F.col("head.head").alias("head"))
    within = Window.partitionBy("part", "at").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = body.groupBy("part", "at").agg(F.sum(F.char_length("seq")).alias("n"))
    sums = sums.select("part", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = body.withColumn("run", F.coalesce(F.sum(F.char_length("seq")).over(within), F.lit(0))).join(sums, ["part", "at"])
    name = F.regexp_extract("head", r"^(.*?)(?::([0-9]+)-[0-9]+)?$", 1)
    start = F.coalesce(F.regexp_extract("head", r":([0-9]+)-[0-9]+$", 1).try_cast("long"), F.lit(1)) - 1
    return placed.select(name.alias("contig"), (start + F.col("base") + F.col("run")).alias("offset"), "seq")


def gff(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Genes, transcripts, exons and coding segments of a GFF3."""
    body = lines(spark, path).where(~F.startswith("value", F.lit("#")))
    c = F.split("value", "\t")
    about = F.get(c, F.lit(8))
    bare = lambda x: F.regexp_replace(x, "^[^:]*:", "")
    rows = body.where(F.size(c) >= 9).select(
        F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(2)).alias("kind"), F.get(c, F.lit(3)).try_cast("long").alias("start"), F.get(c, F.lit(4)).try_cast("long").alias("end"),
        F.get(c, F.lit(6)).alias("strand"), F.get(c, F.lit(7)).try_cast("int").alias("phase"), about.alias("about"), "_seq").where("start is not null and end is not null")
    a = F.col("about")
    parent = bare(info(a, "Parent"))
    return {
        "genes": rows.where("kind = 'gene'").select("chrom", "start", "end", F.coalesce(info(a, "Name"), bare(info(a, "ID"))).alias("name"), F.col("_seq").alias("ordinal")),
        "transcripts": rows.where("kind in ('mRNA', 'transcript')").select(F.coalesce(info(a, "transcript_id"), bare(info(a, "ID"))).alias("transcript"), (F.col("end") - F.col("start")).alias("span"), info(a, "ccdsid").isNotNull().alias("has_ccds")),
        "exons": rows.where("kind = 'exon'").select("chrom", "start", "end", parent.alias("transcript"), info(a, "rank").alias("rank"), F.coalesce(info(a, "exon_id"), info(a, "Name")).alias("exon_id"), F.col("_seq").alias("ordinal")),
        "cds": rows.where("kind = 'CDS'").select(parent.alias("transcript"), "chrom", "start", "end", "strand", "phase"),
    }


def clinvar(spark: SparkSession, path: str) -> DataFrame:
    """Clinical records by exact allele; of several for one allele the last counts."""
    body = lines(spark, path).where(~F.startswith("value", F.lit("#")))
    c = F.split("value", "\t")
    about = F.get(c, F.lit(7))
    rows = body.where(F.size(c) >= 8).select(
        F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).try_cast("long").alias("pos"), F.get(c, F.lit(3)).alias("ref"), F.get(F.split(F.get(c, F.lit(4)), ","), F.lit(0)).alias("alt"),
        F.coalesce(info(about, "CLNSIG"), info(about, "ONC")).alias("clinvar_significance"), info(about, "ONC").alias("clinvar_oncogenic"),
        F.get(F.split(info(about, "MC"), r"\|"), F.lit(1)).alias("consequence"), F.get(c, F.lit(2)).alias("clinvar_id"), F.concat(F.lit("rs"), info(about, "RS")).alias("rsid"), "_seq")
    about_cols = ["clinvar_significance", "clinvar_oncogenic", "consequence", "clinvar_id", "rsid"]
    last = rows.groupBy("chrom", "pos", "ref", "alt").agg(F.max_by(F.struct(*about_cols), "_seq").alias("r"))
    return last.select("chrom", "pos", "ref", "alt", "r.*")
