"""Variant calls from alignments by pileup.

Reads are walked along their CIGARs inside Catalyst's higher-order functions,
exploded to base and indel events, and counted per position with map-side
partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators.annotate import bases_at


@dataclass
class Options:
    min_depth: int = 10
    min_base_quality: int = 20
    min_mapping_quality: int = 20
    min_variant_reads: int = 3
    min_allele_freq: float = 0.05
    min_strand_bias: float | None = None


def walk(reads: DataFrame) -> DataFrame:
    """``reads`` with ``steps``: each CIGAR operation with the reference and read place it starts at."""
    empty = "cast(array() as array<struct<op:string,len:int,ref:bigint,read:bigint>>)"
    advance = F.expr(f"""aggregate(cigar, named_struct('ref', pos, 'read', 0L, 'out', {empty}), (s, c) -> named_struct(
        'ref', s.ref + if(c.op in ('M', '=', 'X', 'D', 'N'), c.len, 0), 'read', s.read + if(c.op in ('M', '=', 'X', 'I', 'S'), c.len, 0),
        'out', concat(s.out, array(named_struct('op', c.op, 'len', c.len, 'ref', s.ref, 'read', s.read)))), s -> s.out)""")
    return reads.withColumn("steps", advance)


def base_events(walked: DataFrame, min_quality: int) -> DataFrame:
    """(chrom, pos, base, back) for every aligned base of enough quality."""
    step = walked.select("chrom", "flag", "seq", "qual", F.explode("steps").alias("s")).where("s.op in ('M', '=', 'X')")
    each = step.select("chrom", "flag", "seq", "qual", "s", F.explode(F.sequence(F.lit(0), F.col("s.len") - 1)).alias("k"))
    at = (F.col("s.read") + F.col("k") + 1).cast("int")
    quality = F.conv(F.hex(F.substr("qual", at, F.lit(1))), 16, 10).cast("int")
    rows = each.select("chrom", (F.col("s.ref") + F.col("k")).alias("pos"), F.upper(F.substr("seq", at, F.lit(1))).alias("base"), (F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("back"), quality.alias("q"))
    return rows.where((F.col("q") >= min_quality) & F.col("base").isin("A", "C", "G", "T")).drop("q")


def indel_events(walked: DataFrame) -> DataFrame:
    """(chrom, pos, kind, text or length, back): insertions and deletions by the base before them; leading ones are dropped."""
    step = walked.select("chrom", "pos", "flag", "seq", F.explode("steps").alias("s")).where("s.op in ('I', 'D') and s.ref > pos")
    inserted = F.when(F.col("s.op") == "I", F.upper(F.substr("seq", (F.col("s.read") + 1).cast("int"), F.col("s.len"))))
    return step.select("chrom", (F.col("s.ref") - 1).alias("pos"), F.col("s.op").alias("op"), F.col("s.len").alias("len"), inserted.alias("text"), (F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("back"))


def usable(reads: DataFrame, min_mapping_quality: int) -> DataFrame:
    """Mapped primary reads that passed and aren't duplicates."""
    return reads.where((F.col("flag").bitwiseAND(F.lit(0x4 | 0x100 | 0x200 | 0x400 | 0x800)) == 0) & (F.col("mapq") >= min_mapping_quality) & F.col("chrom").isNotNull())


def call_variants(reads: DataFrame, reference: DataFrame | None, options: Options) -> DataFrame:
    """Single-base changes, and insertions and deletions where a reference is given.

    ref is the reference base, or without one the commonest base. Quality is
    -10 log10 of the chance of as many errors, 1 in 100 each, bounded by 999;
    strand_bias is twice the distance of the forward share from one half.
    """
    walked = walk(usable(reads, options.min_mapping_quality))
    counts = base_events(walked, options.min_base_quality).groupBy("chrom", "pos", "base").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("back"), 0).otherwise(1)).alias("fwd"))
    sites = counts.groupBy("chrom", "pos").agg(F.sum("n").alias("depth"), F.max_by("base", F.struct("n", F.negative(F.ascii("base")))).alias("major"), F.map_from_entries(F.collect_list(F.struct("base", F.struct("n", "fwd")))).alias("by"))
    if reference is None:
        sites = sites.withColumn("ref", F.col("major"))
    else:
        sites = bases_at(sites, reference).withColumnRenamed("base", "ref")
    entries = sites.where(F.col("depth") >= options.min_depth).select("chrom", "pos", "depth", "ref", F.coalesce(F.try_element_at("by", F.col("ref"))["n"], F.lit(0)).alias("ref_count"), F.explode(F.map_entries("by")).alias("e"))
    snvs = entries.where("e.key <> ref").select("chrom", "pos", "ref", F.col("e.key").alias("alt"), "depth", "ref_count", F.col("e.value.n").alias("alt_count"), F.col("e.value.fwd").alias("fwd"), F.lit("SNV").alias("kind"))
    out = snvs
    if reference is not None:
        events = indel_events(walked).groupBy("chrom", "pos", "op", "len", "text").agg(F.count(F.lit(1)).alias("alt_count"), F.sum(F.when(F.col("back"), 0).otherwise(1)).alias("fwd"))
        # an event's reference text: its anchor and, for a deletion, the bases after it
        ask = events.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("op") == "D", F.col("len")).otherwise(F.lit(0)))).alias("k")).withColumn("anchor", F.col("pos")).withColumn("pos", F.col("pos") + F.col("k"))
        got = bases_at(ask, reference).groupBy("chrom", "anchor", "op", "len", "text", "alt_count", "fwd").agg(F.sort_array(F.collect_list(F.struct("k", "base"))).alias("bs"))
        got = got.where(F.size("bs") == F.when(F.col("op") == "D", F.col("len") + 1).otherwise(1)).withColumn("ref", F.array_join(F.transform("bs", lambda b: b["base"]), ""))
        alleles = got.select("chrom", F.col("anchor").alias("pos"), "ref", F.when(F.col("op") == "I", F.concat("ref", "text")).otherwise(F.left("ref", F.lit(1))).alias("alt"), "alt_count", "fwd")
        depth = sites.select("chrom", "pos", "depth", F.coalesce(F.try_element_at("by", F.col("ref"))["n"], F.lit(0)).alias("ref_count"))
        indels = alleles.join(depth, ["chrom", "pos"]).where(F.col("depth") >= options.min_depth)
        out = snvs.unionByName(indels.select("chrom", "pos", "ref", "alt", "depth", "ref_count", "alt_count", "fwd", F.lit("INDEL").alias("kind")))
    af = F.col("alt_count") / F.col("depth")
    bias = F.abs(F.col("fwd") / F.col("alt_count") - 0.5) * 2
    p = F.lit(0.01)
    # Chernoff bound of a binomial tail: n * KL(af || p)
    kl = F.when(af >= 1, -F.ln(p)).otherwise(af * F.ln(af / p) + (1 - af) * F.ln((1 - af) / (1 - p)))
    qual = F.least(F.lit(999.0), F.greatest(F.lit(0.0), 10 / F.ln(F.lit(10.0)) * F.col("depth") * kl))
    rows = out.select("chrom", "pos", F.lit(".").alias("id"), "ref", "alt", qual.alias("qual"), F.lit("PASS").alias("filter"), F.col("depth").cast("long"), af.alias("allele_freq"), F.col("ref_count").cast("long"), F.col("alt_count").cast("long"), bias.alias("strand_bias"), "kind")
    rows = rows.where((F.col("alt_count") >= options.min_variant_reads) & (F.col("allele_freq") >= options.min_allele_freq))
    if options.min_strand_bias is not None:
        rows = rows.where(F.col("strand_bias") >= options.min_strand_bias)
    return rows.withColumn("_seq", F.struct("chrom", "pos", "ref", "alt"))
