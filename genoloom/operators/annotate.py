"""Gene, exon, coding-change and clinical annotation of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.sequence import amino_acid, three_letter
from genoloom.operators.ranges import point_join
from genoloom.plans.schema import ANNOTATIONS

SPOT = ["chrom", "pos"]


def first_gene(points: DataFrame, genes: DataFrame) -> DataFrame:
    """(chrom, pos, gene) for points inside a gene: the first in file order."""
    return point_join(points, genes).groupBy(SPOT).agg(F.min_by("name", "ordinal").alias("gene"))


def best_exon(points: DataFrame, exons: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(chrom, pos, transcript, exon, exon_id) for points inside an exon.

    Exons of transcripts with a consensus coding sequence come first, then of
    the longest transcripts, then by transcript name, then in file order.
    """
    known = exons.join(transcripts.dropDuplicates(["transcript"]), "transcript", "left")
    rank = F.struct(~F.coalesce("has_ccds", F.lit(False)), -F.coalesce("span", F.lit(0)), "transcript", "ordinal")
    found = point_join(points, known).groupBy(SPOT).agg(F.min_by(F.struct("transcript", "rank", "exon_id"), rank).alias("e"))
    return found.select("chrom", "pos", F.col("e.transcript").alias("transcript"), F.col("e.rank").alias("exon"), F.col("e.exon_id").alias("exon_id"))


def cds_offsets(cds: DataFrame) -> DataFrame:
    """Coding segments with ``before``, the coding bases ahead of them in reading direction."""
    place = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    ahead = Window.partitionBy("transcript").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return cds.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(ahead), F.lit(0)))


def bases_at(spots: DataFrame, reference: DataFrame) -> DataFrame:
    """``spots`` (chrom, pos, ...) with ``base``, the reference base there, where it is known."""
    spans = reference.select(F.col("contig").alias("chrom"), (F.col("offset") + 1).alias("start"), (F.col("offset") + F.char_length("seq")).alias("end"), "seq")
    found = point_join(spots, spans)
    return found.withColumn("base", F.substr("seq", (F.col("pos") - F.col("start") + 1).cast("int"), F.lit(1))).drop("start", "end", "seq")


def coding_changes(snvs: DataFrame, cds: DataFrame, reference: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, transcript, aa_change, hgvs_c) for single-base changes in a coding segment.

    The codon's bases come from the reference, also across segment borders and
    on the reverse strand; where the reference lacks one, or differs from REF,
    there is no change to report.
    """
    key = ["chrom", "pos", "ref", "alt", "transcript"]
    segments = cds_offsets(cds)
    here = point_join(snvs, segments.withColumnRenamed("transcript", "_t")).where("_t = transcript")
    back = F.col("strand") == "-"
    offset = F.col("before") + F.when(back, F.col("end") - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    placed = here.select(*key, back.alias("back"), offset.alias("offset"))
    codon = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("want", F.floor(F.col("offset") / 3) * 3 + F.col("k"))
    seg = segments.select(F.col("transcript").alias("_t"), F.col("start").alias("s"), F.col("end").alias("e"), "before")
    inside = (F.col("transcript") == F.col("_t")) & (F.col("want") >= F.col("before")) & (F.col("want") <= F.col("before") + F.col("e") - F.col("s"))
    spot = F.when(F.col("back"), F.col("e") - (F.col("want") - F.col("before"))).otherwise(F.col("s") + F.col("want") - F.col("before"))
    spots = codon.join(seg, inside).select(*[F.col(c).alias(f"v_{c}") for c in key], "back", "offset", "k", F.col("chrom"), spot.alias("pos"))
    got = bases_at(spots, reference)
    base = F.when(F.col("back"), F.translate("base", "ACGT", "TGCA")).otherwise(F.col("base"))
    codons = got.withColumn("b", base).groupBy(*[f"v_{c}" for c in key], "back", "offset").agg(F.sort_array(F.collect_list(F.struct("k", "b"))).alias("bs")).where(F.size("bs") == 3)
    text = F.array_join(F.transform("bs", lambda x: x["b"]), "")
    c = codons.select(*[F.col(f"v_{x}").alias(x) for x in key], "back", "offset", text.alias("codon"))
    turn = lambda x: F.when(F.col("back"), F.translate(F.upper(x), "ACGT", "TGCA")).otherwise(F.upper(x))
    frame = (F.col("offset") % 3).cast("int")
    c = c.withColumn("r", turn(F.col("ref"))).withColumn("a", turn(F.col("alt"))).withColumn("frame", frame).where(F.substr("codon", F.col("frame") + 1, F.lit(1)) == F.col("r"))
    new = F.overlay("codon", "a", F.col("frame") + 1, F.lit(1))
    old_aa, new_aa = amino_acid(F.col("codon")), amino_acid(new)
    number = (F.floor(F.col("offset") / 3) + 1).cast("string")
    protein = F.when(old_aa == new_aa, F.concat(F.lit("p."), three_letter(old_aa), number, F.lit("="))).otherwise(F.concat(F.lit("p."), three_letter(old_aa), number, three_letter(new_aa)))
    return c.select(*key, protein.alias("aa_change"), F.concat(F.lit("c."), (F.col("offset") + 1).cast("string"), F.col("r"), F.lit(">"), F.col("a")).alias("hgvs_c"))


def annotate(variants: DataFrame, genes: dict[str, DataFrame] | None, clinical: DataFrame | None, reference: DataFrame | None) -> DataFrame:
    """``variants`` with all annotation columns; what isn't found is ".".

    Interval lookups run on distinct positions and join back by equality.
    """
    out = variants
    columns = dict.fromkeys(ANNOTATIONS)
    if genes is not None:
        points = variants.select(SPOT).distinct()
        out = out.join(first_gene(points, genes["genes"]), SPOT, "left").join(best_exon(points, genes["exons"], genes["transcripts"]), SPOT, "left")
        region = F.when(F.col("transcript").isNotNull(), "exon").when(F.col("gene").isNotNull(), "intron")
        out = out.withColumn("region", region)
        columns |= dict.fromkeys(("gene", "transcript", "exon", "exon_id", "region"), True)
        if reference is not None:
            key = ["chrom", "pos", "ref", "alt", "transcript"]
            snvs = out.where((F.char_length("ref") == 1) & (F.char_length("alt") == 1) & F.col("transcript").isNotNull()).select(key).distinct()
            out = out.join(coding_changes(snvs, genes["cds"], reference), key, "left")
            columns |= dict.fromkeys(("aa_change", "hgvs_c"), True)
    if clinical is not None:
        out = out.join(clinical, ["chrom", "pos", "ref", "alt"], "left")
        columns |= dict.fromkeys(("consequence", "clinvar_significance", "clinvar_oncogenic", "clinvar_id", "rsid"), True)
    return out.select(*variants.columns, *[(F.coalesce(F.col(c), F.lit(".")) if live else F.lit(".")).alias(c) for c, live in columns.items()])
