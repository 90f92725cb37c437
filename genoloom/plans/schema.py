"""Record kinds: the fields a query sees, their types and columns."""

from __future__ import annotations

# Columns that annotation adds; a missing value is ".".
ANNOTATIONS = ("gene", "transcript", "exon", "exon_id", "region", "consequence", "aa_change", "hgvs_c", "clinvar_significance", "clinvar_oncogenic", "clinvar_id", "rsid")

_VARIANT = {
    "chrom": "str", "pos": "int", "ref": "str", "alt": "str", "qual": "float", "depth": "int", "ref_count": "int", "alt_count": "int",
    "allele_freq": "float", "strand_bias": "float", "kind": "str", "filter": "str", "id": "str"}
FIELDS = {
    "variant": _VARIANT,
    "annotated_variant": _VARIANT | dict.fromkeys(ANNOTATIONS, "str"),
    "alignment": {"chrom": "str", "pos": "int", "mapq": "int", "flag": "int", "depth": "int", "strand": "str", "is_reverse": "bool", "is_duplicate": "bool", "is_secondary": "bool"},
    "window": {"chrom": "str", "start": "int", "end": "int", "coverage": "int", "normalized": "float", "masked": "bool"},
    "cnv": {"chrom": "str", "start": "int", "end": "int", "length": "int", "type": "str", "copy_number": "float", "avg_coverage": "float", "confidence": "float", "num_windows": "int", "t_statistic": "float"},
    "header": {},
    "empty": {},
}
ALIASES = {
    "variant": {"chr": "chrom", "af": "allele_freq"}, "annotated_variant": {"chr": "chrom", "af": "allele_freq"}, "alignment": {"chr": "chrom"}, "window": {"chr": "chrom"},
    "cnv": {"chr": "chrom", "pos": "start", "cn": "copy_number", "copyNumber": "copy_number"}, "header": {}, "empty": {}, "table": {}}
#: What a whole record shows, in order.
NATURAL = {
    "variant": ("chrom", "pos", "ref", "alt", "qual", "depth", "allele_freq"),
    "annotated_variant": ("chrom", "pos", "ref", "alt", "qual", "depth", "allele_freq", *ANNOTATIONS),
    "alignment": ("chrom", "pos", "mapq", "flag", "depth"),
    "window": ("chrom", "start", "end", "coverage", "normalized"),
    "cnv": ("chrom", "start", "end", "type", "copy_number", "confidence", "num_windows"),
    "header": ("name", "length"),
    "empty": (),
}
#: Keys of a record as JSON: all fields of its kind.
JSON_KEYS = {
    "variant": (("chrom", "chrom"), ("pos", "pos"), ("ref", "ref"), ("alt", "alt"), ("qual", "qual"), ("type", "kind"), ("depth", "depth"), ("ref_count", "ref_count"), ("alt_count", "alt_count"), ("allele_freq", "allele_freq"), ("strand_bias", "strand_bias"), ("filter", "filter"), ("id", "id")),
}
JSON_KEYS["annotated_variant"] = JSON_KEYS["variant"] + tuple((a, a) for a in ANNOTATIONS)
#: Kinds whose WHERE fields are checked before running.
CHECKED = ("variant", "annotated_variant", "alignment", "window")
CALL_KIND = {"variants": "variant", "reads": "alignment", "coverage": "window", "cnv": "cnv", "header": "header"}
#: Without CALL there are no records, but those of these formats still have their fields.
SOURCE_KIND = {"vcf": "variant", "bam": "alignment"}
EMPTY_TYPES = {"int": "long", "float": "double", "str": "string", "bool": "boolean"}
