"""Writers of results as VCF, BED, NDJSON, TSV or a JSON array.

``write`` makes one file, row by row from an iterator, so the driver holds a
batch of rows at most; ``directory`` writes all formats but the array in
parallel, as parts in any store Spark writes. An array in such a store is
written in parallel too; the driver then joins the parts as bytes.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import replace
from itertools import chain

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from genoloom.lang.errors import EngineError

VCF_FIXED = {"chrom": 0, "chr": 0, "pos": 1, "id": 2, "ref": 3, "ref_base": 3, "alt": 4, "qual": 5, "filter": 6}
BED_PLACE = {"chrom", "chr", "start", "end", "pos"}
INFO_TYPES = {"bigint": "Integer", "int": "Integer", "double": "Float", "float": "Float", "boolean": "Flag"}


def cell(v):
    """A value as Python has it, also of a column of several types."""
    return v.toPython() if isinstance(v, VariantVal) else v


def short(v) -> str:
    """A projected cell as text: whole floats with one decimal, others with four at most."""
    v = cell(v)
    if v is None:
        return "."
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isfinite(v) and v == int(v):
            return f"{v:.1f}"
        return f"{v:.4f}".rstrip("0").rstrip(".")
    return str(v)


def plain(v):
    """A value for JSON: NaN and infinities are null."""
    v = cell(v)
    return None if isinstance(v, float) and not math.isfinite(v) else v



def rows(planned):
    df = planned.df.orderBy("_seq") if planned.unordered else planned.df
    return df.toLocalIterator(prefetchPartitions=False)


def record(planned, row) -> dict:
    """A row's JSON object."""
    keys = planned.keys or tuple((c, c) for c in planned.columns)
    return {k: plain(row[c]) for k, c in keys if c in row.__fields__}


def json_lines(planned, found=None):
    for r in found or rows(planned):
        yield json.dumps(record(planned, r), ensure_ascii=False)


def json_array(planned, found=None):
    """One line, in pieces."""
    before = "["
    for line in json_lines(planned, found):
        yield before + line
        before = ","
    yield "]\n" if before == "," else "[]\n"


def tsv(planned, found=None):
    clean = lambda v: "" if v is None else (str(v).lower() if isinstance(v, bool) else str(v)).replace("\t", " ").replace("\n", " ")
    keys = planned.keys or tuple((c, c) for c in planned.columns)
    keys = [(k, c) for k, c in keys if c in planned.df.columns]
    yield "\t".join(k for k, _ in keys)
    for r in found or rows(planned):
        yield "\t".join(clean(plain(r[c])) for _, c in keys)


def vcf(planned, found=None, contigs=(), nothing=False):
    """``nothing``: there are no rows, which is written as variants are, whatever the columns."""
    yield "##fileformat=VCFv4.2"
    lengths = dict(contigs)
    if nothing or planned.kind == "variant" and not planned.projected:
        seen = [] if nothing else planned.df.groupBy("chrom").agg(F.min("_seq").alias("at")).orderBy("at").collect()
        for r in seen:
            yield f"##contig=<ID={r.chrom}" + (f",length={lengths[r.chrom]}" if r.chrom in lengths else "") + ">"
        yield '##INFO=<ID=DP,Number=1,Type=Integer,Description="Read depth">'
        yield '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">'
        yield "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
        for r in found or rows(planned):
            yield f"{r.chrom}\t{r.pos}\t{r.id or '.'}\t{r.ref}\t{r.alt}\t{r.qual:.1f}\t{r.filter or 'PASS'}\tDP={r.depth};AF={r.allele_freq:.4f}"
        return
    kinds = {f.name: f.dataType.simpleString() for f in planned.df.schema}
    extra = [c for c in planned.columns if c not in VCF_FIXED]
    for c in extra:
        yield f'##INFO=<ID={c},Number=1,Type={INFO_TYPES.get(kinds[c], "String")},Description="{c}">'
    yield "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    for r in found or rows(planned):
        fixed = [".", ".", ".", ".", ".", ".", "PASS"]
        for c in planned.columns:
            if c in VCF_FIXED and r[c] is not None:
                fixed[VCF_FIXED[c]] = short(r[c])
        about = ";".join(f"{c}={short(r[c])}" for c in extra)
        yield "\t".join([*fixed, about or "."])


def bed(planned, found=None):
    found = found or rows(planned)
    if not planned.projected and planned.kind == "window":
        for r in found:
            yield f"{r.chrom}\t{r.start}\t{r.end}\t{r.normalized:.4f}"
        return
    if not planned.projected and planned.kind == "variant":
        for r in found:
            yield f"{r.chrom}\t{r.pos - 1}\t{r.pos}\t{r.alt}"
        return
    has = set(planned.columns)
    extra = [c for c in planned.columns if c not in BED_PLACE]
    yield "\t".join(["#chrom", "start", "end", *extra])
    for r in found:
        chrom = short(r["chrom"] if "chrom" in has else r["chr"] if "chr" in has else None)
        if {"start", "end"} <= has:
            a, b = short(r["start"]), short(r["end"])
        elif "pos" in has and r["pos"] is not None:
            a, b = str(r["pos"] - 1), str(r["pos"])
        else:
            a = b = "."
        yield "\t".join([chrom, a, b, *(short(r[c]) for c in extra)])


WRITERS = {"vcf": vcf, "bed": bed, "json": json_lines, "tsv": tsv, "fasta": json_array}


class _Counted:
    """An iterator that counts what it has given."""

    def __init__(self, found) -> None:
        self.found, self.n = found, 0

    def __iter__(self):
        for x in self.found:
            self.n += 1
            yield x


class _Remote:
    """A text file in any store that Hadoop's file systems reach, written in runs."""

    def __init__(self, spark, path: str) -> None:
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out, self.held, self.size = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True), [], 0

    def __enter__(self):
        return self

    def write(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size > 1 << 20:
            self._flush()

    def _flush(self) -> None:
        self.out.write(bytearray("".join(self.held).encode()))
        self.held, self.size = [], 0

    def __exit__(self, *error) -> None:
        if self.held:
            self._flush()
        self.out.close()


def write(planned, fmt: str, path: str, contigs=()) -> str:
    """Write all rows to one file, of the driver or, with a scheme, of any store; the summary line. The plan runs once."""
    if fmt not in WRITERS:
        raise EngineError("UnsupportedInto", f"can't write {fmt}")
    if fmt == "fasta" and "://" in path:
        return f"wrote {_array_of_parts(planned, path)} record(s) to {path} ({fmt})"
    found = iter(rows(planned))
    first = next(found, None)
    counted = _Counted(found if first is None else chain([first], found))
    lines = vcf(planned, counted, contigs, first is None) if fmt == "vcf" else WRITERS[fmt](planned, counted)
    with _Remote(planned.df.sparkSession, path) if "://" in path else open(path, "w", encoding="utf-8") as f:
        for line in lines:
            f.write(line if fmt == "fasta" else line + "\n")
    return f"wrote {counted.n} record(s) to {path} ({fmt})"


def _objects(planned):
    """Each row's JSON object as a column ``value``; NaN and infinities are null."""
    df = planned.df
    keys = [(k, c) for k, c in (planned.keys or tuple((c, c) for c in planned.columns)) if c in df.columns]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def value(c):
        x = F.col(f"`{c}`")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) if kinds[c] in ("double", "float") else x

    return df.select(F.to_json(F.struct(*[value(c).alias(k) for k, c in keys]), {"ignoreNullFields": "false"}).alias("value"))


def _array_of_parts(planned, path: str) -> int:
    """A JSON array on one line, its rows written as parts beside it and joined there; the number of rows. The plan runs once."""
    if planned.unordered:
        planned = replace(planned, df=planned.df.orderBy("_seq"))
    spark = planned.df.sparkSession
    jvm = spark._jvm
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = Observation()
    try:
        _objects(planned).observe(seen, F.count(F.lit(1)).alias("n")).write.option("lineSep", ",").text(folder)
        parts = [f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()]
        parts.sort(key=lambda f: f.getPath().getName())
        out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
        try:
            out.write(bytearray(b"["))
            for i, f in enumerate(parts, 1):
                part = fs.open(f.getPath())
                try:
                    # all but the comma after the last row
                    jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, f.getLen() - (i == len(parts)))
                finally:
                    part.close()
            out.write(bytearray(b"]\n"))
        finally:
            out.close()
    finally:
        fs.delete(at, True)
    return seen.get["n"]


def _short(df, name: str):
    """``short`` as a column; a last digit may differ where the fifth decimal is an exact 5."""
    kind = df.schema[name].dataType.simpleString()
    x = F.col(f"`{name}`")
    if kind in ("double", "float"):
        trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x.cast("double")), "0+$", ""), r"\.$", "")
        finite = F.when(x == F.floor(x), F.format_string("%.1f", x.cast("double"))).otherwise(trimmed)
        text = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(finite)
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("."))


def _vcf_lines(planned):
    df = planned.df
    if planned.kind == "variant" and not planned.projected:
        missing = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))
        about = F.concat(F.lit("DP="), F.col("depth").cast("string"), F.lit(";AF="), F.format_string("%.4f", "allele_freq"))
        cells = [F.col("chrom"), F.col("pos").cast("string"), missing("id", "."), F.col("ref"), F.col("alt"), F.format_string("%.1f", "qual"), missing("filter", "PASS"), about]
        return df.select(F.concat_ws("\t", *cells).alias("value"))
    fixed = [F.lit("."), F.lit("."), F.lit("."), F.lit("."), F.lit("."), F.lit("."), F.lit("PASS")]
    for c in planned.columns:
        if c in VCF_FIXED:
            at = VCF_FIXED[c]
            fixed[at] = F.when(F.col(f"`{c}`").isNotNull(), _short(df, c)).otherwise(fixed[at])
    extra = [F.concat(F.lit(f"{c}="), _short(df, c)) for c in planned.columns if c not in VCF_FIXED]
    return df.select(F.concat_ws("\t", *fixed, F.concat_ws(";", *extra) if extra else F.lit(".")).alias("value"))


def _vcf_head(planned, contigs) -> list[str]:
    """The header lines; contigs by their first record."""
    bare = replace(planned, df=planned.df.limit(0))
    head = list(vcf(bare, [], contigs))
    if planned.kind == "variant" and not planned.projected:
        lengths = dict(contigs)
        seen = planned.df.groupBy("chrom").agg(F.min("_seq").alias("at")).orderBy("at").collect()
        head[1:1] = [f"##contig=<ID={r.chrom}" + (f",length={lengths[r.chrom]}" if r.chrom in lengths else "") + ">" for r in seen]
    return head


def _bed_lines(planned):
    df = planned.df
    if not planned.projected and planned.kind == "window":
        return df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.format_string("%.4f", "normalized")).alias("value"))
    if not planned.projected and planned.kind == "variant":
        return df.select(F.concat_ws("\t", "chrom", (F.col("pos") - 1).cast("string"), F.col("pos").cast("string"), "alt").alias("value"))
    has = set(planned.columns)
    chrom = _short(df, "chrom" if "chrom" in has else "chr") if {"chrom", "chr"} & has else F.lit(".")
    if {"start", "end"} <= has:
        span = [_short(df, "start"), _short(df, "end")]
    elif "pos" in has:
        span = [F.coalesce((F.col("pos") - d).cast("string"), F.lit(".")) for d in (1, 0)]
    else:
        span = [F.lit("."), F.lit(".")]
    extra = [_short(df, c) for c in planned.columns if c not in BED_PLACE]
    return df.select(F.concat_ws("\t", chrom, *span, *extra).alias("value"))


def _put(spark, path: str, head: list[str]) -> None:
    """A small file of its own in the folder, named so that it comes first."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/part-")
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    try:
        out.write(bytearray("".join(line + "\n" for line in head).encode()))
    finally:
        out.close()


def directory(planned, fmt: str, path: str, contigs=()) -> None:
    """Write parts in parallel to a folder of any store Spark writes; parts in order of their names hold the rows in order.

    VCF and BED have their header in a first part of its own; the other parts
    are headless, so the parts one after another are a file.
    """
    if planned.unordered:
        planned = replace(planned, df=planned.df.orderBy("_seq"))
    spark = planned.df.sparkSession
    keys = [(k, c) for k, c in (planned.keys or tuple((c, c) for c in planned.columns)) if c in planned.df.columns]
    out = planned.df.select(*[F.col(f"`{c}`").alias(k) for k, c in keys])
    if fmt == "json":
        out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    elif fmt == "tsv":
        clean = [F.regexp_replace(F.col(f"`{c}`").cast("string"), "[\t\n]", " ").alias(c) for c in out.columns]
        out.select(*clean).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", nullValue="")
    elif fmt == "vcf":
        _vcf_lines(planned).write.mode("overwrite").text(path)
        _put(spark, path, _vcf_head(planned, contigs))
    elif fmt == "bed":
        _bed_lines(planned).write.mode("overwrite").text(path)
        if planned.projected or planned.kind not in ("window", "variant"):
            _put(spark, path, ["\t".join(["#chrom", "start", "end", *[c for c in planned.columns if c not in BED_PLACE]])])
    else:
        raise EngineError("UnsupportedInto", f"no parallel writer for {fmt}")
