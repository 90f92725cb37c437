"""A checked query to a DataFrame.

Clauses run in a fixed order whatever their order in the text: source, call,
annotation, filter, order, limit, projection. Each record carries its place in
the source (``_seq``), which breaks ties as the last sort key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.lower import Scope, lower, predicate
from genoloom.functions.values import when_ok
from genoloom.lang import ast
from genoloom.lang.analyzer import constant, record_kind
from genoloom.lang.errors import EngineError
from genoloom.operators import coverage as cov
from genoloom.operators.annotate import annotate
from genoloom.operators.reads import read_records
from genoloom.operators.setops import isec
from genoloom.operators.variants import Options, call_variants
from genoloom.plans.schema import ALIASES, EMPTY_TYPES, FIELDS, JSON_KEYS, NATURAL
from genoloom.sources import bam as bam_source
from genoloom.sources import text as text_source

TYPES = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool"}


@dataclass
class Planned:
    """Rows in order, with ``_seq``; ``columns`` are those of the result."""

    df: DataFrame
    kind: str
    columns: list[str]
    projected: bool
    keys: tuple = ()  # for whole records: (JSON key, column)
    unordered: bool = False  # joins may have left rows out of source order


def path_of(path, variables: dict) -> str:
    if not isinstance(path, ast.Var):
        return path
    if path.name not in variables:
        raise EngineError("UnboundVariable", f"${path.name} has no value")
    return str(variables[path.name])


def params_of(q: ast.Query, variables: dict) -> dict:
    """WITH values; a number given as a variable's text is parsed."""
    from genoloom.lang.analyzer import PARAMS

    out: dict = {}
    for key, e, _ in q.params:
        value = path_of(e, variables) if isinstance(e, ast.Var) and PARAMS[q.call][key] == "str" else variables.get(e.name) if isinstance(e, ast.Var) else constant(e)
        if isinstance(e, ast.Var) and e.name not in variables:
            raise EngineError("UnboundVariable", f"${e.name} has no value")
        kind = PARAMS[q.call][key]
        try:
            out[key] = value if kind == "str" else int(float(value)) if kind == "int" else float(value)
        except (TypeError, ValueError):
            raise EngineError("TypeMismatch", f"`{key}` needs a number, not {value!r}") from None
    return out


@dataclass
class Region:
    chrom: str | None = None
    start: int | None = None
    end: int | None = None


def region_of(e) -> Region:
    """The chromosome and bounds that WHERE's conjuncts fix; the first of each counts."""
    out = Region()

    def visit(x) -> None:
        if isinstance(x, ast.Binary) and x.op == "AND":
            visit(x.left)
            visit(x.right)
        elif isinstance(x, ast.Binary):
            name, v, op = x.left, x.right, x.op
            if isinstance(name, ast.Lit):
                name, v, op = v, name, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
            if not isinstance(name, ast.Name) or not isinstance(v, ast.Lit):
                return
            if name.name in ("chr", "chrom") and op == "=" and isinstance(v.value, str):
                out.chrom = out.chrom or v.value
            if name.name == "pos" and isinstance(v.value, int) and not isinstance(v.value, bool):
                if op in ("=", ">", ">=") and out.start is None:
                    out.start = v.value
                if op in ("=", "<", "<=") and out.end is None:
                    out.end = v.value

    if e is not None:
        visit(e)
    return out


def within(reads: DataFrame, region: Region) -> DataFrame:
    """Reads that start inside the region; bounds count only with a chromosome."""
    if region.chrom is None:
        return reads
    out = reads.where(F.col("chrom") == region.chrom)
    if region.start is not None:
        out = out.where(F.col("pos") >= region.start)
    return out if region.end is None else out.where(F.col("pos") <= region.end)


def empty(spark: SparkSession, kind: str) -> DataFrame:
    fields = [f"`{n}` {EMPTY_TYPES[t]}" for n, t in FIELDS[kind].items()]
    return spark.createDataFrame([], ", ".join([*fields, "_seq long"]))


def variant_source(spark: SparkSession, fmt: str, path: str, split: bool) -> DataFrame:
    if fmt != "vcf":
        raise EngineError("SourceFormat", f"set operations need vcf, not {fmt}")
    return text_source.vcf(spark, path, split)


def source_records(spark: SparkSession, q: ast.Query, variables: dict) -> DataFrame:
    """The records of FROM and CALL."""
    fmt, path = q.source.format, path_of(q.source.path, variables)
    if fmt in ("json", "tsv"):
        raise EngineError("SourceFormat", f"{fmt} can't be a source")
    if fmt == "cram":
        raise EngineError("UnsupportedInto", "cram has no reader")
    if fmt == "table":
        # a row's place in its file; unlike a running number it lets filters reach the scan
        rows = spark.read.parquet(path)
        return rows.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_seq"))
    opts = params_of(q, variables)
    if q.pair is not None:
        # the partition counts, also where CALL variants follows; SPLIT doesn't apply
        other = variant_source(spark, q.pair.format, path_of(q.pair.path, variables), False)
        return isec(variant_source(spark, fmt, path, False), other, q.pair.mode)
    if q.call is None:
        return empty(spark, record_kind(ast.Query(q.source)))
    if q.call == "header":
        if fmt not in ("bam", "vcf"):
            raise EngineError("SourceFormat", f"{fmt} has no header")
        return bam_source.contigs(spark, path) if fmt == "bam" else text_source.vcf_contigs(spark, path)
    if fmt == "vcf":
        if q.call != "variants":
            raise EngineError("SourceFormat", f"CALL {q.call} needs bam")
        return text_source.vcf(spark, path, q.split)
    if fmt in ("bed", "fasta"):
        return empty(spark, record_kind(ast.Query(q.source, call=q.call)))
    region = region_of(q.where)
    # reads that start before a region may reach into it, so their call needs the whole contig
    bounds = (None, None) if q.call == "variants" else (region.start, region.end)
    reads = bam_source.bam(spark, path, region=region.chrom and (region.chrom, *bounds))
    if q.call == "reads":
        return read_records(within(reads, region).where("chrom is not null"))
    if q.call in ("coverage", "cnv"):
        windows = cov.coverage_windows(within(reads, region).where("chrom is not null and (flag & 4) = 0"), opts.get("window_size", cov.WINDOW_SIZE))
        if q.call == "cnv":
            windows = cov.call_cnv(windows, opts.get("amp_threshold"), opts.get("del_threshold"), opts.get("min_windows"), opts.get("segmentation_method", "adaptive"))
        return windows.withColumn("_seq", F.struct("chrom", "start"))
    reference = opts.pop("reference", None)
    given = {("min_allele_freq" if k == "min_af" else k): v for k, v in opts.items()}
    fasta = text_source.fasta(spark, reference) if reference else None
    if fasta is not None and not fasta.limit(1).count():
        raise EngineError("SourceFormat", f"{reference} holds no sequence")
    # reads that reach into the region matter to its positions, so only the chromosome restricts them
    return call_variants(within(reads, Region(region.chrom)), fasta, Options(**given))


def annotated(spark: SparkSession, df: DataFrame, q: ast.Query, variables: dict) -> DataFrame:
    paths = {k: path_of(e, variables) if isinstance(e, ast.Var) else constant(e) for k, e, _ in q.annotate}
    reference = params_of(q, variables).get("reference")
    return annotate(
        df, text_source.gff(spark, paths["genes"]) if "genes" in paths else None, text_source.clinvar(spark, paths["clinvar"]) if "clinvar" in paths else None,
        text_source.fasta(spark, reference) if reference else None)


def scope_of(df: DataFrame, kind: str, variables: dict) -> Scope:
    known = FIELDS.get(kind) if kind != "table" else {f.name: TYPES[f.dataType.simpleString()] for f in df.schema if f.dataType.simpleString() in TYPES and f.name != "_seq"}
    fields = {}
    for name, t in known.items():
        column = F.col(f"`{name}`")
        fields[name] = (column.cast("long") if t == "int" and kind == "table" else column.cast("double") if t == "float" and kind == "table" else column, t)
    for alias, name in ALIASES[kind].items():
        fields[alias] = fields[name]
    return Scope(fields, variables)


def implied_name(e, i: int) -> str:
    """A column's name where the query gives none."""
    if isinstance(e, (ast.Name, ast.Var, ast.Field)):
        return e.name
    if isinstance(e, ast.Call):
        inner = implied_name(e.args[0], i) if len(e.args) == 1 and isinstance(e.args[0], (ast.Name, ast.Var, ast.Field)) else None
        return f"{e.name}_{inner}" if inner else e.name
    return f"col{i + 1}"


def limit_of(e, variables: dict) -> int | None:
    v = variables.get(e.name) if isinstance(e, ast.Var) else constant(e)
    if isinstance(e, ast.Var) and e.name not in variables:
        raise EngineError("UnboundVariable", f"${e.name} has no value")
    if isinstance(v, bool) or not isinstance(v, int):
        raise EngineError("TypeMismatch", "LIMIT needs a whole number")
    return None if v < 0 else v


def plan(spark: SparkSession, q: ast.Query, variables: dict | None = None, records: DataFrame | None = None) -> Planned:
    """The DataFrame of a checked query; ``records`` may stand in for what FROM and CALL give."""
    variables = variables or {}
    kind = record_kind(q)
    df = source_records(spark, q, variables) if records is None else records
    shuffled = q.pair is not None or q.annotate is not None or q.source.format == "bam"
    if q.call == "header":
        return Planned(df, "header", ["name", "length"], False)
    if kind == "annotated_variant":
        df = annotated(spark, df, q, variables)
    scope = scope_of(df, kind, variables)
    if q.where is not None:
        df = df.where(predicate(q.where, scope))
    items = select_items(q, kind)
    named = dict(items) if items is not None else {}
    if q.order:
        keys = []
        for o in q.order:
            e = named.get(o.expr.name, o.expr) if isinstance(o.expr, ast.Name) else o.expr
            v = lower(e, scope)
            if v.type in ("bool", "null") or v.err is True:
                continue  # such keys order nothing
            column = when_ok(v)
            keys.append(column.desc_nulls_last() if o.descending else column.asc_nulls_last())
        df = df.orderBy(*keys, "_seq")
    n = limit_of(q.limit, variables) if q.limit is not None else None
    if n is not None:
        df = (df.orderBy("_seq") if shuffled and not q.order else df).limit(n)
    if items is None:
        columns = [c for c in df.columns if c != "_seq"] if kind == "table" else list(NATURAL[kind])
        keys = JSON_KEYS.get(kind) or tuple((c, c) for c in columns)
        return Planned(df, kind, columns, False, keys, shuffled and not q.order)
    cells: dict = {}
    for name, e in items:
        cells.pop(name, None)  # of equal names the last counts
        cells[name] = when_ok(lower(e, scope)).alias(name)
    columns = list(cells)
    hidden = "_seq" if "_seq" not in columns else "_place"
    return Planned(df.select(*cells.values(), F.col("_seq").alias(hidden)), "row", columns, True, unordered=shuffled and not q.order and hidden == "_seq")


def select_items(q: ast.Query, kind: str) -> list[tuple[str, object]] | None:
    """SELECT as (name, expression), or None for whole records; a `*` anywhere means whole records."""
    if q.select is None or any(isinstance(i.expr, ast.Star) for i in q.select):
        return None
    items = [(i.alias or implied_name(i.expr, n), i.expr) for n, i in enumerate(q.select)]
    if q.into is not None and q.into.format == "vcf" and kind in ("variant", "annotated_variant"):
        have = {("chrom" if n == "chr" else n) for n, _ in items}
        items = [(c, ast.Name(c)) for c in ("chrom", "pos", "ref", "alt") if c not in have] + items
    return items
