"""Compile, explain and run queries."""

from __future__ import annotations

import json
from dataclasses import is_dataclass

from pyspark.sql import DataFrame, SparkSession

from genoloom import sinks, streaming
from genoloom.functions.lower import Scope, lower
from genoloom.functions.values import when_ok
from genoloom.lang import ast, parser
from genoloom.lang.analyzer import analyze, check_calls
from genoloom.plans.lower import Planned, path_of, plan


def compile_query(text: str) -> ast.Query:
    """Parse and check a query; raises QueryError."""
    q = parser.parse(text)
    analyze(q)
    return q


def to_json(q: ast.Query) -> str:
    """A query's syntax tree as JSON, to store or send; ``from_json`` reads it."""
    def pack(x):
        if is_dataclass(x):
            return {"node": type(x).__name__, **{k: pack(getattr(x, k)) for k in field_names(x)}}
        if isinstance(x, (list, tuple)):
            return [pack(v) for v in x]
        return x

    return json.dumps(pack(q))


def field_names(x) -> list[str]:
    return list(type(x).__dataclass_fields__)


def from_json(text: str) -> ast.Query:
    def unpack(x):
        if isinstance(x, dict):
            kind = getattr(ast, x["node"])
            args = {k: unpack(v) for k, v in x.items() if k != "node"}
            if kind is ast.Call:
                args["args"] = tuple(args["args"])
            return kind(**args)
        return [unpack(v) for v in x] if isinstance(x, list) else x

    q = unpack(json.loads(text))
    q.params = [tuple(p) for p in q.params]
    q.annotate = None if q.annotate is None else [tuple(p) for p in q.annotate]
    return q


class Result:
    """A query's rows, text or summary."""

    def __init__(self, planned: Planned | None = None, text: str | None = None) -> None:
        self.planned, self.text = planned, text

    @property
    def df(self) -> DataFrame:
        """The rows as a DataFrame with just the result's columns."""
        return self.planned.df.select(*[f"`{c}`" for c in self.planned.columns])

    def rows(self) -> list[dict]:
        """All rows as JSON-like dicts; for results that fit the driver."""
        return [sinks.record(self.planned, r) for r in sinks.rows(self.planned)]

    def each(self, callback) -> int:
        return streaming.each(self.planned, callback)

    def json_lines(self):
        return sinks.json_lines(self.planned)


def header_text(planned: Planned) -> str:
    lines = [f"  {r['name']}\t{r.length if r.length is not None else 0}" for r in planned.df.orderBy("_seq").collect()]
    return "\n".join(["reference sequences:", *lines])


def run(spark: SparkSession, query: str | ast.Query, variables: dict | None = None) -> Result:
    """Run a query; INTO writes its file and gives a summary, CALL header gives text."""
    q = compile_query(query) if isinstance(query, str) else query
    planned = plan(spark, q, variables)
    if planned.kind == "header":
        return Result(planned, header_text(planned))
    if q.into is not None:
        contigs = ()
        if q.into.format == "vcf" and q.source.format == "bam":
            from genoloom.sources.bam import contigs as bam_contigs

            contigs = [(r["name"], r.length) for r in bam_contigs(spark, path_of(q.source.path, variables or {})).collect()]
        return Result(planned, sinks.write(planned, q.into.format, path_of(q.into.path, variables or {}), contigs))
    return Result(planned)


def explain(spark: SparkSession, query: str, variables: dict | None = None) -> str:
    """The physical plan as text."""
    q = compile_query(query)
    planned = plan(spark, q, variables)
    return planned.df._sc._jvm.PythonSQLUtils.explainString(planned.df._jdf.queryExecution(), "formatted")


def eval_expr(spark: SparkSession, text: str, variables: dict | None = None):
    """The value of an expression without fields; None where it fails."""
    e = parser.parse_expr(text)
    check_calls(e)
    return sinks.cell(spark.range(1).select(when_ok(lower(e, Scope({}, variables or {}))).alias("v")).first()["v"])
