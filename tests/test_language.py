import pytest

from genoloom import engine, script
from genoloom.lang.errors import QueryError, distance, suggest
from genoloom.lang.parser import parse


@pytest.mark.parametrize("text, value", [
    ("abs(-5)", 5), ("floor(3.9)", 3), ("ceil(3.1)", 4), ("round(2.345, 2)", 2.35), ("round(-2.5)", -3), ("max(3, 7.5)", 7.5), ("min(4)", 4), ("pow(2, 10)", 1024.0),
    ("sqrt(9)", 3.0), ("log(8, 2)", 3.0), ("log(0)", float("-inf")), ('substr("ACGTACGT", 2, 3)', "GTA"), ('substr("ACG", -4, 2)', "AC"), ('concat("chr", 7)', "chr7"), ("concat(1.0, 2.5)", "12.5"),
    ('gc("GGCC")', 1.0), ('gc("NN")', 0.0), ('revcomp("AACG")', "CGTT"), ('translate("ATGAAATAG")', "MK*"), ('translate("AUGNNN")', "MX"), ('codon_at("ATGAAA", 3)', "AAA"), ('codon_at("ATG", 2)', None),
    ("2 + 3 * 4", 14), ("7 / 2", 3), ("-7 / 2", -3), ("1 / 0", None), ("1.0 / 0", float("inf")), ("9223372036854775807 + 1", -(2**63)), ("9223372036854775807 * 3", 9223372036854775805),
    ("false AND depth", False), ("true OR 1 / 0 = 1", True), ("1 / 0 = 1 OR true", None), ("NOT true", False), ("NOT nothing", True), ("NOT 1", None), ('"7" = 7', False), ('"a" < "b"', None), ("nothing = nothing", True),
    ("1 = 1.0", True), ('len("héé")', 3), ("coalesce(nothing, 3)", 3), ('x["k"]', None), ("a.b", None), ('floor("2.7")', 2), ('abs("2")', None), ('contains("abc", "b")', True), ("$n + 1", 5), ("$unbound", None),
    ("abs(-9223372036854775807 - 1)", None), ("round(0.49999999999999994)", 0), ("round(4503599627370497.0)", 4503599627370497), ("round(-0.5)", -1), ("round(2.5)", 3), ("round(1000000000000000000000.0)", 2**63 - 1),
    ('coalesce(1, "a")', 1), ('coalesce(nothing, "a", 1)', "a"), ("coalesce(1, 2.5)", 1), ("coalesce(nothing, nothing)", None), ('7 AND "x"', "x"), ('0 AND "x"', 0), ('"" OR 2.5', 2.5), ('"y" OR 2', "y"), ('nothing OR "z"', "z"), ("nothing AND 1", None),
    ('(7 AND "x") = "x"', True), ('(0 AND "x") = 0', True), ('len(7 AND "abc")', 3), ('len(0 AND "abc")', None), ('(1 AND 2.5) + 1', 3.5), ('("a" AND 2) + 1', 3.0), ('NOT (7 AND true)', False), ('(7 AND "x") < 3', None), ('concat(7 AND "x", 0 AND "x")', "x0"),
    ("concat(100000000000000000000.0)", "1" + "0" * 20), ("concat(1.5 * pow(10, 300))", "15" + "0" * 299), ("concat(0.00001)", "0.00001"), ("concat(0.00000123)", "0.00000123"), ("concat(-12345678.25)", "-12345678.25"), ("concat(0.0001)", "0.0001"), ("concat(-0.0)", "-0"), ("concat(1.0 / 0, log(-1))", "infNaN"), ("concat(true, nothing, 3)", "true3")])
def test_expression(spark, text, value):
    got = engine.eval_expr(spark, text, {"n": 4})
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("text, code", [
    ("SELECT x", "E000"), ('FROM vcf "a" CALL nothing', "E000"), ('FROM vcf "a" FROM vcf "b"', "E005"), ('FROM bam "a" CALL variants WITH min_dept = 3', "E001"), ('FROM bam "a" CALL variants WITH min_depth = "x"', "E002"),
    ('FROM bam "a" CALL variants WITH min_depth = 1 + 2', "E003"), ('FROM bam "a" WITH min_depth = 1', "E004"), ('FROM vcf "a" CALL variants WHERE foo(1) = 1', "E006"), ('FROM vcf "a" CALL variants WHERE abs(1, 2) = 1', "E007"),
    ('FROM vcf "a" CALL variants WHERE upper(1) = "x"', "E008"), ('FROM vcf "a" CALL variants WHERE dept > 1', "E009"), ('FROM bam "a" CALL header LIMIT 1', "E010"), ('FROM vcf "a" CALL variants ANNOTATE WITH gene = "x"', "E011")])
def test_errors(text, code):
    with pytest.raises(QueryError) as e:
        engine.compile_query(text)
    assert e.value.code == code
    assert "^" in e.value.render(text) and code in e.value.render(text)


def test_hints():
    # shared parts first, then fewest edits, three at most
    assert suggest("min_freq", ["min_af", "min_depth", "min_allele_freq"]) == "did you mean `min_allele_freq`?"
    assert suggest("refernce", ["reference", "min_depth"]) == "did you mean `reference`?"
    assert suggest("zzzzzz", ["reference", "min_depth"]) is None
    assert distance("depth", "dept") == 1
    assert suggest("min_dept", ["min_depth", "reference"]) == "did you mean `min_depth`?"
    with pytest.raises(QueryError) as e:
        engine.compile_query('FROM vcf "a" CALL variants WHERE dept > 1')
    assert "depth" in e.value.hint


def test_clause_order_and_comments():
    a = parse('FROM vcf "a" CALL variants LIMIT 3 SELECT chrom -- why\n WHERE af > 0.1')
    b = parse('from vcf "a" where af > 0.1 select chrom call variants limit 3')
    assert (a.call, a.limit.value, len(a.select)) == (b.call, b.limit.value, len(b.select))
    assert parse('FROM vcf "a" WHERE NOT strand_bias > 0.3').where.op == "NOT"


def test_plan_json_round_trip():
    q = engine.compile_query('FROM vcf $p PAIRED WITH vcf "b" MODE germline CALL variants WITH reference = "r" ANNOTATE WITH genes = $g WHERE af > 0.1 OR len(id) = 3 SELECT chrom, af AS f ORDER BY f DESC LIMIT 3 INTO tsv "o"')
    assert engine.from_json(engine.to_json(q)) == q


def test_script():
    found = script.parse_script('#!/usr/bin/env x\n-- @name: demo\n-- @input: path required str "a file"\n-- @input: least optional float 0.5\nFROM vcf $path CALL variants WHERE af > $least AND depth > $extra')
    assert found.about["name"] == "demo" and [i.name for i in found.inputs] == ["path", "least"]
    assert script.bind(found, {"path": "x", "extra": "7"}) == {"path": "x", "least": 0.5, "extra": 7}
    with pytest.raises(ValueError):
        script.bind(found, {"extra": "1"})
