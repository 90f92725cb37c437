"""Every registered genomic query against its SQL."""

import pytest
from conftest import same

from genoloom import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same(q.queries()[name](spark, duck.base).toPandas(), duck(q.oracle_sql()[name]))


def test_partitions_do_not_matter(spark, duck):
    from genoloom.operators.reads import depth_at_start

    reads = q.view(spark, duck.base, q.READS, "events")
    want = sorted(map(tuple, depth_at_start(reads.coalesce(1)).select("chrom", "pos", "depth").collect()))
    for n in (2, 7):
        assert sorted(map(tuple, depth_at_start(reads.repartition(n)).select("chrom", "pos", "depth").collect())) == want


def test_plain_conjuncts_reach_the_scan(spark, duck):
    from genoloom.lang.parser import parse
    from genoloom.plans.lower import plan

    p = plan(spark, parse(f'FROM table "{duck.base}/lineitem.parquet" WHERE l_returnflag = "A" AND l_orderkey > 10 SELECT l_orderkey'))
    text = p.df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_orderkey), EqualTo(l_returnflag,A), GreaterThan(l_orderkey," in text


def test_range_join_is_no_nested_loop(spark, duck):
    points, genes = q.gene_points(spark, duck.base)
    from genoloom.operators.ranges import point_join

    assert "NestedLoop" not in point_join(points, genes)._jdf.queryExecution().executedPlan().toString()
