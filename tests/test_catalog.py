import pytest
from oracle import DATA, assert_same, connect

from gradus.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_partitions_do_not_matter(spark):
    seen = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, catalog.routed_gap(spark, DATA).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
