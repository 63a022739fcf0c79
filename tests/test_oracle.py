"""Every registered query runs; those with a SQL twin equal it on the smallest data set."""

import pytest

import __spark_entry__ as entry
from check_oracle import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert differences(got, con.execute(ORACLES[name]).df()) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_cover_the_inventory():
    have = {n.split("_")[0] for n in QUERIES}
    want = {f"{p}{i}" for p, n in {"S": 25, "C": 25, "J": 19, "W": 35, "N": 13, "P": 22, "A": 21, "B": 5, "Q": 10, "M": 12, "D": 14}.items() for i in range(1, n + 1)}
    assert want <= have
