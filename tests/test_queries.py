"""Every registered query against its check SQL on the smallest tables."""

import re

import duckdb
import pytest
from check import compare

import __spark_entry__ as entry_module
from millwright.plans.views import CHECK_FRAGMENTS, RAW_TABLES

FOLDER = "/root/testdata/sf0.001"
CHECKS = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in RAW_TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query_matches_check(spark, duck, name):
    df = entry_module.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name not in CHECKS:
        assert rows
        return
    result = duck.execute(CHECKS[name])
    assert compare(rows, df.columns, result.fetchall(), [c[0] for c in result.description]) == "ok"


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_fragments_are_not_shadowed():
    entry_module.queries()
    from millwright.plans.registry import CHECKS as raw

    for name, text in raw.items():
        local = set(re.findall(r"\b(x_[a-z_0-9]+) as \(", text))
        assert not local & set(CHECK_FRAGMENTS), name
