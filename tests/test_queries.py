"""The contract, and a few queries against their SQL; check.py does all of them."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
import check
from orderflow.operators import quality
from orderflow.plans import rendering
from orderflow.plans.oracles import ORACLES
from orderflow.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver's tables not there")


def test_contract():
    assert set(ORACLES) == set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 50


@pytest.mark.parametrize("name", [
    "typed_coercion", "strip_thousands", "canonical_keys", "conform_mixed_tables", "packing_full",
    "tail_regex_lines", "lookup_merge", "report_tables", "bucket_lines_by_table",
])
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = check.normal(contract.queries()[name](spark, FOLDER).toPandas())
    want = check.normal(con.execute(contract.oracle_sql()[name]).df())
    assert len(got) == len(want) and all(check.equal(a, b) for a, b in zip(got, want))


def test_numbers_are_not_copied_into_filters(spark):
    """The parse stands once per column in the plan, also under filters on its result."""
    rules = {"qty": "quantity", "price": "price", "amount": "amount"}
    result = quality.validate(rendering.order_lines(spark, FOLDER), rules, "key")
    plan = result.rejects._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"try_cast\(__\w+#\d+ as double\)", plan)) == 3


def test_scan_reads_needed_columns(spark):
    plan = contract.queries()["lookup_merge"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and not any("l_tax" in s or "p_name" in s for s in schemas)
