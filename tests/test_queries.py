"""Every registered query against DuckDB, and the shape of the registry."""

import __spark_entry__ as contract
import pytest
from oracle import assert_same

from sparkassay import workload
from sparkassay.workload.sources import SQL_FOLDER

@pytest.mark.parametrize("name", sorted(workload.ORACLE))
def test_query_answers_as_sql(spark, folder, duck, name):
    sql = workload.ORACLE[name].replace(SQL_FOLDER, folder)  # file sizes are asked for by path
    assert_same(workload.QUERIES[name](spark, folder), duck, sql)


def test_every_query_is_checked():
    assert set(workload.QUERIES) == set(workload.ORACLE)
    # further queries come from the training-data part, where it is there
    assert contract.queries().keys() == workload.QUERIES.keys() | contract.LLM_QUERIES.keys()
    assert contract.oracle_sql().keys() == workload.ORACLE.keys() | contract.LLM_ORACLE.keys()


def test_entry_gives_rows(spark):
    report = contract.entry(spark)
    assert report.columns[:5] == ["table", "column", "requested_metric", "executed_metric", "value"]
    assert report.count() > 0
