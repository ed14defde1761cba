import duckdb
import pytest

from arealis.plans import modelling


@pytest.fixture
def tables(tmp_path):
    rows = "SELECT k // 12 AS l_suppkey, k % 3 + 1 AS l_quantity, 100.0 + k AS l_extendedprice, 0.01 * (k % 5) AS l_discount, 0.01 * (k % 7) AS l_tax, "
    rows += "['R', 'A', 'N'][k % 3 + 1] AS l_returnflag, DATE '2001-06-01' + INTERVAL (k % 4) YEAR AS l_shipdate FROM range(120) r(k)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_line_items_are_summed_once(spark, tables):
    panel = modelling._scaled_panel(spark, tables)
    assert panel.count() == 40
    assert "FileScan" not in panel._jdf.queryExecution().executedPlan().toString()
