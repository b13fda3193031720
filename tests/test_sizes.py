"""Plans whose work for one row or task must not grow with another table."""

from lodestone.catalogue import ORACLE_SQL, QUERIES
from oracle import rows


def test_reader_sets_are_of_one_order(spark, tmp_path):
    """A supplier whose key is not there reads nothing; what a reader may read is held for one order, not for all suppliers."""
    import duckdb

    spark.createDataFrame([(k, k % 25) for k in range(50)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    lines = [(o, (o * 7 + k) % 60, "ANR"[(o * k) % 3]) for o in range(40) for k in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(QUERIES["derivation_readable"](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLE_SQL["derivation_readable"]).df())


def test_operations_read_each_table_once(spark):
    from oracle import SF

    from lodestone.plans import lives

    plan = lives.operations(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "Union" not in plan and "Window" not in plan
