"""Every query with an oracle agrees with it; fixtures of the text rules hold in Spark."""

import pytest
from oracle import SF, duck, rows

from lodestone.catalogue import ORACLE_SQL, QUERIES
from lodestone.functions.dialect import SPARK


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_oracle(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck(ORACLE_SQL[name]))


@pytest.mark.parametrize("text, parts", [
    ("getUserName", ["get", "user", "name"]), ("HTTPServer", ["http", "server"]), ("sha256", ["sha", "256"]), ("plain", ["plain"]),
    ("UPPER", ["upper"]), ("parseHTTP2Frame", ["parse", "http", "2", "frame"]), ("foo_barBaz", ["foo", "bar", "baz"]), ("Élan vital", ["elan", "vital"]),
])
def test_identifier_parts(spark, text, parts):
    assert spark.createDataFrame([(text,)], "x string").selectExpr(SPARK.parts("x") + " as p").first().p == parts


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_chunks_tile_each_text(spark):
    chunks = QUERIES["chunk_neighbours"](spark, SF)
    assert chunks.filter("not tiles").count() == 0
