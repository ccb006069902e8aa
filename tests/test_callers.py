"""Callers through long chains of transparent nodes."""

from changeloom.operators import graph


def test_callers_behind_a_long_chain(spark):
    edges = [(f"t{i}", f"t{i - 1}") for i in range(1, 13)] + [("t0", "end"), ("real", "t12"), ("t0", "t12")]
    clear = spark.createDataFrame([(f"t{i}",) for i in range(13)], "node string")
    got = graph.direct_callers(spark.createDataFrame(edges, "src string, dst string"), clear)
    assert {r["caller"] for r in got.filter("node = 'end'").collect()} == {"real"}
