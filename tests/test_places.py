"""Places in an order of all units, across parts."""

from pyspark.sql import functions as F

from changeloom.operators import decisions


def test_places_of_all(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(1000).select("id", (F.col("id") * 7 % 10).alias("total"))
        got = {r["id"]: r["place"] for r in decisions.places(rows, [F.desc("total"), F.asc("id")]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i * 7 % 10), i)))}
