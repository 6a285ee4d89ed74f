"""Lines, drop capitals, labels and confidences on small masks."""

from pyspark.sql import functions as F

from quire.operators import adhere
from quire.plans import shapes
from tests.compare import spark_rows, sql


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lines_drops_labels(spark):
    lines = spark.createDataFrame([(1, 1, y, 0, 50, 10_000) for y in range(4)] + [(1, 2, 3, 40, 60, 10_000), (1, 3, 9, 0, 5, 10_000)], "p int, l int, y int, x0 int, x1 int, size int")
    got = adhere.small_lines_to_large(lines, ["p"], "l", F.lit(0.005)).select("p", "l", "y", "x0", "x1")
    assert rows(got) == [(1, 1, 0, 0, 50), (1, 1, 1, 0, 50), (1, 1, 2, 0, 50), (1, 1, 3, 0, 60)]
    drops = spark.createDataFrame([(1, 1, 0, 0, 4), (1, 1, 1, 0, 3), (1, 2, 0, 10, 20), (1, 2, 9, 10, 11)], "p int, c int, y int, x0 int, x1 int")
    full = adhere.fill_boxes(drops, ["p"], "c")
    assert rows(full.select("c", "y", "x0", "x1")) == [(1, 0, 0, 4), (1, 1, 0, 4), (2, 0, 10, 20), (2, 9, 10, 11)]
    assert rows(adhere.absorb_covered(drops, full.where("c = 1"), ["p"], "c")) == [(1, 1)]
    layer = spark.createDataFrame([(1, 1, 0, 0, 10), (1, 2, 0, 10, 12), (2, 1, 0, 0, 3)], "p int, label int, y int, x0 int, x1 int")
    mask = spark.createDataFrame([(1, 0, 8, 11)], "p int, y int, x0 int, x1 int")
    cols = ["p", "label", "y", "x0", "x1"]
    assert rows(adhere.set_label(layer, mask, ["p"], 2).select(*cols)) == [(1, 1, 0, 0, 8), (1, 2, 0, 8, 12), (2, 1, 0, 0, 3)]
    assert rows(adhere.set_label(layer, mask, ["p"], 2, only=True).select(*cols)) == [(1, 1, 0, 0, 8), (1, 2, 0, 8, 11), (2, 1, 0, 0, 3)]
    assert rows(adhere.set_label(layer, mask, ["p"], 3, keep=2).select(*cols)) == [(1, 1, 0, 0, 8), (1, 2, 0, 10, 12), (1, 3, 0, 8, 10), (2, 1, 0, 0, 3)]
    scores = spark.createDataFrame([(1, 0, 0, 2, 0.5), (1, 0, 2, 4, 1.0)], "p int, y int, x0 int, x1 int, value double")
    assert rows(adhere.region_confidence(drops.where("c = 1 and y = 0"), scores, ["p"], "c")) == [(1, 1, 0.75)]
    profile = spark.createDataFrame([(1, x, 100 if 20 <= x <= 180 and x not in (60, 140) else 1) for x in range(0, 201)], "p int, x int, n int")
    assert rows(adhere.main_bounds(profile, ["p"], 5)) == [(1, 60, 140)]


def test_confidence_ties(spark):
    """Means are rounded from exact sums: four regions of sf0.01 lie halfway between two roundings."""
    sf = "/root/testdata/sf0.01"
    exact = shapes.ORACLES["region_confidence"].replace("round(avg((y % 10) / 10.0), 4)", "((2000 * sum(y % 10) + count(*)) // (2 * count(*))) / 10000")
    assert "avg" not in exact
    assert spark_rows(shapes.region_confidence(spark, sf)) == sql(exact, sf)
