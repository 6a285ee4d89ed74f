"""Operators on what large tables bring: many keys, many images, long numbers, halves between two values."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import geometry, text
from quire.operators import adhere, columns, grouped, matching, metrics, ordering, polygons, raster, runs
from quire.operators.grouped import by_key
from quire.plans import layout
from tests.compare import SF, spark_rows, sql


def test_images_of_many_keys_are_not_held(spark):
    def kernel(t):
        image = pa.array([bytes(1 << 20)])
        return t.slice(0, 1).select(["k"]).append_column("held", pa.array([pa.total_allocated_bytes()])).append_column("image", image)

    got = by_key(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("v")).repartition(1), ["k"], [], kernel, "k bigint, held bigint, image binary")
    n, held = got.coalesce(1).agg(F.count("*"), F.max("held")).first()
    assert n == 200 and held < 40 << 20


def test_page_boxes_of_runs_as_of_images(spark):
    rng = np.random.default_rng(3)
    rows = [(p, int(y), int(x), int(x + n)) for p in range(4) for y, x, n in zip(rng.integers(0, 40, 90), rng.integers(0, 60, 90), rng.integers(2, 9, 90))]
    t = spark.createDataFrame(rows, "m int, y int, x0 int, x1 int")
    big = t.select("m", F.explode(F.sequence(F.col("y") * 10, F.col("y") * 10 + 9)).alias("y"), (F.col("x0") * 10).alias("x0"), (F.col("x1") * 10).alias("x1"))
    image = raster.from_runs(big, ["m"], 400, 700)
    none = F.lit(None).cast("array<struct<x0:int,x1:int,y0:int,y1:int>>")
    want = columns.page_boxes(image.select("m", F.col("image").alias("text"), F.lit(None).cast(raster.IMAGE).alias("seps"), F.lit(2).alias("num_col"), none.alias("headings")), "m")
    assert sorted(map(tuple, columns.page_boxes_of_runs(t, "m", 40, 70, 2, scale=10).collect())) == sorted(map(tuple, want.collect()))


def test_equal_intervals_take_no_room(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 7 + 3)) for i in range(3000)]
    boxes, points = spark.createDataFrame(rows, "b int, low double, high double"), spark.createDataFrame([(i, i % 100 / 10) for i in range(4000)] + [(-1, None)], "p int, at double")
    for closed in (False, True):
        got = matching.contained_in_interval(points, "at", boxes, "low", "high", 3.0, closed=closed, most=100).select("p", "b")
        want = points.crossJoin(boxes).where("low <= at and at <= high" if closed else "low <= at and at < high").select("p", "b")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    matching.contained_in_interval(points, "at", boxes, "low", "high", 3.0).select("p", "b").write.parquet(str(tmp_path / "out"))
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.6 * spark.read.parquet(str(tmp_path / "out")).count()


def test_intersections_are_painted_only_where_they_must_be(spark):
    rng = np.random.default_rng(5)
    rect = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    odd = [None, [], [(0, 0), (5, 5)], [(0, 0), (9, 3), (2, 9)], [(0, 8), (8, 8), (8, 0), (0, 0)], rect(3, 3, 3, 9), [(1, 1), (9, 9), (9, 1), (1, 9)]]
    shapes = odd + [rect(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in rng.integers(0, 12, (40, 4))]
    pairs = [(i, j) for i in range(len(shapes)) for j in range(len(shapes))]
    df = spark.createDataFrame([(i, j, shapes[i], shapes[j]) for i, j in pairs], f"i int, j int, a {polygons.POLY}, b {polygons.POLY}")
    got = {(r.i, r.j): None if r.a is None else [tuple(p) for p in r.a] for r in polygons.intersect_columns(df, "a", "b").collect()}
    assert got == {(i, j): None if shapes[i] is None or shapes[j] is None else polygons.intersection(shapes[i], shapes[j]) for i, j in pairs}
    many = spark.range(200_000, numPartitions=4).selectExpr("id", *(f"transform(array(0, 40, 40, 0), (v, k) -> struct(v + int(id % 50) * {d} as x, if(k < 2, 0, 30) as y)) as {c}" for c, d in (("a", 1), ("b", -1))))
    began = time.time()
    assert polygons.intersect_columns(many, "a", "b").where("a is not null").count() == 200_000 // 50 * 20 and time.time() - began < 30


def test_boxes_alone_are_not_painted(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(x), int(y), int(x + w), int(y + h)) for k, x, y, w, h in zip(rng.integers(0, 60, 150), *rng.integers(0, 14, (2, 150)), *rng.integers(0, 7, (2, 150)))]
    t = spark.createDataFrame([*rows, rows[0], (None, 1, 1, 4, 3), (99, 5, 5, 5, 9)], "k int, x0 int, y0 int, x1 int, y1 int")
    for dx, dy in ((0, 0), (2, 1)):
        got = polygons.box_contours(t, ["k"], dx, dy)
        grown = runs.dilate(runs.from_boxes(t, ["k"]), ["k"], dx, dy)
        want = polygons.contours(grown.withColumn("comp", F.lit(1)), ["k"]).select("k", "poly", F.col("parent").isNotNull().alias("hole"))
        assert got.select("k", "poly", "hole").exceptAll(want).isEmpty() and want.exceptAll(got.select("k", "poly", "hole")).isEmpty()
        size = runs.area(grown, ["k"])
        assert got.select("k", "area").distinct().exceptAll(size).isEmpty() and got.select("k").distinct().count() == size.count()
    began = time.time()
    many = spark.range(100_000).selectExpr("id as k", "int(id % 90) as x0", "3 as y0", "int(id % 90 + 40) as x1", "20 as y1")
    assert polygons.box_contours(many, ["k"], 3, 3).where("area = 46 * 23 and size(poly) = 4").count() == 100_000 and time.time() - began < 30


def test_nearest_pairs_makes_no_others(spark):
    rng = np.random.default_rng(7)

    def plain(a, b):
        dist = lambda x, y: None if None in (*x[2:], *y[2:]) else round(sum((u - v) ** 2 for u, v in zip(x[2:], y[2:])) ** 0.5, 9)
        want = []
        for p in {r[0] for r in a} & {r[0] for r in b} - {None}:
            own = sorted(((dist(x, y), x[1], y[1]) for x in a for y in b if x[0] == y[0] == p), key=lambda t: (t[0] is None, t[0] or 0, *t[1:]))
            first = {}
            for n, (_, i, j) in enumerate(own):
                first.setdefault(("i", i), n), first.setdefault(("j", j), n)
            want += [(p, i, j, d) for d, i, j in own[: max(first.values()) + 1]]
        return sorted(map(str, want))

    kinds = "p int, idx bigint, cx double, cy double, area double"
    for grid in (3, 1000):
        a, b = ([(int(p), k // 2 if grid == 3 else k, *map(float, v)) for k, (p, v) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, grid, (n, 3))))] for n in (40, 25))
        a += [(1, 900, None, 1.0, 1.0), (None, 901, 1.0, 1.0, 1.0), (8, 902, 1.0, 1.0, 1.0)]
        got = matching.nearest_pairs(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), ["p"]).select("p", "i", "j", "d").collect()
        assert sorted(str(tuple(r)) for r in got) == plain(a, b)
    side = lambda n, s: spark.range(n).select(F.lit(1).alias("p"), F.col("id").alias("idx"), (F.rand(s) * 1000).alias("cx"), (F.rand(s + 1) * 1000).alias("cy"), F.rand(s + 2).alias("area"))
    began = time.time()
    assert matching.nearest_pairs(side(20_000, 1), side(5_000, 4), ["p"]).count() < 3_000_000 and time.time() - began < 30


def test_identifiers_from_10000_on(spark, tmp_path):
    spark.range(10_050).selectExpr("id as conv_id", "1 as turn", "'user' as role", "'x' as text").write.parquet(str(tmp_path / "conversations.parquet"))
    assert spark_rows(layout.line_ids(spark, str(tmp_path))) == sql(layout.ORACLES["line_ids"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'"))
    whole = spark.range(1).select(text.region_id(F.lit(12345)).alias("r"), text.line_id(F.lit(7), F.lit(12345)).alias("l")).first()
    assert tuple(whole) == ("region_12345", "region_0007_line_12345")


def test_a_box_that_holds_the_share_exactly_stays(spark):
    rows = [(1, 0, 0, 62)] + [(1, y, 5, 5 + 7 + (y <= 37)) for y in range(1, 40)]  # 372 pixels of 62 x 40, 0.15 of it
    drops = spark.createDataFrame([(0, *r) for r in rows], "p int, c int, y int, x0 int, x1 int")
    assert adhere.fill_boxes(drops, ["p"], "c", 0.15).agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == 372
    assert adhere.fill_boxes(drops, ["p"], "c", 0.149).agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == 62 * 40


def test_labels_under_masks_in_one_sweep(spark):
    rng = np.random.default_rng(8)

    def draw(n, pages):
        return [(int(p), int(y), int(x), int(x + w), int(k)) for p, y, x, w, k in zip(rng.integers(0, pages, n), rng.integers(0, 4, n), rng.integers(0, 20, n), rng.integers(1, 6, n), rng.integers(1, 4, n))]

    layer, mask = draw(120, 6), draw(50, 4)
    kinds = "p int, y int, x0 int, x1 int, label int"
    own, cover = spark.createDataFrame(layer, kinds), spark.createDataFrame(mask, kinds).drop("label")
    pixels = lambda rows: {(p, k, y, x) for p, y, x0, x1, k in rows for x in range(x0, x1)}
    masked = {r[0] for r in mask}
    for only in (False, True):
        for keep in (None, 2):
            got = adhere.set_label(own, cover, ["p"], 3, only, keep).select("p", "y", "x0", "x1", "label").collect()
            new = {(p, y, x) for p, _, y, x in pixels(mask)} - {(p, y, x) for p, k, y, x in pixels(layer) if k == keep}
            want = {(p, k, y, x) for p, k, y, x in pixels(layer) if p not in masked or (p, y, x) not in new and not (only and k == 3)} | {(p, 3, y, x) for p, y, x in new}
            assert pixels(map(tuple, got)) == want
            assert sorted(tuple(r) for r in got if r.p not in masked) == sorted(r for r in layer if r[0] not in masked)
            assert len({(r.p, r.label, r.y, e) for r in got if r.p in masked for e in (r.x0, r.x1)}) == 2 * sum(r.p in masked for r in got)


def test_partitions_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(grouped, "SHARE", 4000)
    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines = t.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("cx"), F.col("l_extendedprice").alias("cy"), F.col("l_discount").alias("w"), F.col("l_tax").alias("h"))
    masks = t.selectExpr("l_suppkey as m", "int(l_orderkey % 40) as y", "int(l_partkey % 60) as x0", "int(l_partkey % 60 + l_linenumber + 1) as x1", "l_linenumber as l")
    box = t.selectExpr("l_orderkey as page_id", "l_linenumber as region_idx", "int(l_partkey % 500) as x0", "int(l_partkey % 500 + 20) as x1", "int(l_suppkey % 300) as y0", "int(l_suppkey % 300 + 9) as y1")
    cover = masks.select("m", "y", "x0", "x1")
    for df in (
        ordering.line_order(lines, ["l_orderkey"], "cx", "cy", "w", "h", "l_linenumber"), runs.normalise(masks, ["m"]), runs.erode(masks, ["m"], 1, 1), runs.opened(masks, ["m"], 1, 1),
        adhere.small_lines_to_large(masks.withColumn("size", F.lit(2400)), ["m"], "l", F.lit(0.05)), adhere.absorb_covered(masks, cover, ["m"], "l"),
        adhere.region_confidence(masks, cover.withColumn("value", F.lit(1)), ["m"], "l"), matching.match_boxes(box, box.withColumn("box_idx", F.col("region_idx"))),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "Window" not in plan.split("REPARTITION_BY_NUM")[-1]


def test_polygons_travel_as_numbers(spark):
    rng = np.random.default_rng(9)
    shapes = [(int(p), k, [(int(x), int(y)) for x, y in zip(*rng.integers(0, 600, (2, 5)))]) for k, p in enumerate(rng.integers(0, 5, 80))] + [(1, 800, None), (1, 801, [])]
    polys = spark.createDataFrame(shapes, f"page_id int, k int, poly {polygons.POLY}")
    points = spark.createDataFrame([(int(p), int(x), int(y)) for p, x, y in zip(rng.integers(0, 5, 200), *rng.integers(0, 600, (2, 200)))], "page_id int, x int, y int")
    for edge in (True, False):
        df = matching.points_in_polygons(points, polys, edge=edge)
        want = points.join(polys, "page_id").where(geometry.point_in_polygon(F.col("x"), F.col("y"), F.col("poly")) >= (0 if edge else 1)).select(*df.columns)
        assert df.exceptAll(want).isEmpty() and want.exceptAll(df).isEmpty() and df.count()
    plan = matching.points_in_polygons(points, polys).select("page_id", "k")._jdf.queryExecution().optimizedPlan().toString()
    sent = [x for x in plan.splitlines() if "RepartitionByExpression" in x]
    assert len(sent) == 2 and "poly AS" not in plan.split("RepartitionByExpression")[0]


def test_edits_of_long_lines(spark):
    rng = np.random.default_rng(10)
    texts = ["", "a", "ß€x", *("".join(rng.choice(list("abcß€ "), int(n))) for n in rng.integers(1, 90, 40))]
    pairs = [(i, x, texts[-i - 1]) for i, x in enumerate(texts)] + [(98, None, "a"), (99, "a", None)]
    t = metrics.with_edits(spark.createDataFrame(pairs, "i int, a string, b string"), "a", "b", "e")
    assert t.where(~F.col("e").eqNullSafe(F.levenshtein("a", "b"))).isEmpty()
    long = ["".join(rng.choice(list("abcdefgh "), 12_000)) for _ in range(2)]
    began = time.time()
    assert 0 < metrics.edits(*long) < 12_000 and time.time() - began < 2
