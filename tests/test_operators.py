"""Kernels and operators against numpy, and end to end on small pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry, scores, signal, text
from quire.operators import augment, inference, matching, metrics, ordering, raster, runs
from quire.sources import pages
from quire.streaming import pages as streams


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def arr(a):
    return F.array(*[F.lit(float(x)) for x in a])


def test_signal(spark):
    a = np.random.default_rng(1).integers(0, 9, 30).astype(float)
    a[10:13] = 20
    got = one(spark, signal.gaussian_smooth(arr(a), 2.0), signal.find_peaks(arr(a)), signal.spread(arr(a)), signal.softmax(arr(a[:4])), signal.one_hot(F.lit(2), 4), signal.find_peaks(arr([1, 2])), signal.top_peaks(arr(a), 2))
    k = np.array(signal.gaussian_kernel(2.0))
    assert np.allclose(got.c0, np.convolve(np.pad(a, 8, "symmetric"), k, "valid"))
    peaks = [i for i in range(1, 29) if a[i] > a[i - 1] and (j := next((j for j in range(i, 30) if a[j] != a[i]), None)) and a[j] < a[i]]
    assert [p for p in got.c1 if p != 11] == [p for p in peaks if p != 10] and 11 in got.c1
    assert got.c2 == pytest.approx(a.std()) and sum(got.c3) == pytest.approx(1) and got.c4 == [0, 0, 1, 0] and got.c5 == [] and 11 in got.c6


def test_geometry(spark):
    p = F.expr("array(struct(0 as x, 0 as y), struct(10 as x, 0 as y), struct(10 as x, 4 as y), struct(0 as x, 4 as y))")
    f = lambda x, y: geometry.point_in_polygon(F.lit(x), F.lit(y), p)
    r = one(spark, geometry.area(p), geometry.centroid(p), f(5.0, 2.0), f(10.0, 2.0), f(11.0, 2.0), geometry.parse_points(F.lit("1,2 3,4")), geometry.points_string(p), geometry.box_to_rect(*[F.lit(i) for i in (1, 2, 3, 4)]), geometry.parse_points(F.lit("")))
    assert r.c0 == 40 and (round(r.c1.x, 9), round(r.c1.y, 9)) == (5, 2) and (r.c2, r.c3, r.c4) == (1, 0, -1)
    assert [tuple(x) for x in r.c5] == [(1, 2), (3, 4)] and r.c6 == "0,0 10,0 10,4 0,4" and tuple(r.c7) == (2, 6, 1, 4) and r.c8 is None
    w = one(spark, geometry.largest_rotated(F.lit(4.0), F.lit(2.0), F.lit(0.0)), geometry.orientation(F.lit(2.0), F.lit(2.0), F.lit(-1.0)))
    assert (round(w.c0.w, 6), round(w.c0.h, 6)) == (4, 2) and w.c1 == -90


def test_text_and_scores(spark):
    lines = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(
        spark, text.glue_lines(lines("ab-", "cd", "ef¬", "g")), text.glue_lines(lines("ab-")), text.stem(F.lit("/a/b.c.png")), text.ctc_collapse(lines("a", "a", "_", "a", "b"), F.lit("_")),
        text.vectorize(F.lit("ba?"), ["a", "b"], 9, 5), text.confident_text(F.lit("x"), F.lit(float("nan"))), text.columns_of_comment(F.lit("num_col 3")), text.local_name(F.lit("{ns}Page")), text.decode_symbols(F.array(F.lit(0), F.lit(9)), ["q"]),
        scores.early_width(F.lit(9)), text.region_id(F.lit(7)), scores.working_size(F.lit(1), F.lit(0.5), F.lit(3000), F.lit(1000)),
    )
    assert (r.c0, r.c1, r.c2, r.c3) == ("abcd efg", "ab-", "b.c", ["a", "a", "b"]) and r.c4 == [2, 1, 0, 9, 9] and tuple(r.c5) == ("", 0.0)
    assert (r.c6, r.c7, r.c8, r.c9, r.c10, tuple(r.c11)) == (3, "Page", "q", 4000, "region_0007", (3000, 1000))
    with pytest.raises(Exception, match="no width"):
        one(spark, scores.extractor_width(F.lit(7)))


def grid(df, h=40, w=40):
    m = np.zeros((h, w), bool)
    for r in df.collect():
        m[r.y, max(0, r.x0) : r.x1] = True
    return m


def test_runs_equal_pixels(spark):
    rng = np.random.default_rng(2)
    rows = lambda: [(1, int(y), int(x), int(x + n)) for y, x, n in zip(rng.integers(5, 30, 40), rng.integers(5, 25, 40), rng.integers(1, 8, 40))]
    a, b = (spark.createDataFrame(rows(), "m int, y int, x0 int, x1 int") for _ in range(2))
    p, q = grid(a), grid(b)
    k = ["m"]
    assert (grid(runs.union(a, b, k)) == (p | q)).all() and (grid(runs.intersect(a, b, k)) == (p & q)).all() and (grid(runs.subtract(a, b, k)) == (p & ~q)).all()
    around = lambda m, dy, dx: np.stack([np.roll(m, (i, j), (0, 1)) for i in range(-dy, dy + 1) for j in range(-dx, dx + 1)])
    assert (grid(runs.dilate(a, k, 2, 1)) == around(p, 1, 2).any(0)).all() and (grid(runs.erode(a, k, 1, 1)) == around(p, 1, 1).all(0)).all()
    assert {r.x: r.n for r in runs.column_profile(runs.normalise(a, k), k).collect()} == {i: int(n) for i, n in enumerate(p.sum(0)) if n}
    boxes = spark.createDataFrame([(1, 2, 3, 5, 7)], "m int, x0 int, y0 int, x1 int, y1 int")
    assert grid(runs.from_boxes(boxes, k)).sum() == 12 and runs.clip(a, F.lit(0), F.lit(0), F.lit(0), F.lit(9)).count() == 0
    got = runs.component_boxes(runs.components(runs.normalise(a, k), k), k).collect()
    left, count = p.copy(), 0
    while left.any():
        count, todo = count + 1, [tuple(np.argwhere(left)[0])]
        while todo:
            y, x = todo.pop()
            if left[y, x]:
                left[y, x] = False
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert len(got) == count and sum(r.area for r in got) == p.sum()


def test_components_of_many_rows(spark):
    """A U, a frame and a comb of some hundred rows are one component each; two bars are two."""
    n, rows = 300, []
    for y in range(n):
        ends = [(0, 2), (8, 10)]
        rows += [(1, y, *x) for x in ends]  # two bars
        rows += [(2, y, *x) for x in (ends if y < n - 1 else [(0, 10)])]  # U
        rows += [(3, y, *x) for x in (ends if 0 < y < n - 1 else [(0, 10)])]  # frame
        rows += [(4, y, 4 * i, 4 * i + 2) for i in range(5) if y >= 40 * (5 - i)] if y < n - 1 else [(4, y, 0, 18)]  # comb, tops from right to left
    t = spark.createDataFrame(rows, "m int, y int, x0 int, x1 int")
    got = runs.component_boxes(runs.components(t, ["m"]), ["m"]).collect()
    count = {m: sum(r.m == m for r in got) for m in (1, 2, 3, 4)}
    assert count == {1: 2, 2: 1, 3: 1, 4: 1} and sum(r.area for r in got) == sum(r[3] - r[2] for r in rows)


def test_order_and_matching(spark):
    assert ordering.pairwise_order(6, lambda pivot, i: float(i > pivot)) == [0, 1, 2, 3, 4, 5]
    assert ordering.pairwise_order(5, lambda pivot, i: float(i < pivot)) == [4, 3, 2, 1, 0]
    boxes = np.array([[0, 0, 100, 8], [60, 10, 100, 40], [0, 10, 40, 20], [0, 22, 40, 40]])
    assert ordering.xy_cut(boxes) == [0, 2, 3, 1] and ordering.xy_cut(boxes[:0]) == []
    df = spark.createDataFrame([(p, i, *map(int, b)) for p in (1, 2) for i, b in enumerate(boxes)], "page_id int, region_idx int, x0 int, y0 int, x1 int, y1 int")
    got = ordering.xy_cut_order(df).orderBy("page_id", "ord").collect()
    assert [r.region_idx for r in got] == [0, 2, 3, 1] * 2
    halves = spark.createDataFrame([(1, 0, "a", 0.5, 0), (1, 1, "b", 0.2, 1), (1, 2, "c", 0.4, -1)], "r int, i int, text string, conf double, merge_flag int")
    assert [(r.text, round(r.conf, 3)) for r in ordering.merge_halves(halves, ["r"], "i").orderBy("i").collect()] == [("a", 0.5), ("b c", 0.3)]
    pts = spark.createDataFrame([(1, 5.0, 5.0), (1, 50.0, 5.0), (1, 10.0, 3.0)], "page_id int, x double, y double")
    poly = spark.sql("select 1 as page_id, array(struct(0 as x, 0 as y), struct(10 as x, 0 as y), struct(10 as x, 10 as y), struct(0 as x, 10 as y)) as poly")
    assert matching.points_in_polygons(pts, poly).count() == 2 and matching.points_in_polygons(pts, poly, edge=False).count() == 1
    hist = spark.createDataFrame([(1, 10), (2, 10), (8, 10), (9, 10)], "v int, n int")
    assert metrics.otsu(hist, "v").first().threshold == 2


def image(spark, a, **more):
    row = {"page_id": 1, "image": raster.pack(a)}
    return spark.createDataFrame([row], "page_id int, image struct<h:int,w:int,c:int,data:binary>")


def test_raster_and_inference(spark):
    a = np.zeros((90, 120, 3), np.uint8)
    for y in range(10, 80, 12):
        a[y : y + 5, 8:110] = 255
    assert abs(raster.skew_angle(raster.turn(a, 4.0)) + 4) < 0.8 and len(raster.line_rows(a, 1.0)) == 6
    assert (raster.turn(a, 0) == a).all() and raster.resize(a, 45, 60).shape == (45, 60, 3) and set(raster.otsu_mask(a).ravel()) == {0, 255}
    assert raster.trace(a[..., 0][:20] > 0) == [(8, 10), (109, 10), (109, 14), (8, 14)]
    df = image(spark, a)
    ink = lambda: lambda x: np.stack([1 - x[..., 0], x[..., 0]], -1)
    for tile in (None, (40, 40)):
        r = inference.segment(df, "image", ink, ["page_id"], tile).first()
        assert (raster.unpack(r.label.asDict())[..., 0] == (a[..., 0] > 0)).all() and raster.unpack(r.conf.asDict()).min() >= 254
    rr = raster.to_runs(inference.segment(df, "image", ink, ["page_id"]), "label", ["page_id"])
    assert rr.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == (a[..., 0] > 0).sum()
    assert (raster.unpack(inference.binarise(df, "image", ink, ["page_id"]).first().image.asDict())[..., 0] == 255 - a[..., 0]).all()
    assert inference.classify(df, "image", lambda: lambda x: x.mean((1, 2)), ["page_id"], (8, 8)).first().scores is not None
    charset = list("ab")
    steps = np.array([[0.9, 0.05, 0.05], [0.8, 0.1, 0.1], [0.1, 0.1, 0.8], [0.1, 0.7, 0.2]])
    r = inference.recognise(df, "image", lambda: lambda x: np.repeat(steps[None], len(x), 0), charset, ["page_id"]).first()
    assert r.text == "ab" and r.conf == pytest.approx(0.8)
    zoo = inference.Registry("/models")
    zoo.add(inference.Spec("page", "", "page.bin"), lambda path: lambda x: x)
    zoo.override("page", "", "/other.bin")
    assert zoo.path("page") == "/other.bin" and zoo.table(spark).count() == 1
    with pytest.raises(ValueError):
        zoo.get("nothing")
    with pytest.raises(RuntimeError):
        inference.failures(spark.createDataFrame([(True,), (False,)], "ok boolean"), "ok", 0.1)


def test_augment(spark):
    a = np.random.default_rng(3).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    config = {"flip": ["h", "v"], "rotate": [5], "rotate_90": True, "scale": [0.5], "degrade": [0.5], "brighten": [1.5], "blur": ["blur", "gauss", "median"], "padding": [0.2], "shift": ["up", "down_right"], "channels": [(2, 1, 0)], "depth": ["left", "up"], "wave": [2], "invert": True, "noise": (0.05, 0.05), "strips": True, "binary": True}
    got = {r.variant: raster.unpack(r.image.asDict()) for r in augment.augment(image(spark, a), "image", config, ["page_id"]).collect()}
    assert len(got) == 22 and (got["flip_h"] == a[:, ::-1]).all() and (got["invert"] == 255 - a).all() and got["rotate_90"].shape == (30, 20, 3) and got["padding_0.2"].shape == (24, 34, 3)
    again = {r.variant: raster.unpack(r.image.asDict()) for r in augment.augment(image(spark, a), "image", config, ["page_id"]).collect()}
    assert all((got[k] == again[k]).all() for k in got)
    tiles = list(raster.tiles(a, 16, 16, 2))
    assert all(t.shape == (16, 16, 3) for _, t in tiles) and {n for n, _ in tiles} == {f"{y}_{x}" for y in (0, 4) for x in (0, 12, 14)}


def test_page_xml_round_trip(spark, tmp_path):
    poly = "array(struct(1 as x, 2 as y), struct(30 as x, 2 as y), struct(30 as x, 9 as y))"
    page = spark.sql("select 1 as page_id, 'a&b.png' as name, 50 as h, 60 as w, 2 as num_col, 0.25D as slope")
    reg = spark.sql(f"select 1 as page_id, * from values (0, 'marginalia-right', 0), (1, 'paragraph', 2), (2, 'heading', 1), (3, 'image', null), (4, 'marginalia-left', 0) as t(region_idx, kind, ord)").withColumn("poly", F.expr(poly)).withColumn("conf", F.lit(0.5))
    lin = spark.sql("select 1 as page_id, 1 as region_idx, * from values (0, 'x < y', 0.25D), (1, null, null) as t(line_idx, text, conf)").withColumn("poly", F.expr(poly))
    xml = pages.write_page_xml(page, reg, lin, F.lit("2024-01-01").cast("timestamp")).cache()
    p = pages.parse_page(xml)
    got = {(r.id, r.kind): r.ord for r in pages.regions(p, ["page_id"]).collect()}
    assert got == {("region_0001", "paragraph"): 2, ("region_0002", "heading"): 1, ("region_0003", "marginalia"): 0, ("region_0004", "marginalia"): 3, ("region_0005", "ImageRegion"): None}
    assert [(r.line_id, r.text) for r in pages.lines(p, ["page_id"]).orderBy("line_idx").collect()] == [("region_0001_line_0001", "x < y"), ("region_0001_line_0002", "")]
    assert tuple(pages.frame(p, ["page_id"]).first()) == (1, 60, 50, 0, 0, 60, 50)
    assert [pages.save_pages(xml, str(tmp_path / "out"), overwrite=o) for o in (False, False, True)] == [1, 0, 1]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a&b.xml"]
    again = pages.list_xml(spark, str(tmp_path / "out")).withColumn("xml", F.col("content").cast("string"))
    assert pages.regions(pages.parse_page(again), ["stem"]).count() == 5
    framed = pages.write_page_xml(page.withColumn("border", F.expr(poly)), reg.withColumn("slope", F.lit(1.5)), lin)
    p = pages.parse_page(framed)
    assert tuple(pages.frame(p, ["page_id"]).first()) == (1, 60, 50, 1, 2, 30, 9) and [r._orientation for r in p.select("pc.Page.TextRegion").first()[0]] == [-1.5] * 4


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.TIF", "b.png", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"x")
    src = streams.new_files(spark, str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = src.select("stem", "length").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.stem for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    ev = spark.sql("select 1 as k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) as ts, 1.0D as v from values (0), (4), (30) as t(m)")
    assert sorted(r.n for r in streams.sessions(ev, "k", "ts", "10 minutes").collect()) == [1, 2]
    assert streams.windows(ev, "ts", "10 minutes", "v", ["k"], "5 minutes").count() == 4
    ev.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = streams.sessions(s, "k", "ts", "10 minutes").writeStream.format("memory").queryName("got").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("got").count() == 2
