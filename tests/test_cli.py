"""The command line over folders of files, with stand-in models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import api, cli
from quire.operators import groundtruth, inference, overlay, raster, regions
from quire.sources import images, pages
from tests import stand_ins

ZOO = ["--zoo", "tests.stand_ins:registry"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    (at / "in").mkdir()
    (at / "in" / "a.png").write_bytes(images.encode_png(stand_ins.page()))
    (at / "in" / "b.ppm.PNG").write_bytes(images.encode_png(stand_ins.page()[:, ::-1]))
    (at / "in" / "broken.png").write_bytes(b"no image")
    (at / "in" / "notes.txt").write_text("no image either")
    cli.main([*ZOO, "layout", "-di", str(at / "in"), "-o", str(at / "xml"), "-si", str(at / "cut"), "-sl", str(at / "drawn")])
    return at


def parsed(spark, folder, name="a"):
    return pages.parse_page(pages.list_xml(spark, str(folder)).where(F.col("stem") == name).select("stem", F.col("content").cast("string").alias("xml")))


def test_layout(spark, folder):
    assert sorted(p.name for p in (folder / "xml").iterdir() if p.suffix == ".xml") == ["a.xml", "b.ppm.xml"]
    p = parsed(spark, folder / "xml").cache()
    page = p.select("pc.Page.*", "pc.Metadata.Comments").first()
    assert page.Comments == "num_col 2" and abs(page._orientation) < 0.6 and page.Border is not None
    assert tuple(pages.frame(p, ["stem"]).first())[1:] == (1600, 900, 5, 5, 1594, 894)
    r = {x.id: x for x in pages.regions(p, ["stem"]).collect()}
    kinds = sorted(x.kind for x in r.values())
    assert kinds == ["ImageRegion", "heading", "marginalia", "paragraph", "paragraph", "paragraph", "paragraph"]
    main = sorted((x for x in r.values() if x.ord is not None and x.kind != "marginalia"), key=lambda x: x.ord)
    left_top = [(min(q.x for q in x.poly), min(q.y for q in x.poly)) for x in main]
    assert [x.kind for x in main][0] == "heading" and [(x // 100, y // 100) for x, y in left_top[1:]] == [(2, 2), (2, 4), (9, 2), (9, 4)]
    lines = pages.lines(p, ["stem"]).groupBy("region_id").count().collect()
    assert sorted(x["count"] for x in lines) == [1, 1, 10, 10, 10, 10] and all(0 < x.conf <= 1 for x in r.values())
    before = {q: q.stat().st_mtime_ns for q in (folder / "xml").glob("*.xml")}
    cli.main([*ZOO, "layout", "-di", str(folder / "in"), "-o", str(folder / "xml")])
    assert before == {q: q.stat().st_mtime_ns for q in (folder / "xml").glob("*.xml")}
    assert len(list((folder / "cut").glob("a_*.png"))) == 1 and len(list((folder / "drawn").glob("*.png"))) == 2
    assert images.decode((folder / "drawn" / "a.png").read_bytes()).shape == (900, 1600, 3)


def test_order_models_and_right_to_left(spark, folder):
    df = spark.createDataFrame([(1, "p.png", raster.pack(stand_ins.page()))], "page_id bigint, name string, image struct<h:int,w:int,c:int,data:binary>")

    def columns_of(xml):
        r = pages.regions(pages.parse_page(xml), ["page_id"]).where("kind = 'paragraph'").orderBy("ord").collect()
        return [min(q.x for q in x.poly) // 100 for x in r]

    assert columns_of(api.layout(df, stand_ins.registry(), right_to_left=True, angles=[0.0])) == [9, 9, 2, 2]
    assert columns_of(api.layout(df, stand_ins.with_order(), angles=[0.0])) == [9, 9, 2, 2]
    cli.main(["--zoo", "tests.stand_ins:with_order", "machine-based-reading-order", "-di", str(folder / "xml"), "-o", str(folder / "ordered")])
    p = parsed(spark, folder / "ordered")
    r = pages.regions(p, ["stem"]).where("kind = 'paragraph'").orderBy("ord").collect()
    assert [min(q.x for q in x.poly) // 100 for x in r] == [9, 9, 2, 2] and pages.frame(p, ["stem"]).first().x0 == 5
    cli.main(["machine-based-reading-order", "-di", str(folder / "xml"), "-o", str(folder / "plain")])
    r = pages.regions(parsed(spark, folder / "plain"), ["stem"]).where("kind = 'paragraph'").orderBy("ord").collect()
    assert sorted(x.ord for x in r) == [x.ord for x in r]


def test_other_commands(spark, folder, tmp_path, capsys):
    src = str(folder / "in")
    (tmp_path / "symbols").write_text("a\n-")
    cli.main([*ZOO, "binarization", "-i", f"{src}/a.png", "-o", str(tmp_path / "bin")])
    a = images.decode((tmp_path / "bin" / "a.png").read_bytes())
    assert set(np.unique(a)) == {0, 255} and (a[..., 0] == 0).sum() == (stand_ins.page() <= 1).all(2).sum()
    cli.main([*ZOO, "ocr", "-di", src, "-dx", str(folder / "xml"), "-o", str(tmp_path / "text"), "-cs", str(tmp_path / "symbols")])
    assert "aaaaaaaaa" in (tmp_path / "text" / "a.txt").read_text()
    cli.main([*ZOO, "extract-images", "-di", src, "-o", str(tmp_path / "cut")])
    assert len(list((tmp_path / "cut").iterdir())) == 2
    cli.main([*ZOO, "-mv", "page", "", "/other.npz", "models", "list"])
    assert "/other.npz" in capsys.readouterr().out
    for action in ("pagexml2label", "reading-order"):
        cli.main(["generate-gt", action, "-dx", str(folder / "xml"), "-o", str(tmp_path / action)])
    labels = images.decode((tmp_path / "pagexml2label" / "a.png").read_bytes())[..., 0]
    assert set(np.unique(labels)) == {0, 1, 2, 3, 4} and labels[70, 800] == 2 and labels[250, 300] == 1 and labels[750, 700] == 4
    assert len(list((tmp_path / "reading-order").glob("a_*.png"))) == 5 * 4
    cli.main(["generate-gt", "export-lines", "-dx", str(folder / "xml"), "-di", src, "-o", str(tmp_path / "lines")])
    assert not (tmp_path / "lines").exists() or not list((tmp_path / "lines").iterdir())  # no line has a text yet
    cli.main([*ZOO, "inference", "-c", "region", "-di", src, "-o", str(tmp_path / "labels"), "-gt", str(tmp_path / "pagexml2label")])
    assert "mean_iou" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["layout", "-di", src, "-o", "x"])


def test_ground_truth(spark):
    poly = lambda x0, y0, x1, y1: [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    regions_ = [{"kind": "paragraph", "poly": poly(5, 5, 60, 40)}, {"kind": "separator", "poly": poly(0, 45, 99, 47)}, {"kind": "image", "poly": poly(30, 20, 50, 30)}, {"kind": "odd", "poly": poly(70, 5, 90, 20)}]
    config = {"labels": {"paragraph": 1, "separator": 2, "image": 3}, "rest_as_paragraph": True}
    a = groundtruth.label_raster(60, 100, regions_, config, (0, 0, 80, 60))
    assert a[10, 10] == 1 and a[25, 40] == 1 and a[46, 50] == 2 and a[10, 80] == 1 and a[58, 2] == 0
    b = groundtruth.label_raster(60, 100, regions_, config | {"artificial_class_label": 9, "printspace_label": 8, "columns_width": {"2": 50}}, (0, 0, 80, 60), 2)
    assert b.shape == (30, 50) and b[5, 45] == 8 and 9 in b and (b == 1).sum() < (a == 1).sum() / 4
    df = spark.createDataFrame([(1, [(0, 0), (30, 0), (30, 30), (0, 30)]), (2, [(0, 0), (3, 0), (3, 3)]), (3, [(0, 0), (3, 0)])], "i int, poly array<struct<x:int,y:int>>")
    assert sorted((r.i, r.early) for r in groundtruth.usable_regions(df, F.lit(10_000), 0.0001, 0.01).collect()) == [(1, False), (2, True)]
    page = spark.createDataFrame([(1, "p", raster.pack(stand_ins.page()))], "page_id bigint, stem string, image struct<h:int,w:int,c:int,data:binary>")
    lines = spark.createDataFrame([(1, "r1", 0, [(200, 200), (700, 200), (700, 208)], "yes"), (1, "r1", 1, [(200, 216), (700, 216), (700, 224)], ""), (1, "r2", 0, [(200, 232), (700, 232), (700, 240)], "no")], "page_id bigint, region_id string, line_idx int, poly array<struct<x:int,y:int>>, text string")
    got = {r.name: (r.text, r.image.h, r.image.w) for r in groundtruth.line_crops(page, lines, "set").collect()}
    assert got == {"p_line_0_set_masked": ("yes", 9, 501), "p_line_2_set_masked": ("no", 9, 501)}
    assert {r.variant for r in groundtruth.degraded(page, [0.5, 0.25], ["page_id"]).collect()} == {"original", "0.5", "0.25"}
    assert len({tuple(c) for c in groundtruth.colours(9).tolist()}) >= 8


def test_overlays():
    labels = np.zeros((20, 30), np.uint8)
    labels[5:10, 5:10] = 1
    image = np.full((20, 30, 3), 200, np.uint8)
    assert (overlay.over(labels, image)[0, 0] == 200).all() and tuple(overlay.over(labels, image)[6, 6]) == (228, 100, 100)
    assert overlay.painted(np.array([[0, 99]])).shape == (1, 2, 3) and overlay.gray(labels)[6, 6].tolist() == [1, 1, 1]
    a = overlay.arrows(image, [(2, 2), (25, 2), (25, 15)])
    assert (a[2, 12] == (0, 0, 255)).all() and (a[10, 25] == (0, 0, 255)).all() and (a[18, 2] == 200).all()
    assert (overlay.outlined(image, [([(1, 1), (8, 1), (8, 8), (1, 8)], (9, 9, 9))], filled=True)[4, 4] == 9).all()
    assert overlay.matrix(np.array([[3, 1], [0, 0]]), 2).shape == (4, 4, 3) and overlay.profile(np.arange(10), [3])[0, 3].tolist() == [255, 0, 0]
    assert overlay.text_size(275, 60, 10) == 50 and overlay.text_size(10, 10, 10) == 10 and overlay.text_size(110, 40, 10) == 20


def test_frames_and_features(spark):
    m = np.zeros((900, 1600), np.uint8)
    m[100:800, 200:1400] = 1
    df = spark.createDataFrame([(1, raster.pack(m)), (2, raster.pack(m * 0)), (3, None)], "page_id int, label struct<h:int,w:int,c:int,data:binary>")
    got = {r.page_id: r for r in regions.frames(df, spread=3).collect()}
    assert tuple(got[1])[1:5] == (197, 97, 1403, 803) and tuple(got[2])[1:5] == (0, 0, 1600, 900) and got[3].x0 is None
    two = np.zeros((900, 1600), np.uint8)
    for x in (250, 900):
        for y in range(100, 800, 20):
            two[y : y + 10, x : x + 450] = 1
    df = spark.createDataFrame([(1, raster.pack(raster.turn(two * 255, 3.0) > 127), 2), (2, raster.pack(m * 0), None), (3, None, 1)], "page_id int, label struct<h:int,w:int,c:int,data:binary>, n int")
    got = {r.page_id: r for r in regions.page_features(df, "n").collect()}
    assert got[1].num_col == 2 and abs(got[1].slope + 3) < 0.5 and (got[2].num_col, got[2].slope) == (1, 0.0) and got[3].slope is None
    assert inference.Registry().specs == {}


def test_working_sizes_and_line_images(spark):
    small = stand_ins.page(300, 600)
    df = spark.createDataFrame([(1, "p.png", raster.pack(small))], "page_id bigint, name string, image struct<h:int,w:int,c:int,data:binary>")
    zoo = stand_ins.registry()
    r = api.working_images(df, zoo).first()
    assert (r.image.w, r.image.h, r.num_col, r.scale_x) == (1000, 500, 1, 1000 / 600)
    zoo.add(inference.Spec("col_classifier"), lambda path: lambda x: np.repeat([[0.0, 0.0, 0.95, 0.05, 0.0, 0.0]], len(x), 0))
    assert (lambda r: (r.image.w, r.num_col))(api.working_images(df, zoo).first()) == (3000, 3)
    assert (lambda r: (r.image.w, r.num_col))(api.working_images(df, zoo, upper=2).first()) == (1300, 2)
    calls = []
    zoo.add(inference.Spec("once"), lambda path: calls.append(path) or (lambda x: x))
    load = zoo.loader("once")
    assert load() is load() and len(calls) == 1 and zoo.asdict()["page"] == "page.npz"
    a = np.full((200, 300, 3), 255, np.uint8)
    a[50:60, 20:280] = 0
    tilted = raster.turn(a, 8.0, 255)
    m = tilted[..., 0] < 128
    y, x = np.nonzero(m)
    outline = [(int(x.min()), int(y[x == x.min()].max())), (int(x.max()), int(y[x == x.max()].min())), (int(x.max()), int(y[x == x.max()].max()) + 2), (int(x.min()), int(y[x == x.min()].max()) + 8)]
    assert api.line_image(tilted, outline).shape[0] < 40 and api.line_image(a, [(400, 1), (410, 2), (400, 9)]) is None
    assert api.line_image(a.transpose(1, 0, 2), [(50, 20), (59, 20), (59, 279), (50, 279)]).shape[:2] == (10, 260)
    one = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.5)], "i int, text string, conf double")
    two = spark.createDataFrame([(1, "x", 0.9), (2, "y", 0.5)], "i int, text string, conf double")
    assert sorted((r.i, r.text) for r in inference.voted(one, two, ["i"]).collect()) == [(1, "x"), (2, "b")]


def test_tables_and_a_fuller_model(spark):
    df = spark.createDataFrame([(1, "p.png", raster.pack(stand_ins.page()))], "page_id bigint, name string, image struct<h:int,w:int,c:int,data:binary>")
    zoo = stand_ins.registry()

    def at(x0, x1, y0, y1, k, n):
        def model(x):
            out = np.zeros((*x.shape[:3], n), np.float32)
            out[..., 0] = 0.4
            out[:, y0:y1, x0:x1, k] = 0.8
            return out

        return lambda path: model

    zoo.add(inference.Spec("table"), at(890, 1420, 450, 660, 1, 2))
    zoo.add(inference.Spec("full_layout"), at(190, 720, 190, 400, 2, 8))
    r = api.analysed(df, zoo, angles=[0.0]).select(F.inline("regions")).collect()
    assert sorted(x.kind for x in r) == ["heading", "heading", "image", "marginalia-left", "paragraph", "paragraph", "table"]
    assert next(x.conf for x in r if x.kind == "table") == 204 / 255 and sum(len(x.lines) for x in r) == 32
    assert sorted(x.ord for x in r if x.kind in ("heading", "paragraph")) == [0, 1, 2, 3]
