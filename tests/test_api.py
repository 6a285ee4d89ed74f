"""Pages through the whole layout, recognition and order pipelines with stand-in models."""

import numpy as np
from pyspark.sql import functions as F

from quire import api
from quire.operators import inference, raster


def test_pages_end_to_end(spark):
    a = np.full((240, 200, 3), 255, np.uint8)
    for top in (20, 120):  # two regions of two lines
        for y in (top, top + 20):
            a[y : y + 10, 20:180] = 0
    df = spark.createDataFrame([(1, "p.png", raster.pack(a)), (2, "q.png", raster.pack(a[:, ::-1]))], "page_id bigint, name string, image struct<h:int,w:int,c:int,data:binary>")
    zoo = inference.Registry()

    def region(x):
        ink = (x[..., 0] < 0.5).any(2)  # rows with ink, filled between lines of a region
        out = np.zeros((*x.shape[:3], 5), np.float32)
        for k in range(len(x)):
            y = np.flatnonzero(ink[k])
            for top in (20, 120):
                if len(y):
                    out[k, top - 2 : top + 32, 10:190, 1] = 1
        out[..., 0] = 0.5
        return out

    zoo.add(inference.Spec("region"), lambda path: region)
    zoo.add(inference.Spec("textline"), lambda path: lambda x: np.stack([x[..., 0], 1 - x[..., 0]], -1))
    zoo.add(inference.Spec("binarization"), lambda path: lambda x: np.stack([x[..., 0], 1 - x[..., 0]], -1))
    zoo.add(inference.Spec("enhancement"), lambda path: lambda x: 1 - x)
    zoo.add(inference.Spec("ocr"), lambda path: lambda x: np.repeat(np.array([[[0.9, 0.1, 0.0], [0.0, 0.1, 0.9], [0.1, 0.8, 0.1]]]), len(x), 0))
    xml = api.layout(df, zoo).cache()
    assert xml.count() == 2
    lines = api.ocr(df, xml.select("page_id", "xml"), zoo, ["a", "-"]).cache()
    assert lines.count() == 8 and {r.text for r in lines.collect()} == {"a-"}
    assert {r.text for r in api.region_texts(lines).collect()} == {"aa"}
    assert [r.id for r in api.reading_order(xml.select("page_id", "xml")).where("page_id = 1").orderBy("ord").collect()] == ["region_0001", "region_0002"]
    assert api.binarize(df, zoo).count() == 2
    assert raster.unpack(api.enhance(df, zoo).where("page_id = 1").first().image.asDict()).min() == 0
    assert api.extract_images(df, zoo).count() == 0
    assert all(abs(r.slope) < 1 for r in api.deskew(df.limit(1), [-4.0, 0.0, 4.0]).collect())
    assert api.regions_of(df, zoo).select(F.sum("area")).first()[0] == 4 * 34 * 180
