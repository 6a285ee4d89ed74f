"""The user's entry points: whole pipelines over DataFrames of pages.

`images` is (page_id bigint, name string, image struct<h, w, c, data>) everywhere;
models come from an `inference.Registry`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import scores
from quire.functions.geometry import bbox
from quire.operators import inference
from quire.operators import lines as lines_
from quire.operators import ordering, polygons, raster, regions
from quire.sources import pages


def binarize(images: DataFrame, zoo: inference.Registry, tile: tuple[int, int] | None = None) -> DataFrame:
    """(page_id, name, image): ink black on white."""
    return inference.binarise(images, "image", zoo.loader("binarization"), ["page_id", "name"], tile)


def enhance(images: DataFrame, zoo: inference.Registry) -> DataFrame:
    """(page_id, name, image): the model's picture of each page, at the page's size."""
    load = zoo.loader("enhancement")

    def kernel(a: np.ndarray) -> np.ndarray:
        got = load()(a[None].astype(np.float32) / 255)[0]
        return raster.resize(np.clip(np.rint(got * 255), 0, 255).astype(np.uint8), *a.shape[:2])

    return raster.map_images(images.select("page_id", "name", "image"), "image", kernel)


def working_images(images: DataFrame, zoo: inference.Registry, lower: int | None = None, upper: int | None = None, better: bool = True) -> DataFrame:
    """(page_id, name, image, num_col, scale_x, scale_y): pages at the working size of their number of columns, by the model `col_classifier` or the bounds where they agree; what had to grow goes through `enhancement` if wished and there."""
    have = {c for c, _ in zoo.specs}
    if lower is not None and lower == upper or "col_classifier" not in have:
        t = images.select("page_id", "name", "image", F.struct(F.lit(upper or lower or 1).alias("num_col"), F.lit(1.0).alias("conf")).alias("c"))
    else:
        scored = inference.classify(images, "image", zoo.loader("col_classifier"), ["page_id", "name", "image"], (448, 448))
        t = scored.withColumn("c", scores.column_class(F.col("scores"), lower, upper)).drop("scores")
    w, h, n, conf = F.col("image.w"), F.col("image.h"), F.col("c.num_col"), F.col("c.conf")
    t = t.withColumn("size", F.when(n <= 2, scores.small_working_size(n, conf, w, h)).otherwise(scores.working_size(n, conf, w, h)))
    load = zoo.loader("enhancement") if better and "enhancement" in have else None
    schema = T.StructType([images.schema["page_id"], images.schema["name"], T.StructField("image", raster.IMAGE), T.StructField("num_col", T.IntegerType()), T.StructField("scale_x", T.DoubleType()), T.StructField("scale_y", T.DoubleType())])
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if load is None else load()
        for b in batches:
            made, sx, sy = [], [], []
            for v, s in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
                a = raster.unpack(v)
                new = None if a is None else raster.resize(a, max(1, s["h"]), max(1, s["w"]))
                if model is not None and new is not None and new.shape[1] > a.shape[1]:
                    new = np.clip(np.rint(raster.resize(model(new[None].astype(np.float32) / 255)[0], *new.shape[:2]) * 255), 0, 255).astype(np.uint8)
                made.append(raster.pack(new))
                sx.append(None if a is None else new.shape[1] / a.shape[1])
                sy.append(None if a is None else new.shape[0] / a.shape[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, kind), b.column(3), pa.array(sx, pa.float64()), pa.array(sy, pa.float64())], names=schema.names)

    return t.select("page_id", "name", "image", n.cast("int").alias("num_col"), "size").mapInArrow(run, schema)


def regions_of(images: DataFrame, zoo: inference.Registry, min_share: float = 0.0002, tile: tuple[int, int] | None = None) -> DataFrame:
    """(page_id, region_idx, kind, x0, y0, x1, y1, area, conf, poly): components of each label that cover at least a share of the page, with their outlines."""
    seg = inference.segment(images, "image", zoo.loader("region"), ["page_id"], tile)
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in regions.KINDS.items() for x in (k, v)]), F.col("label"))
    return regions.found(seg, ["page_id"], min_share).withColumn("kind", F.coalesce(kind, F.lit("paragraph"))).select("page_id", "region_idx", "kind", "x0", "y0", "x1", "y1", "area", "conf", "poly")


def analysed(images: DataFrame, zoo: inference.Registry, tile: tuple[int, int] | None = None, min_share: float = 0.0002, right_to_left: bool = False, angles: list[float] | None = None) -> DataFrame:
    """(page_id, name, h, w, num_col, slope, border, regions with their lines): all models of a page where it is, nothing shuffled.

    Needs the models `region` and `textline`; `page` (frame), `table`, `full_layout` (drop
    capitals, headings), `col_classifier` and `reading_order` are used where the registry
    has them.
    """
    keys, have = ["page_id", "name"], {c for c, _ in zoo.specs}
    t = images.select(*keys, "image")
    for category, tiled in (("region", tile), ("textline", tile), ("page", None), ("table", tile), ("full_layout", tile)):
        if category in have or category in ("region", "textline"):
            t = inference.segment(t, "image", zoo.loader(category), t.columns, tiled).withColumnsRenamed({"label": f"m_{category}", "conf": f"c_{category}"})
        else:
            t = t.withColumns({f"{k}_{category}": F.lit(None).cast(raster.IMAGE) for k in "mc"})
    if "col_classifier" in have:
        got = inference.classify(t, "image", zoo.loader("col_classifier"), [c for c in t.columns if c != "image"], (448, 448))
        t = got.withColumn("expected", scores.column_class(F.col("scores"))["num_col"].cast("int"))
    else:
        t = t.withColumn("expected", F.lit(None).cast("int"))
    t = t.withColumnsRenamed({"m_region": "label", "c_region": "conf", "m_textline": "line", "m_page": "page", "m_table": "table", "c_table": "table_conf", "m_full_layout": "full"})
    return regions.layout(t, keys, zoo.loader("reading_order") if "reading_order" in have else None, min_share, right_to_left, None if angles is None else np.array(angles))


def crop_boxes(images: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(page_id, keys, image): the boxes (x0, y0, x1, y1) cut from their pages; a page travels once, with the list of its boxes."""
    listed = boxes.groupBy("page_id").agg(F.collect_list(F.struct(*keys, "x0", "y0", "x1", "y1")).alias("boxes"))
    both = images.select("page_id", "image").join(listed, "page_id")
    schema = T.StructType([both.schema["page_id"], *(boxes.schema[k] for k in keys), T.StructField("image", raster.IMAGE)])
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            element = b.schema.field("boxes").type.value_type
            for i, (v, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                a = raster.unpack(v)
                cuts = [] if a is None else [raster.pack(a[max(0, o["y0"]) : o["y1"], max(0, o["x0"]) : o["x1"]]) for o in own]
                rows = own if cuts else []
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows), pa.int64())), *(pa.array([o[k] for o in rows], element.field(k).type) for k in keys), pa.array(cuts, kind)], names=schema.names)

    return both.select("page_id", "image", "boxes").mapInArrow(run, schema)


def line_image(a: np.ndarray, outline: list[tuple[int, int]], height: int = 32) -> np.ndarray | None:
    """A line cut from its page, white outside its outline, upright: turned by its moments from three degrees on; one that fills less than half its box and is long is straightened piece by piece."""
    x, y = [p[0] for p in outline], [p[1] for p in outline]
    box = max(0, min(x)), min(a.shape[1], max(x) + 1), max(0, min(y)), min(a.shape[0], max(y) + 1)
    if box[0] >= box[1] or box[2] >= box[3]:
        return None
    m = polygons.fill([outline], box)
    cut = np.where(m[..., None], a[box[2] : box[3], box[0] : box[1]], 255).astype(np.uint8)
    if cut.shape[0] > cut.shape[1] * 1.4:  # a standing line
        return np.rot90(cut, -1).copy()
    if m.mean() < 0.5 and cut.shape[1] * height / cut.shape[0] > 90:
        return lines_.straightened(cut, m, height)
    angle = lines_.moments_angle(m)
    if 3 < abs(angle) < 45:
        cut, m = raster.turn(cut, angle, 255, True), raster.turn(m.astype(np.uint8) * 255, angle, 0, True) > 127
        yy, xx = np.nonzero(m)
        cut = cut[yy.min() : yy.max() + 1, xx.min() : xx.max() + 1]
    return cut


def line_images(images: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(page_id, keys, image) of lines (page_id, keys, poly), each as `line_image` makes it; a page travels once, with the list of its lines."""
    listed = lines.where(F.size("poly") > 0).groupBy("page_id").agg(F.collect_list(F.struct(*keys, "poly")).alias("lines"))
    both = images.select("page_id", "image").join(listed, "page_id")
    schema = T.StructType([both.schema["page_id"], *(lines.schema[k] for k in keys), T.StructField("image", raster.IMAGE)])
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            element = b.schema.field("lines").type.value_type
            for i, (v, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                a = raster.unpack(v)
                got = [] if a is None else [(o, line_image(a, [(p["x"], p["y"]) for p in o["poly"]])) for o in own]
                got = [(o, c) for o, c in got if c is not None]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(got), pa.int64())), *(pa.array([o[k] for o, _ in got], element.field(k).type) for k in keys), pa.array([raster.pack(c) for _, c in got], kind)], names=schema.names)

    return both.mapInArrow(run, schema)


def layout(images: DataFrame, zoo: inference.Registry, tile: tuple[int, int] | None = None, right_to_left: bool = False, angles: list[float] | None = None) -> DataFrame:
    """(page_id, name, xml): frame, regions, lines, slopes and reading order of each page as PAGE-XML.

    The pages' analysis is persisted, since regions and lines are both read from it.
    """
    done = analysed(images, zoo, tile, right_to_left=right_to_left, angles=angles).persist(StorageLevel.MEMORY_AND_DISK)
    found = done.select("page_id", F.inline("regions"))
    listed = found.select("page_id", "region_idx", F.inline("lines")).select("page_id", "region_idx", "line_idx", "poly", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("conf"))
    return pages.write_page_xml(done.drop("regions"), found.select("page_id", "region_idx", "kind", "ord", "conf", "slope", "poly"), listed)


def ocr(images: DataFrame, xmls: DataFrame, zoo: inference.Registry, charset: list[str], least: float = 0.3, binary: DataFrame | None = None) -> DataFrame:
    """(page_id, region_id, line_id, line_idx, text, conf) of the lines of each page's PAGE-XML (page_id, xml).

    Lines are cut along their outlines and made upright. With binary images of the same
    pages each line is read twice and the surer reading stays. Uses the model `ocr`.
    """
    found = pages.lines(pages.parse_page(xmls), ["page_id"])
    keys = ["region_id", "line_id", "line_idx"]
    read = lambda src: inference.recognise(line_images(src, found.select("page_id", *keys, "poly"), keys), "image", zoo.loader("ocr"), charset, ["page_id", *keys], least=least)
    return read(images) if binary is None else inference.voted(read(images), read(binary), ["page_id", *keys])


def region_texts(lines: DataFrame) -> DataFrame:
    """(page_id, region_id, text): hyphens at line ends resolved."""
    from quire.functions.text import glue_lines

    t = lines.groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "text"))).alias("l"))
    return t.select("page_id", "region_id", glue_lines(F.transform("l", lambda s: s["text"])).alias("text"))


def reading_order(xmls: DataFrame) -> DataFrame:
    """(page_id, id, ord) of the paragraphs and headings of PAGE-XML (page_id, xml), by XY-cut of their boxes."""
    r = pages.regions(pages.parse_page(xmls), ["page_id"]).where(F.col("kind").isin("paragraph", "heading", "header") & F.col("poly").isNotNull())
    b = r.withColumn("b", bbox(F.col("poly"))).select("page_id", "id", *[F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return ordering.xy_cut_order(b, "page_id", "id")


def reading_order_by_model(xmls: DataFrame, zoo: inference.Registry, sizes: tuple[int, int] = (672, 448)) -> DataFrame:
    """(page_id, id, ord) of the paragraphs and headings of PAGE-XML (page_id, xml), by the pairwise model `reading_order`."""
    parsed = pages.parse_page(xmls)
    r = pages.regions(parsed, ["page_id"]).where(F.col("poly").isNotNull())
    label = F.element_at(F.create_map(*[F.lit(x) for k, v in pages.LABELS.items() for x in (k, v)]), F.col("kind"))
    listed = r.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce(label, F.lit(0)).alias("label"), "id", "kind", "poly"))).alias("regions"))
    both = pages.frame(parsed, ["page_id"]).select("page_id", "w", "h").join(listed, "page_id")
    load, schema = zoo.loader("reading_order"), f"page_id {dict(xmls.dtypes)['page_id']}, id string, ord int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for i, (w, h, own) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                a = np.zeros((h, w), np.uint8)
                for q in own:  # ascending labels: later ones are painted over earlier ones
                    a[polygons.fill([[(p["x"], p["y"]) for p in q["poly"]]], (0, w, 0, h))] = q["label"]
                main = [q for q in own if q["kind"] in ("paragraph", "heading", "header")]
                order = regions.order_by_model(a, [[(p["x"], p["y"]) for p in q["poly"]] for q in main], model, sizes)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(order), pa.int64())), pa.array([main[k]["id"] for k in order], pa.string()), pa.array(range(len(order)), pa.int32())], names=["page_id", "id", "ord"])

    return both.mapInArrow(run, schema)


def with_order(xmls: DataFrame, order: DataFrame) -> DataFrame:
    """PAGE-XML (page_id, xml) with its ReadingOrder replaced by (page_id, id, ord), after the frame if there is one."""
    ref = F.concat(F.lit('<RegionRefIndexed index="'), F.col("s.k").cast("string"), F.lit('" regionRef="'), F.col("s.id"), F.lit('"/>'))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("ord")) - 1
    refs = order.withColumn("s", F.struct(n.alias("k"), "id")).withColumn("x", ref)
    group = refs.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s.k", "x"))), lambda r: r["x"]), "").alias("__refs"))
    new = F.concat(F.lit('<ReadingOrder><OrderedGroup id="reading_order">'), "__refs", F.lit("</OrderedGroup></ReadingOrder>"))
    bare = F.regexp_replace("xml", r"(?s)\s*<(\w+:)?ReadingOrder[ >/].*?</(\w+:)?ReadingOrder>", "")
    head = r"(?s)(<(?:\w+:)?Page\b[^>]*>(?:\s*(?:<(?:\w+:)?AlternativeImage\b[^>]*>|<(?:\w+:)?(?:Border|PrintSpace)\b[^>]*>.*?</(?:\w+:)?(?:Border|PrintSpace)>))*)"
    at = F.length(F.regexp_substr(bare, F.lit(r"(?s)^.*?" + head)))
    xml = F.when(F.col("__refs").isNull(), F.col("xml")).otherwise(F.concat(F.substr(bare, F.lit(1), at), new, F.substr(bare, at + 1)))
    return xmls.join(group, "page_id", "left").withColumn("xml", xml).drop("__refs")


def extract_images(images: DataFrame, zoo: inference.Registry, least: int = 150) -> DataFrame:
    """(page_id, region_idx, image): image regions at least so high and wide."""
    r = regions_of(images, zoo).where("kind = 'image'").where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    return crop_boxes(images, r, ["region_idx"])


def deskew(images: DataFrame, angles: list[float] | None = None) -> DataFrame:
    """(page_id, slope): the angle at which rows of ink stand out most."""
    tried = None if angles is None else np.array(angles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if v is None else raster.skew_angle(255 - raster.unpack(v), tried) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["page_id", "slope"])

    return images.select("page_id", "image").mapInArrow(run, "page_id bigint, slope double")
