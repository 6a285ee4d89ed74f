"""Reading and writing pages: file scans, PAGE-XML in and out, one file a page, HTML pages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.geometry import points_string
from quire.functions.text import conf_string, is_image, is_xml, line_id, region_id, stem

NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
_COORDS = "Coords STRUCT<_points STRING, _conf DOUBLE, Point ARRAY<STRUCT<_x INT, _y INT>>>"
_REGION = f"ARRAY<STRUCT<_id STRING, _type STRING, {_COORDS}>>"
_TEXT = f"ARRAY<STRUCT<_id STRING, _type STRING, _orientation DOUBLE, {_COORDS}, TextLine ARRAY<STRUCT<_id STRING, {_COORDS}, TextEquiv ARRAY<STRUCT<_conf DOUBLE, Unicode STRING>>>>, TextEquiv ARRAY<STRUCT<_conf DOUBLE, Unicode STRING>>>>"
OTHERS = ("ImageRegion", "GraphicRegion", "SeparatorRegion", "TableRegion", "MapRegion", "NoiseRegion")
SCHEMA = (
    "Metadata STRUCT<Creator STRING, Created STRING, LastChange STRING, Comments STRING>, Page STRUCT<_imageFilename STRING, _imageWidth INT, _imageHeight INT, _orientation DOUBLE, _custom STRING, "
    f"Border STRUCT<{_COORDS}>, PrintSpace STRUCT<{_COORDS}>, ReadingOrder STRUCT<OrderedGroup STRUCT<_id STRING, RegionRefIndexed ARRAY<STRUCT<_index INT, _regionRef STRING>>>>, "
    f"TextRegion {_TEXT}, {', '.join(f'{k} {_REGION}' for k in OTHERS)}>"
)
#: Label of each kind in a page raster; later ones are painted over earlier ones.
LABELS = {"paragraph": 1, "heading": 2, "header": 2, "marginalia": 3, "ImageRegion": 4, "SeparatorRegion": 5}
KIND_RANK = ("paragraph", "heading", "drop-capital", "marginalia-left", "marginalia-right", "image", "separator", "table")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder (flat): path, stem, modificationTime, length, content. Content is read only if it is used."""
    return spark.read.format("binaryFile").load(folder).where(is_image(F.col("path"))).withColumn("stem", stem(F.col("path")))


def list_xml(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where(is_xml(F.col("path"))).withColumn("stem", stem(F.col("path")))


def image_with_xml(images: DataFrame, xmls: DataFrame, binarised: DataFrame | None = None) -> DataFrame:
    """Images with the PAGE-XML of the same stem and, if there, the binarised image."""
    both = images.join(xmls.select("stem", F.col("content").alias("xml")), "stem")
    return both if binarised is None else both.join(binarised.select("stem", F.col("content").alias("content_bin")), "stem", "left")


def first_with_prefix(images: DataFrame, stems: DataFrame) -> DataFrame:
    """stems(stem) with the first image (by name) whose file name is the stem, a dot and anything."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    every = images.withColumn("__n", name).select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("__n", r"\.")) - 1), lambda k: F.array_join(F.slice(F.split("__n", r"\."), F.lit(1), k), "."))).alias("__s"))
    best = every.groupBy("__s").agg(F.min_by(F.struct(*images.columns), "__n").alias("image"))
    return stems.join(best, stems["stem"] == F.col("__s")).drop("__s")


def count_by_class(spark: SparkSession, folder: str) -> DataFrame:
    """(class, n): files in each directory of a folder."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return t.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class")).agg(F.count("*").alias("n"))


METS = "mets STRUCT<fileSec STRUCT<fileGrp ARRAY<STRUCT<_USE STRING, file ARRAY<STRUCT<_ID STRING, _MIMETYPE STRING, FLocat STRUCT<_href STRING>>>>>>, structMap ARRAY<STRUCT<_TYPE STRING, div STRUCT<div ARRAY<STRUCT<_ID STRING, _ORDER INT, fptr ARRAY<STRUCT<_FILEID STRING>>>>>>>>"


def mets_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_id, ord, grp, file_id, mimetype, href): the files of METS workspaces with the pages they belong to (null for none)."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(F.col("content").cast("string"), r"(</?|\s)(?:mets|xlink):", "$1").alias("xml"))
    kind = METS.split(" ", 1)[1]
    m = raw.select("path", F.from_xml("xml", kind[len("STRUCT<") : -1]).alias("m")).where("m is not null")
    files = m.select("path", F.explode("m.fileSec.fileGrp").alias("g")).select("path", F.col("g._USE").alias("grp"), F.explode("g.file").alias("f"))
    divs = m.select("path", F.explode("m.structMap").alias("s")).where("s._TYPE = 'PHYSICAL'").select("path", F.explode("s.div.div").alias("d"))
    owners = divs.select("path", F.col("d._ID").alias("page_id"), F.col("d._ORDER").alias("ord"), F.explode("d.fptr").alias("p")).select("path", "page_id", "ord", F.col("p._FILEID").alias("file_id"))
    return files.select("path", "grp", F.col("f._ID").alias("file_id"), F.col("f._MIMETYPE").alias("mimetype"), F.col("f.FLocat._href").alias("href")).join(owners, ["path", "file_id"], "left")


def parse_page(df: DataFrame, xml: str = "xml") -> DataFrame:
    """The column read as PAGE-XML into `pc`; what isn't XML gives nulls."""
    return df.withColumn("pc", F.from_xml(F.col(xml).cast("string"), SCHEMA))


def polygon(coords: Column) -> Column:
    """Points of a Coords element, from its attribute or from the older Point children."""
    pairs = F.transform(F.split(F.trim(coords["_points"]), r"\s+"), lambda t: F.struct(F.split(t, ",")[0].cast("int").alias("x"), F.split(t, ",")[1].cast("int").alias("y")))
    old = F.transform(coords["Point"], lambda p: F.struct(p["_x"].alias("x"), p["_y"].alias("y")))
    return F.coalesce(F.when(F.length(F.trim(coords["_points"])) > 0, pairs), old)


def regions(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, kind, ord, conf, poly): text regions by type, others by element; ord from the reading order."""
    page = F.col("pc.Page")

    def listed(element: str) -> Column:
        kind = lambda r: F.coalesce(r["_type"], F.lit("paragraph")) if element == "TextRegion" else F.lit(element)
        return F.transform(page[element], lambda r: F.struct(r["_id"].alias("id"), kind(r).alias("kind"), r["Coords"]["_conf"].alias("conf"), polygon(r["Coords"]).alias("poly")))

    none = F.expr("cast(array() as array<struct<id:string,kind:string,conf:double,poly:array<struct<x:int,y:int>>>>)")
    refs = page["ReadingOrder"]["OrderedGroup"]["RegionRefIndexed"]
    every = F.concat(*[F.coalesce(a, none) for a in map(listed, ("TextRegion", *OTHERS))])
    t = parsed.select(*keys, refs.alias("refs"), F.explode(every).alias("r"))
    place = F.get(F.filter("refs", lambda x: x["_regionRef"] == F.col("r.id")), F.lit(0))["_index"]
    kind = F.when(F.col("r.kind").isin("drop-capital", "signature-mark", "heading", "header", "marginalia", *OTHERS), F.col("r.kind")).otherwise("paragraph")
    return t.select(*keys, F.col("r.id").alias("id"), kind.alias("kind"), place.alias("ord"), F.col("r.conf").alias("conf"), F.col("r.poly").alias("poly"))


def lines(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region_id, line_id, line_idx, poly, text, conf); a line without text has ''."""
    t = parsed.select(*keys, F.explode("pc.Page.TextRegion").alias("r")).select(*keys, F.col("r._id").alias("region_id"), F.posexplode("r.TextLine").alias("line_idx", "l"))
    first = F.get(F.col("l.TextEquiv"), F.lit(0))
    return t.select(*keys, "region_id", F.col("l._id").alias("line_id"), "line_idx", polygon(F.col("l.Coords")).alias("poly"), F.coalesce(first["Unicode"], F.lit("")).alias("text"), first["_conf"].alias("conf"))


def frame(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, w, h, x0, y0, x1, y1): the box of Border, else PrintSpace, else the page."""
    p = F.col("pc.Page")
    poly = F.coalesce(polygon(p["Border"]["Coords"]), polygon(p["PrintSpace"]["Coords"]))
    xs, ys = F.transform(poly, lambda q: q["x"]), F.transform(poly, lambda q: q["y"])
    w, h = p["_imageWidth"], p["_imageHeight"]
    return parsed.select(*keys, w.alias("w"), h.alias("h"), F.coalesce(F.array_min(xs), F.lit(0)).alias("x0"), F.coalesce(F.array_min(ys), F.lit(0)).alias("y0"), F.coalesce(F.array_max(xs), w).alias("x1"), F.coalesce(F.array_max(ys), h).alias("y1"))


def _escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def write_page_xml(pages: DataFrame, region_rows: DataFrame, line_rows: DataFrame, created: Column | None = None) -> DataFrame:
    """(page_id, name, xml) of pages(page_id, name, h, w, num_col, slope), regions(page_id, region_idx, kind, ord, conf, poly) and lines(page_id, region_idx, line_idx, poly, text, conf).

    Pages may have a `border` polygon, regions a `slope`. Regions stand by kind, then by index, and get ids in that order; the reading
    order has left marginals, text by `ord`, right marginals.
    """
    coords = lambda p, c=None: F.concat(F.lit('<Coords points="'), points_string(p), F.lit('"'), F.coalesce(F.concat(F.lit(' conf="'), conf_string(c), F.lit('"')), F.lit("")) if c is not None else F.lit(""), F.lit("/>"))
    place = F.array_position(F.array(*[F.lit(k) for k in KIND_RANK]), F.col("kind"))
    rank = F.when(place > 0, place).otherwise(F.lit(len(KIND_RANK) + 1))
    w = Window.partitionBy("page_id").orderBy("rank", "region_idx")
    numbered = region_rows.withColumn("rank", rank).withColumn("n", F.row_number().over(w))
    text_of = line_rows.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "region_idx").orderBy("line_idx")))
    line_xml = F.concat(
        F.lit('<TextLine id="'), line_id(F.col("n"), F.col("k")), F.lit('">'), coords(F.col("l.poly")),
        F.when(F.col("l.text").isNotNull(), F.concat(F.lit("<TextEquiv"), F.coalesce(F.concat(F.lit(' conf="'), conf_string(F.col("l.conf")), F.lit('"')), F.lit("")), F.lit("><Unicode>"), _escape(F.col("l.text")), F.lit("</Unicode></TextEquiv>"))).otherwise(F.lit("")),
        F.lit("</TextLine>"),
    )
    both = text_of.select("page_id", "region_idx", "k", F.struct("poly", "text", "conf").alias("l")).join(numbered.select("page_id", "region_idx", "n"), ["page_id", "region_idx"])
    per_region = both.withColumn("x", line_xml).groupBy("page_id", "region_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), "").alias("lines"))
    tag = F.when(F.col("rank") <= 5, "TextRegion").when(F.col("rank") == 6, "ImageRegion").when(F.col("rank") == 7, "SeparatorRegion").otherwise("TableRegion")
    kind = F.when(F.col("rank") <= 5, F.concat(F.lit(' type="'), F.regexp_replace("kind", "-(left|right)$", ""), F.lit('"'))).otherwise(F.lit(""))
    r = numbered.join(per_region, ["page_id", "region_idx"], "left").withColumn("tag", tag)
    turn = F.when((F.col("rank") <= 5) & F.col("slope").isNotNull(), F.concat(F.lit(' orientation="'), (-F.col("slope")).cast("string"), F.lit('"'))) if "slope" in region_rows.columns else F.lit(None)
    r = r.withColumn("x", F.concat(F.lit("<"), "tag", F.lit(' id="'), region_id(F.col("n")), F.lit('"'), kind, F.coalesce(turn, F.lit("")), F.lit(">"), coords(F.col("poly"), F.col("conf")), F.coalesce("lines", F.lit("")), F.lit("</"), "tag", F.lit(">")))
    side = F.when(F.col("rank") == 4, 0).when(F.col("rank") <= 3, 1).when(F.col("rank") == 5, 2)
    body = r.withColumn("side", side).groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n", "x"))), lambda s: s["x"]), "").alias("body"),
        F.array_sort(F.collect_list(F.when(F.col("side").isNotNull(), F.struct("side", F.coalesce("ord", "n").alias("o"), "n")))).alias("refs"),
    )
    ref = F.array_join(F.transform("refs", lambda s, i: F.concat(F.lit('<RegionRefIndexed index="'), i.cast("string"), F.lit('" regionRef="'), region_id(s["n"]), F.lit('"/>'))), "")
    stamp = F.date_format(created if created is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    p = pages.join(body, "page_id", "left")
    xml = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{NAMESPACE}"><Metadata><Creator>quire</Creator><Created>'), stamp, F.lit("</Created><LastChange>"), stamp, F.lit("</LastChange><Comments>num_col "), F.col("num_col").cast("string"), F.lit("</Comments></Metadata><Page imageFilename=\""),
        _escape(F.col("name")), F.lit('" imageWidth="'), F.col("w").cast("string"), F.lit('" imageHeight="'), F.col("h").cast("string"), F.lit('" readingDirection="left-to-right" textLineOrder="top-to-bottom" orientation="'), (-F.col("slope")).cast("string"), F.lit('" custom="layout {num_col:'), F.col("num_col").cast("string"), F.lit(';}">'),
        F.coalesce(F.when(F.size("border") > 0, F.concat(F.lit("<Border>"), coords(F.col("border")), F.lit("</Border>"))), F.lit("")) if "border" in pages.columns else F.lit(""),
        F.when(F.size("refs") > 0, F.concat(F.lit('<ReadingOrder><OrderedGroup id="reading_order">'), ref, F.lit("</OrderedGroup></ReadingOrder>"))).otherwise(F.lit("")), F.coalesce("body", F.lit("")), F.lit("</Page></PcGts>"),
    )
    return p.select("page_id", "name", xml.alias("xml"))


def written_stems(spark: SparkSession, folder: str) -> DataFrame | None:
    """(stem) of the files in a folder; null where there is none yet. No content is read."""
    try:
        return spark.read.format("binaryFile").load(folder).select(stem(F.col("path")).alias("stem")).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def save_files(df: DataFrame, folder: str, name: str = "name", content: str = "xml", suffix: str = ".xml", overwrite: bool = False) -> int:
    """Writes the content of each row to folder/stem.suffix, whole or not at all, and tells how many; names that are there are skipped unless overwritten.

    Files are written where the rows are, to a path or URI that all executors see, under a
    name of the attempt's own first, so that a task that is run again does no harm.
    """
    t = df.select(stem(F.col(name)).alias("stem"), F.col(content).alias("value"))
    done = None if overwrite else written_stems(df.sparkSession, folder)
    if done is not None:
        t = t.join(done, "stem", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(path, recursive=True)
        for b in batches:
            n = 0
            for s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s is not None and v is not None:
                    part = f"{path}/.{s}.{uuid.uuid4().hex}"
                    with where.open_output_stream(part) as f:
                        f.write(v if isinstance(v, bytes) else v.encode())
                    where.move(part, f"{path}/{s}{suffix}")
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return t.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def save_pages(df: DataFrame, folder: str, name: str = "name", content: str = "xml", overwrite: bool = False) -> int:
    """One stem.xml a page."""
    return save_files(df, folder, name, content, ".xml", overwrite)


def html_regions(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, tag, pos, kind, text) of an HTML page, read once: h1 a heading, p a paragraph, nav and footer marginalia, div an image or advert."""
    kinds = {"h1": "heading", "p": "paragraph", "nav": "marginalia", "footer": "marginalia", "div": "image"}

    def found(i: int, tag: str, kind: str) -> Column:
        raw = F.regexp_extract_all(F.col(html), F.lit(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1))
        return F.transform(raw, lambda r, n: F.struct(F.lit(i).alias("tag"), n.alias("pos"), F.lit(kind).alias("kind"), F.trim(F.regexp_replace(r, "<[^>]*>", "")).alias("text")))

    return pages.select(key, F.inline(F.concat(*[found(i, t, k) for i, (t, k) in enumerate(kinds.items())])))
