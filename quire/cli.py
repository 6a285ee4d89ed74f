"""The command line: folders of images or PAGE-XML in, one file a page out.

    python -m quire layout -di in -o out --zoo my_models:registry
    python -m quire models list --zoo my_models:registry

`--zoo module:name` names an `inference.Registry` or a function that makes one from the
model folder (-m). Without a Spark session of its own configuration (spark-submit) it
runs on this machine.
"""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import api
from quire.operators import groundtruth, inference, metrics, overlay, raster
from quire.sources import images as files
from quire.sources import pages

log = logging.getLogger("quire")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-m", "--model-basedir", default=".", help="folder of the models")
    p.add_argument("-mv", "--model-overrides", nargs=3, action="append", default=[], metavar=("CATEGORY", "VARIANT", "PATH"))
    p.add_argument("-l", "--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR", "OFF"])
    p.add_argument("--zoo", default="", help="module:name of the model registry")
    p.add_argument("--master", default="", help="Spark master; by default what spark-submit says, else all cores of this machine")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, images: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        one = c.add_mutually_exclusive_group(required=True)
        one.add_argument("-i", "--image" if images else "--input", dest="one")
        one.add_argument("-di", "--dir-in", dest="dir")
        c.add_argument("-o", "--out", required=True)
        c.add_argument("-O", "--overwrite", action="store_true")
        return c

    c = add("layout", "frame, regions, lines and reading order as PAGE-XML")
    c.add_argument("-r2l", "--right2left", action="store_true")
    c.add_argument("-tile", "--tile", type=int, nargs=2, metavar=("H", "W"))
    c.add_argument("-si", "--save-images", help="folder for the image regions")
    c.add_argument("-sl", "--save-layout", help="folder for overlays of what was found")
    c.add_argument("-H", "--halt-fail", type=float, default=0.0, help="pages that may fail: a share below 1, or a number")
    c = add("binarization", "ink black on white")
    c.add_argument("-tile", "--tile", type=int, nargs=2)
    c = add("enhancement", "the model's picture of each page")
    c.add_argument("-sos", "--save-org-scale", action="store_true", help="at the size of the page (always so here)")
    c = add("extract-images", "image regions as files")
    c.add_argument("-least", "--least", type=int, default=150)
    c = add("ocr", "text of the lines of PAGE-XML")
    c.add_argument("-dx", "--dir-xmls", required=True)
    c.add_argument("-cs", "--charset", required=True, help="a file with one symbol a line")
    c.add_argument("-min", "--min-conf", type=float, default=0.3)
    c = add("machine-based-reading-order", "the reading order of PAGE-XML by the pairwise model, or by boxes without one", images=False)
    m = sub.add_parser("models", help="the model registry").add_subparsers(dest="action", required=True)
    m.add_parser("list")
    m.add_parser("package").add_argument("out")
    g = sub.add_parser("generate-gt", help="training data from PAGE-XML").add_subparsers(dest="action", required=True)
    for name in ("pagexml2label", "reading-order", "export-lines", "image-enhancement"):
        c = g.add_parser(name)
        c.add_argument("-dx", "--dir-xml", required=name != "image-enhancement")
        c.add_argument("-di", "--dir-imgs", required=name in ("export-lines", "image-enhancement"))
        c.add_argument("-o", "--out", required=True)
        c.add_argument("-c", "--config", help="JSON: labels, boundaries, widths (pagexml2label) or scales (image-enhancement)")
        c.add_argument("-t", "--type", choices=["2d", "3d"], default="2d")
        c.add_argument("-ps", "--printspace", action="store_true")
        c.add_argument("-p", "--prefix", default="")
        c.add_argument("-nmask", "--no-mask", action="store_true")
        c.add_argument("-min", "--min-area", type=float, default=0.0)
    c = add("inference", "labels of a model for each image")
    c.add_argument("-c", "--category", required=True)
    c.add_argument("-gt", "--ground-truth", help="folder of label images: prints the mean IoU")
    c.add_argument("-tile", "--tile", type=int, nargs=2)
    c = sub.add_parser("ensembling", help="the mean of several checkpoints")
    c.add_argument("-i", "--in", dest="checkpoints", action="append", required=True)
    c.add_argument("-o", "--out", required=True)
    c = sub.add_parser("build", help="a network with random or given weights")
    c.add_argument("kind")
    c.add_argument("shape", type=int, nargs=3)
    c.add_argument("-o", "--out", required=True)
    c.add_argument("-s", "--start")
    c.add_argument("-n", "--classes", type=int, default=2)
    return p


def registry(args: argparse.Namespace) -> inference.Registry:
    if not args.zoo:
        raise SystemExit("--zoo module:name is needed")
    module, _, name = args.zoo.partition(":")
    found = getattr(importlib.import_module(module), name or "registry")
    zoo = found if isinstance(found, inference.Registry) else found(args.model_basedir)
    for category, variant, path in args.model_overrides:
        zoo.override(category, variant, path)
    return zoo


def session(args: argparse.Namespace) -> SparkSession:
    if args.master or SparkSession.getActiveSession() is None:
        from quire.session import local_session, share_code

        spark = SparkSession.builder.master(args.master).getOrCreate() if args.master else local_session()
        share_code(spark)
        return spark
    return SparkSession.getActiveSession()


def _images(spark: SparkSession, args: argparse.Namespace, done: str | None = None) -> DataFrame:
    """(page_id, name, stem, image) of the folder or file, without those that are done."""
    t = pages.list_images(spark, args.one or args.dir)
    ready = None if args.overwrite or done is None else pages.written_stems(spark, done)
    t = t if ready is None else t.join(ready, "stem", "left_anti")
    named = files.with_images(t.select(F.xxhash64("path").alias("page_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "stem", "content"))
    bad = named.where("image is null").count() if log.isEnabledFor(logging.DEBUG) else 0
    if bad:
        log.warning("%d files could not be read", bad)
    return named.where("image is not null")


def _save_images(df: DataFrame, folder: str, name: str, overwrite: bool) -> int:
    return pages.save_files(files.as_png(df), folder, name, "png", ".png", overwrite)


def _xml(spark: SparkSession, path: str) -> DataFrame:
    t = pages.list_xml(spark, path)
    return t.select(F.xxhash64("stem").alias("page_id"), "stem", F.concat("stem", F.lit(".xml")).alias("name"), F.col("content").cast("string").alias("xml"))


def _regions_by_page(parsed: DataFrame) -> DataFrame:
    """(page_id, w, h, num_col, frame, regions) for the ground-truth operators."""
    r = pages.regions(parsed, ["page_id"])
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in pages.LABELS.items() for x in (k, v)]), F.col("kind")), F.lit(0))
    short = F.lower(F.regexp_replace("kind", "Region$", ""))
    listed = r.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", short.alias("kind"), label.alias("label"), F.col("ord").cast("int").alias("ord"), "poly"))).alias("regions"))
    comment = F.regexp_extract(F.col("pc.Metadata.Comments"), r"num_col\s*(\d+)", 1).try_cast("int")
    f = pages.frame(parsed, ["page_id"]).select("page_id", "w", "h", F.struct("x0", "y0", "x1", "y1").alias("frame"))
    return parsed.select("page_id", "stem", comment.alias("num_col")).join(f, "page_id").join(listed, "page_id", "left")


def layout(spark: SparkSession, args: argparse.Namespace) -> None:
    zoo, src = registry(args), _images(spark, args, args.out)
    tile = tuple(args.tile) if args.tile else None
    done = api.layout(src, zoo, tile, args.right2left)
    n = pages.save_pages(done, args.out, overwrite=args.overwrite)
    if args.halt_fail:
        inference.failures(src.join(pages.written_stems(spark, args.out).withColumn("ok", F.lit(True)), "stem", "left").select(F.coalesce("ok", F.lit(False)).alias("ok")), "ok", args.halt_fail)
    if args.save_images:
        cut = api.extract_images(src, zoo, 1).join(src.select("page_id", "stem"), "page_id")
        _save_images(cut.withColumn("file", F.format_string("%s_%03d.png", "stem", "region_idx")), args.save_images, "file", args.overwrite)
    if args.save_layout:
        r = pages.regions(pages.parse_page(done), ["page_id"])
        label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in pages.LABELS.items() for x in (k, v)]), F.col("kind")), F.lit(6))
        listed = r.where("poly is not null").groupBy("page_id").agg(F.collect_list(F.struct(label.alias("label"), "ord", "poly")).alias("regions"))
        _save_images(overlay.page_overlays(src.join(listed, "page_id")).join(src.select("page_id", "name"), "page_id"), args.save_layout, "name", args.overwrite)
    log.info("%d pages written", n)


def binarization(spark: SparkSession, args: argparse.Namespace) -> None:
    _save_images(api.binarize(_images(spark, args, args.out), registry(args), tuple(args.tile) if args.tile else None), args.out, "name", args.overwrite)


def enhancement(spark: SparkSession, args: argparse.Namespace) -> None:
    _save_images(api.enhance(_images(spark, args, args.out), registry(args)), args.out, "name", args.overwrite)


def extract_images(spark: SparkSession, args: argparse.Namespace) -> None:
    src = _images(spark, args)
    cut = api.extract_images(src, registry(args), args.least).join(src.select("page_id", "stem"), "page_id")
    _save_images(cut.withColumn("file", F.format_string("%s_%03d.png", "stem", "region_idx")), args.out, "file", args.overwrite)


def ocr(spark: SparkSession, args: argparse.Namespace) -> None:
    src = _images(spark, args, args.out)
    xml = _xml(spark, args.dir_xmls).drop("page_id").join(src.select("stem", "page_id"), "stem")
    charset = Path(args.charset).read_text(encoding="utf-8").splitlines()
    read = api.ocr(src, xml.select("page_id", "xml"), registry(args), charset, args.min_conf)
    text = api.region_texts(read).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_id", "text"))).alias("r"))
    out = text.join(src.select("page_id", "name"), "page_id").select("name", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"))
    pages.save_files(out, args.out, "name", "text", ".txt", args.overwrite)


def machine_based_reading_order(spark: SparkSession, args: argparse.Namespace) -> None:
    xml = _xml(spark, args.one or args.dir)
    zoo = registry(args) if args.zoo else None
    model = zoo is not None and any(c == "reading_order" for c, _ in zoo.specs)
    order = api.reading_order_by_model(xml, zoo) if model else api.reading_order(xml)
    pages.save_pages(api.with_order(xml, order), args.out, overwrite=args.overwrite)


def models(spark: SparkSession, args: argparse.Namespace) -> None:
    zoo = registry(args)
    rows = [(s.category, s.variant, s.filename, "yes" if s.filename and Path(zoo.path(*k)).exists() else "no", s.help) for k, s in sorted(zoo.specs.items())]
    if args.action == "list":
        spark.createDataFrame(rows, "category string, variant string, filename string, installed string, help string").show(len(rows), False)
    else:
        for _, _, name, there, _ in rows:
            if there == "yes":
                print(f"tar -rf {args.out} -C {args.model_basedir} {name}")


def generate_gt(spark: SparkSession, args: argparse.Namespace) -> None:
    config = json.loads(Path(args.config).read_text()) if args.config else {}
    if args.action == "image-enhancement":
        args.one, args.dir, args.overwrite = None, args.dir_imgs, True
        made = groundtruth.degraded(_images(spark, args), config.get("scales", [0.5]), ["stem"])
        _save_images(made.withColumn("file", F.concat("stem", F.lit("_"), "variant", F.lit(".png"))), args.out, "file", True)
        return
    parsed = pages.parse_page(_xml(spark, args.dir_xml))
    if args.action == "pagexml2label":
        config.setdefault("labels", {"paragraph": 1, "heading": 2, "header": 2, "marginalia": 3, "image": 4, "separator": 5})
        by_page = _regions_by_page(parsed)
        made = groundtruth.label_rasters(by_page, config, colour=args.type == "3d", crop=args.printspace)
        _save_images(made.join(by_page.select("page_id", F.concat("stem", F.lit(".png")).alias("file")), "page_id"), args.out, "file", True)
    elif args.action == "reading-order":
        by_page = _regions_by_page(parsed)
        made = groundtruth.order_pairs(by_page, least=args.min_area).join(by_page.select("page_id", "stem"), "page_id")
        named = made.withColumn("file", F.format_string("%s_%d_%d_%d.png", "stem", "i", "j", "cls"))
        _save_images(named, args.out, "file", True)
    else:
        args.one, args.dir, args.overwrite = None, args.dir_imgs, True
        src = _images(spark, args)
        lines = pages.lines(parsed, ["stem"]).join(src.select("stem", "page_id"), "stem")
        made = groundtruth.line_crops(src, lines, args.prefix, not args.no_mask)
        _save_images(made.withColumn("file", F.concat("name", F.lit(".png"))), args.out, "file", True)
        pages.save_files(made.withColumn("file", F.concat("name", F.lit(".txt"))), args.out, "file", "text", ".txt", True)


def infer(spark: SparkSession, args: argparse.Namespace) -> None:
    src = _images(spark, args, args.out)
    seg = inference.segment(src, "image", registry(args).loader(args.category), ["name", "stem"], tuple(args.tile) if args.tile else None)
    _save_images(seg.select("name", F.col("label").alias("image")), args.out, "name", args.overwrite)
    if args.ground_truth:
        truth = files.with_images(pages.list_images(spark, args.ground_truth).select("stem", "content")).select("stem", F.col("image").alias("truth"))
        counts = raster.pair_counts(seg.join(truth, "stem"), "truth", "label", ["stem"])
        metrics.mean_iou(counts, "truth", "label", "n").show()


def ensembling(spark: SparkSession | None, args: argparse.Namespace) -> None:
    from quire.models.networks import Weights, mean_weights

    mean_weights([Weights.load(p) for p in args.checkpoints]).save(args.out)


def build(spark: SparkSession | None, args: argparse.Namespace) -> None:
    from quire.models.networks import build_and_save

    build_and_save(args.kind, tuple(args.shape), args.out, start=args.start, classes=args.classes)


_RUN = {
    "layout": layout, "binarization": binarization, "enhancement": enhancement, "extract-images": extract_images, "ocr": ocr, "machine-based-reading-order": machine_based_reading_order,
    "models": models, "generate-gt": generate_gt, "inference": infer, "ensembling": ensembling, "build": build,
}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(level=100 if args.log_level == "OFF" else args.log_level, format="%(levelname)s %(name)s: %(message)s")
    _RUN[args.command](None if args.command in ("ensembling", "build") else session(args), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
