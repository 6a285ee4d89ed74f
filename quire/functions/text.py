"""Line text, identifiers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HYPHENS = "-⸗¬"
IMAGE = r"(?i)\.(jpe?g|png|tiff?)$"


def is_image(path: Column) -> Column:
    return path.rlike(IMAGE)


def is_xml(path: Column) -> Column:
    return path.rlike(r"\.xml$")


def stem(path: Column) -> Column:
    """The file name without folder and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def local_name(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^\{[^}]*\}", "")


def namespace(tag: Column) -> Column:
    return F.regexp_extract(tag, r"\{([^}]*)\}", 1)


def _number(i: Column, cut: bool) -> Column:
    return F.lpad(i.cast("string"), 4, "0") if cut else F.format_string("%04d", i)


def region_id(i: Column, cut: bool = False) -> Column:
    """region_0001; numbers of more than four digits stay whole, or are cut to their first four, as by SQL's lpad."""
    return F.concat(F.lit("region_"), _number(i, cut))


def line_id(region: Column, line: Column, cut: bool = False) -> Column:
    return F.concat(region_id(region, cut), F.lit("_line_"), _number(line, cut))


def glue_lines(lines: Column) -> Column:
    """Several lines: one that ends in a hyphen loses it and takes the next without a blank; a single line stays."""
    joined = F.aggregate(
        lines, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")),
        lambda acc, x: F.struct(
            F.concat(acc["text"], F.when(acc["open"], F.lit("")).otherwise(F.lit(" ")), F.regexp_replace(x, f"[{HYPHENS}]$", "")).alias("text"), x.rlike(f"[{HYPHENS}]$").alias("open")
        ),
    )["text"]
    return F.when(F.size(lines) > 1, joined).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))


def ctc_collapse(symbols: Column, blank: Column) -> Column:
    """Greedy CTC: repeats count once, blanks go."""
    n = F.size(symbols)
    keep = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i == 0) | (F.get(symbols, i) != F.get(symbols, F.greatest(i - 1, F.lit(0))))) & (F.get(symbols, i) != blank))
    return F.when(n > 0, F.transform(keep, lambda i: F.get(symbols, i))).otherwise(F.slice(symbols, 1, 0))


def decode_symbols(ids: Column, charset: list[str], unknown: str = "[UNK]") -> Column:
    table = F.array(*[F.lit(c) for c in charset])
    return F.replace(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(unknown))), ""), F.lit(unknown), F.lit(""))


def vectorize(text: Column, charset: list[str], pad: int, length: int) -> Column:
    """Characters as places in the charset (0 for unknown ones, from 1), padded on the right."""
    table = F.array(*[F.lit(c) for c in charset])
    ids = F.transform(F.slice(F.split(text, ""), 1, length), lambda c: F.array_position(table, c).cast("int"))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def confident_text(text: Column, conf: Column, least: float = 0.3) -> Column:
    """struct(text, conf); below the threshold, or NaN, '' and 0."""
    ok = (conf >= least) & ~F.isnan(conf)
    return F.struct(F.when(ok, text).otherwise(F.lit("")).alias("text"), F.when(ok, conf).otherwise(F.lit(0.0)).alias("conf"))


def columns_of_comment(comment: Column) -> Column:
    return F.regexp_extract(comment, r"num_col\s+(\d+)", 1).try_cast("int")


def conf_string(conf: Column) -> Column:
    return F.when(conf.isNotNull(), F.format_string("%.2f", conf))
