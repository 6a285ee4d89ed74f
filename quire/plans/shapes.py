"""Queries on polygons, moments, losses, names, halves, assignments and pairs of shapes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry, scores, signal, text
from quire.operators import adhere, columns, matching, metrics, ordering, polygons, runs
from quire.plans.layout import _BOX, _PIX, _RUNS, boxes, mask
from quire.session import table
from quire.sources import pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _poly(*points):
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])


@query(f"""
WITH r AS ({_BOX}), p AS (SELECT o_orderkey AS page_id, o_custkey % 500 AS x, o_orderkey % 300 AS y FROM orders),
l AS (SELECT *, x0 + 9 AS xm, y0 + 3 AS ym FROM r)
SELECT page_id, region_idx, x::BIGINT AS x, y::BIGINT AS y FROM p JOIN l USING (page_id)
WHERE (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND ym) OR (x BETWEEN x0 AND xm AND y BETWEEN y0 AND y1)
""")
def points_in_concave(spark: SparkSession, sf: str) -> DataFrame:
    """One point a page against L-shaped polygons, edges included."""
    c = {n: F.col(n) for n in ("x0", "y0", "x1", "y1")}
    xm, ym = c["x0"] + 9, c["y0"] + 3
    shape = _poly((c["x0"], c["y0"]), (c["x1"], c["y0"]), (c["x1"], ym), (xm, ym), (xm, c["y1"]), (c["x0"], c["y1"]))
    found = boxes(spark, sf).select("page_id", "region_idx", shape.alias("poly"))
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 500).cast("bigint").alias("x"), (F.col("o_orderkey") % 300).cast("bigint").alias("y"))
    return matching.points_in_polygons(points, found).select("page_id", "region_idx", "x", "y")


@query(f"""
WITH r AS ({_BOX}), s AS (SELECT page_id, region_idx, x0, y0, x1, y1, x1 - x0 + 7 AS w, y1 - y0 + 7 AS h FROM r)
SELECT DISTINCT page_id, region_idx, ((x0 - 3) || ',' || (y0 - 3) || ' ' || (x1 + 3) || ',' || (y0 - 3) || ' ' || (x1 + 3) || ',' || (y1 + 3) || ' ' || (x0 - 3) || ',' || (y1 + 3)) AS points, w * h AS area FROM s
""")
def box_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes as masks, grown by three pixels and traced: their outlines and areas."""
    keys = ["page_id", "region_idx", "x0", "y0", "x1", "y1"]  # ids stand twice in the table
    half_open = boxes(spark, sf).withColumn("x1", F.col("x1") + 1).withColumn("y1", F.col("y1") + 1)
    found = polygons.box_contours(half_open, keys, 3, 3).where("not hole")
    return found.select("page_id", "region_idx", geometry.points_string(F.col("poly")).alias("points"), F.col("area").cast("int").alias("area"))


@query(f"""
WITH r AS ({_BOX}), a AS (SELECT * FROM r WHERE region_idx % 2 = 1), j AS (SELECT a.page_id, a.region_idx, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM a JOIN r b ON b.page_id = a.page_id AND b.region_idx = a.region_idx + 1)
SELECT page_id, region_idx, (x1 - x0) * (y1 - y0) AS area FROM j WHERE x0 < x1 AND y0 < y1
""")
def polygon_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Each odd box cut with its next one."""
    c = {n: F.col(n) for n in ("x0", "y0", "x1", "y1")}
    shape = _poly((c["x0"], c["y0"]), (c["x1"], c["y0"]), (c["x1"], c["y1"]), (c["x0"], c["y1"]))
    b = boxes(spark, sf).select("page_id", "region_idx", shape.alias("poly"))
    pairs = b.where("region_idx % 2 = 1").join(b.select("page_id", (F.col("region_idx") - 1).alias("region_idx"), F.col("poly").alias("other")), ["page_id", "region_idx"])
    cut = polygons.intersect_columns(pairs, "poly", "other")
    return cut.where("poly is not null").select("page_id", "region_idx", geometry.area(F.col("poly")).cast("int").alias("area"))


@query("""
WITH p AS (SELECT l_suppkey AS k, l_quantity AS x, l_linenumber * l_discount * 100 AS y FROM lineitem),
m AS (SELECT k, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM p GROUP BY k)
SELECT k, round(CASE WHEN a = b THEN CASE WHEN c < 0 THEN -90 ELSE 90 END ELSE degrees(atan2(2 * c, a - b)) / 2 END, 4) AS angle FROM m
""")
def main_axis(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * F.col("l_discount") * 100).alias("y"))
    m = p.groupBy("k").agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    return m.select("k", F.round(geometry.orientation(F.col("a"), F.col("b"), F.col("c")), 4).alias("angle"))


@query("""
SELECT l_suppkey, CASE WHEN abs(s / pi() * 180) < 10 THEN 0 WHEN abs(s / pi() * 180) > 200 THEN 1 ELSE 2 END AS cls
FROM (SELECT l_suppkey, regr_slope(l_discount * 100, l_quantity) AS s FROM lineitem GROUP BY l_suppkey HAVING count(*) > 2)
""")
def line_classes(spark: SparkSession, sf: str) -> DataFrame:
    t = matching.slopes(table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y")), ["l_suppkey"], "x", "y")
    return t.select("l_suppkey", geometry.line_class(F.col("slope")).alias("cls"))


@query("""
WITH t AS (SELECT p_partkey, p_size::DOUBLE + 1 AS w, (p_retailprice % 50)::DOUBLE + 1 AS h, radians(p_partkey % 90 + 0.5) AS a FROM part),
u AS (SELECT *, abs(sin(a)) AS s, abs(cos(a)) AS c, greatest(w, h) AS long, least(w, h) AS short FROM t),
v AS (SELECT *, short <= 2 * s * c * long OR abs(s - c) < 1e-10 AS half, w >= h AS wide, c * c - s * s AS d FROM u)
SELECT p_partkey, round(CASE WHEN half THEN CASE WHEN wide THEN short / 2 / s ELSE short / 2 / c END ELSE (w * c - h * s) / d END, 4) AS w,
  round(CASE WHEN half THEN CASE WHEN wide THEN short / 2 / c ELSE short / 2 / s END ELSE (h * c - w * s) / d END, 4) AS h FROM v
""")
def largest_rotated(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    r = geometry.largest_rotated(F.col("p_size").cast("double") + 1, (F.col("p_retailprice") % 50).cast("double") + 1, F.radians(F.col("p_partkey") % 90 + 0.5))
    return p.select("p_partkey", r.alias("r")).select("p_partkey", F.round("r.w", 4).alias("w"), F.round("r.h", 4).alias("h"))


@query("""
WITH p AS (SELECT vec_id, label, [exp(x::DOUBLE) for x in embedding] AS e FROM embeddings), q AS (SELECT vec_id, label, [x / list_sum(e) for x in e] AS p FROM p),
r AS (SELECT *, p[label + 1] AS t FROM q)
SELECT vec_id, round(-0.25 * (1 - t) ** 2 * ln(t), 5) AS focal, round((t + 1) / (t + 0.2 * (1 - t) + 0.8 * (1 - t) + 1), 5) AS tversky,
  round((1 - (t + 100) / (2 - t + 100)) * 100, 5) AS jaccard,
  round(2 * t / 1.000001 / (1e6 * (1 - t) + (1 + t) / 1.000001), 6) AS dice, round(((t + 0.5) / 2), 5) AS mixed FROM r
""")
def loss_family(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of each vector read as class scores, against its label."""
    p, y = signal.softmax(F.transform("embedding", lambda x: x.cast("double"))), signal.one_hot(F.col("label"), 64)
    t = table(spark, sf, "embeddings").select("vec_id", p.alias("p"), F.transform(y, lambda v: v.cast("double")).alias("y"), "label")
    hit = F.get("p", F.col("label").cast("int"))
    focal, dice = scores.focal_loss(F.col("y"), F.col("p")), scores.generalized_dice(F.col("y"), F.col("p"))
    return t.select(
        "vec_id", F.round(focal, 5).alias("focal"), F.round(scores.tversky(hit, 1 - hit, 1 - hit), 5).alias("tversky"), F.round(scores.jaccard_distance(F.col("y"), F.col("p")), 5).alias("jaccard"),
        F.round(dice, 6).alias("dice"), F.round(scores.superposition([hit, F.lit(0.5)], [1.0, 1.0]), 5).alias("mixed"),
    )


@query(r"""
SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem, regexp_matches(lower(url || '.TIFF'), '\.(jpe?g|png|tiff?)$') AS image, regexp_matches(url, '\.xml$') AS xml,
  'region_' || lpad((page_id % 1000)::VARCHAR, 4, '0') || '_line_' || lpad((page_id % 7)::VARCHAR, 4, '0') AS line_id, (page_id % 9)::INT AS n_col,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE printf('%.2f', (page_id % 100) / 100.0) END AS conf FROM pages
""")
def names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    conf = F.when(F.col("page_id") % 3 != 0, (F.col("page_id") % 100) / 100.0)
    return p.select(
        "page_id", text.stem(F.col("url")).alias("stem"), text.is_image(F.concat("url", F.lit(".TIFF"))).alias("image"), text.is_xml(F.col("url")).alias("xml"),
        text.line_id(F.col("page_id") % 1000, F.col("page_id") % 7).alias("line_id"), text.columns_of_comment(F.concat(F.lit("made by hand; num_col "), (F.col("page_id") % 9).cast("string"))).alias("n_col"), text.conf_string(conf).alias("conf"),
    )


_CHARS = "abcdefghijklmnopqrstuvwxyz "


@query(f"""
WITH t AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % 10 / 10.0 AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN c >= 0.3 THEN text ELSE '' END AS text, round(CASE WHEN c >= 0.3 THEN c ELSE 0 END, 2)::DOUBLE AS conf,
  array_to_string([CASE WHEN i > length(text) THEN 99 ELSE coalesce(list_position(string_split('{_CHARS}', ''), text[i]), 0) END for i in range(1, 33)], ' ') AS ids FROM t
""")
def line_text(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as recognised lines: doubtful ones emptied, characters as places in a charset, padded to 32."""
    t = table(spark, sf, "conversations").withColumn("c", ((F.col("conv_id") * 7 + F.col("turn")) % 10) / 10)
    sure = text.confident_text(F.col("text"), F.col("c"))
    return t.select("conv_id", "turn", text.vectorize(F.col("text"), list(_CHARS), 99, 32).alias("v"), sure.alias("s")).select("conv_id", "turn", "s.text", F.round("s.conf", 2).alias("conf"), F.array_join(F.col("v").cast("array<string>"), " ").alias("ids"))


@query("""
WITH t AS (SELECT conv_id, turn, text, (turn % 4) / 4.0 AS conf, CASE WHEN n % 3 = 1 AND last THEN 0 WHEN n % 3 = 1 THEN 1 WHEN n % 3 = 2 THEN -1 ELSE 0 END AS flag FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM conversations)),
w AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t2, lead(conf) OVER (PARTITION BY conv_id ORDER BY turn) AS c2 FROM t)
SELECT conv_id, turn, CASE WHEN flag = 1 THEN concat_ws(' ', text, t2) ELSE text END AS text, round(CASE WHEN flag = 1 THEN (conf + c2) / 2 ELSE conf END, 4)::DOUBLE AS conf FROM w WHERE flag <> -1
""")
def merged_halves(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines cut in two: every first and second of three are halves of one."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text", ((F.col("turn") % 4) / 4).alias("conf"), F.row_number().over(w).alias("n"), F.lead("turn").over(w).isNull().alias("last"))
    flag = F.when((F.col("n") % 3 == 1) & ~F.col("last"), 1).when(F.col("n") % 3 == 2, -1).otherwise(0)
    return ordering.merge_halves(t.withColumn("merge_flag", flag), ["conv_id"], "turn").select("conv_id", "turn", "text", F.round("conf", 4).alias("conf"))


@query("""
WITH l AS (SELECT doc_id, (x[2])::INT AS n, x[1] AS line FROM (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS x FROM documents)),
p AS (SELECT doc_id, n, line AS truth, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS read FROM l), q AS (SELECT * FROM p WHERE read IS NOT NULL AND truth <> ''),
c AS (SELECT *, list_distinct(string_split(truth, '') || string_split(read, '')) AS d FROM q),
-- characters as single bytes, for edits are counted in bytes here
e AS (SELECT *, levenshtein(array_to_string([chr((list_position(d, x))::INT) for x in string_split(truth, '')], ''), array_to_string([chr((list_position(d, x))::INT) for x in string_split(read, '')], '')) AS k FROM c)
SELECT doc_id, n, k::BIGINT AS edits, length(truth)::BIGINT AS chars, round(k / length(truth), 6) AS cer, len(string_split(truth, ' '))::BIGINT AS words FROM e
""")
def line_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Character error rates of every line of every document, read as the line before it."""
    from pyspark.sql import Window

    l = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "truth"))
    p = l.withColumn("read", F.lag("truth").over(Window.partitionBy("doc_id").orderBy("n"))).where("read is not null and truth <> ''")
    return metrics.line_rates(p, F.col("truth"), F.col("read"), ["doc_id", "n"]).drop("word_edits", "wer")


@query("""
WITH s AS (SELECT s_nationkey AS nation, s_suppkey AS i, s_suppkey % 97 AS ax, s_suppkey % 89 AS ay, round(s_acctbal / 1000, 3) AS aa FROM supplier),
c AS (SELECT c_nationkey AS nation, c_custkey AS j, c_custkey % 97 AS bx, c_custkey % 89 AS by_, round(c_acctbal / 1000, 3) AS ba FROM customer),
d AS (SELECT nation, i, j, round(sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (aa - ba) ** 2), 9) AS d FROM s JOIN c USING (nation)),
n AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY d, i, j) AS n FROM d),
m AS (SELECT *, greatest(min(n) OVER (PARTITION BY nation, i), min(n) OVER (PARTITION BY nation, j)) AS m FROM n),
k AS (SELECT *, max(m) OVER (PARTITION BY nation) AS stop FROM m)
SELECT nation, i, j, round(d, 4) AS d FROM k WHERE n <= stop
""")
def shape_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and customers of a nation as shapes of two pictures: nearest pairs until all are met."""
    def side(name: str, p: str, nation: str, key: str) -> DataFrame:
        return table(spark, sf, name).select(F.col(nation).alias("nation"), F.col(key).alias("idx"), (F.col(key) % 97).cast("double").alias("cx"), (F.col(key) % 89).cast("double").alias("cy"), F.round(F.col(f"{p}_acctbal") / 1000, 3).alias("area"))

    got = matching.nearest_pairs(side("supplier", "s", "s_nationkey", "s_suppkey"), side("customer", "c", "c_nationkey", "c_custkey"), ["nation"])
    return got.select("nation", "i", "j", F.round("d", 4).alias("d"))


_LINES = "SELECT l_suppkey AS m, l_linenumber AS l, (l_orderkey % 40)::INT AS y, (l_partkey % 60)::INT AS x0, (l_partkey % 60 + l_linenumber + 1)::INT AS x1 FROM lineitem"
_LPIX = f"SELECT DISTINCT m, l, y, unnest(range(x0, x1)) AS x FROM ({_LINES})"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    t = mask(spark, sf).select("m", "y", "x0", "x1")
    return runs.normalise(t.withColumn("l", F.col("x1") - F.col("x0") - 1), ["m", "l"])


@query(f"""
WITH p AS MATERIALIZED ({_LPIX}), a AS (SELECT m, l, count(*) AS n FROM p GROUP BY m, l), s AS (SELECT m, l FROM a WHERE n < 0.05 * 2400), g AS (SELECT m, l FROM a WHERE n >= 0.05 * 2400),
o AS (SELECT p.m, p.l AS s, q.l AS l, count(*) AS n FROM p JOIN s USING (m, l) JOIN p q ON q.m = p.m AND q.y = p.y AND q.x = p.x JOIN g ON g.m = q.m AND g.l = q.l GROUP BY ALL),
b AS (SELECT m, s, arg_max(l, (n, -l)) AS l FROM o GROUP BY m, s),
u AS (SELECT p.m, p.l, y, x FROM p JOIN g USING (m, l) UNION SELECT p.m, b.l, y, x FROM p JOIN b ON b.m = p.m AND b.s = p.l)
SELECT m, l, count(*) AS n FROM u GROUP BY m, l
""")
def small_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line masks by line number: small ones go to the large one they overlap most."""
    t = _lines(spark, sf).withColumn("size", F.lit(2400))
    return adhere.small_lines_to_large(t, ["m"], "l", F.lit(0.05)).groupBy("m", "l").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))


@query(f"""
WITH p AS MATERIALIZED ({_LPIX}), b AS (SELECT m, l, min(x) AS u0, max(x) + 1 AS u1, min(y) AS v0, max(y) + 1 AS v1, count(*) AS n FROM p GROUP BY m, l)
SELECT m, l, CASE WHEN n > 0.15 * (u1 - u0) * (v1 - v0) THEN (u1 - u0) * (v1 - v0) ELSE n END::BIGINT AS n FROM b
""")
def filled_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return adhere.fill_boxes(_lines(spark, sf), ["m"], "l", 0.15).groupBy("m", "l").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))


@query(f"""
WITH p AS MATERIALIZED ({_LPIX}), c AS (SELECT DISTINCT m, y, x FROM ({_PIX}) WHERE f = 'N')
SELECT m, l FROM p LEFT JOIN c USING (m, y, x) GROUP BY m, l HAVING count(c.m) >= 0.5 * count(*)
""")
def covered_lines(spark: SparkSession, sf: str) -> DataFrame:
    cover = runs.normalise(mask(spark, sf, "N"), ["m"])
    return adhere.absorb_covered(_lines(spark, sf), cover, ["m"], "l", 0.5)


@query(f"""
WITH a AS MATERIALIZED (SELECT DISTINCT m, y, x FROM ({_PIX}) WHERE f = 'N'), r AS MATERIALIZED (SELECT DISTINCT m, y, x FROM ({_PIX}) WHERE f = 'A' EXCEPT FROM a), k AS MATERIALIZED (SELECT DISTINCT m, y, x FROM ({_PIX}) WHERE f = 'R'),
pages AS (SELECT DISTINCT m FROM k), layer AS (SELECT m, y, x, 1 AS label FROM a UNION ALL SELECT m, y, x, 2 FROM r),
n AS (SELECT m, y, x FROM k EXCEPT SELECT m, y, x FROM r)
SELECT m, label, count(*) AS n FROM (
  SELECT m, y, x, label FROM layer WHERE m NOT IN (FROM pages) UNION ALL SELECT m, y, x, label FROM layer WHERE m IN (FROM pages) AND label <> 3 AND (m, y, x) NOT IN (SELECT (m, y, x) FROM n) UNION ALL SELECT m, y, x, 3 FROM n) GROUP BY m, label
""")
def label_under_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Label 3 painted where a mask is, but for label 2."""
    one = runs.normalise(mask(spark, sf, "N"), ["m"])
    two = runs.subtract(mask(spark, sf, "A"), one, ["m"])
    layer = one.withColumn("label", F.lit(1)).unionByName(two.withColumn("label", F.lit(2)))
    return adhere.set_label(layer, mask(spark, sf, "R"), ["m"], 3, keep=2).groupBy("m", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))


@query(f"""
WITH p AS MATERIALIZED ({_LPIX}), s AS (SELECT DISTINCT m, y, x FROM ({_PIX}) WHERE f = 'N')
SELECT m, l, round(avg((y % 10) / 10.0), 4) AS conf FROM p JOIN s USING (m, y, x) GROUP BY m, l
""")
def region_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Scores are decimals, so that a mean halfway between two roundings goes up whatever the order of rows."""
    known = runs.normalise(mask(spark, sf, "N"), ["m"]).withColumn("value", ((F.col("y") % 10) / 10).cast("decimal(2,1)"))
    return adhere.region_confidence(_lines(spark, sf), known, ["m"], "l").withColumn("conf", F.round("conf", 4).cast("double"))


@query(f"""
WITH p AS (SELECT m, x, count(*) AS n FROM (SELECT DISTINCT m, y, x FROM ({_PIX})) GROUP BY m, x), e AS (SELECT m, min(x) AS a, max(x) AS b, max(n) AS top FROM p GROUP BY m),
v AS (SELECT p.m, p.x, p.n, e.a, e.b FROM p JOIN e USING (m) WHERE p.n * 2 < e.top AND p.x > e.a AND p.x < e.b AND p.n = (SELECT min(n) FROM p q WHERE q.m = p.m AND q.x BETWEEN p.x - 3 AND p.x + 3)),
l AS (SELECT m, arg_max(x, (-n, x)) AS x FROM v WHERE x < (a + b) / 2 GROUP BY m), r AS (SELECT m, arg_max(x, (-n, -x)) AS x FROM v WHERE x >= (a + b) / 2 GROUP BY m)
SELECT m, coalesce(l.x, a)::INT AS "left", coalesce(r.x, b)::INT AS "right" FROM e LEFT JOIN l USING (m) LEFT JOIN r USING (m)
""")
def main_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The main column between the deepest valleys of each mask's column profile."""
    return adhere.main_bounds(runs.column_profile(runs.normalise(mask(spark, sf), ["m"]), ["m"]), ["m"], 3, 0.5)


@query(f"""
WITH p AS (SELECT DISTINCT m, y, x FROM ({_PIX})) SELECT m, y, count(*) AS n FROM p GROUP BY m, y
""")
def row_profile(spark: SparkSession, sf: str) -> DataFrame:
    return runs.row_profile(runs.normalise(mask(spark, sf), ["m"]), ["m"])


@query(f"""
WITH o AS (SELECT DISTINCT m, y + d AS y, x + e AS x FROM (SELECT m, y, x FROM (SELECT DISTINCT m, y + d AS y, x + e AS x, d, e FROM ({_PIX}) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS e)) GROUP BY m, y, x HAVING count(*) = 9) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS e))
SELECT m, count(*) AS area FROM o GROUP BY m
""")
def run_open(spark: SparkSession, sf: str) -> DataFrame:
    return runs.area(runs.opened(mask(spark, sf), ["m"], 1, 1), ["m"])


@query(r"""
WITH l AS (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS x FROM documents), t AS (SELECT doc_id, (x[2])::INT AS i, x[1] AS line FROM l WHERE trim(x[1]) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM t)
SELECT doc_id AS page_id, 'region_' || lpad(k::VARCHAR, 4, '0') AS region_id, 'region_' || lpad(k::VARCHAR, 4, '0') || '_line_0001' AS line_id, trim(line) AS text, round((i % 100) / 100.0, 2)::DOUBLE AS conf,
  '1,' || (i * 10) || ' ' || (length(line) + 1) || ',' || (i * 10) || ' ' || (length(line) + 1) || ',' || (i * 10 + 9) AS points FROM n
""")
def xml_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a page with a region for each of its lines, written as PAGE-XML and read again."""
    d = table(spark, sf, "documents")
    l = d.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("region_idx", "text")).where(F.trim("text") != "")
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    y, right = F.col("region_idx") * 10, F.length("text") + 1
    l = l.withColumn("poly", F.array(at(F.lit(1), y), at(right, y), at(right, y + 9)))
    page = d.select(F.col("doc_id").alias("page_id"), F.concat("source", F.lit(".png")).alias("name"), F.lit(9999).alias("h"), F.lit(9999).alias("w"), F.lit(1).alias("num_col"), F.lit(0.0).alias("slope"))
    reg = l.select("page_id", "region_idx", F.lit("paragraph").alias("kind"), F.col("region_idx").alias("ord"), F.lit(None).cast("double").alias("conf"), "poly")
    lin = l.select("page_id", "region_idx", F.lit(0).alias("line_idx"), "poly", "text", ((F.col("region_idx") % 100) / 100).alias("conf"))
    xml = pages.write_page_xml(page, reg, lin, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return pages.lines(pages.parse_page(xml), ["page_id"]).select("page_id", "region_id", "line_id", F.trim("text").alias("text"), "conf", geometry.points_string(F.col("poly")).alias("points"))


_HOURLY = "SELECT user_id, list(v ORDER BY h) AS a FROM (SELECT u.user_id, h, coalesce(sum(round(e.value, 3)), 0) AS v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN events e ON e.user_id = u.user_id AND hour(e.ts) = h GROUP BY u.user_id, h) GROUP BY user_id"


@query(f"SELECT user_id, round(list_stddev_pop(a), 3) AS spread, a[1:1][1] IS NOT NULL AS some FROM ({_HOURLY})")
def profile_spread(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.hour(F.col("ts").cast("timestamp_ntz")).alias("h"), F.round("value", 3).alias("v"))
    n = e.groupBy("user_id", "h").agg(F.sum("v").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("m"))
    a = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("m", h), F.lit(0.0)))
    return n.select("user_id", F.round(signal.spread(a), 3).alias("spread"), F.lit(True).alias("some"))


@query()
def page_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Reading boxes of the masks that line items paint (text from flags A and N, separators none), as pages of 60 by 40 blown up tenfold."""
    return columns.page_boxes_of_runs(runs.normalise(mask(spark, sf), ["m"]), "m", 40, 70, 2, scale=10)
