"""Queries on scores, profiles, metrics and generated rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import scores, signal, text
from quire.operators import augment, metrics
from quire.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query("""
WITH s AS (SELECT vec_id, embedding AS s FROM embeddings), n AS (SELECT vec_id, list_position(s, list_max(s)) AS n, list_max(s)::DOUBLE AS c FROM s)
SELECT vec_id, least(greatest(n, 2), 5)::INT AS num_col, round(CASE WHEN n < 2 OR n > 5 THEN 1 ELSE c END, 5) + 0::DOUBLE AS conf FROM n
""")
def column_class(spark: SparkSession, sf: str) -> DataFrame:
    s = scores.column_class(F.col("embedding"), 2, 5)
    return table(spark, sf, "embeddings").select("vec_id", s["num_col"].cast("int").alias("num_col"), (F.round(s["conf"], 5) + F.lit(0.0)).alias("conf"))


@query("""
WITH c AS (SELECT vec_id, embedding[k * 8 + 1 : k * 8 + 8] AS p FROM embeddings CROSS JOIN (SELECT unnest(range(8)) AS k)),
l AS (SELECT vec_id, list_max(p)::DOUBLE AS m FROM c WHERE list_position(p, list_max(p)) <> 8)
SELECT vec_id, round(coalesce(avg(m), 0), 5) + 0::DOUBLE AS conf FROM embeddings LEFT JOIN l USING (vec_id) GROUP BY vec_id
""")
def score_confidence(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))
    c = scores.line_confidence(steps, 7)
    return table(spark, sf, "embeddings").select("vec_id", (F.round(F.when(F.isnan(c), 0.0).otherwise(c), 5) + F.lit(0.0)).alias("conf"))


@query("""
WITH t AS (SELECT vec_id, s, k, embedding[s + k + 1]::DOUBLE AS v, 1 / (1 + exp(5 - 5 * least(k, 15 - k) / 4.0)) AS w FROM embeddings CROSS JOIN (SELECT unnest([0, 8, 16, 24, 32, 40, 48]) AS s) CROSS JOIN (SELECT unnest(range(16)) AS k))
SELECT vec_id, (s + k)::INT AS x, round(sum(v * w) / sum(w), 5) + 0::DOUBLE AS v FROM t GROUP BY vec_id, s + k
""")
def tile_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows of 16 blended by sigmoid weights towards their edges."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.array(*[F.lit(i) for i in range(0, 49, 8)])).alias("s"))
    t = e.select("vec_id", "s", F.posexplode(F.slice("embedding", F.col("s") + 1, F.lit(16))).alias("k", "v"))
    w = F.get(signal.blend_window(4), F.least(F.col("k"), 15 - F.col("k")))
    return t.groupBy("vec_id", (F.col("s") + F.col("k")).alias("x")).agg((F.round(F.sum(F.col("v").cast("double") * w) / F.sum(w), 5) + F.lit(0.0)).alias("v"))


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    """(event_type, a): events in each of the 24 hours of the day."""
    e = table(spark, sf, "events").withColumn("h", F.hour(F.col("ts").cast("timestamp_ntz")))
    n = e.groupBy("event_type", "h").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    return n.select("event_type", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("m", h), F.lit(0)).cast("double")).alias("a"))


_HOURS = "SELECT event_type, h, count(e.ts)::DOUBLE AS n FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT event_type AS t, ts, hour(ts) AS hh FROM events) e ON t = event_type AND hh = h GROUP BY event_type, h"
_KERNEL = ", ".join(f"({i - 4}, {w!r})" for i, w in enumerate(signal.gaussian_kernel(1.0)))
_SMOOTH = f"SELECT a.event_type, a.h, sum(k.w * b.n) AS z FROM ({_HOURS}) a CROSS JOIN (VALUES {_KERNEL}) k(d, w) JOIN ({_HOURS}) b ON b.event_type = a.event_type AND b.h = CASE WHEN a.h + d < 0 THEN -1 - a.h - d WHEN a.h + d > 23 THEN 47 - a.h - d ELSE a.h + d END GROUP BY a.event_type, a.h"


@query(f"SELECT event_type, h::INT AS h, round(z, 5) AS z FROM ({_SMOOTH})")
def smooth_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _hours(spark, sf).select("event_type", F.posexplode(signal.gaussian_smooth(F.col("a"), 1.0)).alias("h", "z")).withColumn("z", F.round("z", 5))


_RISE = "SELECT *, lag(z) OVER w AS p, lead(z) OVER w AS q FROM (SELECT event_type, h, round(z, 5) AS z FROM ({})) WINDOW w AS (PARTITION BY event_type ORDER BY h)".format(_SMOOTH)


@query(f"SELECT event_type, h::INT AS h, z FROM ({_RISE}) WHERE z > p AND z > q")
def profile_peaks(spark: SparkSession, sf: str) -> DataFrame:
    t = _hours(spark, sf).select("event_type", F.transform(signal.gaussian_smooth(F.col("a"), 1.0), lambda x: F.round(x, 5)).alias("z"))
    return t.select("event_type", F.explode(signal.find_peaks(F.col("z"))).alias("h"), "z").select("event_type", "h", F.get("z", F.col("h")).alias("z"))


@query("""
WITH d AS (SELECT l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT d, n, lag(n) OVER (ORDER BY d) AS p, lead(n) OVER (ORDER BY d) AS q FROM d)
SELECT strftime(d, '%Y-%m-%d') AS d, n FROM s WHERE n < p AND n < q
""")
def column_valleys(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n"))
    return signal.valleys(d, [], "d", "n").select("d", "n")  # one row for each day


_CM = "SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY quality, toxic"


@query(f"SELECT t AS truth, p AS pred, n, round(n / sum(n) OVER (PARTITION BY t), 6) AS share FROM ({_CM})")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    cm = metrics.confusion(table(spark, sf, "labels"), "quality", "toxic")
    return metrics.normalised(cm, "quality", "toxic", "true").select(F.col("quality").alias("truth"), F.col("toxic").alias("pred"), "n", F.round("share", 6).alias("share"))


_CLS = f"WITH m AS ({_CM}), c AS (SELECT DISTINCT t AS cls FROM m UNION SELECT p FROM m), x AS (SELECT cls, coalesce((SELECT sum(n) FROM m WHERE t = cls AND p = cls), 0) AS tp, coalesce((SELECT sum(n) FROM m WHERE t <> cls AND p = cls), 0) AS fp, coalesce((SELECT sum(n) FROM m WHERE t = cls AND p <> cls), 0) AS fn FROM c)"


@query(f"{_CLS} SELECT round(avg(tp / (tp + fp + fn)), 6) AS mean_iou FROM x WHERE tp + fn > 0")
def mean_iou(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_iou(table(spark, sf, "labels"), "quality", "toxic").select(F.round("mean_iou", 6).alias("mean_iou"))


@query(f"{_CLS} SELECT cls, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2 * tp / (2 * tp + fp + fn), 6) AS dice FROM x")
def dice(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_class(table(spark, sf, "labels"), "quality", "toxic").select("cls", "tp", "fp", "fn", F.round("dice", 6).alias("dice"))


@query("""
WITH j AS (SELECT d.source AS s, l.quality AS t, l.toxic AS p FROM labels l JOIN documents d USING (doc_id)), k AS (SELECT DISTINCT s, t AS cls FROM j),
x AS (SELECT k.s, cls, sum((t = cls AND p = cls)::INT) AS tp, sum((t = cls OR p = cls)::INT) AS u FROM k JOIN j ON j.s = k.s GROUP BY k.s, cls)
SELECT cls, round(avg((tp + 0.001) / (u + 0.001)), 6) AS value FROM x GROUP BY cls
""")
def image_iou(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return metrics.image_metric(j, "quality", "toxic", "source").select("cls", F.round("value", 6).alias("value"))


@query("""
WITH n AS (SELECT lang AS cls, count(*) AS n FROM documents GROUP BY lang), a AS (SELECT *, 1.0 / n / sum(1.0 / n) OVER () AS w FROM n), b AS (SELECT *, w / min(w) OVER () AS v FROM a)
SELECT cls, n, round(v / sum(v) OVER (), 6) AS weight FROM b
""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_weights(table(spark, sf, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@query("SELECT lang, quality, toxic, count(*) AS n, grouping(lang, quality, toxic)::INT AS g FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, quality, toxic), (quality, toxic), (lang), ())")
def confusion_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    c = [F.col(x) for x in ("lang", "quality", "toxic")]
    return j.groupingSets([c, c[1:], c[:1], []], *c).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("g"))


@query("SELECT label, (pos - 1)::INT AS pos, round(avg(v::DOUBLE), 5) + 0::DOUBLE AS mean FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos")
def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ensemble(table(spark, sf, "embeddings"), ["label"], "embedding").withColumn("mean", F.round("mean", 5) + F.lit(0.0))


@query("""
WITH h AS (SELECT least(n_chars // 50, 255) AS v, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS w0, sum(n * v) OVER (ORDER BY v) AS s0, sum(n) OVER () AS w, sum(n * v) OVER () AS s FROM h)
SELECT arg_max(v, (b, -v)) AS threshold FROM (SELECT v, round(w0::DOUBLE * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) / (w::DOUBLE * w), 6) AS b FROM c WHERE w0 < w)
""")
def otsu_threshold(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").groupBy(F.least(F.floor(F.col("n_chars") / 50), F.lit(255)).alias("v")).agg(F.count("*").alias("n"))
    return metrics.otsu(h, "v")


@query("""
WITH s AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, string_agg(event_type[1:1], '' ORDER BY ts, event_id) AS text FROM s WHERE (p IS NULL OR p <> event_type) AND event_type <> 'click' GROUP BY user_id
""")
def ctc_collapse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    c = text.ctc_collapse(F.transform("s", lambda x: x["event_type"]), F.lit("click"))
    return e.select("user_id", F.array_join(F.transform(c, lambda x: F.substr(x, F.lit(1), F.lit(1))), "").alias("text")).where("text <> ''")


@query("SELECT doc_id, flip, angle, n_chars FROM documents CROSS JOIN (SELECT unnest(['none', 'h', 'v']) AS flip) CROSS JOIN (SELECT unnest([-5, 0, 5]) AS angle)")
def augment_grid(spark: SparkSession, sf: str) -> DataFrame:
    return augment.grid(table(spark, sf, "documents"), {"flip": ["none", "h", "v"], "angle": [-5, 0, 5]}, [F.col("doc_id"), F.col("n_chars")])


@query("SELECT vec_id, i::INT AS i, embedding[floor(i * 64 / 100)::INT + 1]::DOUBLE AS v FROM embeddings CROSS JOIN (SELECT unnest(range(100)) AS i)")
def nearest_resize(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(signal.nearest_resize(F.col("embedding"), F.lit(100))).alias("i", "v"))
    return e.withColumn("v", F.col("v").cast("double"))


@query("""
WITH p AS (SELECT vec_id, label, [exp(x::DOUBLE) for x in embedding] AS e FROM embeddings), q AS (SELECT vec_id, label, [x / list_sum(e) for x in e] AS p FROM p)
SELECT vec_id, round(-ln(p[label + 1]), 5) AS loss, round(1 - 2 * p[label + 1] / (1 + list_sum([x * x for x in p]) + 1e-6), 5) AS dice_loss FROM q
""")
def class_losses(spark: SparkSession, sf: str) -> DataFrame:
    p, y = signal.softmax(F.transform("embedding", lambda x: x.cast("double"))), signal.one_hot(F.col("label"), 64)
    t = table(spark, sf, "embeddings").select("vec_id", p.alias("p"), F.transform(y, lambda v: v.cast("double")).alias("y"))
    return t.select("vec_id", F.round(scores.cross_entropy(F.col("y"), F.col("p")), 5).alias("loss"), F.round(scores.soft_dice_loss(F.col("y"), F.col("p")), 5).alias("dice_loss"))


@query("""
SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    from quire.streaming.pages import windows

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows(e, "ts", "1 hour", "value", ["event_type"]).select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))
