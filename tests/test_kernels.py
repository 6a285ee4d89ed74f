"""Image files, polygons, columns, lines: kernels against plain versions and round trips."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import augment, columns, lines, matching, metrics, ordering, polygons, raster, regions, runs
from quire.operators.grouped import local_roots
from quire.sources import images, pages


def png(a, depth, color, interlaced=False, filters=None, palette=b"", clear=b""):
    """A PNG of samples a [h, w, channels], written plainly, with the filter of each row given."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    h, w, c = a.shape
    step = max(1, c * depth // 8)

    def rows(p):
        out, above = b"", None
        for y, row in enumerate(p):
            if depth == 16:
                line = row.astype(">u2").tobytes()
            else:
                bits = np.unpackbits(row.astype(np.uint8).ravel()[:, None], axis=1)[:, 8 - depth :].ravel()
                line = np.packbits(bits).tobytes()
            above = above or bytes(len(line))
            kind = filters[y % len(filters)] if filters else 0
            got = []
            for i, x in enumerate(line):
                left, up, corner = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p_ = left + up - corner
                near = min((left, up, corner), key=lambda v: (abs(p_ - v), (left, up, corner).index(v)))
                got.append((x - [0, left, up, (left + up) // 2, near][kind]) % 256)
            out += bytes([kind]) + bytes(got)
            above = line
        return out

    body = b"".join(rows(a[y0::dy, x0::dx]) for y0, x0, dy, dx in images._PASSES if a[y0::dy, x0::dx].size) if interlaced else rows(a)
    extra = (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"")
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, int(interlaced))) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
def test_png(interlaced):
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (7, 5), (13, 18)):
        for depth, color, c in ((1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3)):
            a = rng.integers(0, 1 << depth, (h, w, c))
            want = np.repeat(a >> 8 if depth == 16 else a * 255 // ((1 << depth) - 1), 3 // c, 2)
            assert (images.decode(png(a, depth, color, interlaced, [0, 1, 2, 3, 4])) == want).all(), (h, w, depth, color)
        palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
        a = rng.integers(0, 16, (h, w, 1))
        assert (images.decode(png(a, 4, 3, interlaced, [4, 3], palette.tobytes())) == palette[a[..., 0]]).all()
        a = rng.integers(0, 256, (h, w, 4))
        k = a[..., 3:]
        assert (images.decode(png(a, 8, 6, interlaced, [2, 4, 1])) == (a[..., :3] * k + 255 * (255 - k)) // 255).all()
    a = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    assert (images.decode(images.encode_png(a)) == a).all() and images.decode(images.encode_png(a)[:60]) is None and images.decode(b"GIF89a") is None


def test_pnm_and_dpi(spark):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (images.decode(b"P6 4 2\n# note\n255\n" + a.tobytes()) == a).all()
    assert (images.decode(b"P3\n4 2\n255\n" + " ".join(map(str, a.ravel())).encode()) == a).all()
    assert images.decode(b"P1\n3 1\n101")[0, :, 0].tolist() == [0, 255, 0] and images.decode(b"P4\n3 1\n\xa0")[0, :, 0].tolist() == [0, 255, 0]
    assert images.decode(b"P5 2 1 65535\n" + b"\xff\xff\x00\x00")[0, :, 0].tolist() == [255, 0]
    png_ = images.encode_png(a, 300)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\2" + struct.pack(">BHH", 1, 150, 150) + b"\0\0\xff\xda"
    tiff = lambda unit, top: b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 282, 5, 1, 38) + struct.pack("<HHIHH", 296, 3, 1, unit, 0) + bytes(4) + struct.pack("<II", top, 1)
    assert [images.dpi(x) for x in (png_, jpeg, tiff(2, 400), tiff(3, 254), tiff(2, 1), images.encode_png(a), b"junk", None)] == [300, 150, 400, 100, 230, 230, 230, 230]
    df = spark.createDataFrame([(1, bytearray(png_)), (2, bytearray(b"no image")), (3, None)], "page_id int, content binary")
    got = {r.page_id: r for r in images.as_png(images.with_images(df)).collect()}
    assert got[1].dpi == 300 and (images.decode(bytes(got[1].png)) == a).all() and got[2].image is got[3].png is None and got[3].dpi == 230
    assert (images.swap_channels(a) == a[..., ::-1]).all() and images.swap_channels(a[..., 0]).shape == (2, 4, 3)


def blob(rng, h, w, share=0.5):
    m = rng.random((h, w)) < share
    return columns.grow(m, 1, 0)


def flood(mask, diagonal):
    left, out = mask.copy(), []
    while left.any():
        todo, own = [tuple(np.argwhere(left)[0])], []
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and left[y, x]:
                left[y, x] = False
                own.append((y, x))
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not i or not j]
        out.append(own)
    return out


def test_masks():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m = blob(rng, int(rng.integers(1, 20)), int(rng.integers(1, 25)), 0.2)
        label, boxes = columns.labelled(m)
        parts = flood(m, True)
        assert len(boxes) == len(parts) and (label > 0).sum() == m.sum()
        for own in parts:
            ys, xs = zip(*own)
            i = label[own[0]]
            assert {label[p] for p in own} == {i} and boxes[i - 1].tolist() == [min(xs), max(xs) + 1, min(ys), max(ys) + 1]
        dx, dy = int(rng.integers(0, 4)), int(rng.integers(0, 4))
        big = np.pad(m, ((dy, dy), (dx, dx)))
        want = np.stack([big[i : i + m.shape[0], j : j + m.shape[1]] for i in range(2 * dy + 1) for j in range(2 * dx + 1)])
        assert (columns.grow(m, dx, dy) == want.any(0)).all()
        full = np.pad(m, ((dy, dy), (dx, dx)), constant_values=True)
        want = np.stack([full[i : i + m.shape[0], j : j + m.shape[1]] for i in range(2 * dy + 1) for j in range(2 * dx + 1)])
        assert (columns.shrink(m, dx, dy) == want.all(0)).all()


def test_outlines_fill_their_masks_again():
    rng = np.random.default_rng(4)
    for _ in range(40):
        m = blob(rng, int(rng.integers(1, 16)), int(rng.integers(1, 16)), 0.3)
        h, w = m.shape
        found = polygons.outlines(m)
        tops = [i for i, (_, parent) in enumerate(found) if parent < 0]
        assert len(tops) == len(flood(m, True))
        inner = [p for p in flood(np.pad(~m, 1, constant_values=True), False) if (0, 0) not in p]
        assert sum(parent >= 0 for _, parent in found) == len(inner) and all(parent in tops for _, parent in found if parent >= 0)
        again = np.zeros_like(m)
        for o, parent in found:
            if parent < 0:
                again |= polygons.fill([o], (0, w, 0, h))
        holes = np.zeros_like(m)
        for own in inner:
            for y, x in own:
                holes[y - 1, x - 1] = True
        assert (again | holes == m | holes).all()


def test_polygons(spark):
    a, b = [(0, 0), (10, 0), (10, 10), (0, 10)], [(30, 2), (40, 2), (40, 8), (30, 8)]
    assert polygons.intersection(a, b) is None and polygons.intersection(a, [(5, 5), (20, 5), (20, 20), (5, 20)]) == [(5, 5), (10, 5), (10, 10), (5, 10)]
    one = polygons.join([a, b])
    m = polygons.fill([one], (0, 45, 0, 15))
    assert m[5, 5] and m[5, 35] and m[5, 20] and not m[12, 20] and len(flood(m, True)) == 1
    assert polygons.join([a]) == a and polygons.join([]) == []
    d, p = polygons.nearest_points(a, b)[0], polygons.nearest_points(a, [(13, 14), (20, 20), (14, 20)])
    assert d == 20 and p[0] == 5 and p[1:] == ((10.0, 10.0), (13.0, 14.0))
    grown = polygons.fill([polygons.dilate(a, 3)], (-5, 16, -5, 16))
    y, x = np.mgrid[-5:16, -5:16]
    far = np.hypot(np.maximum(np.maximum(-x, x - 10), 0), np.maximum(np.maximum(-y, y - 10), 0))
    assert (grown == (far <= 3)).all()
    assert polygons.valid([(0, 0), (10, 10), (10, 0), (0, 10)]) and polygons.valid([(1, 1), (2, 2)]) == []
    assert sorted(polygons.clip([(-5, 5), (5, -5), (15, 5), (5, 15)], 0, 0, 10, 10)) == sorted([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (10, 0), (10, 10), (0, 10)]) or abs(polygons.shoelace(polygons.clip([(-5, 5), (5, -5), (15, 5), (5, 15)], 0, 0, 10, 10))) == 100
    assert abs(polygons.shoelace(polygons.clip(a, 2, 3, 7, 50))) == 35
    w, h, t = polygons.min_area_box([(0, 0), (40, 40), (36, 44), (-4, 4)])
    assert (round(w, 4), round(h, 4), round(t, 4)) in {(round(40 * 2**0.5, 4), round(4 * 2**0.5, 4), 45.0)}
    bar = lambda t, n=100: [(int(n * np.cos(np.deg2rad(t))), int(n * np.sin(np.deg2rad(t)))), (0, 0), (int(-5 * np.sin(np.deg2rad(t))), int(5 * np.cos(np.deg2rad(t))))]
    lying = [[(0, 0), (1000, 35), (999, 55), (-1, 20)]] * 3 + [[(0, 0), (10, 0), (10, 10), (0, 10)]]
    assert abs(polygons.skew(lying) - 2.0) < 0.1 and polygons.skew([a]) is None and polygons.skew([]) is None and bar(0)
    df = spark.createDataFrame([(1, 1, [(0, 0), (4, 0), (4, 4), (0, 4)]), (1, 2, [(20, 0), (24, 0), (24, 4), (20, 4)]), (2, 1, None)], "page_id int, i int, poly array<struct<x:int,y:int>>")
    got = {r.page_id: r.poly for r in polygons.join_by(df, ["page_id"]).collect()}
    assert polygons.fill([[(q.x, q.y) for q in got[1]]], (0, 30, 0, 10))[2, 12] and got[2] == []
    moved = polygons.map_polygons(df, "poly", lambda p: [(x + 1, y) for x, y in p]).orderBy("page_id", "i").collect()
    assert moved[0].poly[0].x == 1 and moved[2].poly is None


def test_contours_with_holes(spark):
    ring = np.ones((9, 9), bool)
    ring[3:6, 3:6] = False
    rows = [(1, int(y), int(a), int(z)) for y, a, z in zip(*columns.mask_runs(ring))] + [(2, 5, 0, 3)]
    t = runs.components(spark.createDataFrame(rows, "page_id int, y int, x0 int, x1 int"), ["page_id"])
    got = sorted((r.page_id, r.comp, r.parent, len(r.poly)) for r in polygons.contours(t, ["page_id"]).fillna(-1, ["parent"]).collect())
    assert got == [(1, 1, -1, 4), (1, 1, 1, 4), (2, 1, -1, 2)]


def test_components_page_by_page_and_spread_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(p, int(y), int(x), int(x) + int(n)) for p in range(4) for y, x, n in zip(rng.integers(0, 30, 60), rng.integers(0, 40, 60), rng.integers(1, 9, 60))]
    t = spark.createDataFrame(rows, "m int, y int, x0 int, x1 int")
    for corners in (True, False):
        one, two = (sorted(map(tuple, f(t, ["m"], corners).select("m", "y", "x0", "x1", "comp").collect())) for f in (runs.components, runs.components_spread))
        assert one == two and len({(r[0], r[4]) for r in one}) > 4


def page(*boxes, shape=(1200, 2000)):
    m = np.zeros(shape, bool)
    for x0, x1, y0, y1 in boxes:
        m[y0:y1, x0:x1] = True
    return m


def test_columns():
    three = page((250, 650, 100, 1100), (800, 1200, 100, 1100), (1350, 1750, 100, 1100))
    cuts = columns.column_cuts(three, 3)
    assert len(cuts) == 2 and abs(cuts[0] - 725) < 15 and abs(cuts[1] - 1275) < 15 and columns.column_count(three, 3) == 3 and columns.column_count(three, 3, most=2) == 2
    assert columns.column_cuts(page(), 3) == [] and columns.column_cuts(page((300, 1700, 100, 1100)), 1) == []
    assert columns.column_cuts(page((250, 1600, 100, 1100), (1650, 1760, 100, 1100)), 2) == []  # a sliver
    assert columns.cuts_by_lines(page((600, 606, 0, 1200), (1300, 1306, 0, 1200))) == [602, 1302]


def test_separators_and_boxes():
    a, b, c, d = (300, 900, 150, 560), (1100, 1700, 150, 560), (300, 900, 640, 1000), (1100, 1700, 640, 1000)
    text = page(a, b, c, d)
    across = page((200, 1800, 598, 604))
    seps, splits = columns.separators(across, 2)
    assert [s.kind for s in seps] == ["horizontal"] and len(splits) == 1 and abs(splits[0] - 601) < 3
    order = lambda boxes: [next(i for i, (x0, x1, y0, y1) in enumerate(boxes) if x0 <= (p[0] + p[1]) / 2 < x1 and y0 <= (p[2] + p[3]) / 2 < y1) for p in (a, b, c, d)]
    boxes, borders = columns.reading_boxes(text, across, seps, splits, 2)
    assert order(boxes) == sorted(order(boxes)) and len(set(order(boxes))) == 4 and len(borders) == 2
    boxes, _ = columns.reading_boxes(text, across, seps, splits, 2, right_to_left=True)
    i = order(boxes)
    assert i[1] < i[0] < i[3] < i[2]
    boxes, _ = columns.reading_boxes(text, page(), [], [], 2)  # without it, column after column
    i = order(boxes)
    assert i[0] == i[2] < i[1] == i[3]
    # a heading over both columns is a border as a separator is
    head = (300, 1700, 590, 620)
    whole = text | page(head)
    seps, splits = columns.separators(page(), 2, [head])
    boxes, _ = columns.reading_boxes(whole, page(), seps, splits, 2)
    i = order(boxes)
    assert max(i[:2]) < min(i[2:]) and splits == [590, 620]
    # two bars on one horizon are one separator, a bar upright is another kind
    seps, splits = columns.separators(page((200, 990, 598, 604), (1010, 1800, 600, 606), (1000, 1008, 700, 1040)), 2)
    assert sorted(s.kind for s in seps) == ["horizontal", "vertical"] and len(splits) >= 1
    assert columns.page_columns(text, [], [], 2)[0] > 900


def test_page_boxes(spark):
    text = page((300, 900, 150, 1000), (1100, 1700, 150, 1000))
    df = spark.createDataFrame([(1, raster.pack(text * 255), None, 2, None), (2, None, None, 1, None)], "page_id int, text struct<h:int,w:int,c:int,data:binary>, seps struct<h:int,w:int,c:int,data:binary>, num_col int, headings array<struct<x0:int,x1:int,y0:int,y1:int>>")
    got = columns.page_boxes(df).orderBy("box_idx").collect()
    assert {r.page_id for r in got} == {1} and got[0].x0 == 0 and got[-1].x1 == 2000 and [r.box_idx for r in got] == list(range(len(got)))


def test_lines(spark):
    m = np.zeros((200, 300), bool)
    for y in (20, 60, 100, 140):
        m[y : y + 14, 10:290] = True
    bands = lines.line_bands(m)
    assert len(bands) == 4 and all(a <= y and y + 14 <= z for (a, z), y in zip(bands, (20, 60, 100, 140)))
    assert lines.line_bands(m[:50]) == [(0, 50)] and lines.line_bands(m & False) == [] and len(lines.line_bands(m[:90])) == 2
    boxes = lines.line_boxes(m, 0.0, (5, 7))
    assert len(boxes) == 4 and boxes[0][0][0] == 15 and boxes[0][1][0] == 294
    slanted = raster.turn(m.astype(np.uint8) * 255, 6.0) > 127
    turned = lines.line_boxes(slanted, 6.0)
    assert len(turned) == 4 and turned[1][0][1] > turned[1][1][1]
    thick = columns.grow(m, 0, 11)
    thick[:, 140:143] = True
    assert len(columns.labelled(lines.separated(thick))[1]) >= 4
    assert len(lines.curved_lines(columns.grow(slanted, 0, 2), 6.0)) >= 4 and len(lines.curved_lines(m.T, 90.0)) == 4
    bent = np.zeros((120, 400), bool)
    for x in range(400):
        y = int(40 + 20 * np.sin(x / 60))
        bent[y : y + 12, x] = x % 80 > 6
    gray = np.where(bent, 0, 255).astype(np.uint8)[:, :, None].repeat(3, 2)
    flat = lines.straightened(gray, bent)
    assert flat.shape[0] == 32 and flat.shape[1] > 200 and (flat < 128).mean() > (gray < 128).mean()
    assert abs(lines.moments_angle(raster.turn(m[:40].astype(np.uint8) * 255, 10.0) > 127) + 10) < 2 and lines.moments_angle(m & False) == 0
    rows = [(1, 3, int(y), int(a), int(z)) for y, a, z in zip(*columns.mask_runs(m))]
    got = lines.lines_of_regions(spark.createDataFrame(rows, "page_id int, region_idx int, y int, x0 int, x1 int"), ["page_id", "region_idx"]).collect()
    assert sorted(r.line_idx for r in got) == [0, 1, 2, 3] and {r.region_idx for r in got} == {3}


def test_matching_of_two_sides(spark):
    r = random.Random(6)
    for _ in range(3):
        a, b = ([(1, i, r.random(), r.random(), r.random()) for i in range(n)] for n in (7, 4))
        kinds = "p int, idx int, cx double, cy double, area double"
        got = {(x.i, x.j) for x in matching.nearest_pairs(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), ["p"]).collect()}
        want, left = set(), {("a", i) for i in range(7)} | {("b", j) for j in range(4)}
        for d, i, j in sorted((round(sum((u - v) ** 2 for u, v in zip(p[2:], q[2:])) ** 0.5, 9), p[1], q[1]) for p in a for q in b):
            if not left:
                break
            want.add((i, j))
            left -= {("a", i), ("b", j)}
        assert got == want
    t = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 0.0, 10.0), (1, 2, 2.5, 9.0), (1, 3, 0.0, 11.0), (1, 4, 10.5, 12.0), (2, 5, 3.0, 4.0)], "k int, i int, a double, b double")
    assert sorted(x.i for x in matching.without_inside(t, "a", "b", ["k"]).collect()) == [3, 4, 5]


def test_nearest_on_one_key(spark):
    """Many rows on one key, quickly: no frame is read anew for each row."""
    n = 60_000
    a = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 3 % n).cast("double").alias("at"))
    b = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("j"), (F.col("id") * 7 % n + 0.25).alias("to"))
    got = matching.nearest(a, b, "at", "to", "j", ["k"]).select(F.max(F.abs(F.col("to") - F.col("at"))).alias("d"), F.count("*").alias("n")).first()
    assert got.n == n and got.d <= 1


def test_word_error_rates(spark):
    r = random.Random(7)
    words = ["eins", "zwei", "drei", "é", "fünf", "x"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 9))), " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(60)]

    def edits(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    got = metrics.line_rates(spark.createDataFrame(rows, "i int, t string, r string"), F.col("t"), F.col("r"), ["i"]).collect()
    for x in got:
        _, t, s = rows[x.i]
        assert (x.edits, x.chars, x.word_edits, x.words) == (edits(t, s), len(t), edits(t.split(" "), s.split(" ")), len(t.split(" ")))
        assert x.wer == round(x.word_edits / x.words, 6) and x.cer == round(x.edits / x.chars, 6)


def test_slopes(spark):
    rng = np.random.default_rng(8)
    x, e = rng.normal(size=40), rng.normal(size=40)
    rows = [(1, float(a), float(2 * a + 0.1 * b)) for a, b in zip(x, e)] + [(2, 1.0, 2.0), (2, 2.0, 3.0)]
    got = matching.slopes(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").collect()
    y = np.array([r[2] for r in rows[:40]])
    slope, base = np.polyfit(x, y, 1)
    error = (((y - slope * x - base) ** 2).sum() / 38 / ((x - x.mean()) ** 2).sum()) ** 0.5
    assert len(got) == 1 and abs(got[0].slope - slope) < 1e-9 and abs(got[0].stderr - error) < 1e-6


def test_component_loss(spark):
    rows = lambda *b: spark.createDataFrame([(1, y, x0, x1) for x0, x1, y0, y1 in b for y in range(y0, y1)], "m int, y int, x0 int, x1 int")
    parts = lambda *b: runs.components(rows(*b), ["m"])
    same = metrics.component_loss(parts((0, 4, 0, 4), (8, 12, 0, 4)), parts((0, 4, 0, 4), (8, 12, 0, 4)), ["m"]).first().loss
    merged = metrics.component_loss(parts((0, 4, 0, 4), (5, 9, 0, 4)), parts((0, 9, 0, 4)), ["m"]).first().loss
    assert abs(same) < 1e-9 and abs(merged - (1 - np.hypot(16, 16) / 32)) < 1e-9


def test_pairs_of_images_and_labels(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    label = (a[..., :1] > 128).astype(np.uint8)
    config = {"flip": ["h"], "rotate": [10], "rotate_90": True, "shift": ["down"], "scale": [0.5], "brighten": [1.2]}
    got = {n: (x, y) for n, x, y in augment.pair_variants(a, label, config)}
    assert len(got) == 7 and all(x.shape[:2] == y.shape[:2] for x, y in got.values())
    assert (got["flip_h"][1] == label[:, ::-1]).all() and (got["brighten_1.2"][1] == label).all() and (got["shift_down"][1][1:] == label[:-1]).all()
    x, y = got["rotate_10"]
    assert x.shape[0] < 40 and (x.sum(2) > 0).mean() > 0.95 and 0.3 < y.mean() < 0.7
    flat = np.full((30, 30, 3), 77, np.uint8)
    assert (augment.elastic(flat, 20, 3, 1) == 77).all() and (augment.elastic(a, 15, 2, 1) != a).any() and (augment.elastic(a, 15, 2, 1) == augment.elastic(a, 15, 2, 1)).all()
    assert augment.crop_turned(flat, 0).shape == flat.shape and augment.red_ink_on_background(np.array([[[0, 0, 0]], [[255] * 3]]), flat, np.full((2, 1, 3), 5))[:, 0, 0].tolist() == [5, 77]
    df = spark.createDataFrame([(1, raster.pack(a), raster.pack(label)), (2, None, None)], "i int, image struct<h:int,w:int,c:int,data:binary>, label struct<h:int,w:int,c:int,data:binary>")
    rows = augment.augment_pairs(df, "image", "label", {"flip": ["h"]}, ["i"], (32, 32)).collect()
    assert {r.variant for r in rows} == {f"{n}_{y}_{x}" for n in ("original", "flip_h") for y in (0, 8) for x in (0, 28)} and {(r.image.h, r.label.w) for r in rows} == {(32, 32)}


def test_layers_of_labels():
    a = np.zeros((100, 100), np.uint8)
    a[10:30, 10:60], a[40:44, 5:90], a[60:90, 20:50] = 1, 5, 4
    a[0, 99] = 1
    table = np.zeros_like(a)
    table[12:20, 12:30] = 1
    out, lines_, conf = regions.early_layout(a, table, a == 1, np.full(a.shape, 9), np.full(a.shape, 7), 0.001)
    assert out[15, 15] == 6 and conf[15, 15] == 7 and conf[25, 15] == 9 and out[41, 50] == 5 and out[70, 30] == 4 and out[30, 30] == 1 and out[0, 99] == 0 and lines_[25, 20]
    full = np.where(out == 1, 1, 0).astype(np.uint8)
    full[10:30, 40:60] = 7
    full[20:30, 10:40] = 2
    full[95:98, :] = 5
    got = regions.full_layout(out, full)
    assert got[20, 50] == 7 and got[25, 35] == 2 and got[96, 50] == 5 and regions.full_layout(out, full, True)[96, 50] == 0
    boxes = [{"x0": 0, "y0": 0, "x1": 90, "y1": 20}, {"x0": 0, "y0": 40, "x1": 30, "y1": 70}, {"x0": 40, "y0": 40, "x1": 90, "y1": 70}]
    full = np.zeros((100, 100), np.uint8)
    full[0:20, 0:60], full[0:20, 60:90], full[40:70, 0:30], full[40:70, 40:70], full[40:70, 70:90] = 1, 2, 2, 2, 1
    assert regions.relabel_headings(a, boxes, full) == ["heading", "paragraph", "heading"]


def test_files_and_workspaces(spark, tmp_path):
    for n in ("a.png", "a.bin.png", "ab.png", "b.tif"):
        (tmp_path / n).write_bytes(b"x")
    found = pages.first_with_prefix(pages.list_images(spark, str(tmp_path)), spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")).collect()
    assert sorted((r.stem, r.image.path.split("/")[-1]) for r in found) == [("a", "a.bin.png"), ("b", "b.tif")]
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / f"{i}.npy").write_bytes(b"x")
    assert {r["class"]: r.n for r in pages.count_by_class(spark, str(tmp_path)).collect()}["d"] == 3
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "mets.xml").write_text(
        '<mets:mets xmlns:mets="http://www.loc.gov/METS/" xmlns:xlink="http://www.w3.org/1999/xlink"><mets:fileSec><mets:fileGrp USE="IMG"><mets:file ID="f1" MIMETYPE="image/png"><mets:FLocat LOCTYPE="URL" xlink:href="img/1.png"/></mets:file>'
        '<mets:file ID="f2" MIMETYPE="image/png"><mets:FLocat xlink:href="img/2.png"/></mets:file></mets:fileGrp><mets:fileGrp USE="OCR"><mets:file ID="x1" MIMETYPE="text/xml"><mets:FLocat xlink:href="x/1.xml"/></mets:file></mets:fileGrp></mets:fileSec>'
        '<mets:structMap TYPE="PHYSICAL"><mets:div TYPE="physSequence"><mets:div ID="p1" ORDER="1"><mets:fptr FILEID="f1"/><mets:fptr FILEID="x1"/></mets:div><mets:div ID="p2" ORDER="2"><mets:fptr FILEID="f2"/></mets:div></mets:div></mets:structMap></mets:mets>'
    )
    got = sorted((r.grp, r.page_id, r.ord, r.file_id, r.href) for r in pages.mets_files(spark, str(tmp_path / "w")).collect())
    assert got == [("IMG", "p1", 1, "f1", "img/1.png"), ("IMG", "p2", 2, "f2", "img/2.png"), ("OCR", "p1", 1, "x1", "x/1.xml")]


def test_xy_cut_equals_cuts_at_empty_rows_and_columns():
    def plain(boxes, own):
        for axis in (1, 0):
            used = {i for k in own for i in range(boxes[k][axis], boxes[k][axis + 2])}
            parts = {}
            for k in own:
                parts.setdefault(sum(i not in used for i in range(boxes[k][axis])), []).append(k)
            if len(parts) > 1:
                return [k for _, part in sorted(parts.items()) for k in plain(boxes, part)]
        return sorted(own, key=lambda k: (boxes[k][1], boxes[k][0], k))

    r = random.Random(11)
    for _ in range(300):
        boxes = [(x := r.randrange(25), y := r.randrange(25), x + r.randint(1, 8), y + r.randint(1, 8)) for _ in range(r.randint(0, 9))]
        assert ordering.xy_cut(np.array(boxes, float).reshape(-1, 4)) == plain(boxes, list(range(len(boxes))))


def test_a_snake_of_ten_thousand_rows_is_one_component():
    y, x0, x1 = [], [], []
    for i in range(10_000):  # bars joined left and right in turn, single runs between them
        y.append(i)
        x0.append(0 if i % 2 == 0 or i % 4 == 1 else 18)
        x1.append(20 if i % 2 == 0 else 2 if i % 4 == 1 else 20)
    a, b = runs.touching(*(np.array(v) for v in (y, x0, x1)))
    assert len(a) == 9_999 and (local_roots(10_000, a, b) == 0).all()
    a, b = runs.touching(np.arange(5), np.array([0, 3, 6, 9, 12]), np.array([3, 6, 9, 12, 15]))
    assert len(a) == 4 and len(runs.touching(np.arange(5), np.array([0, 3, 6, 9, 12]), np.array([3, 6, 9, 12, 15]), False)[0]) == 0
