"""Pixel steps against plain loops, and pages through Spark."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import pixels as P
from folioscope.operators import image
from folioscope.plans import options, pipeline

RNG = np.random.default_rng(7)


def noise(h, w, *more):
    return RNG.integers(0, 256, (h, w, *more), np.uint8)


def written(angle=0.0, h=400, w=600):
    """White, with black level bars like underlined lines of text."""
    page = np.full((h, w), 255, np.uint8)
    page[60 : h - 60 : 40, 80 : w - 80] = 0
    page[61 : h - 60 : 40, 80 : w - 80] = 0
    return P.rotate(page, angle) if angle else page


def filtered(page, kinds):
    """A PNG whose lines use the given filters in turn."""
    h, w = page.shape[:2]
    step = page[0, 0].size
    rows, out = page.reshape(h, -1).astype(int), bytearray()
    for y in range(h):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for x in range(w * step):
            a = rows[y, x - step] if x >= step else 0
            b = rows[y - 1, x] if y else 0
            c = rows[y - 1, x - step] if y and x >= step else 0
            near = min((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c)))[2]
            out.append(int(rows[y, x] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    plain = P.encode(page)
    at = plain.index(b"IDAT") - 4
    body = zlib.compress(bytes(out))
    return plain[:at] + len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big") + plain[-12:]


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (9, 4, 3)])
def test_png(shape):
    page = noise(*shape)
    assert np.array_equal(P.decode(P.encode(page)), page)
    assert np.array_equal(P.decode(filtered(page, (0, 1, 2, 3, 4))), page)
    for broken in (b"", b"no", P.encode(page)[:30], P.encode(page)[:-20]):
        with pytest.raises(ValueError):
            P.decode(broken)


def test_otsu_and_thresholds():
    page = np.concatenate([RNG.normal(60, 9, 300), RNG.normal(180, 20, 500)]).clip(0, 255).astype(np.uint8).reshape(20, 40)

    def between(t):
        a, b = page[page <= t].astype(float), page[page > t].astype(float)
        return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else 0.0

    scores = [between(t) for t in range(256)]
    assert math.isclose(scores[P.otsu(page)], max(scores)) and set(np.unique(P.binarize(page))) == {0, 255}
    assert P.otsu(np.full((3, 3), 9, np.uint8)) == 0
    page, size = noise(9, 12), 5
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-(np.arange(-2, 3) ** 2) / (2 * sigma**2))
    k /= k.sum()
    padded = np.pad(page, 2, "edge").astype(float)
    blurred = np.array([[(np.outer(k, k) * padded[y : y + 5, x : x + 5]).sum() for x in range(12)] for y in range(9)])
    assert np.abs(P.gaussian(page, size) - blurred).max() <= 0.501
    assert np.array_equal(P.adaptive(page, size, 4) > 0, page.astype(int) > P.gaussian(page, size).astype(int) - 4)


def test_shapes_and_specks():
    page = noise(11, 13)
    for w, h in ((2, 1), (2, 2), (1, 1), (3, 3)):
        window = lambda y, x: [page[j, i] for j in range(y - h // 2, y - h // 2 + h) for i in range(x - w // 2, x - w // 2 + w) if 0 <= j < 11 and 0 <= i < 13]  # noqa: E731, B023
        assert np.array_equal(P.dilate(page, w, h), [[max(window(y, x)) for x in range(13)] for y in range(11)])
        assert np.array_equal(P.erode(page, w, h), [[min(window(y, x)) for x in range(13)] for y in range(11)])
    for share in (0.1, 0.25, 0.4):
        on = RNG.random((30, 40)) < share
        seen, want = set(), np.zeros_like(on)
        for start in zip(*np.nonzero(on), strict=True):
            part, front = {start}, [start]
            while front:
                y, x = front.pop()
                for n in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if 0 <= n[0] < 30 and 0 <= n[1] < 40 and on[n] and n not in part:
                        part.add(n)
                        front.append(n)
            for p in part if len(part) < 5 else ():
                want[p] = True
            seen |= part
        assert np.array_equal(P.small_components(on, 5), want)


def test_sizes_and_sharpness():
    flat = np.full((40, 30), 77, np.uint8)
    assert (P.resize(flat, 61, 17) == 77).all() and P.resize(noise(9, 9, 3), 4, 20).shape == (20, 4, 3)
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None], 5, axis=0)
    assert np.abs(P.resize(ramp, 200, 5)[0, 20:180].astype(int) - (np.arange(20, 180) + 0.5 - 1)).max() <= 1
    page = noise(6, 7)
    sharp = P.sharpen(page, 1.5)
    assert np.array_equal(sharp[0], page[0]) and np.array_equal(sharp[:, -1], page[:, -1]) and np.array_equal(P.sharpen(page, 1.0), page)
    near = page[1:4, 2:5].astype(int)
    smooth = math.floor((near.sum() + 4 * near[1, 1]) / 13 + 0.5)
    assert sharp[2, 3] == int(min(max(smooth + 1.5 * (near[1, 1] - smooth), 0), 255))
    assert P.contrast(flat, 1.5).tolist() == flat.tolist() and P.grey(np.full((1, 1, 3), 200, np.uint8))[0, 0] == 200


def test_contrast_of_parts():
    page = (noise(50, 70) // 4 + 90).astype(np.uint8)
    out = P.clahe(page, 2.0)
    assert out.shape == page.shape and out.std() > page.std()
    # the middle of a part takes its own table
    page = noise(80, 80) // 2
    part = page[30:40, 30:40]
    n = np.bincount(part.ravel(), minlength=256)
    over = int((n - np.minimum(n, 1)).sum())
    n = np.minimum(n, 1) + over // 256
    left = over % 256
    for i in range(left):
        n[i * max(256 // left, 1)] += 1
    y, x = 35, 35
    table = np.rint(np.cumsum(n) * 255 / 100)
    assert P.clahe(page, 2.0)[y, x] == np.clip(table[page[y, x]], 0, 255)


def test_noise_against_loops():
    page = noise(9, 8) // 8 + 100
    padded = np.pad(page, 13, "symmetric").astype(float)
    want = np.zeros(page.shape)
    for y in range(9):
        for x in range(8):
            mine, total, weights = padded[y + 10 : y + 17, x + 10 : x + 17], 0.0, 0.0
            for j in range(21):
                for i in range(21):
                    other = padded[y + j : y + j + 7, x + i : x + i + 7]
                    w = math.exp(-((mine - other) ** 2).mean() / 100)
                    w = w if w >= 0.001 else 0.0
                    total, weights = total + w * other[3, 3], weights + w
            want[y, x] = total / weights
    assert np.abs(P.denoise(page, 10, band=4) - want).max() <= 0.51


@pytest.mark.parametrize("angle", [3.0, -2.0, 5.5])
def test_straightening(angle):
    leaning = written(angle)
    assert abs(image.skew(leaning) + angle) < 0.4
    assert abs(image.skew(image.deskew(leaning))) < 0.4
    assert image.skew(written()) == 0 and image.skew(np.full((50, 50), 255, np.uint8)) == 0 and image.skew(noise(30, 40)) == 0


def test_borders_and_choice():
    page = np.full((100, 200), 255, np.uint8)
    assert image.crop(page).shape == (96, 192)
    page[40:50, 60:90] = 0
    assert image.crop(page).shape == (30, 50) and image.crop(page)[10, 10] == 0
    page[0, 0] = 240
    assert image.crop(page).shape == (70, 110)
    two = np.where(RNG.random((60, 60)) < 0.3, 40, 200) + RNG.integers(-3, 4, (60, 60))
    assert set(np.unique(image.binarize_if_clear(two.astype(np.uint8)))) == {0, 255}
    calm = RNG.normal(150, 3, (40, 40)).astype(np.uint8)
    assert np.array_equal(image.binarize_if_clear(calm), calm)
    assert set(np.unique(image.binarize_if_clear(noise(40, 40)))) == {0, 255}
    assert P.peaks(np.array([0, 3, 1, 2, 2, 1, 5.0, 0]), 1, 1) == [1, 3, 6] and P.peaks(np.array([0, 3, 1, 2, 2, 1, 5.0, 0]), 1, 4) == [1, 6]


def test_whole_preparations():
    page = written(2.0, 240, 320)
    for more in ({}, {"more_contrast": True}, {"by_hand": True}, {"dilate": True, "binarize": True}):
        out = image.full(page, 300, colour=not more, **more)
        assert out.shape[1] <= 300 and out.ndim == (2 if more else 3)
    assert image.light(page, 1600, 1000).shape[1] == 1000 and image.light(noise(20, 3000), 2000).shape == (13, 2000, 3)
    assert image.grey_contrast(noise(10, 2048, 3)).shape == (5, 1024) and image.colour_sized(noise(30, 40)).shape == (60, 80, 3) and image.colour_sized(noise(10, 4000)).shape == (5, 2000, 3)
    for step in (image.adaptive_threshold, image.close_gaps, image.thicken, image.handwriting, image.drop_specks, image.local_contrast):
        assert step(noise(24, 31, 3)).shape == (24, 31)


def test_pages(spark, tmp_path):
    page = noise(12, 10, 3)
    (tmp_path / "a.png").write_bytes(P.encode(page))
    (tmp_path / "b.PNG").write_bytes(P.encode(page[:, :, 0]))
    (tmp_path / "c.jpg").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(P.encode(page))
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    found = image.pages(spark, str(tmp_path)).withColumn("sharp", image.on_pages(image.sharpen)("page"))
    out = {r.file_name: r for r in found.collect()}
    assert set(out) == {"a.png", "b.PNG", "c.jpg", "e.pdf"} and out["c.jpg"].page is None and out["c.jpg"].sharp is None and out["e.pdf"].page is None
    assert np.array_equal(P.decode(bytes(out["a.png"].page)), page) and np.array_equal(P.decode(bytes(out["b.PNG"].page)), page[:, :, 0])
    assert np.array_equal(P.decode(bytes(out["a.png"].sharp)), P.sharpen(page, 1.5))
    nothing = spark.createDataFrame([(None,), (bytearray(b"x"),)], "page binary").select(image.on_pages(P.grey)("page").alias("p")).where(F.col("p").isNotNull())
    assert nothing.count() == 0


class Sizes:
    def open(self, settings):
        return lambda content, prompt: "Page of " + " x ".join(map(str, P.decode(content).shape))


def test_pipeline_prepares_pages(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(P.encode(noise(50, 100)))
    (tmp_path / "c.jpg").write_bytes(b"broken")
    prepared = options.Options(first_page=image.first_page, light=image.prepare_light, full=image.prepare_full, retry=False)
    rows = image.pages(spark, str(tmp_path)).withColumnRenamed("page", "content")
    out = {r.file_name: r for r in pipeline.run(rows, pipeline.ModelBackend(Sizes()), "ocr_only", options=prepared).collect()}
    assert out["a.png"].ocr_text.startswith("Page of 500 x 1000 x 3") and "no page" in out["c.jpg"].error
    with pytest.raises(ValueError):
        image.first_page(b"x", ".txt")
