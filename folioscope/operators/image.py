"""Preparing page images for models, over DataFrames: decoding, straightening, noise, contrast, sharpening, borders, binarisation.

A page is the bytes of a PNG in a binary column, so that it can be stored and handed to any model. `on_pages` runs steps in
Arrow batches, one page in memory at a time; pixels have no built-in functions in Spark. Null pages stay null; bytes that aren't a page become null.

`pages` reads files by Spark's own image source, which decodes JPEG, PNG, BMP, GIF and TIFF (its first page) in the JVM. PDFs are drawn by PyMuPDF where
that is installed and are null otherwise.

Lines that show a page's skew are found by whole votes instead of random ones, so a page always gets the same angle; a page without any
long line stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import pixels as P
from folioscope.sources import files

Step = Callable[[np.ndarray], np.ndarray]
DRAWN = (".pdf",)
# Sizes and contrast of the two older ways of preparing.
GREY_WIDTH, GREY_CONTRAST = 1024, 1.5
COLOUR_LEAST, COLOUR_MOST = 800, 2000


def adaptive_threshold(page: np.ndarray) -> np.ndarray:
    return P.adaptive(P.grey(page), 15, 8)


def skew(page: np.ndarray) -> float:
    """Degrees a page leans, 0 if under 0.3 or unknown."""
    found = [a for a in P.level_lines(P.edges(P.grey(page), 50, 150)) if abs(a) < 10]
    angle = float(np.median(found)) if found else 0.0
    return angle if abs(angle) >= 0.3 else 0.0


def deskew(page: np.ndarray) -> np.ndarray:
    angle = skew(page)
    return P.rotate(page, angle) if angle else page


def denoise(page: np.ndarray, strength: int = 10) -> np.ndarray:
    return P.denoise(P.grey(page), strength)


def sharpen(page: np.ndarray, factor: float = 1.5) -> np.ndarray:
    return P.sharpen(page, factor)


def local_contrast(page: np.ndarray, clip: float = 2.0) -> np.ndarray:
    return P.clahe(P.grey(page), clip)


def crop(page: np.ndarray, share: float = 0.02, margin: int = 10) -> np.ndarray:
    """What isn't nearly white, and a margin; of a white page all but a share at each side."""
    seen = P.grey(page) <= 240
    h, w = seen.shape
    if not seen.any():
        dx, dy = int(w * share), int(h * share)
        return page[dy : h - dy, dx : w - dx]
    ys, xs = np.nonzero(seen.any(axis=1))[0], np.nonzero(seen.any(axis=0))[0]
    y, x = max(0, ys[0] - margin), max(0, xs[0] - margin)
    return page[y : min(h, y + ys[-1] - ys[0] + 1 + 2 * margin), x : min(w, x + xs[-1] - xs[0] + 1 + 2 * margin)]


def close_gaps(page: np.ndarray) -> np.ndarray:
    return P.erode(P.dilate(P.binarize(P.grey(page)), 2, 2), 2, 2)


def thicken(page: np.ndarray, times: int = 1) -> np.ndarray:
    return P.dilate(P.binarize(P.grey(page)), 2, 1, times)


def handwriting(page: np.ndarray) -> np.ndarray:
    return P.adaptive(P.clahe(P.grey(page), 3.0), 11, 5)


def binarize_if_clear(page: np.ndarray) -> np.ndarray:
    """One threshold if the histogram has two peaks, a local one if values vary much, else the page in its own values."""
    light = P.grey(page)
    share = np.bincount(light.ravel(), minlength=256) / light.size
    if len(P.peaks(share, 0.01, 20)) >= 2:
        return P.binarize(light)
    return P.adaptive(light, 25, 10) if light.std() > 40 else page


def drop_specks(page: np.ndarray) -> np.ndarray:
    """Black on white without black parts of fewer than five pixels."""
    light = P.grey(page)
    dark = light <= P.otsu(light)
    return np.where(dark & ~P.small_components(dark, 5), 0, 255).astype(np.uint8)


def to_width(page: np.ndarray, width: int) -> np.ndarray:
    """No wider than `width`."""
    h, w = page.shape[:2]
    return P.resize(page, width, int(h * (width / w))) if w > width else page


def full(page: np.ndarray, width: int = 2048, colour: bool = True, more_contrast: bool = False, by_hand: bool = False, dilate: bool = False, binarize: bool = False) -> np.ndarray:
    """All steps for scanned pages, in grey; as colour or grey for the model."""
    steps: list[Step] = [
        P.grey, lambda p: P.resize(p, p.shape[1] * 2, p.shape[0] * 2) if max(p.shape) < 1500 else p, deskew, lambda p: denoise(p, 15 if by_hand else 10),
        lambda p: local_contrast(p, 3.0 if more_contrast else 2.0), lambda p: sharpen(p, 1.5 if by_hand else 1.3), lambda p: crop(p, 0.01),
    ]
    steps += [lambda p: local_contrast(p, 3.0), sharpen] if more_contrast else []
    steps += [handwriting] * by_hand + [thicken] * dilate + [binarize_if_clear] * binarize
    steps += [close_gaps, drop_specks] if binarize or by_hand else []
    for step in [*steps, lambda p: to_width(p, width), P.colour if colour else P.grey]:
        page = step(page)
    return page


def light(page: np.ndarray, width: int = 1600, least: int = 1000) -> np.ndarray:
    """Colour, at least and at most so wide, a little sharper."""
    page = P.colour(page)
    h, w = page.shape[:2]
    if w < least:
        page = P.resize(page, int(w * (least / w)), int(h * (least / w)))
    return sharpen(to_width(page, width), 1.2)


def grey_contrast(page: np.ndarray) -> np.ndarray:
    return P.contrast(to_width(P.grey(page), GREY_WIDTH), GREY_CONTRAST)


def colour_sized(page: np.ndarray) -> np.ndarray:
    page = P.colour(page)
    h, w = page.shape[:2]
    page = P.resize(page, w * 2, h * 2) if max(h, w) < COLOUR_LEAST else page
    h, w = page.shape[:2]
    by = COLOUR_MOST / max(h, w)
    return P.resize(page, int(w * by), int(h * by)) if by < 1 else page


def first_page(content: bytes, suffix: str = ".png", dpi: int = 400) -> bytes:
    """PNG of an image or of a document's first page. ValueError if nothing here can decode it."""
    if content.startswith(P.SIGNATURE):
        return content
    if suffix not in files.SUFFIXES:
        raise ValueError(f"Unsupported: {suffix}")
    try:
        import fitz
    except ImportError as e:
        raise ValueError(f"no decoder for {suffix} is installed; read images by `pages`") from e
    with fitz.open(stream=content, filetype=suffix[1:]) as doc:
        return doc[0].get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72) if suffix in DRAWN else None, alpha=False).tobytes("png")


def prepare_light(content: bytes, width: int) -> bytes:
    """`light` from PNG to PNG: for Options."""
    return P.encode(light(P.decode(content), width))


def prepare_full(content: bytes, width: int) -> bytes:
    """`full` in grey, from PNG to PNG: for Options."""
    return P.encode(full(P.decode(content), width, colour=False))


def _kept(content: bytes | None, change: Callable[[bytes], bytes]) -> bytes | None:
    try:
        return None if content is None else change(bytes(content))
    except ValueError:
        return None


def on_pages(*steps: Step) -> Callable[[Column], Column]:
    """A column function that takes pages through steps in turn."""

    def change(content: bytes) -> bytes:
        page = P.decode(content)
        for step in steps:
            page = step(page)
        return P.encode(page)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield pd.Series([_kept(c, change) for c in contents], dtype=object)

    return run


def pages(spark: SparkSession, folder: str, dpi: int = 400) -> DataFrame:
    """(path, file_name, page) of one folder's supported files: each one's first page as a PNG, null if it can't be decoded."""
    name, kind = files.file_name(F.col("path")), files.suffix(F.col("path"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = []
            for h, w, n, data in zip(rows["height"], rows["width"], rows["nChannels"], rows["data"], strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n) if h > 0 and w > 0 else None
                # the source stores blue first
                made.append(None if raw is None else P.encode(raw[:, :, 0] if n == 1 else np.ascontiguousarray(raw[:, :, 2::-1])))
            yield pd.DataFrame({"path": rows["path"], "page": made})

    @F.pandas_udf("binary")
    def drawn(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, kinds in batches:
            yield pd.Series([_kept(c, lambda b, k=k: first_page(b, k, dpi)) for c, k in zip(contents, kinds, strict=True)], dtype=object)

    images = spark.read.format("image").option("dropInvalid", False).load(folder).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    images = images.where(files.supported(F.col("path")) & ~kind.isin(*DRAWN)).mapInPandas(packed, "path string, page binary")
    documents = spark.read.format("binaryFile").load(folder).where(kind.isin(*DRAWN)).select("path", drawn("content", kind).alias("page"))
    return images.union(documents).select("path", name.alias("file_name"), "page")
