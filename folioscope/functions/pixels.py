"""Page images as arrays of bytes, (rows, columns) in grey or (rows, columns, 3) in colour: PNG in and out, and what is done to single pixels.

All steps are deterministic and hold a few copies of one page. Values follow the public definitions of the usual image libraries, so that pages prepared
here look like theirs: rounding, borders and anchors are stated with each step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS = 1 << 28


def encode(page: np.ndarray) -> bytes:
    """PNG of a page."""
    h, w = page.shape[:2]
    lines = np.zeros((h, 1 + page[0].size if h else 1), np.uint8)
    lines[:, 1:] = page.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if page.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def _unfilter(raw: bytes, h: int, row: int, step: int) -> np.ndarray:
    """Bytes of a PNG's lines with their prediction undone."""
    if len(raw) < h * (row + 1):
        raise ValueError("a PNG that ends too early")
    lines = np.frombuffer(raw, np.uint8, h * (row + 1)).reshape(h, row + 1)
    out = np.zeros((h + 1, row), np.uint8)
    for y in range(h):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            padded = np.zeros(-(-row // step) * step, np.uint8)
            padded[:row] = line
            out[y + 1] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:row]
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            done, up, data = bytearray(row), above.tolist(), line.tolist()
            for x in range(row):
                a, b = (done[x - step] if x >= step else 0), up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[x] = (data[x] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(done), np.uint8)
        else:
            raise ValueError(f"PNG filter {kind}")
    return out[1:]


def decode(content: bytes) -> np.ndarray:
    """The page of a PNG of 8 bits a sample (grey, colour or palette, not interlaced); transparency is dropped. ValueError if it's anything else."""
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, head, palette, data = len(SIGNATURE), None, None, []
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        at += size + 12
        if content[at - 4 : at] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a PNG with a broken part")
        if kind == b"IHDR" and size == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None:
        raise ValueError("a PNG without a header")
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced or not 0 < w * h <= MOST_PIXELS:
        raise ValueError(f"PNG of {w} x {h}, {depth} bits, colour {colour}, interlaced {interlaced}")
    step = CHANNELS[colour]
    size = h * (w * step + 1)
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), size)
    except zlib.error as e:
        raise ValueError(f"a broken PNG: {e}") from e
    page = _unfilter(raw, h, w * step, step).reshape(h, w, step)
    if colour == 3:
        if palette is None or len(palette) <= int(page.max()):
            raise ValueError("a PNG without its palette")
        return palette[page[:, :, 0]]
    return page[:, :, 0] if colour in (0, 4) else np.ascontiguousarray(page[:, :, :3])


def grey(page: np.ndarray) -> np.ndarray:
    """Luma in 16-bit fixed point, rounded."""
    if page.ndim == 2:
        return page
    # fixed values: weights of red, green and blue, in 65536ths
    return ((page.astype(np.int32) @ np.array([19595, 38470, 7471], np.int32) + 32768) >> 16).astype(np.uint8)


def colour(page: np.ndarray) -> np.ndarray:
    return page if page.ndim == 3 else np.repeat(page[:, :, None], 3, axis=2)


def _taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights in 22-bit fixed point) of the Lanczos window of three lobes for each of `new` samples; it widens as pages shrink."""
    scale = old / new
    wide = max(scale, 1.0)
    reach = 3.0 * wide
    middle = (np.arange(new) + 0.5) * scale
    low = np.maximum((middle - reach + 0.5).astype(np.int64), 0)
    high = np.minimum((middle + reach + 0.5).astype(np.int64), old)
    place = low[:, None] + np.arange(int((high - low).max()))
    x = (place - middle[:, None] + 0.5) / wide
    weight = np.where((np.abs(x) < 3.0) & (place < high[:, None]), np.sinc(x) * np.sinc(x / 3.0), 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.minimum(place, old - 1), np.floor(weight * (1 << 22) + 0.5).astype(np.int64)


def _along_columns(page: np.ndarray, new: int) -> np.ndarray:
    place, weight = _taps(page.shape[1], new)
    total = np.full((page.shape[0], new, *page.shape[2:]), 1 << 21, np.int64)
    for k in range(place.shape[1]):
        total += page[:, place[:, k]] * weight[:, k].reshape(-1, *[1] * (page.ndim - 2))
    return np.clip(total >> 22, 0, 255).astype(np.uint8)


def resize(page: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos, columns first, each direction rounded to bytes."""
    width, height = max(width, 1), max(height, 1)
    if width != page.shape[1]:
        page = _along_columns(page, width)
    if height != page.shape[0]:
        page = np.ascontiguousarray(_along_columns(page.swapaxes(0, 1), height).swapaxes(0, 1))
    return page


def blend(plain: np.ndarray | int, page: np.ndarray, factor: float) -> np.ndarray:
    """plain + factor * (page - plain), held to bytes and cut off."""
    low = np.asarray(plain, np.float32)
    return np.clip(low + np.float32(factor) * (page.astype(np.float32) - low), 0, 255).astype(np.uint8)


def sharpen(page: np.ndarray, factor: float) -> np.ndarray:
    """Away from a smoothed page (each pixel counts 5 times, its eight neighbours once); the outermost pixels stay."""
    smooth = page.copy()
    if min(page.shape[:2]) > 2:
        h, w = page.shape[:2]
        total = 4 * page[1:-1, 1:-1].astype(np.int32)
        for dy in range(3):
            for dx in range(3):
                total += page[dy : h - 2 + dy, dx : w - 2 + dx]
        smooth[1:-1, 1:-1] = (2 * total + 13) // 26
    return blend(smooth, page, factor)


def contrast(page: np.ndarray, factor: float) -> np.ndarray:
    """Away from the page's rounded mean."""
    return blend(int(grey(page).mean() + 0.5), page, factor)


def gaussian(page: np.ndarray, size: int) -> np.ndarray:
    """Blur by a window of `size`, of the width that usually goes with it; edges repeat. Rounded half to even."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    k = (k / k.sum()).astype(np.float32)
    out = page.astype(np.float32)
    for axis in (1, 0):
        edge = [(0, 0), (0, 0)]
        edge[axis] = (size // 2, size // 2)
        padded, n = np.pad(out, edge, "edge"), out.shape[axis]
        out = sum(k[i] * (padded[:, i : i + n] if axis else padded[i : i + n]) for i in range(size))
    return np.rint(out).astype(np.uint8)


def adaptive(page: np.ndarray, size: int, less: int) -> np.ndarray:
    """White where a pixel is over its blurred surroundings less `less`."""
    return np.where(page.astype(np.int16) > gaussian(page, size).astype(np.int16) - less, 255, 0).astype(np.uint8)


def otsu(page: np.ndarray) -> int:
    """The threshold that parts the histogram into the two classes furthest from each other; the lowest of equals."""
    n = np.bincount(page.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    share = below * (below[-1] - below)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(share > 0, (total[-1] * below - total * below[-1]) ** 2 / share, 0.0)
    return int(between.argmax())


def binarize(page: np.ndarray) -> np.ndarray:
    return np.where(page > otsu(page), 255, 0).astype(np.uint8)


def clahe(page: np.ndarray, clip: float, tiles: int = 8) -> np.ndarray:
    """Equalised by the clipped histograms of tiles x tiles parts, interpolated between their middles; sides that don't divide are mirrored on, without the edge."""
    h, w = page.shape
    add = (tiles - h % tiles, tiles - w % tiles) if h % tiles or w % tiles else (0, 0)
    whole = np.pad(page, ((0, add[0]), (0, add[1])), "reflect" if min(h, w) > 1 else "edge")
    th, tw = whole.shape[0] // tiles, whole.shape[1] // tiles
    area = th * tw
    most = max(int(clip * area / 256), 1)
    tables = np.empty((tiles, tiles, 256), np.float32)
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(whole[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + over // 256
            left = over % 256
            if left:
                n[np.arange(256)[:: max(256 // left, 1)][:left]] += 1
            tables[i, j] = np.clip(np.rint(np.cumsum(n).astype(np.float32) * np.float32(255 / area)), 0, 255)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.arange(n, dtype=np.float32) / np.float32(size) - np.float32(0.5)
        low = np.floor(x).astype(np.int64)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), x - low

    (y1, y2, ya), (x1, x2, xa) = between(h, th), between(w, tw)
    out = np.empty_like(page)
    for y in range(h):
        v = page[y]
        upper = tables[y1[y], x1, v] * (1 - xa) + tables[y1[y], x2, v] * xa
        lower = tables[y2[y], x1, v] * (1 - xa) + tables[y2[y], x2, v] * xa
        out[y] = np.clip(np.rint(upper * (1 - ya[y]) + lower * ya[y]), 0, 255)
    return out


def denoise(page: np.ndarray, strength: float, patch: int = 7, search: int = 21, band: int = 128) -> np.ndarray:
    """Non-local means: each pixel becomes the mean of those around it, by how alike their patches are; edges are mirrored. In bands of rows."""
    h, w = page.shape
    p, s = patch // 2, search // 2
    padded = np.pad(page, p + s, "reflect" if min(h, w) > p + s else "symmetric").astype(np.float32)
    out = np.empty_like(page)
    for top in range(0, h, band):
        n = min(band, h - top)
        mine = padded[top + s : top + s + n + 2 * p, s : s + w + 2 * p]
        total, weights = np.zeros((n, w), np.float32), np.zeros((n, w), np.float32)
        for dy in range(search):
            for dx in range(search):
                other = padded[top + dy : top + dy + n + 2 * p, dx : dx + w + 2 * p]
                far = (mine - other) ** 2
                far = sum(far[k : k + n] for k in range(patch))
                far = sum(far[:, k : k + w] for k in range(patch))
                weight = np.exp(far * np.float32(-1 / (patch * patch * strength * strength)))
                weight[weight < 0.001] = 0
                total += weight * other[p : p + n, p : p + w]
                weights += weight
        out[top : top + n] = np.clip(np.rint(total / weights), 0, 255)
    return out


def _spread(page: np.ndarray, width: int, height: int, step: np.ufunc, edge: int) -> np.ndarray:
    """max or min over a width x height window anchored at its middle (the later one of two)."""
    padded = np.pad(page, ((height // 2, height - 1 - height // 2), (width // 2, width - 1 - width // 2)), constant_values=edge)
    h, w = page.shape
    parts = [padded[y : y + h, x : x + w] for y in range(height) for x in range(width)]
    return step.reduce(parts)


def dilate(page: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        page = _spread(page, width, height, np.maximum, 0)
    return page


def erode(page: np.ndarray, width: int, height: int) -> np.ndarray:
    return _spread(page, width, height, np.minimum, 255)


def small_components(on: np.ndarray, less: int) -> np.ndarray:
    """Where `on` pixels (eight neighbours) form components of fewer than `less` pixels.

    Labels spread only as far as such a component reaches; a label's pixels are one if none of them touches another label.
    """
    h, w = on.shape
    label = np.where(on, np.arange(1, h * w + 1).reshape(h, w), 0)
    nothing = h * w + 1
    around = lambda a, fill: [np.pad(a, 1, constant_values=fill)[y : y + h, x : x + w] for y in range(3) for x in range(3)]
    for _ in range(less):
        label = np.where(on, np.minimum.reduce(around(np.where(on, label, nothing), nothing)), 0)
    touching = np.zeros((h, w), bool)
    for other in around(label, 0):
        touching |= on & (other > 0) & (other != label)
    size = np.bincount(label.ravel(), minlength=nothing)
    part = np.bincount(label[touching], minlength=nothing) > 0
    return on & (size[label] < less) & ~part[label]


def edges(page: np.ndarray, low: int, high: int) -> np.ndarray:
    """Canny: ridges of the 3 x 3 Sobel gradient (sum of both sizes) over `low` that hang on to one over `high`; edges repeat."""
    a = np.pad(page, 1, "edge").astype(np.int32)
    side = a[:-2] + 2 * a[1:-1] + a[2:]
    gx = side[:, 2:] - side[:, :-2]
    top = a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
    gy = top[2:] - top[:-2]
    size = np.abs(gx) + np.abs(gy)
    padded = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = np.abs(gy) < np.abs(gx) * 0.4142135623730951, np.abs(gy) > np.abs(gx) * 2.414213562373095
    same = (gx ^ gy) >= 0
    ridge = np.where(
        flat, (size > at(0, -1)) & (size >= at(0, 1)),
        np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(same, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))),
    )
    weak = ridge & (size > low)
    found = weak & (size > high)
    front = found
    while front.any():
        p = np.pad(front, 1)
        near = np.logical_or.reduce([p[y : y + h, x : x + w] for y in range(3) for x in range(3)])
        front = near & weak & ~found
        found = found | front
    return found


def level_lines(on: np.ndarray, votes: int = 100, length: int = 100, gap: int = 10, most: int = 9) -> list[float]:
    """Angles in degrees, downwards to the right, of straight runs of `on` pixels within `most` degrees of level.

    Hough votes at whole degrees; of the fullest line the runs of at least `length` with no gap over `gap` are taken and their pixels
    leave the vote, until no line has `votes` votes.
    """
    y, x = np.nonzero(on)
    turns = np.deg2rad(np.arange(-most, most + 1))
    base = x.max(initial=0) + 1
    rho = np.rint(np.outer(np.cos(turns), y) - np.outer(np.sin(turns), x)).astype(np.int64) + base
    size = int(rho.max(initial=0)) + 1
    counts = np.stack([np.bincount(r, minlength=size) for r in rho])
    left, found = np.ones(len(x), bool), []
    while True:
        t, r = np.unravel_index(counts.argmax(), counts.shape)
        if counts[t, r] < votes:
            return found
        line = np.nonzero((rho[t] == r) & left)[0]
        line = line[np.argsort(x[line], kind="stable")]
        for run in np.split(line, np.nonzero(np.diff(x[line]) > gap)[0] + 1):
            if x[run[-1]] - x[run[0]] >= length:
                a, b = run[0], run[-1]
                found.append(float(np.degrees(np.arctan2(y[b] - y[a], x[b] - x[a]))))
        left[line] = False
        for k in range(len(turns)):
            counts[k] -= np.bincount(rho[k][line], minlength=size)


def rotate(page: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned counter-clockwise about its middle onto a page that holds all of it; nearest pixels."""
    h, w = page.shape[:2]
    turn = -np.deg2rad(degrees)
    c, s = round(float(np.cos(turn)), 15), round(float(np.sin(turn)), 15)
    x, y = np.array([0, w, w, 0]) - w / 2, np.array([0, 0, h, h]) - h / 2
    nx, ny = c * x + s * y + w / 2, -s * x + c * y + h / 2
    nw, nh = int(np.ceil(nx.max()) - np.floor(nx.min())), int(np.ceil(ny.max()) - np.floor(ny.min()))
    gx, gy = np.arange(nw) + 0.5 - nw / 2, (np.arange(nh) + 0.5 - nh / 2)[:, None]
    px, py = np.floor(c * gx + s * gy + w / 2).astype(np.int64), np.floor(-s * gx + c * gy + h / 2).astype(np.int64)
    inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    out = np.full((nh, nw, *page.shape[2:]), fill, np.uint8)
    out[inside] = page[py[inside], px[inside]]
    return out


def peaks(share: np.ndarray, least: float, apart: int) -> list[int]:
    """Inner maxima (the middle of a level one) of at least `least`, the higher first, none nearer than `apart` to a kept one."""
    at, i, n = [], 1, len(share)
    while i < n - 1:
        j = i
        while j < n - 1 and share[j + 1] == share[i]:
            j += 1
        if share[i - 1] < share[i] and j < n - 1 and share[j + 1] < share[i]:
            at.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted((p for p in at if share[p] >= least), key=lambda p: (-share[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    return sorted(kept)
