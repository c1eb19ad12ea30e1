"""Operator 9: media columns in Matroska.

`packets` parses EBML elements of variable length, tracks, clusters (also of unknown size), simple blocks and block
groups with all three kinds of lacing, and cues, into a packet table: track, timestamp, key flag and byte range.
`encode` stores bytes losslessly as unsigned 8-bit mono PCM: frames of FRAME samples, LACE frames a block, BLOCKS
blocks a cluster, a cue for each cluster.

A null or empty text is a payload of 64 zero bytes. Each row holds its own container, so a task holds one slice of rows.
A container cut short or broken raises ValueError in `packets`; `packet_table` gives such a row no packets and
the reason in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FRAME, LACE, BLOCKS, RATE = 512, 8, 8, 8000
PAD = 64

# Element ids of the format (fixed values).
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1254C367, 0x1043A770, 0x1941A469
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    size: int
    key: bool
    cluster: int


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)


def _vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, bool]:
    """(value, next place, all value bits set) of a variable-length integer; keep: with its marker, as ids are."""
    if at >= end or not data[at]:
        raise ValueError(f"no element at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise ValueError(f"an integer is cut at byte {at}")
    x = int.from_bytes(data[at : at + n], "big")
    bits = x & ((1 << 7 * n) - 1)
    return (x if keep else bits), at + n, bits == (1 << 7 * n) - 1


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start and end of the content); an unknown size reaches to the parent's end."""
    while at < end:
        kind, at, _ = _vint(data, at, end, keep=True)
        size, at, unknown = _vint(data, at, end)
        stop = end if unknown else at + size
        if stop > end:
            raise ValueError(f"element {kind:x} at byte {at} reaches past its parent")
        if unknown and kind == CLUSTER:  # ends where the next element of the top level begins
            place = at
            while place < end:
                inner, after, _ = _vint(data, place, end, keep=True)
                if inner in TOP_LEVEL:
                    break
                n, after, _ = _vint(data, after, end)
                place = after + n
            stop = min(place, end)
        yield kind, at, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _block(m: Media, data: bytes, a: int, b: int, base: int, key: bool | None, cluster: int) -> None:
    track, at, _ = _vint(data, a, b)
    if at + 3 > b:
        raise ValueError(f"a block is cut at byte {a}")
    (relative,), flags = struct.unpack(">h", data[at : at + 2]), data[at + 2]
    at, lacing = at + 3, flags >> 1 & 3
    sizes: list[int] = []
    if lacing:
        if at >= b:
            raise ValueError(f"a block is cut at byte {a}")
        frames, at = data[at] + 1, at + 1
        if lacing == 1:  # Xiph: runs of 255
            for _ in range(frames - 1):
                n = 0
                while at < b and data[at] == 255:
                    n, at = n + 255, at + 1
                if at >= b:
                    raise ValueError(f"laces reach past the block at byte {a}")
                n, at = n + data[at], at + 1
                sizes.append(n)
        elif lacing == 3:  # EBML: the first size, then signed differences
            if frames > 1:
                n, at, _ = _vint(data, at, b)
                sizes.append(n)
            for _ in range(frames - 2):
                first = at
                d, at, _ = _vint(data, at, b)
                sizes.append(sizes[-1] + d - ((1 << 7 * (at - first) - 1) - 1))
        else:
            if (b - at) % frames:
                raise ValueError(f"fixed lacing doesn't divide the block at byte {a}")
            sizes = [(b - at) // frames] * (frames - 1)
    sizes.append(b - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"laces reach past the block at byte {a}")
    step = m.tracks.get(track, {}).get("frame_ns", 0)
    t = (base + relative) * m.scale
    for k, n in enumerate(sizes):
        m.packets.append(Packet(track, t + k * step, at, n, bool(flags & 0x80) if key is None else key, cluster))
        at += n


def packets(data: bytes) -> Media:
    """Parse a whole container."""
    m, end = Media(), len(data)
    seen = False
    for kind, a, b in _elements(data, 0, end):
        if kind != SEGMENT:
            continue
        seen = True
        for top, c, d in _elements(data, a, b):
            if top == INFO:
                m.scale = next((_uint(data, x, y) for k, x, y in _elements(data, c, d) if k == TIMESTAMP_SCALE), m.scale)
            elif top == TRACKS:
                for k, x, y in _elements(data, c, d):
                    if k == TRACK_ENTRY:
                        parts = {i: (p, q) for i, p, q in _elements(data, x, y)}
                        at = lambda i, parts=parts: _uint(data, *parts[i]) if i in parts else 0
                        m.tracks[at(TRACK_NUMBER)] = {"type": at(TRACK_TYPE), "codec": data[slice(*parts.get(CODEC_ID, (0, 0)))].decode("ascii", "replace"), "frame_ns": at(DEFAULT_DURATION)}
            elif top == CLUSTER:
                base, number = 0, len(m.clusters)
                m.clusters.append(c)
                for k, x, y in _elements(data, c, d):
                    if k == TIMESTAMP:
                        base = _uint(data, x, y)
                    elif k == SIMPLE_BLOCK:
                        _block(m, data, x, y, base, None, number)
                    elif k == BLOCK_GROUP:
                        inner = list(_elements(data, x, y))
                        key = all(i != REFERENCE for i, _, _ in inner)
                        for i, p, q in inner:
                            if i == BLOCK:
                                _block(m, data, p, q, base, key, number)
            elif top == CUES:
                for k, x, y in _elements(data, c, d):
                    if k == CUE_POINT:
                        time = 0
                        for i, p, q in _elements(data, x, y):
                            if i == CUE_TIME:
                                time = _uint(data, p, q)
                            elif i == CUE_POSITIONS:
                                parts = {j: _uint(data, r, s) for j, r, s in _elements(data, p, q)}
                                m.cues.append((time * m.scale, parts.get(CUE_TRACK, 0), a + parts.get(CUE_CLUSTER, 0)))
    if not seen:
        raise ValueError("no segment")
    return m


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def _element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + _size(len(content)) + content


def _number(kind: int, x: int) -> bytes:
    return _element(kind, x.to_bytes(max(1, -(-x.bit_length() // 8)), "big"))


_HEAD = _element(EBML, _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2))
_INFO = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"folioscope") + _element(WRITING_APP, b"folioscope"))
_TRACKS = _element(
    TRACKS,
    _element(TRACK_ENTRY, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))),
)


def _simple_block(frames: list[bytes], relative: int) -> bytes:
    """Fixed lacing for equal frames, EBML lacing for others, none for one frame."""
    sizes = [len(f) for f in frames]
    lacing, head = 0, b""
    if len(frames) > 1:
        lacing, head = (2, b"") if len(set(sizes)) == 1 else (3, _size(sizes[0]))
        if lacing == 3:
            for a, b in zip(sizes, sizes[1:-1], strict=False):
                k = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
                head += (b - a + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
        head = bytes([len(frames) - 1]) + head
    return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, 0x80 | lacing << 1) + head + b"".join(frames))


def encode(payload: bytes) -> bytes:
    """A container with the payload as 8-bit samples."""
    per, body, cues = FRAME * LACE * BLOCKS, _INFO + _TRACKS, b""
    parts, at = [body], len(body)
    for c in range(0, len(payload), per):
        base, blocks = c * 1000 // RATE, []
        for b in range(c, min(c + per, len(payload)), FRAME * LACE):
            frames = [payload[i : min(i + FRAME, len(payload))] for i in range(b, min(b + FRAME * LACE, len(payload)), FRAME)]
            blocks.append(_simple_block(frames, b * 1000 // RATE - base))
        cues += _element(CUE_POINT, _number(CUE_TIME, base) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at)))
        parts.append(_element(CLUSTER, _number(TIMESTAMP, base) + b"".join(blocks)))
        at += len(parts[-1])
    parts.append(_element(CUES, cues))
    return _HEAD + _element(SEGMENT, b"".join(parts))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media: binary): each text padded with zero bytes to a positive multiple of PAD and stored."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.texts_of(batch.column(1))
            stored = [encode(t.ljust(max(PAD, -(-len(t) // PAD) * PAD), b"\0")) for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_slices(rows, "doc_id long, n_bytes long, media binary", make)


def packet_table(media_rows: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: (doc_id, packet, cluster, track, timestamp_ns, start, size, key, error)."""
    schema = "doc_id long, packet int, cluster int, track int, timestamp_ns long, start long, size long, key boolean, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                rows: list[tuple] = []
                for doc, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        rows += [(doc, k, p.cluster, p.track, p.timestamp_ns, p.start, p.size, p.key, None) for k, p in enumerate(packets(data or b"").packets)]
                    except (ValueError, IndexError) as e:
                        rows.append((doc, None, None, None, None, None, None, None, str(e)))
                columns = list(zip(*rows, strict=True)) or [()] * 9
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "packet", "cluster", "track", "timestamp_ns", "start", "size", "key", "error"])

    return media_rows.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def features(media_rows: DataFrame) -> DataFrame:
    """Read each container's payload back through its packet table and digest it."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make():
        def one(data: bytes) -> tuple:
            m = packets(data)
            payload = b"".join(data[p.start : p.start + p.size] for p in m.packets)
            samples = np.frombuffer(payload, np.uint8)
            wide = samples.astype(np.int64)
            levels = np.bincount(samples >> 5, minlength=8).tolist()
            length = m.packets[-1].timestamp_ns // 1_000_000 if m.packets else 0
            text = f"packets={len(m.packets)};clusters={len(m.clusters)};cues={len(m.cues)};last_ms={length};sum={wide.sum()};energy={(wide * wide).sum()};steps={np.abs(np.diff(wide)).sum()};levels={','.join(map(str, levels))}"
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), text

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = list(zip(*map(one, batch.column(2).to_pylist()), strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)

        return step

    return common.map_slices(media_rows.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make, 2)
