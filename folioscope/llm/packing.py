"""Operator 5: best-fit decreasing sequence packing with certified lower bounds.

Documents become token ids, as the unmodified tokenizer file gives them, and an end id; longer ones are cut into pieces of the capacity, of which
only the first may be shorter. Pieces that fill a sequence stand alone. The others are dealt at random to partitions of about
`part_rows` pieces, and each partition is packed by best-fit decreasing. Dual-feasible functions give each partition
a lower bound on its number of sequences: where it is met, the packing is proven best. Then partitions exchange documents: those with a gap give all
their sequences that aren't full, those without one only their emptiest, into pools of about `fan` partitions' rows; best-fit
decreasing runs again over each pool, and its packing is taken if it has fewer sequences. When such a round saves nothing, all sequences that aren't full
are pooled in the same way. Rounds go on until the whole table's own bound is met or that saves nothing either. Every step holds one partition or one pool, never a table; partitions are dealt by row, so no key can be hot.
`certificate` states the whole table's sequences and bound.

A null or empty text is the end id alone. Repeated rows and null doc_ids are packed like any others.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
PART_ROWS = 8192
FAN = 8
#: Distinct chunks of text whose ids a worker process keeps; beyond it the memory of them starts anew.
CACHE = 600_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
PACKED = PIECES + ", sequence_id long, offset long, unit long, gap long, fill long, emptiest boolean"


#: Encoders and ids of chunks that a worker process has made, by tokenizer file.
_encoders: dict[str, Callable[[str], list[int]]] = {}
_known: dict[str, dict[str, bytes]] = {}
_added: dict[str, tuple[list[bytes], Callable[[str], list[int]]]] = {}
#: Bytes that may begin or end white space other than a space or a line feed: control characters, and parts of U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000.
_RARE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0xE1, 0xE2, 0xE3])
_BLANK = np.isin(np.arange(256), [10, 32])


def encoder(tokenizer_path: str) -> Callable[[str], list[int]]:
    """Text without added tokens' strings to ids as `tokenizers` gives them for the file (such strings are ordinary text to it; see ids_of).

    `tokenizers` takes six times as long for words that it hasn't seen as tiktoken, which needs only ranks. So where the
    file is a byte-level BPE whose ids follow its merges, tiktoken gets its vocabulary; other files are left to `tokenizers`.
    """
    if tokenizer_path in _encoders:
        return _encoders[tokenizer_path]
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        model = json.load(f)
    slow = Tokenizer.from_file(tokenizer_path)
    slow.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"] for x in model.get("added_tokens", [])}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special and all(c in byte_of for c in t)}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"].get("merges", [])]
    vocab = model["model"]["vocab"]
    ordered = [vocab[m] for m in merges]
    before = model.get("pre_tokenizer") or {}
    fits = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not model.get("normalizer") and ordered == sorted(ordered) and len(ranks) == len(merges) + 256
    if fits:
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = "It's 3,000 naïve été's words…  two\n\nlines\t<|endoftext|> 日本 $$$### a "
        if list(fast(probe)) != slow.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{tokenizer_path} isn't read alike by both libraries")
        _encoders[tokenizer_path] = fast
    else:
        _encoders[tokenizer_path] = lambda text: slow.encode(text, add_special_tokens=False).ids
    return _encoders[tokenizer_path]


def added_tokens(tokenizer_path: str) -> tuple[list[bytes], Callable[[str], list[int]]]:
    """(strings of the file's added tokens, text to ids as the file has it, each such string being one id)."""
    if tokenizer_path not in _added:
        import json

        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            strings = [x["content"].encode() for x in json.load(f).get("added_tokens", [])]
        own = Tokenizer.from_file(tokenizer_path)
        _added[tokenizer_path] = strings, lambda text: own.encode(text, add_special_tokens=False).ids
    return _added[tokenizer_path]


class _Chunks(dict):
    """Ids of chunks as bytes, made when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = array("I", self.encode(chunk)).tobytes()
        return ids


def ids_of(tokenizer_path: str, specials: bool = True) -> Callable[[list[bytes]], list[bytes]]:
    """UTF-8 texts to ids as little-endian unsigned 32-bit bytes.

    Byte-level pre-tokens never reach over the place before a lone space, so a text without adjacent white space
    is the concatenation of its space-led chunks; each distinct chunk is encoded once. Other texts are encoded whole. Texts that hold
    an added token's string go through `tokenizers` as the file has it; without `specials` the string is ordinary text.
    """
    encode = encoder(tokenizer_path)
    strings, by_file = added_tokens(tokenizer_path) if specials else ([], encode)
    known = _known.setdefault(tokenizer_path, _Chunks(encode))

    def as_bytes(text: str) -> bytes:
        return np.array(encode(text), "<u4").tobytes()

    def run(texts: list[bytes]) -> list[bytes]:
        if len(known) > CACHE:
            known.clear()
        data = np.frombuffer(b"x" + b"x".join(texts) + b"x", np.uint8)
        blank = _BLANK[data]
        odd = np.nonzero(_RARE[data] | (blank & np.roll(blank, 1)))[0]
        starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
        whole = set((np.searchsorted(starts, odd, side="right") - 1).tolist())
        out = []
        for i, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            if any(x in raw for x in strings):
                out.append(np.array(by_file(text), "<u4").tobytes())
                continue
            if i in whole or not text:
                out.append(as_bytes(text))
                continue
            first, *rest = text.split(" ")
            chunks = [first, *(" " + x for x in rest)]
            out.append(b"".join(map(known.__getitem__, chunks)))
        return out

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """A row for each piece, with a number (uid) of its own; to be written before it is used twice."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = ids_of(tokenizer_path, specials), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in common.slices(batch, 1, common.SLICE_BYTES // 2):
                out: list[list] = [[] for _ in range(6)]
                for doc, ids in zip(part.column(0).to_pylist(), encode(common.texts_of(part.column(1))), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, x in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), uid), strict=True):
                            column.append(x)
                        uid += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Least number of bins for these sizes."""
    return bound_of(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(h: np.ndarray, capacity: int) -> int:
    """Least number of bins for h[w] pieces of each size w, by two families of dual-feasible functions, over all their thresholds."""
    if not h.sum():
        return 0
    c, w = capacity, np.arange(capacity + 1)
    count, load = np.cumsum(h), np.cumsum(h * w)
    best = int(load[-1])
    # sizes over c - e count as c, those under e as nothing
    e = np.arange(1, c // 2 + 1)
    best = max(best, int(((count[-1] - count[c - e]) * c + load[c - e] - load[e - 1]).max()))
    out = -(-best // c)
    # sizes are rounded to multiples of c / k
    for k in range(1, 21):
        scaled = np.where(((k + 1) * w) % c == 0, w * k, ((k + 1) * w // c) * c)  # times k
        out = max(out, -(-int((h * scaled).sum()) // (c * k)))
    return out


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: largest first, each into the fullest bin that has room."""
    bins, by_room, rooms, n = np.empty(len(sizes), np.int64), [[] for _ in range(capacity + 1)], 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        w = int(sizes[i])
        if m := rooms >> w:
            room = w + (m & -m).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if left := room - w:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _laid(rows: pa.Table, bins: np.ndarray, sizes: np.ndarray, capacity: int, unit: int, gap: int) -> pa.Table:
    """rows with places in their bins, in the order of uid."""
    load = np.bincount(bins, weights=sizes).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.concatenate([[0], np.cumsum(load)[:-1]])
    offset = np.empty(len(bins), np.int64)
    offset[order] = ends - sizes[order] - first[bins[order]]
    n = len(bins)
    for name, x in (("sequence_id", (unit << 24) + bins), ("offset", offset), ("unit", np.full(n, unit)), ("gap", np.full(n, gap)), ("fill", load[bins]), ("emptiest", bins == load.argmin())):
        rows = rows.append_column(name, pa.array(x))
    return rows


def _repack(capacity: int, r: int, names: list[str]):
    """Best-fit decreasing over a pool of pieces; what they had stays if it takes no more sequences."""

    def again(key, rows):
        rows = rows.sort_by("uid")
        sizes, unit = rows["length"].to_numpy(), (r << 32) + key[0].as_py()
        old, old_bins = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        bins = best_fit_decreasing(sizes, capacity)
        if bins.max() + 1 >= len(old):
            bins = old_bins
        # sequences that were full before the exchange are at their bound, so the pool's own bound certifies it
        gap = int(bins.max()) + 1 - lower_bound(sizes, capacity)
        return _laid(rows.select(names), bins, sizes, capacity, unit, gap)

    return again


def _bound(items: DataFrame, capacity: int) -> int:
    """Least number of sequences for all pieces; their sizes reach the driver as at most `capacity` counts."""
    got = items.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    h = np.zeros(capacity + 1, np.int64)
    h[got["length"].to_numpy()] = got["n"].to_numpy()
    return bound_of(h, capacity)


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, fan: int = FAN, rounds: int | None = None) -> DataFrame:
    """PACKED rows for `items` (PIECES, written): places, and per unit the gap to its bound (0: proven best).

    unit and sequence_id are any numbers; those of full pieces are negative. `rounds` ends exchange earlier.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]
    number = lambda x: F.lit(x).cast("long")
    alone = items.where(F.col("length") == capacity).select(*names, (-F.col("uid") - 1).alias("sequence_id"), number(0).alias("offset"), number(-1).alias("unit"), number(0).alias("gap"), number(capacity).alias("fill"), F.lit(False).alias("emptiest"))
    rest = items.where(F.col("length") < capacity)
    parts = max(1, -(-rest.count() // part_rows))

    def first(key, rows):
        rows = rows.select(names).sort_by("uid")
        sizes = rows["length"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        return _laid(rows, bins, sizes, capacity, key[0].as_py(), int(bins.max()) + 1 - lower_bound(sizes, capacity))

    dealt = rest.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    state = common.materialize(dealt.groupBy("part").applyInArrow(first, PACKED), "packed")
    sequences = lambda df: df.where("offset = 0").count()
    free = (F.col("fill") < capacity) & ((F.col("gap") > 0) | F.col("emptiest"))
    done, r, wide = [], 0, False
    excess = sequences(state) - _bound(rest, capacity)
    while excess > 0 and (rounds is None or r < rounds):
        r += 1
        if wide:
            for x in done:
                state = state.unionByName(x)
            done = []
        takes = F.col("fill") < capacity if wide else free
        gives = state.where(takes)
        rows, units = gives.agg(F.count("*"), F.count_distinct("unit")).first()
        saved = 0
        if units > 1:
            pools = -(-rows // (fan * part_rows))
            pooled = gives.withColumn("pool", F.pmod(F.xxhash64("sequence_id" if wide else "unit", F.lit(r)), F.lit(pools))).groupBy("pool").applyInArrow(_repack(capacity, r, names), PACKED)
            before = sequences(gives)
            done.append(state.where(~takes))
            state = common.materialize(pooled, "packed")
            saved = before - sequences(state)
            excess -= saved
        if wide and not saved:
            break
        wide = not saved
    out = state
    for x in (alone, *done):
        out = out.unionByName(x)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (sequences, bound, tokens) for PACKED rows: bound is what no packing of all their pieces can be under."""
    bound = _bound(packed, capacity)
    return packed.agg(F.count_if(F.col("offset") == 0).alias("sequences"), F.lit(bound).alias("bound"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """PACKED rows of all documents; with `specials`, ids are those of the unmodified tokenizer file."""
    return pack(common.materialize(pieces(docs, tokenizer_path, capacity, 0, id_col, text_col, specials), "pieces"), capacity)
