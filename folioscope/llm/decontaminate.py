"""Operator 10: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Passages are aligned with test items by word (match 2, mismatch -1, gap -1). A pair is contaminated if its local score reaches
`least` of that of a full copy; items of under SHORT words must occur whole, and items of one or two words must be the
whole text, as such words by themselves show nothing. Items without words match nothing, nor do null or empty texts.

Seeds are pairs of words: neighbours, or with one word between. They follow from the score: an alignment of m matches that reaches S
spends at most 2m - S on what lies between its matches, so, counting 2 for each two matches in a row without a word
between and 1 for each two with one word between on either side or both, it has at least S - 2 points. A place of the item gives at most 2,
so an alignment that reaches S also touches one of any places that are more than (S - 3) / 2 fewer than all: the item's rarest ones, by
counts over the whole corpus, are enough to propose every pair. How common a seed is only decides which places propose, never what is found.

Passages around a seed are as wide as an alignment that reaches S can stretch (BLOCKS of that width with their neighbours, so wide texts
make many passages of fixed width). Before alignment their points are counted exactly; those under S - 2 can't reach S.
Equal passages of a batch are aligned once.

Items are held in blocks of at most `block_words` words (or one longer item); each block is broadcast and joined to the seeds of all texts
where the texts are, so texts are never shuffled and no seed or item makes a hot key. Counts of seeds are
summed per task and then by Spark. Repeated rows give one row per doc_id and item_id (the best alignment).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

LEAST, LEAST_OF_ALL = 0.5, 0.25
SHORT = 8
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1 << 20
BITMAP = 22
#: Cells that one NumPy step of an alignment holds, and hits that one step of counting points holds.
BATCH_CELLS, BATCH_HITS = 250_000, 2_000_000
#: Text bytes of one step; hashing words takes about sixty times as many.
SLICE_BYTES = 512 << 10
FOUND = "doc_id long, item_id long, score long, similarity double, seeds long, start_word long, end_word long"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def items_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words: array of hashes) of the items that have words."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = words.lowered(common.texts_of(batch.column(1)))
            h, owner, _, _ = words.word_hashes(texts)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            rows = [h[a:b].view(np.int64).tolist() for a, b in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["item_id", "words"])

        return step

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_slices(rows, "item_id long, words array<long>", make).where(F.size("words") > 0)


def needed(n: int, least: float) -> int:
    """The score that an item of n words has to reach."""
    return MATCH * n if n < SHORT else int(np.ceil(least * MATCH * n - 1e-9))


def _expand(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of every place in the ranges [first, first + size)."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


class Index:
    """Seeds of one block of items."""

    def __init__(self, ids: list, texts: list[np.ndarray], least: float):
        whole = [i for i, t in enumerate(texts) if len(t) > 2]
        #: items of one or two words, by these
        self.tiny: dict[tuple, list] = {}
        for i, t in zip(ids, texts, strict=True):
            if len(t) <= 2:
                self.tiny.setdefault(tuple(t.tolist()), []).append(i)
        self.ids, self.texts = [ids[i] for i in whole], [texts[i] for i in whole]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.need = np.array([needed(len(t), least) for t in self.texts], np.int64)
        self.reach = 3 * self.size - self.need
        h = np.concatenate(self.texts or [np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.texts)), self.size)
        self.first = np.cumsum(self.size) - self.size
        near, at1 = words.pairs(h, owner, 1)
        wide, at2 = words.pairs(h, owner, 2)
        self.seeds, slot = np.unique(np.concatenate([near, wide]), return_inverse=True)
        at, self_near = np.concatenate([at1, at2]), np.concatenate([np.ones(len(at1), bool), np.zeros(len(at2), bool)])
        self.shift = np.uint64(64 - BITMAP)
        self.bits = np.zeros(1 << BITMAP, bool)
        self.bits[self.seeds >> self.shift] = True
        self.of_place = (slot[: len(at1)], at1, slot[len(at1) :], at2)
        # seeds of each item, and the places they start at
        key = owner[at] * max(len(self.seeds), 1) + slot
        order = np.argsort(key, kind="stable")
        self.keys, cut = np.unique(key[order], return_index=True)
        self.cut = np.append(cut, len(order))
        self.place, self.near = at[order], self_near[order]
        self.proposes = (np.empty(0, np.int64), np.zeros(len(self.seeds) + 1, np.int64))

    def find(self, h: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(seed, word number) of all seeds of the block in the texts: of neighbours, and with one word between."""
        out = []
        for gap in (1, 2):
            g, at = words.pairs(h, owner, gap)
            if not len(self.seeds):
                out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                continue
            keep = np.nonzero(self.bits[g >> self.shift])[0]
            slot = np.minimum(np.searchsorted(self.seeds, g[keep]), len(self.seeds) - 1)
            same = self.seeds[slot] == g[keep]
            out.append((slot[same], at[keep[same]]))
        return out

    def choose(self, counts: np.ndarray, rare: int | None) -> None:
        """Let each item's rarest places propose, as many as no alignment can avoid; and all others with at most `rare` hits."""
        s1, at1, s2, at2 = self.of_place
        hits = np.zeros(int(self.size.sum()), np.int64)
        hits[at1] += counts[s1]
        hits[at2] += counts[s2]
        takes = np.zeros(len(hits), bool)
        for f, n, need in zip(self.first.tolist(), self.size.tolist(), self.need.tolist(), strict=True):
            places = hits[f : f + n - 1]
            takes[f + np.argsort(places, kind="stable")[: n - 1 - (need - 3) // 2]] = True
            if rare is not None:
                takes[f : f + n - 1] |= places <= rare
        slot, at = np.concatenate([s1, s2]), np.concatenate([at1, at2])
        on = takes[at]
        item = np.searchsorted(self.first, at[on], side="right") - 1
        both = np.unique(slot[on] * max(len(self.size), 1) + item)
        slot, item = both // max(len(self.size), 1), both % max(len(self.size), 1)
        self.proposes = item, np.searchsorted(slot, np.arange(len(self.seeds) + 1))

    def passages(self, h: np.ndarray, owner: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, first word, end, places of the item with a seed) of the passages whose points allow the score, in parts."""
        starts = np.searchsorted(owner, np.arange(n + 1))
        found, (by, cut) = self.find(h, owner), self.proposes
        slot, at = (np.concatenate(x) for x in zip(*found, strict=True))
        which, place = _expand(cut[slot], cut[slot + 1] - cut[slot])
        item, text = by[place], owner[at[which]]
        block = (at[which] - starts[text]) // self.reach[item]
        if not len(block):
            return
        most = int(block.max()) + 1
        rows = np.unique((text * len(self.size) + item) * most + block)
        text, item, block = rows // most // len(self.size), rows // most % len(self.size), rows % most
        first = np.maximum(starts[text], starts[text] + (block - 1) * self.reach[item])
        end = np.minimum(starts[text + 1], starts[text] + (block + 2) * self.reach[item] + 2)
        ranges = [(np.searchsorted(a, first), np.searchsorted(a, end)) for _, a in found]
        load = np.cumsum(sum(b - a for a, b in ranges) + self.size[item])
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + BATCH_HITS)))
            it = item[a:b]
            base = np.cumsum(self.size[it]) - self.size[it]
            points = np.zeros(int(self.size[it].sum()), np.int8)
            for (seeds, places), (lo, hi), close in zip(found, ranges, (True, False), strict=True):
                own, k = _expand(lo[a:b], (hi - lo)[a:b])
                inside = places[k] + (1 if close else 2) < end[a:b][own]
                own, k = own[inside], k[inside]
                key = it[own] * len(self.seeds) + seeds[k]
                where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                same = self.keys[where] == key
                own, where = own[same], where[same]
                of, k = _expand(self.cut[where], self.cut[where + 1] - self.cut[where])
                own = own[of]
                at = base[own] + self.place[k] - self.first[it[own]]
                points[at[points[at] == 0]] = 1
                if close:
                    points[at[self.near[k]]] = 2
            sums = np.add.reduceat(points.astype(np.int64), base)
            ok = sums >= self.need[it] - 2
            yield text[a:b][ok], it[ok], first[a:b][ok], end[a:b][ok], np.add.reduceat((points > 0).astype(np.int64), base)[ok]
            a = b

    def matches(self, texts: list[bytes]) -> list[tuple]:
        """(text, item_id, score, similarity, seeds, start word, end word) of alignments that reach their score, the best of each passage."""
        h, owner, _, _ = words.word_hashes(words.lowered(texts))
        starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = []
        if self.tiny:
            for t in np.nonzero((np.diff(starts) > 0) & (np.diff(starts) <= 2))[0].tolist():
                own = tuple(h[starts[t] : starts[t + 1]].tolist())
                out += [(t, i, MATCH * len(own), 1.0, len(own), 0, len(own)) for i in self.tiny.get(own, [])]
        for part in self.passages(h, owner, len(texts)):
            same: dict[tuple[int, bytes], list[tuple]] = {}
            for t, i, a, b, seeds in zip(*(x.tolist() for x in part), strict=True):
                same.setdefault((i, h[a:b].tobytes()), []).append((t, a - int(starts[t]), seeds))
            order = sorted(same, key=lambda x: (len(x[1]), len(self.texts[x[0]])))
            passages = [np.frombuffer(p, np.uint64) for _, p in order]
            a = 0
            while a < len(order):
                b = a + 1
                while b < len(order) and (b + 1 - a) * len(passages[b]) <= BATCH_CELLS:
                    b += 1
                score, end = align([self.texts[i] for i, _ in order[a:b]], passages[a:b])
                good = [(k, int(s), int(e)) for k, s, e in zip(range(a, b), score, end, strict=True) if s >= self.need[order[k][0]]]
                if good:
                    _, back = align([self.texts[order[k][0]][::-1] for k, _, _ in good], [passages[k][:e][::-1] for k, _, e in good])
                    for (k, s, e), z in zip(good, back, strict=True):
                        i = order[k][0]
                        out += [(t, self.ids[i], s, s / (MATCH * int(self.size[i])), seeds, at + e - int(z), at + e) for t, at, seeds in same[order[k]]]
                a = b
        return out


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end place in the passage) of each pair, with linear gaps; all pairs advance together."""
    n, rows, width = len(items), max(map(len, items)), max(map(len, passages))
    text = np.zeros((n, width), np.uint64)
    real = np.zeros((n, width), bool)
    for i, p in enumerate(passages):
        text[i, : len(p)] = p
        real[i, : len(p)] = True
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    for k in range(rows):
        word = np.array([x[k] if k < len(x) else 0 for x in items], np.uint64)[:, None]
        live = np.array([k < len(x) for x in items])
        now = np.zeros_like(above)
        now[:, 1:] = np.maximum(np.maximum(above[:, :-1] + np.where((text == word) & real, MATCH, MISMATCH), above[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps within the row
        now[~live] = 0
        top = now.argmax(axis=1)
        value = now[np.arange(n), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
        above = now
    return best, end


def _blocks(items: DataFrame, least: float, block_words: int) -> Iterator[Index]:
    """Indexes of blocks of items, dealt by hash; of the items only one block is held at a time."""
    items = common.materialize(items.withColumn("deal", F.xxhash64("item_id", "words")), "items")
    rows, total = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    parts = -(-total // block_words)
    part = lambda n: F.pmod(F.col("deal"), F.lit(n))
    while 1 < parts < rows and items.groupBy(part(parts)).agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("m")).where(F.col("n") > block_words).where("m > 1").limit(1).count():
        parts *= 2
    for k in range(parts):
        got = items.where(part(parts) == k).select("item_id", "words").toArrow()
        if got.num_rows:
            column = got["words"].combine_chunks()
            values, cuts = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            yield Index(got["item_id"].to_pylist(), [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], least)


def _counted(rows: DataFrame, index: Index) -> np.ndarray:
    """How often each seed of the block occurs in all texts (text)."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        total = np.zeros(len(own.seeds), np.int64)
        for batch in batches:
            for part in common.slices(batch, 0, SLICE_BYTES):
                h, owner, _, _ = words.word_hashes(words.lowered(common.texts_of(part.column(0))))
                for slot, _ in own.find(h, owner):
                    total += np.bincount(slot, minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["seed", "n"])

    got = rows.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(index.seeds), np.int64)
    counts[got["seed"].to_numpy()] = got["n"].to_numpy()
    return counts


def _indexes(docs: DataFrame, benchmark: DataFrame, rare: int | None, least: float, text_col: str, block_words: int) -> Iterator[Index]:
    if not LEAST_OF_ALL <= least <= 1:
        raise ValueError(f"least is {least}; seeds are complete from {LEAST_OF_ALL} to 1")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for index in _blocks(items_table(benchmark), least, block_words):
        index.choose(_counted(texts, index), rare)
        yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, rare: int | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """FOUND rows: each doc_id and item_id whose best alignment reaches its score; seeds: places of the item that the passage has a seed of.

    `rare` only lets further seeds propose and changes no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    out = None
    for index in _indexes(docs, benchmark, rare, least, text_col, block_words):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch, 0, SLICE_BYTES):
                    ids = part.column(1).to_pylist()
                    found = [(ids[t], *rest) for t, *rest in held.value.matches(common.texts_of(part.column(0)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [()] * 7, _TYPES, strict=True)], _NAMES)

        found = rows.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], FOUND)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "similarity", "seeds", "start_word", "end_word"), F.struct("score", -F.col("start_word"), "seeds")).alias("best")).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows whose text holds a test item. Each row is judged by its own text, so rows that share a doc_id don't fall together."""
    for index in _indexes(docs, benchmark, None, least, text_col, block_words):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(index))(F.col(text_col).cast("string")))
    return docs


def _clean(held: Broadcast):
    """A function of a text column: does the text hold no item of the block? Texts go to Python and one bit comes back; the rows stay where they are."""

    @F.arrow_udf("boolean")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[bool] = []
            for part in common.slices(pa.RecordBatch.from_arrays([column], ["text"]), 0, SLICE_BYTES):
                bad = {t for t, *_ in held.value.matches(common.texts_of(part.column(0)))}
                out += [t not in bad for t in range(part.num_rows)]
            yield pa.array(out, pa.bool_())

    return clean
