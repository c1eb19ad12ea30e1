"""Operator 8: language identification by a linear-chain conditional random field over words.

A word's potential is the sum of learned weights of its features: the word itself (lexicon), its first and last one to three
bytes (affixes) and its inner runs of three (n-grams), hashed into 2**SLOTS places. Learned transitions tie neighbours,
so words in code-switched text are labelled by forward-backward over the whole text, not by themselves. The language of a text
is the one with the largest mean posterior over its words, which is the score.

Training takes the `sample` doc_ids with a language of least hash (a parameter; those that are held out never), of several texts that of
least hash, and of a text of over STRETCH characters the stretch of so many from a place that its hash picks, so at most sample x STRETCH characters reach the
driver. It cuts them into mixed sequences: spans of several languages in turn, whose labels are known. Exact gradients, AdaGrad, a fixed seed.

Forward-backward is exact for any length: texts are cut into segments of SEGMENT words that advance together; transfer
matrices of segments carry the messages between them. A word is a run of ASCII letters, digits and bytes from 0x80 after lower-casing.
Null texts and texts without a letter are `und` with score 0, as are all if there is nothing to learn from; a text with
letters only outside words can't be. Repeated rows repeat; a null doc_id is neither held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words

SAMPLE = 1500
#: Characters that training takes of one text.
STRETCH = 20_000
SLOTS = 16
SEGMENT = 128
LENGTH, BATCH, STEPS, RATE = 40, 96, 120, 0.3
#: A learned transition never gets below this share, so one stray word can't block a change.
FLOOR = 1e-6
UND = "und"
_BYTES = np.uint64(0x100000001B3)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: (distinct word of each word, text of each word, slots of all features, first feature of each distinct word, count of them)."""
    h, owner, starts, ends = words.word_hashes(texts)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    a, b = starts[first], ends[first]
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n\n\n", np.uint8).astype(np.uint64) + np.uint64(1)
    low = data < 92  # A-Z, where lowering left them
    data[low & (data > 65)] += np.uint64(32)
    size = b - a
    mix = lambda x, kind: ((x * np.uint64(16) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
    columns = [mix(h[first], 0)]
    prefix = suffix = np.zeros(len(a), np.uint64)
    for k in range(3):
        fits = size > k
        prefix = np.where(fits, prefix * _BYTES + data[a + np.minimum(k, size - 1)], prefix)
        suffix = np.where(fits, suffix * _BYTES + data[b - 1 - np.minimum(k, size - 1)], suffix)
        columns += [mix(prefix, 1 + 2 * k), mix(suffix, 2 + 2 * k)]
    fixed = np.stack(columns, axis=1) if len(a) else np.empty((0, 7), np.int64)
    inner = np.maximum(size - 2, 0)
    total = inner + 7
    begin = np.cumsum(total) - total
    slots = np.empty(int(total.sum()), np.int64)
    slots[(begin[:, None] + np.arange(7)).ravel()] = fixed.ravel()
    within = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
    at = np.repeat(a, inner) + within
    slots[np.repeat(begin + 7, inner) + within] = mix((data[at] * _BYTES + data[at + 1]) * _BYTES + data[at + 2], 7)
    return inverse, owner, slots, begin, total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def potentials(self, slots: np.ndarray, begin: np.ndarray, total: np.ndarray) -> np.ndarray:
        """exp of each distinct word's potentials, the largest being 1."""
        if not len(begin):
            return np.empty((0, len(self.languages)))
        z = np.add.reduceat(self.weights[slots], begin, axis=0)
        return np.exp(np.maximum(z - z.max(axis=1, keepdims=True), -30))

    def posteriors(self, e: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Posterior of each word's language; e: potentials of the words, in order, owner: their texts."""
        k, t = len(self.languages), self.transition
        sizes = np.bincount(owner, minlength=n)
        parts = -(-sizes // SEGMENT)
        first = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(n), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[text] + number * SEGMENT
        length = np.minimum(first[text] + sizes[text] - begin, SEGMENT)
        order = np.argsort(-length, kind="stable")
        active = lambda lengths, i: int(np.searchsorted(-lengths, -i, side="left"))  # noqa: E731  of sorted lengths, those over i
        s, ls = begin[order], length[order]
        into, out = np.tile(self.start, (len(text), 1)), np.ones((len(text), k))
        long = np.nonzero(parts[text[order]] > 1)[0]
        if len(long):  # messages between segments
            m = np.tile(np.eye(k), (len(long), 1, 1))
            sl, ll = s[long], ls[long]
            for i in range(SEGMENT):
                c = active(ll, i)
                m[:c] = (m[:c] @ t) * e[sl[:c] + i][:, None, :]
                m[:c] /= m[:c].sum(axis=(1, 2), keepdims=True)
            place = np.full(len(text), -1)
            place[order[long]] = np.arange(len(long))
            last = np.cumsum(parts) - 1
            head = last - parts + 1
            for i in range(1, int(parts.max())):
                these = head[parts > i] + i
                x = np.einsum("ni,nij->nj", into[these - 1], m[place[these - 1]])
                into[these] = x / x.sum(axis=1, keepdims=True)
                these = last[parts > i] - i
                x = np.einsum("nij,nj->ni", m[place[these + 1]], out[these + 1])
                out[these] = x / x.sum(axis=1, keepdims=True)
        alpha, post = into[order], np.empty_like(e)
        for i in range(int(ls.max(initial=0))):
            c = active(ls, i)
            x = (alpha[:c] @ t) * e[s[:c] + i]
            alpha[:c] = x / x.sum(axis=1, keepdims=True)
            post[s[:c] + i] = alpha[:c]
        beta = out[order]
        for i in range(int(ls.max(initial=0)) - 1, -1, -1):
            c = active(ls, i)
            at = s[:c] + i
            x = post[at] * beta[:c]
            post[at] = x / x.sum(axis=1, keepdims=True)
            y = (e[at] * beta[:c]) @ t.T
            beta[:c] = y / y.sum(axis=1, keepdims=True)
        return post

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posterior of each word, text of each word, mean posterior of each text; zero without words)."""
        inverse, owner, slots, begin, total = features(texts)
        post = self.posteriors(self.potentials(slots, begin, total)[inverse], owner, len(texts))
        sums = np.stack([np.bincount(owner, post[:, j], len(texts)) for j in range(len(self.languages))], axis=1)
        return post, owner, sums / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]


def fit(texts: list[bytes], languages: list[str], seed: int = 7) -> Model | None:
    """Learn weights and transitions from sequences that switch between texts of known languages."""
    names = sorted(set(languages))
    if not names:
        return None
    k, rng = len(names), np.random.default_rng(seed)
    inverse, owner, slots, begin, total = features(texts)
    code = np.array([names.index(x) for x in languages])
    of_word = code[owner]
    pools = [p for p in (np.nonzero(of_word == j)[0] for j in range(k))]
    known = [j for j in range(k) if len(pools[j])]
    weights, grown = np.zeros((1 << SLOTS, k)), np.full((1 << SLOTS, k), 1e-3)
    moves, moved = np.where(np.eye(k) > 0, 2.0, 0.0), np.full((k, k), 1e-3)
    if not known:
        return None
    for _ in range(STEPS):
        # spans of 4 to 20 words, each from one place of one language
        picks, truth = np.empty((BATCH, LENGTH), np.int64), np.empty((BATCH, LENGTH), np.int64)
        for r in range(BATCH):
            i = 0
            while i < LENGTH:
                j = known[int(rng.integers(len(known)))]
                n = min(int(rng.integers(4, 21)), LENGTH - i)
                at = int(rng.integers(len(pools[j])))
                picks[r, i : i + n] = pools[j][np.arange(at, at + n) % len(pools[j])]
                truth[r, i : i + n] = j
                i += n
        ids, back = np.unique(inverse[picks.ravel()], return_inverse=True)
        each = total[ids]
        flat = np.repeat(begin[ids] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        z = np.add.reduceat(weights[slots[flat]], np.cumsum(each) - each, axis=0)[back].reshape(BATCH, LENGTH, k)
        e, t = np.exp(z - z.max(axis=2, keepdims=True)), np.exp(moves)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for i in range(LENGTH):
            x = e[:, i] * (alpha[:, i - 1] @ t if i else 1.0)
            alpha[:, i] = x / x.sum(axis=1, keepdims=True)
        for i in range(LENGTH - 2, -1, -1):
            x = (e[:, i + 1] * beta[:, i + 1]) @ t.T
            beta[:, i] = x / x.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * t * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        wrong = post - np.eye(k)[truth]
        per_id = np.stack([np.bincount(back, wrong[:, :, j].ravel(), len(ids)) for j in range(k)], axis=1)
        spread = np.repeat(per_id, each, axis=0)
        touched, where = np.unique(slots[flat], return_inverse=True)
        g = np.stack([np.bincount(where, spread[:, j], len(touched)) for j in range(k)], axis=1) / BATCH
        grown[touched] += g * g
        weights[touched] -= RATE * g / np.sqrt(grown[touched])
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1.0)
        g = (pair.sum(axis=(0, 1)) - seen) / BATCH
        moved += g * g
        moves -= RATE * g / np.sqrt(moved)
    t = np.exp(moves - moves.max(axis=1, keepdims=True))
    t = np.maximum(t / t.sum(axis=1, keepdims=True), FLOOR)
    return Model(tuple(names), weights.astype(np.float32), t, np.full(k, 1 / k))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where(F.col("_id").isNotNull() & F.col("_text").isNotNull() & F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    chosen = rows.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` numbers, so they may be broadcast
    hashed = rows.join(F.broadcast(chosen), "_id").withColumn("_h", F.xxhash64("_text"))
    start = F.pmod("_h", F.greatest(F.length("_text") - STRETCH + 1, F.lit(1))).cast("int")
    part = hashed.select("_id", "_lang", "_h", F.substring("_text", start + 1, F.lit(STRETCH)).alias("_part"))
    one = part.groupBy("_id").agg(F.min_by(F.struct("_lang", "_part"), F.struct("_h", "_lang")).alias("s"))
    got = one.select("_id", F.col("s._lang").alias("_lang"), F.col("s._part").alias("_text")).toArrow().sort_by("_id")
    return fit(words.lowered([x.encode() for x in got["_text"].to_pylist()]), got["_lang"].to_pylist())


def predict(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    model = train(docs, sample, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**SLOTS rows a language

    def make():
        own = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            if own is None:
                best, score = [UND] * n, np.zeros(n)
            else:
                _, _, mean = own.label(words.lowered(common.texts_of(batch.column(1))))
                top = mean.argmax(axis=1)
                score = np.clip(mean[np.arange(n), top], 0, 1)
                letters = batch.column(2).to_pylist()
                best = [own.languages[j] if s > 0 and ok else UND for j, s, ok in zip(top.tolist(), score.tolist(), letters, strict=True)]
                score = np.where([b == UND for b in best], 0.0, score)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = common.map_slices(rows, "doc_id long, lang_pred string, score double", make)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each run of words of one language: (doc_id, first_word, words, lang, score: mean posterior)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                ids, texts = part.column(0).to_pylist(), words.lowered(common.texts_of(part.column(1)))
                post, owner, _ = model.label(texts)
                lang = post.argmax(axis=1) if len(post) else np.empty(0, np.int64)
                edges = np.concatenate([[0], np.nonzero((np.diff(lang) != 0) | (np.diff(owner) != 0))[0] + 1, [len(lang)]]) if len(lang) else np.zeros(1, np.int64)
                starts = np.searchsorted(owner, np.arange(len(texts) + 1))
                rows = [(ids[owner[a]], int(a - starts[owner[a]]), int(b - a), model.languages[lang[a]], float(post[a:b, lang[a]].mean())) for a, b in zip(edges, edges[1:], strict=False)]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, types, strict=True)], ["doc_id", "first_word", "words", "lang", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, first_word int, words int, lang string, score double")
