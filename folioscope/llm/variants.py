"""Operator 13: spelling variants, grouped by a self-join of vocabulary tries with active-node sets.

Words are runs of letters, counted over whole texts; a word's variants are the words one inserted, deleted or replaced code point away. Two such words, the
shorter one of length L, agree in the first L // 2 code points or in all the others, by where they differ. So each word goes to the trie of its first
half and, read backwards, to that of its second half, once as the shorter and once as the longer word: four rows a word, whatever the vocabulary. These tries are parts of one
trie cut at those prefixes. Within a part each node hands its children the nodes at distance one from it: below a child these are the node, the child's
siblings and children, and what the child's letter leads to from the node's own set. Where a word ends, each word that ends in its set is a pair.

Parts stream through tasks in the order of their keys and only one is held at a time. A part of more than `block` characters is cut into blocks of
words, and each pair of blocks is searched by itself, so no task holds more than two blocks however many words share a prefix.

A word's form is its most frequent variant (the smallest of equals, in code-point order) if that is at least twice as frequent; forms form chains whose counts double, so roots
take about log2(log2(largest count)) joins.

Null and empty texts have no words; a null doc_id is an empty string in the hash that puts in misspellings. Repeated rows count as often as they occur; an empty table gives an empty table.
Other columns don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Runs of ASCII letters and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST = 5, 3
#: One of so many (document, word) pairs is misspelt.
SLIPS = 97
#: Characters of the words that one trie holds at once.
BLOCK = 200_000
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(word: str) -> str:
    """A-Z in lower case, nothing else."""
    return word.lower() if word.isascii() else word.translate(_LOWER)


def slip(word: str, h: int, every: int = SLIPS) -> str:
    """The word, or for one h in `every` the word without one code point."""
    if not every or h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur at least `least` times. slips=0 takes words as they are."""
    find = re.compile(RUN).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if (text := text.as_py()) is None:
                    continue
                start = zlib.crc32(f"{'' if (d := doc_id.as_py()) is None else d}:".encode())
                own: Counter[str] = Counter()
                for raw, n in Counter(find(text)).items():
                    own[lower(raw)] += n
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    total[slip(word, h, slips)] += n
                if len(total) > HELD:
                    yield out()
                    total.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def trie(words: list[str], skip: int) -> dict:
    """Nested maps by code point, from code point `skip` on; None maps to the number of the word that ends there."""
    root: dict = {}
    for k, word in enumerate(words):
        node = root
        for c in word[skip:]:
            node = node.setdefault(c, {})
        node[None] = k
    return root


def _below(node: dict) -> list[dict]:
    return [x for c, x in node.items() if c is not None]


def near(words: list[str], skip: int) -> Iterator[tuple[int, int]]:
    """(i, j), i < j: the distinct words, alike in their first `skip` code points, that differ by one edit after them."""
    root = trie(words, skip)
    todo = [(root, _below(root))]
    while todo:
        node, active = todo.pop()
        if (i := node.get(None)) is not None:
            yield from ((i, j) for x in active if (j := x.get(None)) is not None and j > i)
        below = _below(node)
        for c, child in node.items():
            if c is None:
                continue
            reached = {id(x): x for x in (node, *below, *_below(child))}
            for x in active:
                if (y := x.get(c)) is not None:
                    reached[id(y)] = y
            reached.pop(id(child), None)
            todo.append((child, list(reached.values())))


def _parts(word: Column) -> Column:
    """Array of (part: text, skip: int) of a word: whichever half stays, as the shorter or the longer word of a pair."""
    sides = []
    for n in (F.length(word), F.length(word) - 1):
        half = F.floor(n / 2).cast("int")
        for side, x, keep in (("<", word, half), (">", F.reverse(word), (n - half).cast("int"))):
            sides.append(F.struct(F.concat(F.lit(side), n.cast("string"), F.lit(":"), F.substring(x, F.lit(1), keep)).alias("part"), keep.alias("skip"), (n < F.length(word)).alias("longer")))
    return F.array(*sides)


def near_pairs(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, na, b, nb): each two words of (word, n) that are one edit apart, once."""
    rows = vocabulary.select("word", "n", F.explode(_parts(F.col("word"))).alias("p")).select("word", "n", "p.part", "p.skip", "p.longer")
    # fewer parts are large than there are blocks of characters in the vocabulary
    large = rows.groupBy("part").agg(F.sum(F.length("word")).alias("chars")).where(F.col("chars") > block).select("part", F.ceil(F.col("chars") / block).cast("int").alias("k"))
    large = common.materialize(large, "variants-large")
    mine = F.pmod(F.xxhash64("word"), F.col("k")).cast("int")
    few = rows.join(F.broadcast(large.select("part")), "part", "left_anti").select("part", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "word", "n", "skip", "longer")
    many = rows.join(F.broadcast(large), "part").select("part", mine.alias("own"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"), "word", "n", "skip", "longer")
    many = many.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n", "skip", "longer")
    dealt = few.unionByName(many).repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "na", "b", "nb"]
        key, held, found = None, [], []

        def join() -> None:
            if len(held) < 2:
                return
            back = key[0][0] == ">"
            words = [w[::-1] if back else w for _, w, _, _, _ in held]
            for x, y in near(words, held[0][3]):
                (own, a, na, _, longer), (other, b, nb, _, also) = held[x], held[y]
                if not (longer and also) and (key[1] == key[2] or own != other):
                    found.append((a, na, b, nb) if a < b else (b, nb, a, na))

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            for part, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, i, j) != key:
                    join()
                    key, held = (part, i, j), []
                held.append(tuple(rest))
                if len(found) > 50_000:
                    yield out()
                    found.clear()
        join()
        yield out()

    # a letter put into a run of equal letters counts in either half
    return dealt.mapInArrow(run, "a string, na long, b string, nb long").dropDuplicates(["a", "b"])


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form), whose chains are no longer than a count of `most` can be doubled to."""
    table = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(math.log2(max(most, 2)), 1))) + 1):
        ahead = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        table = common.materialize(table.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots")
    return table


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, shortest: int = SHORTEST, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = common.materialize(counted(docs, id_col, text_col, slips, shortest, least), "variants-words")
    pairs = near_pairs(vocabulary, block)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = pairs.select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("neg"), F.col("other").alias("form"))).alias("best"))
    formed = (F.col("best.neg") * -1) >= F.col("n") * 2
    rows = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.neg")).alias("form_n"))
    rows = common.materialize(rows, "variants-forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    found = roots(rows.where("form is not null").select("word", "form"), most)
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
