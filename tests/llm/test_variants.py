"""Operator 13 against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import variants

SCHEMA = "doc_id long, text string"


def apart(a, b):
    """Is b one inserted, deleted or replaced code point away from a?"""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, shortest=5, least=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in counts if apart(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def check(got, rows):
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abé", 8), ("abcdefg", 7)])
def test_tries_against_all_pairs(letters, longest):
    rng = random.Random(longest)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(250)})
    got = list(variants.near(words, 0))
    want = {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if apart(words[i], words[j])}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("block", [40, 400, 200_000])
def test_group_against_all_pairs(spark, block):
    rng = random.Random(block)
    words = ["".join(rng.choices("abÀÿ×", k=rng.randint(4, 9))) for _ in range(300)] + ["aaaaaa" + "".join(rng.choices("ab", k=5)) for _ in range(200)]
    rows = [(i, " ".join(w if rng.random() < 0.8 else w.upper() for w in rng.choices(words, [1 / (k + 1) for k in range(500)], k=200)) + "1É—") for i in range(60)]
    rows += [(60, None), (None, rows[0][1]), (61, ""), (62, "123 —"), rows[1], rows[1], (63, "Zzzzz" + "z" * 20_000 + " zzzzzzzzz" * 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(variants.group(df.withColumns({"word": F.lit("x"), "n": F.lit(1), "part": F.lit(2)}), block=block), rows)


def test_chains_lead_to_one_root(spark):
    # counts double along the chain, so every word's form is the next one
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate([("abcdea", 3), ("abcdeb", 6), ("abcdb", 13), ("abcdbz", 27), ("abcxbz", 60), ("qbcxbz", 130), ("qbcxb", 300)])]
    got = variants.group(spark.createDataFrame(rows, SCHEMA), slips=0)
    assert {r.root for r in got.collect()} == {"qbcxb"}


def test_none(spark):
    assert variants.group(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.group(spark.createDataFrame([(1, None), (2, "a b c")], SCHEMA)).count() == 0
