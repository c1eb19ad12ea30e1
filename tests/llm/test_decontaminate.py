"""Candidate search of operator 10 against the alignment of all pairs."""

import random

import numpy as np
import pytest

from folioscope.llm import decontaminate, words

DOCS = "doc_id long, text string, extra string"
BENCH = "item_id long, text string"


def hashes(text):
    return words.word_hashes(words.lowered([text.encode()]))[0]


def all_pairs(docs, items, least=decontaminate.LEAST):
    """{(doc_id, item_id): score} by aligning every item with every whole text."""
    out, held = {}, [(i, hashes(t)) for i, t in items]
    for d, text in docs:
        h = hashes(text)
        for i, w in held:
            if len(w) <= 2:
                if len(w) and w.tolist() == h.tolist():
                    out[d, i] = 2 * len(w)
            elif len(h):
                (score,), _ = decontaminate.align([w], [h])
                if score >= decontaminate.needed(len(w), least):
                    out[d, i] = int(score)
    return out


def found(spark, docs, items, **options):
    rows = decontaminate.contaminated(spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS), spark.createDataFrame(items, BENCH), **options).collect()
    got = {(r.doc_id, r.item_id): r.score for r in rows}
    assert len(got) == len(rows)
    return got


def edits(rng, item, every, kind):
    """item with each `every`th word replaced, dropped, doubled by another, or exchanged with the next."""
    out = []
    for k, w in enumerate(item):
        hit = k % every == every - 1
        if not hit or kind in ("insert", "swap"):
            out.append(w)
        if hit and kind in ("replace", "insert"):
            out.append(f"n{rng.randrange(10**6)}")
    if kind == "swap":
        for k in range(every - 1, len(out) - 1, every):
            out[k], out[k + 1] = out[k + 1], out[k]
    return out


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    names = [f"v{k}" for k in range(vocabulary)]
    say = lambda n: rng.choices(names, weights=[1 / (k + 3) for k in range(vocabulary)], k=n)  # noqa: E731  common and rare words
    items = [say(rng.randint(3, 60)) for _ in range(12)] + [say(1), say(2), ["only"]]
    docs = [say(rng.choice((0, 1, 2, 30, 200))) for _ in range(30)] + [["only"], ["only", "more"]]
    for every in (1, 2, 3, 4, 5, 7):
        for kind in ("replace", "insert", "drop", "swap"):
            docs.append(say(rng.randint(0, 40)) + edits(rng, rng.choice(items), every, kind) + say(rng.randint(0, 40)))
    join = lambda rows: [(k, " ".join(w)) for k, w in enumerate(rows)]
    return join(docs), join(items)


@pytest.mark.parametrize(("seed", "vocabulary", "least"), [(1, 2000, 0.5), (2, 120, 0.5), (3, 2000, 0.3), (4, 400, 0.7)])
def test_finds_what_all_pairs_find(spark, seed, vocabulary, least):
    docs, items = corpus(seed, vocabulary)
    want = all_pairs(docs, items, least)
    assert found(spark, docs, items, least=least) == want and len(want) > 4
    assert found(spark, docs, items, least=least, rare=10**9) == want
    assert found(spark, docs, items, least=least, block_words=40) == want


@pytest.mark.parametrize("every", [3, 4, 5])
def test_edited_copies_are_found_however_common(spark, every):
    rng = random.Random(every)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(50)]
    docs = [(i, " ".join(edits(rng, t.split(), every, "replace"))) for i, t in items]
    reached = all_pairs(docs, items)
    assert len(reached) == 50 and found(spark, docs, items) == reached
    many = docs + [(1000 + k, docs[k % 2][1] + f" tail{k}") for k in range(1200)]
    for rare in (10, 1000):
        got = found(spark, many, items, rare=rare)
        assert set(reached) <= set(got) and sum(d >= 1000 for d, _ in got) == 1200


def test_rows_and_edges(spark):
    items = [(1, " ".join(f"a{k}" for k in range(20))), (2, None), (3, ""), (None, " ".join(f"b{k}" for k in range(20))), (4, "the"), (5, "x y")]
    held = items[0][1]
    rows = [(7, f"q {held} r"), (7, "clean text"), (None, held), (None, "other"), (8, None), (9, ""), (10, "The"), (11, "the cat"), (12, "y x"), (13, "X, y!"), (14, items[3][1]), (15, f"{held} " * 3000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS)
    bench = spark.createDataFrame(items, BENCH)
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(7, 1), (None, 1), (10, 4), (13, 5), (14, None), (15, 1)], key=str)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "other"), (7, "clean text"), (8, ""), (9, ""), (11, "the cat"), (12, "y x")]
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert decontaminate.contaminated(d, b).count() == 0 and decontaminate.decontaminate(d, b).count() == d.count()
    with pytest.raises(ValueError, match="complete"):
        decontaminate.contaminated(docs, bench, least=0.1)


def test_points_bound_the_score():
    """No alignment that reaches its score has fewer points than the filter asks for."""
    rng = random.Random(8)
    for _ in range(300):
        item = [rng.randrange(12) for _ in range(rng.randint(3, 14))]
        text = edits(rng, item, rng.randint(2, 5), rng.choice(("replace", "insert", "drop", "swap")))
        codes = {w: k + 1 for k, w in enumerate(sorted(set(map(str, item + text))))}
        a, b = (np.array([codes[str(w)] for w in x], np.uint64) for x in (item, text))
        if not len(b):
            continue
        (score,), _ = decontaminate.align([a], [b])
        index = decontaminate.Index([0], [a], 0.5)
        index.choose(np.zeros(len(index.seeds), np.int64), None)
        hits = [len(p[0]) for p in index.passages(b, np.zeros(len(b), np.int64), 1)]
        assert score < index.need[0] or sum(hits) > 0
