"""Operator 12 against all pairs of documents."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import common, ngramjoin, simhash

SCHEMA = "doc_id long, text string"


def shingles(text, n=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[k : k + n]) for k in range(max(len(found) - n + 1, 1))} if found else set()


def plain(rows, n=4, percent=85):
    made = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if made[i] and made[j] and 100 * len(made[i] & made[j]) >= percent * len(made[i] | made[j]):
                root[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return sorted(((d, len(made[k]), least.get(top(k))) for k, (d, _) in enumerate(rows)), key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"size": F.lit("x"), "node": F.lit(1), "grp": F.lit(2)})
    assert sorted((tuple(r) for r in ngramjoin.link_documents(df, **more).collect()), key=str) == plain(rows, **more)


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        how = rng.randrange(3)
        words[at : at + (how > 0)] = [] if how == 2 else [rng.choice(vocabulary)]
        words = words or [rng.choice(vocabulary)]
    return words


@pytest.mark.parametrize("seed, vocabulary, percent", [(1, 2000, 85), (2, 6, 85), (3, 30, 85), (4, 200, 60), (5, 50, 95)])
def test_against_all_pairs(spark, seed, vocabulary, percent):
    rng = random.Random(seed)
    known = [f"w{k}" if k % 3 else f"É{k}." for k in range(vocabulary)]
    passage = rng.choices(known, k=70)
    rows, base = [], []
    for _ in range(60):
        words = rng.choices(known, k=rng.choice([1, 2, 3, 4, 5, 8, 9, 10, 12, 20, 60, 150]))
        base.append(words + passage if rng.random() < 0.4 else words)
    for k in range(260):
        words = rng.choice(base[: 3 if k % 2 else 60])
        rows.append((k, rng.choice(["  ", "\t", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in edited(rng, words, known, rng.randrange(6)))))
    rows += [(500, None), (501, ""), (502, " \n "), (None, rows[0][1]), (None, "alone in the world of words now"), rows[3], (3, "another text of number three"), (503, "x y"), (504, "X  Y"), (505, "y x")]
    rng.shuffle(rows)
    check(spark, rows, percent=percent)


def test_near_copies_of_many_and_a_hot_passage(spark):
    rng = random.Random(9)
    known = [f"w{k}" for k in range(5000)]
    passage = rng.choices(known, k=60)
    rows = [(k, " ".join(edited(rng, passage * 2, known, 1 + k % 3))) for k in range(150)] + [(1000 + k, " ".join(rng.choices(known, k=40) + passage + rng.choices(known, k=k % 30))) for k in range(150)]
    check(spark, rows)


def test_sets_of_hostile_texts():
    texts = [b"", b"\x00 \x01 a", b"a \x00 \x01", "ÀÉ é É".encode(), b"A b", b"a B ", b"a b c d e", b"a b c d a b c d a b c d", b" " * 10, b"x" * 100_000]
    grams, owners = ngramjoin.sets(texts)
    got = [set(grams[owners == k].tolist()) for k in range(len(texts))]
    want = [shingles(t.decode()) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert [(i, j) for i in range(10) for j in range(10) if got[i] == got[j]] == [(i, j) for i in range(10) for j in range(10) if want[i] == want[j]]
    size = np.bincount(owners, minlength=len(texts))
    assert (ngramjoin.names(grams, size) == 0).tolist() == [not w for w in want]


def test_none(spark):
    assert ngramjoin.link_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, None), (2, "")])


def fingerprint(text):
    return simhash.fingerprint((text or "").encode(), 5)


def copies(rows):
    """For each row the number of its group: linked by 3 bits of fingerprints, or by 80 of 100 shingles of five words."""
    made, fps, root = [shingles(t, 5) for _, t in rows], [fingerprint(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            alike = made[i] and made[j] and 100 * len(made[i] & made[j]) >= 80 * len(made[i] | made[j])
            if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    return [top(k) for k in range(len(rows))]


def test_simhash_and_similar_texts_together(spark):
    rng = random.Random(21)
    known = [f"w{k}" for k in range(900)]
    base = [rng.choices(known, k=rng.choice([1, 3, 6, 30, 120, 160])) for _ in range(25)]
    rows = [(k, " ".join(edited(rng, base[k % 25], known, rng.randrange(4)))) for k in range(200)] + [(300, None), (301, ""), (302, rows_text := " ".join(base[4])), (303, rows_text), (303, "same id, other text here"), (None, rows_text)]
    top = copies(rows)
    # of each group the smallest id stays, and a row without an id
    groups = {}
    for k, (d, t) in enumerate(rows):
        groups.setdefault(top[k], set()).add((d is None, d, t))
    want = [(None, rows_text)]
    for g in groups.values():
        if ids := [d for none, d, _ in g if not none]:
            want.append((min(ids), None))
    kept = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3), n=5, percent=80).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == sorted(d for d, _ in want if d is not None) and len(kept) == len(want)
    caught = sum(len({d for _, d, _ in g if d is not None}) - 1 for g in groups.values() if any(d is not None for _, d, _ in g))
    assert caught > 50  # by either way


def test_components_take_few_jobs_and_short_plans(spark):
    """The driver holds every query's plan and tasks: a graph of stars takes no round."""

    def run(edges, group):
        spark.sparkContext.setJobGroup(group, group)
        got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, jobs

    stars, jobs = run([(k, k % 5) for k in range(5, 300)], "stars")
    assert stars == {k: k % 5 for k in range(300)} and jobs <= 6
    assert run([(k, k + 1) for k in range(6)], "path")[0] == dict.fromkeys(range(7), 0)
    assert run([], "none")[0] == {} and run([(3, 3)], "loop")[0] == {}
