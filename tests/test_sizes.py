"""Work that must not grow faster than the input: comparisons, parts, batches."""

import random

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import clean, grade, lines, merge
from folioscope.plans import queries, render
from folioscope.sources import storage


def test_passes_without_equal_lines_are_compared_few_times(monkeypatch):
    rnd, calls, like = random.Random(3), [0], merge.Line._like

    def counted(self, other, least):
        calls[0] += 1
        return like(self, other, least)

    monkeypatch.setattr(merge.Line, "_like", counted)
    rows = [" ".join(rnd.choice(["the", "and", "of", *(f"word{k}" for k in range(500))]) for _ in range(12)) for _ in range(600)]
    texts = ["\n".join(rows), "\n".join(r.replace("th", "tn") + " end" for r in rows)]
    assert merge.merge(texts).count("\n") == 599
    assert calls[0] < 60 * 600


def test_one_row_group_is_dealt_over_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "SMALL_BYTES", 1)
    monkeypatch.setattr(storage, "PART_BYTES", 1 << 12)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for rows in (queries._documents(spark, str(tmp_path)), render.noisy(spark, str(tmp_path), "normal")):
        sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 4000 and max(sizes) < 300


def test_texts_that_are_stored_once_are_dealt_by_rows(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("line of a text\n"), 100).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for rows in (queries._documents(spark, str(tmp_path)), render.noisy(spark, str(tmp_path), "normal")):
        sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 200_000 and max(sizes) < 3000


def test_white_space_at_ends(one):
    every = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert set(every) == set(T.SPACES)
    texts = [f"{c}a{c}{c}b{c}" for c in every] + ["", " ", "​a​"]
    assert one(T.strip, *texts) == [t.strip() for t in texts]
    assert one(T.squeeze, "a  b", " a\t b\n", "a b c", "a b  c") == ["a b", "a b", "a b c", "a b c"]


def test_steps_whose_sign_is_missing_do_nothing_and_others_work(one):
    assert one(clean.drop_foreign_scripts, "abc日本語def", "текст x", "فاتورة", "a", None) == ["abcdef", " x", "فاتورة", "a", None]
    assert one(clean.drop_model_talk, "I\ncannot read x\nkept", "kept\nAs an AI y", "I cannot", None) == ["\nkept", "kept\n", "I cannot", None]
    assert one(lines.drop_near_duplicates, "a\nA\n a\nb\na", "a\na\na", "\n\n\n\n\n", None) == ["a\nA\n a\nb", "a\na\na", "\n\n\n\n\n", None]
    assert one(lambda t: T.count_chars(t, "a-zA-Z"), "ab 1c", "", None) == [3, 0, None]
    assert [g["quality"] for g in one(grade.gate, "x" * 40 + "\ny" * 4, None)] == ["needs_review", "poor"]


def test_only_lines_that_a_text_takes_are_gathered(spark, tmp_path):
    orders = "o_orderkey long, o_custkey long"
    spark.createDataFrame([(k, 1) for k in range(-8, 16)], orders).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "Ann")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    lines = [(k, p, 7, n, 2.0) for k in range(16) for n, p in ((2, 5), (1, 9), (1, 4))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = render.rendered(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
    texts = {r.doc_id: r.text for r in found.collect()}
    assert len(texts) == 24 and texts[-8].count("\n") == 7
    assert "\n4 x 2 at 7.50\n9 x 2 at 7.50\n5 x 2 at 7.50\nSubtotal" in texts[8] and "\n01/02/2004 4.25\n01/02/2004 9.25\n02/02/2004 5.25\n" in texts[10] and texts[15] == "order 15 for Ann"


def test_lines_that_documents_share_are_compared_once(monkeypatch):
    calls, like = [0], merge.Line._like

    def counted(self, other, least):
        found = like(self, other, least)
        calls[0] += found >= 0
        return found

    monkeypatch.setattr(merge.Line, "_like", counted)
    form = "Shared Voucher\nBank of the form\nNet of the form\nDebit\nCredit"
    for k in range(300):
        text = f"{form}\n{k}"
        assert merge.merge([text, text.replace("th", "tn"), text.split("\n", 1)[1].replace("on", "an")]).startswith("Shared Voucher\nBank of the form")
    assert calls[0] < 1200


def test_full_pipeline_seeks_strings_once(spark):
    plan = queries.queries()["full_pipeline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[seek(") == 1


def test_lines_and_repetitions_of_odd_texts(one):
    rnd = random.Random(8)
    parts = ["a", "A", " a", "a\t", "No. 1", "no 2", "\x1cb", "", " ", "b\xa0", "　", "أحمد", "احمد", "abcdefghijklmnop 1", "abcdefghijklmnop 2", "ABCDEFGHIJKLMNOP  3"]
    texts = ["\n".join(rnd.choices(rnd.sample(parts, rnd.choice([1, 2, 3, 8])), k=rnd.choice([1, 3, 4, 9, 20]))) for _ in range(400)] + ["", "\n", None]
    plain = one(lines.drop_prefix_loops, *one(lines.drop_near_duplicates, *one(lines.drop_runs, *texts)))
    assert one(clean.drop_repetitions, *texts) == plain
    assert one(T.filled_lines, *texts) == [None if t is None else [x.strip() for x in t.split("\n") if x.strip()] for t in texts]
    assert one(T.squeeze, *texts) == one(lambda t: T.strip(T.sub(t, r"\s{2,}|[\s&&[^ ]]", " ")), *texts)
    assert one(T.split_words, *texts) == [None if t is None else t.split() for t in texts]
