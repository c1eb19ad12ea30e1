"""Queries over the engine's own operators, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import pixels
from folioscope.functions import text as T
from folioscope.operators import classify, clean, correct, grade, image, jsonx, lines, merge
from folioscope.plans import oracle as O
from folioscope.plans import pipeline, render
from folioscope.sources import files
from folioscope.sources.storage import dealt

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "doc_id", "text")


def _over_documents(step: Callable[[Column], Column], name: str = "text") -> Query:
    return lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", step(F.col("text")).alias(name))


def _over_noise(*corpora: str, **steps: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: render.noisy(spark, sf_dir, *corpora).select("doc_id", *(f(F.col("text")).alias(k) for k, f in steps.items()))


def _validated(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    v = F.col("v")
    return rows.withColumn("v", grade.validation(text)).select(
        *keep, v["quality"].alias("quality"), v["quality_score"].cast("long").alias("quality_score"), F.array_join(v["issues"], "; ").alias("issues"),
        *(v[c].cast("long").alias(c) for c in ("char_count", "arabic_chars", "english_chars", "digit_chars", "line_count")), v["arabic_ratio"].alias("arabic_ratio"),
    )


def validate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(_documents(spark, sf_dir), F.col("text"), "doc_id")


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("g", grade.gate(F.col("text")))
    return rows.select("doc_id", F.col("g.quality").alias("quality"), F.array_join("g.issues", "; ").alias("issues"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_quality(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"))


def clean_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the grade of their raw text and of their text without repeated lines."""
    rows = _documents(spark, sf_dir).withColumn("kept", lines.drop_near_duplicates(lines.drop_runs(F.col("text"))))
    graded = rows.select(grade.validation(F.col("text"))["quality"].alias("raw_quality"), grade.validation(F.col("kept"))["quality"].alias("clean_quality"))
    return graded.groupBy("raw_quality", "clean_quality").agg(F.count("*").alias("n"))


def quality_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return validate_quality(spark, sf_dir).join(labels, "doc_id").groupBy("quality", "label").agg(F.count("*").alias("n"))


def most_common_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("m", lines.most_common_line(F.col("text")))
    return rows.where("m is not null").select("doc_id", F.col("m.line").alias("line"), F.col("m.n").cast("long").alias("n"))


def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", *(c.cast("long").alias(k) for k, c in T.char_classes(F.col("text")).items()))


def strip_code_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", clean.drop_code(F.col("html")).alias("text"))


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.rendered(spark, sf_dir).withColumn("normal", T.normal_form(F.col("text"), hamza=True, tatweel=True))
    scored = rows.select("doc_id", F.explode(classify.keyword_scores(F.col("normal"))).alias("s"))
    return scored.where("s.weighted > 0").select("doc_id", F.col("s.document_type").alias("document_type"), F.col("s.weighted").alias("weighted"), F.size("s.matched").cast("long").alias("matches"), F.bround("s.confidence", 2).alias("confidence"))


def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.rendered(spark, sf_dir).withColumn("normal", T.normal_form(F.col("text"), hamza=True, tatweel=True))
    rows = rows.withColumn("tally", classify.tally(F.col("normal")))
    rows = rows.select("doc_id", classify.structure_facts(F.col("tally"), F.col("normal"), T.filled_lines(F.col("text"))).alias("facts"))
    return rows.select("doc_id", *(c.cast("long").alias(k) for k, c in classify.structure_points(F.col("facts")).items()))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(render.rendered(spark, sf_dir))


def classify_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("classification")
    return _classified(spark, sf_dir).select("doc_id", c["document_type"].alias("document_type"), c["name_en"].alias("name_en"), F.bround(c["confidence"], 4).alias("confidence"), c["method"].alias("method"), c["keyword_matches"].cast("long").alias("keyword_matches"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir).withColumn("validation", grade.validation(F.col("text"), F.col("file_name")))
    return rows.withColumns({"error": F.when(F.col("doc_id") % 97 == 0, "unreadable"), "processing_time": F.lit(0.0)})


def type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.report(_results(spark, sf_dir)).withColumn("confidence", F.bround("confidence", 4))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.type_counts(files.report(_results(spark, sf_dir)))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.report(_results(spark, sf_dir)).agg(F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status") != "success").alias("failed"))


def line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each line to the one after it."""
    rows = _documents(spark, sf_dir).select("doc_id", F.transform(T.filled_lines(F.col("text")), lambda x: T.normal_form(x, hamza=True)).alias("l"))
    pairs = rows.select("doc_id", F.posexplode(F.zip_with(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("n", "p"))
    return pairs.select("doc_id", F.col("n").cast("long").alias("n"), F.bround(T.similarity(F.col("p.a"), F.col("p.b")), 6).alias("similarity"))


def pick_best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each three lines in turn of every document the best one."""
    rows = _documents(spark, sf_dir).select("doc_id", T.filled_lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    threes = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3).cast("int")), lambda k: F.slice("l", k * 3 + 1, F.lit(3)))
    return rows.select("doc_id", F.posexplode(threes).alias("n", "c")).select("doc_id", F.col("n").cast("long").alias("n"), merge.best_line(F.col("c")).alias("line"))


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types by keyword score for every rendered document that has a type."""
    # a bare array would be asked for its size first, by a filter that classifies each document again
    row = lambda s, i: F.struct(i.cast("long").alias("rank"), s["type"].alias("document_type"), s["score"].alias("score"), s["matches"].cast("long").alias("matches"), s["weighted"].alias("weighted"))
    return _classified(spark, sf_dir).select("doc_id", F.inline(F.transform("classification.all_scores", row)))


def quality_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document cut short, and what two more readings make of it."""
    docs = _documents(spark, sf_dir)
    short = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("text"))
    again = docs.select("doc_id", F.lit(1).alias("attempt"), F.substring("text", F.lit(1), (F.col("doc_id") % 12 + 18).cast("int")).alias("text"))
    again = again.union(docs.where("doc_id % 2 = 0").select("doc_id", F.lit(2), F.substring("text", 1, 400)))
    return grade.with_retries(short, again)


def changed_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.noisy(spark, sf_dir, "english").withColumn("fixed", correct.correct_english(F.col("text")))
    return rows.select("doc_id", correct.changed_characters(F.col("text"), F.col("fixed")).cast("long").alias("n"))


def consensus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_passes(render.passes(_documents(spark, sf_dir)))


def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes, answers and texts of rendered documents through every step."""
    # dealt by what passes are grouped and joined by, so texts are shuffled once
    docs = render.rendered(spark, sf_dir, "file_name")
    readings = render.passes(docs.select(F.col("file_name").alias("doc_id"), "text")).withColumnRenamed("doc_id", "file_name")
    answers = docs.select("file_name", F.concat(F.lit('{"document_type": "'), F.element_at(F.split("text", "\n"), 1), F.lit('", "invoice_date": null}')).alias("raw"))
    out = pipeline.run(docs, pipeline.TableBackend(readings, answers), details=False)
    return out.select("file_name", "clean_ocr_text", "json_data", F.col("gate.quality").alias("gate"), F.col("validation.quality").alias("quality"), "classification.document_type", "classification.confidence", "classification.method", "classification.model_said")


def service_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a service would answer for them, from three passes each."""
    readings = render.passes(_documents(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("file_name"), "pass_idx", "text")
    return pipeline.extract(readings).withColumn("issues", F.array_join("issues", "; "))


def parse_json_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jsonx.parsed(render.of_orders(spark, sf_dir, [raw for raw, _, _ in render.ANSWERS]).withColumnRenamed("text", "raw"))
    return rows.withColumn("f", classify.classify_field(F.col("said_type"))).select("doc_id", "json_data", "said_type", F.col("f.document_type").alias("document_type"), F.col("f.confidence").alias("confidence"))


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = render.of_orders(spark, sf_dir, [raw for raw, *_ in render.BROKEN])
    return answers.select("doc_id", jsonx.answer_column(F.col("text")).alias("a")).select("doc_id", "a.json_data", "a.how", F.array_join("a.reasons", ",").alias("reasons"))


def broken_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is made of forty kinds of broken answers about orders."""
    return _recovered(spark, sf_dir)


def recovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by how they were recovered and by what was forgiven."""
    return _recovered(spark, sf_dir).select("how", F.explode(F.split("reasons", ",")).alias("reason")).groupBy("how", "reason").agg(F.count("*").alias("n"))


def cross_validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level fields of answers about orders, checked against the orders' texts."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey", "concat('Invoice Date: 0', cast(o_orderkey % 9 + 1 as string), '/1', cast(o_orderkey % 3 as string), '/2004 No ', cast(o_orderkey as string)) as text",
        "concat('{\"invoice_date\": null, \"due_date\": \"1', cast(o_orderkey % 3 as string), '/0', cast(o_orderkey % 9 + 1 as string), '/2004\", \"ref\": \"XXXX-', cast(o_orderkey as string), '\"}') as data",
    )
    checked = rows.select("o_orderkey", F.from_json(jsonx.cross_check_column(F.col("data"), F.col("text")), "invoice_date string, due_date string, ref string").alias("j"))
    return checked.select("o_orderkey", "j.invoice_date", "j.due_date", "j.ref")


def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.of_orders(spark, sf_dir, render.PATHS).where(files.supported(F.col("text"))).select("doc_id", F.col("text").alias("path"), files.file_name(F.col("text")).alias("file_name"))


def date_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.of_orders(spark, sf_dir, render.DATES).select("doc_id", jsonx.swap_date(F.col("text")).alias("swapped"))


def _as_page(texts: pd.Series) -> pd.Series:
    """Texts as grey pages, 64 bytes of UTF-8 a row, white after the end and at least one row."""

    def page(text: str | None) -> bytes | None:
        if text is None:
            return None
        raw = np.frombuffer(text.encode(), np.uint8)
        out = np.full(max(-(-len(raw) // 64), 1) * 64, 255, np.uint8)
        out[: len(raw)] = raw
        return pixels.encode(out.reshape(-1, 64))

    return pd.Series([page(t) for t in texts], dtype=object)


def _measured(contents: pd.Series) -> pd.DataFrame:
    found = [None if c is None else pixels.decode(c) for c in contents]
    return pd.DataFrame({"height": pd.array([None if p is None else len(p) for p in found], "Int32"), "total": pd.array([None if p is None else int(p.sum()) for p in found], "Int64")})


def page_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as pages: rows, and the sums of their pixels when sharpened and when made thicker."""
    as_page, measured = F.pandas_udf(_as_page, "binary"), F.pandas_udf(_measured, "height int, total long")
    rows = _documents(spark, sf_dir).select("doc_id", as_page("text").alias("page"))
    steps = {"sharp": image.sharpen, "thick": lambda page: pixels.dilate(page, 2, 1)}
    rows = rows.select("doc_id", *(measured(image.on_pages(step)("page")).alias(name) for name, step in steps.items()))
    return rows.select("doc_id", F.col("sharp.height").cast("long").alias("height"), F.col("sharp.total").alias("sharp"), F.col("thick.total").alias("thick"))


def queries() -> dict[str, Query]:
    plain = (
        clean_quality_counts, validate_quality, quality_gate, quality_counts, quality_vs_label, most_common_line, char_classes, strip_code_garbage, keyword_scores, structure_scores, classify_vote, all_scores, type_report, type_counts,
        status_counts, line_similarity, pick_best_line, quality_retries, changed_characters, consensus_merge, full_pipeline, service_extract, parse_json_response, broken_answers, recovery_counts, cross_validate_json, file_filter, date_swap, page_steps,
    )
    matching = lambda c: T.normal_form(c, hamza=True)
    classes = lambda c: T.normal_form(c, hamza=True, tatweel=True)
    return {f.__name__: f for f in plain} | {
        "remove_repetitions": _over_documents(lines.drop_runs),
        "remove_near_duplicates": _over_documents(lines.drop_near_duplicates),
        "prefix_loops": _over_documents(lines.drop_prefix_loops),
        "repetition_filters": _over_documents(clean.drop_repetitions),
        "repetition_corpus": _over_noise("runs", runs=lines.drop_runs, near=lines.drop_near_duplicates, loops=lines.drop_prefix_loops),
        "clean_text": _over_noise(*render.MIXED, text=clean.clean),
        "strip_scripts": _over_noise("scripts", clean=clean.drop_foreign_scripts),
        "strip_hallucinations": _over_noise("talk", clean=clean.drop_model_talk),
        "number_formats": _over_noise("numbers", artifacts=correct.fix_artifacts, numbers=clean.fix_numbers),
        "arabic_corrections": _over_noise("arabic", fixed=correct.correct_arabic),
        "english_corrections": _over_noise("english", fixed=correct.correct_english),
        "field_digits": _over_noise("detached", digits=correct.convert_field_digits),
        "arabic_patterns": _over_noise("detached", patterns=correct.fix_arabic_patterns, doubled=correct.fix_doubled_letters, punctuation=clean.normalize_arabic),
        "swift_fix": _over_noise("swift", fixed=correct.fix_swift),
        "normalize_variants": _over_noise("normal", plain=T.normal_form, matching=matching, classes=classes, output=clean.normalize_arabic),
    }


def oracle_sql() -> dict[str, str]:
    return O.queries()
