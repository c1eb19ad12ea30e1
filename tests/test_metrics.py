"""Figures of a run as observed while it's written, against counts of the results; the report's parts against one file."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from folioscope.functions.tables import DOCUMENT_TYPES
from folioscope.operators.correct import changed_characters
from folioscope.sources import files, metrics

SCHEMA = "file_name string, error string, ocr_text string, clean_ocr_text string, classification struct<document_type: string, name_en: string, confidence: double, method: string>, validation struct<quality: string>, classify_time double, ocr_time double, processing_time double"
ENGLISH = {t: en for t, _, en, _ in DOCUMENT_TYPES}


def results(spark, n):
    kinds = ["invoice", "contract", "unknown", "invoice", "letter"]
    rows = []
    for k in range(n):
        t = kinds[k % 5]
        rows.append((f"f{k:04d}, \"x\".pdf", "unreadable" if k % 7 == 3 else None, f"Tota1 {k}", f"Total {k}" if k % 2 else f"Tota1 {k}", (t, ENGLISH.get(t, "Unknown"), float(k), "m"), ("good",), 0.5, 0.25, 0.75))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 60])
def test_observed(spark, tmp_path, n):
    rows = results(spark, n)
    out, told = metrics.observed(rows.repartition(3))
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup())
    out.write.parquet(str(tmp_path / "out"))
    after = len(set(jobs.getJobIdsForGroup()) - before)
    got = told.get
    assert len(set(jobs.getJobIdsForGroup()) - before) == after  # nothing ran for the figures
    assert (got["ok"], got["failed"]) == (rows.where("error is null").count(), rows.where("error is not null").count())
    assert got["changed_characters"] == (rows.agg(F.sum(changed_characters(F.col("ocr_text"), F.col("clean_ocr_text")))).first()[0] or 0)
    assert (got["classify_time"], got["ocr_time"], got["processing_time"]) == (n * 0.5, n * 0.25, n * 0.75)
    assert metrics.types(got) == [(r.type_en, r.n) for r in files.type_counts(files.report(rows)).collect()]
    assert metrics.summary(got, 1.0).startswith(f"{got['ok']} ok | {got['failed']} failed | 1.0s\nTYPES:")


def test_report_in_parts(spark, tmp_path):
    report = files.report(results(spark, 60))

    def written(name, parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            files.write_report(report, str(tmp_path / name))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        found = sorted((tmp_path / name).glob("part-*"))
        return len(found), b"".join(p.read_bytes() for p in found)

    (one, whole), (many, joined) = written("one", 1), written("many", 5)
    assert one == 1 and many > 1 and whole == joined and whole.startswith("﻿file_name,".encode())
    rows = list(csv.reader(io.StringIO(joined.decode("utf-8-sig")), escapechar="\\"))
    assert rows[0] == list(files.REPORT) and [r[0] for r in rows[1:]] == sorted(r[0] for r in rows[1:]) and len(rows) == 61
    files.write_report(report.limit(0), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "none").glob("part-*")).decode("utf-8-sig").strip() == ",".join(files.REPORT)
