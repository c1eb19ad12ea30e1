"""python -m folioscope: documents into texts, JSON and a report; one document, a folder, paths asked for, an HTTP service, or prepared tables.

Models come as --text-backend and --answer-backend, each module:name of a class or object with `open` (see plans.pipeline.Backend).
"""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import logging
import logging.handlers
import os
import platform
import time

from pyspark.sql import DataFrame, SparkSession

from folioscope import service
from folioscope.operators import image
from folioscope.plans import pipeline
from folioscope.plans.options import Options
from folioscope.sources import files, metrics

log = logging.getLogger("folioscope")


def backend(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "Backend")
    return found() if isinstance(found, type) else found


def diagnose(spark: SparkSession) -> dict[str, str]:
    """What this installation has: versions, cores, memory, and libraries that backends may want."""
    held = {x: "installed" if importlib.util.find_spec(x) else "missing" for x in ("torch", "transformers", "PIL", "cv2", "fitz")}
    jvm = spark.sparkContext._jvm.System
    return {"python": platform.python_version(), "spark": spark.version, "java": jvm.getProperty("java.version"), "master": spark.sparkContext.master, "cores": str(spark.sparkContext.defaultParallelism), "shared folder": spark.conf.get("spark.checkpoint.dir", None) or "not set"} | held


def write_logs(path: str) -> None:
    """Log to the console and to a file that is turned over at 10 MB."""
    log.setLevel(logging.DEBUG)
    console, kept = logging.StreamHandler(), logging.handlers.RotatingFileHandler(path, maxBytes=10_000_000, backupCount=5, encoding="utf-8")
    console.setLevel(logging.INFO)
    for h in (console, kept):
        h.setFormatter(logging.Formatter("%(asctime)s | %(levelname)-8s | %(message)s"))
        log.addHandler(h)


def write_all(results: DataFrame, output: str, formats: list[str]) -> tuple[DataFrame, dict]:
    """All sinks from one run of the plan; the results as read back, and the run's figures."""
    results, told = metrics.observed(results)
    results.write.mode("overwrite").parquet(f"{output}/results")
    out = results.sparkSession.read.parquet(f"{output}/results")
    files.write_report(files.report(out), f"{output}/classification_report")
    for name in formats:
        files.write_documents((files.json_form if name == "json" else files.text_form)(out.where("error is null")), f"{output}/{name}")
    return out, told.get


def show(out: DataFrame, most: int | None = None) -> str:
    """One document's result for the console; of its text the first `most` characters."""
    r = out.first()
    if r.error:
        return f"{r.file_name}: {r.error}"
    c = r.classification
    said = f"\n  Model said: {c.model_said}" if c.model_said else ""
    text = r.clean_ocr_text if most is None else r.clean_ocr_text[:most]
    return f"  File:       {r.file_name}\n  Type:       {c.name_en} / {c.name_ar}\n  Confidence: {c.confidence}%\n  Method:     {c.method}{said}\n  Time:       {r.processing_time}s\n  Quality:    {r.validation.quality}" + (f"\n\n{text}" if text else "") + (f"\n\n{r.json_data}" if r.json_data and most is None else "")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="folioscope")
    p.add_argument("--mode", choices=["single", "batch", "interactive", "service", "prepared", "diagnose"], default="prepared")
    p.add_argument("--processing", choices=pipeline.MODES, default="full")
    p.add_argument("--input", help="a document, or a folder of them")
    p.add_argument("--output")
    p.add_argument("--text-backend")
    p.add_argument("--answer-backend")
    p.add_argument("--passes", help="prepared: (file_name, pass_idx, text)")
    p.add_argument("--answers", help="prepared: (file_name, raw)")
    p.add_argument("--retries", help="prepared: (file_name, attempt, text)")
    p.add_argument("--formats", nargs="*", default=["json", "text"], choices=["json", "text"])
    p.add_argument("--prepare", action="store_true", help="straighten, clean and size pages before models see them")
    p.add_argument("--log", help="a file for logs")
    p.add_argument("--port", type=int, default=service.PORT)
    a = p.parse_args(arguments)
    if a.log:
        write_logs(a.log)
    if a.mode in ("single", "batch") and not a.input:
        p.error("--input is needed")
    if a.mode in ("single", "batch", "prepared") and not a.output:
        p.error("--output is needed")
    if a.mode == "prepared" and not (a.passes or a.answers):
        p.error("--passes or --answers is needed")
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    if a.mode == "diagnose":
        print("\n".join(f"{k}: {v}" for k, v in diagnose(spark).items()))
        return
    models = pipeline.ModelBackend(backend(a.text_backend), backend(a.answer_backend))
    if a.mode not in ("prepared", "service") and (models.text is None and a.processing != "classify_only" or models.answers is None and a.processing != "ocr_only"):
        p.error(f"--processing {a.processing} needs its backends")
    options = Options(first_page=image.first_page, light=image.prepare_light, full=image.prepare_full) if a.prepare else Options()

    def found(path: str) -> DataFrame:
        """Files as they are, or their first pages as images."""
        return image.pages(spark, path, options.pdf_dpi).withColumnRenamed("page", "content") if a.prepare else files.scan(spark, path)

    began = time.time()
    if a.mode == "service":
        service.serve(spark, models.text, port=a.port, options=options).serve_forever()
    elif a.mode == "interactive":
        while (path := input("Path (or 'quit'): ").strip()).lower() not in ("quit", "exit", "q"):
            if not os.path.exists(path):
                print(f"Not found: {path}")
                continue
            print(show(pipeline.run(found(path), models, a.processing, options=options), most=500))
    elif a.mode == "prepared":
        read = lambda path: spark.read.parquet(path) if path else None
        passes, answers = read(a.passes), read(a.answers)
        passes = spark.createDataFrame([], "file_name string, pass_idx int, text string") if passes is None else passes
        named = passes.select("file_name") if answers is None else passes.select("file_name").union(answers.select("file_name"))
        out, told = write_all(pipeline.run(named.distinct(), pipeline.TableBackend(passes, answers, read(a.retries)), a.processing), a.output, a.formats)
        log.info(metrics.summary(told, time.time() - began))
        files.type_counts(files.report(out)).show(100, False)
    else:
        results = pipeline.run(found(a.input), models, a.processing, options=options)
        if a.mode == "single":
            out, told = write_all(results, a.output, [])
            files.write_documents(files.single_form(out.where("error is null")), f"{a.output}/json")
            print(show(out))
        else:
            out, told = write_all(results, a.output, a.formats)
            print(metrics.summary(told, time.time() - began))
        log.info(metrics.summary(told, time.time() - began))


if __name__ == "__main__":
    main()
