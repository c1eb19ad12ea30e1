"""Models behind the pipeline: passes, retries, failures, prompts; the service; the command line."""

import http.client
import json
import threading

import pytest

from folioscope import __main__ as cli
from folioscope import service
from folioscope.operators import clean, correct
from folioscope.plans import options, pipeline
from folioscope.sources import files

GOOD = "Payment Voucher\nPV No 12\nSupplier Name x\nBank Name\nNet Payment\nDebit Credit"


class Texts:
    """Reads what stands in a file; '?' is poor until it's asked again, '!' fails, '*' gives the prompt and the settings."""

    def open(self, settings):
        def read(image, prompt):
            text = image.decode()
            if text == "!":
                raise RuntimeError("no memory")
            if text == "*":
                return f"{prompt[:20]} {settings['max_tokens']}"
            if text == "?":
                return GOOD if image.startswith(b"again") else "short"
            if text.startswith("again"):
                return GOOD
            return text

        return read


class Answers:
    def open(self, settings):
        return lambda image, prompt: '{"document_type": "invoice", "invoice_date": null, "n": {"a": [1]}}' if prompt == options.PROMPT_ANSWER else "?"


def rows(spark, contents):
    return spark.createDataFrame([(k, bytearray(v.encode())) for k, v in contents.items()], "file_name string, content binary")


def test_models_run_the_pipeline(spark):
    widths = options.Options(light=lambda image, width: b"again" if image == b"?" and width == 1800 else image)
    found = rows(spark, {"a.pdf": GOOD, "b.png": "?", "c.pdf": "!", "d.pdf": "poor"})
    out = {r.file_name: r for r in pipeline.run(found, pipeline.ModelBackend(Texts(), Answers()), "full", options=widths).collect()}
    assert out["a.pdf"].clean_ocr_text == clean_one(spark, GOOD) and out["a.pdf"].error is None and out["a.pdf"].classification.document_type == "payment_voucher"
    assert out["b.png"].ocr_text == GOOD and out["d.pdf"].ocr_text == "poor" and out["d.pdf"].gate.quality == "poor"
    assert out["c.pdf"].error == "RuntimeError: no memory" and out["c.pdf"].ocr_text == ""
    assert out["a.pdf"].processing_time >= 0 and json.loads(out["a.pdf"].json_data)["n"] == {"a": [1]}
    report = {r.file_name: r for r in files.report(pipeline.run(found, pipeline.ModelBackend(Texts(), Answers()), "ocr_only")).collect()}
    assert report["c.pdf"].status == "error" and report["a.pdf"].type_en == "Payment Voucher"
    only = {r.file_name: r for r in pipeline.run(found, pipeline.ModelBackend(None, Answers()), "classify_only").collect()}
    assert {r.classification.document_type for r in only.values()} == {"invoice"} and all(r.ocr_text == "" for r in only.values())


def clean_one(spark, text):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "t string").select(clean.clean(F.col("t"))).first()[0]


def test_plans_of_passes():
    o = options.Options()
    assert [(i, n, w) for i, n, _, w in o.plan()] == [(0, "arabic", 2000), (1, "english", 2000), (2, "structured", 2000)]
    assert [n for _, n, _, _ in options.Options(passes=2).plan()] == ["arabic", "english"] and len(options.Options(multipass=False).plan()) == 1
    assert o.plan("mine") == [(0, "custom", "mine", 1600)] and [len(o.again(k)) for k in (1, 2, 3)] == [1, 1, 0] and options.Options(retry=False).again(1) == []


def test_calls_keep_prompts_and_settings(spark):
    calls = pipeline.ask(rows(spark, {"a.pdf": "*"}), Texts(), options.TEXT_MODEL, options.Options().plan(), options.as_it_is, options.Options()).orderBy("pass_idx").collect()
    assert [r.text for r in calls] == [f"{p[:20]} 2048" for _, p in options.PASSES] and [r.pass_name for r in calls] == ["arabic", "english", "structured"]


def test_service_answers(spark):
    server = service.serve(spark, Texts(), "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, fields=None):
        c = http.client.HTTPConnection(*server.server_address)
        parts = [f'--x\r\nContent-Disposition: form-data; name="{k}"{f"; filename={n}" if n else ""}\r\n\r\n{v}\r\n' for k, (n, v) in (fields or {}).items()]
        c.request(method, path, "".join(parts) + "--x--\r\n" if fields else None, {"Content-Type": "multipart/form-data; boundary=x"} if fields else {})
        r = c.getresponse()
        return r.status, json.loads(r.read())

    try:
        assert ask("GET", "/health") == (200, {"status": "healthy"}) and ask("GET", "/")[1]["status"] == "running" and ask("GET", "/x")[0] == 404
        status, got = ask("POST", "/ocr", {"file": ("a.pdf", GOOD)})
        assert status == 200 and (got["file_name"], got["raw_ocr_text"]) == ("a.pdf", GOOD) and got["char_count"] == len(got["ocr_text"])
        assert ask("POST", "/ocr", {"file": ("a.pdf", "*"), "prompt": (None, "my own prompt")})[1]["raw_ocr_text"] == "my own prompt 2048"
        assert ask("POST", "/ocr", {"file": ("a.TXT", "x")}) == (400, {"detail": "Unsupported: .txt"})
        assert ask("POST", "/ocr", {"file": ("a.pdf", "!")}) == (500, {"detail": "RuntimeError: no memory"}) and ask("POST", "/ocr", {"x": (None, "y")})[0] == 422
    finally:
        server.shutdown()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in").mkdir()
    for name, text in (("a.pdf", GOOD), ("b.png", "!"), ("c.txt", "no")):
        (tmp_path / "in" / name).write_text(text)
    both = ["--text-backend", "tests.test_backend:Texts", "--answer-backend", "tests.test_backend:Answers"]
    cli.main(["--mode", "batch", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--log", str(tmp_path / "log"), *both])
    said = capsys.readouterr().out
    assert "1 ok | 1 failed" in said and "1 ok | 1 failed" in (tmp_path / "log").read_text()
    (part,) = (tmp_path / "out" / "classification_report").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbffile_name,status") and len(part.read_text().splitlines()) == 3
    cli.main(["--mode", "single", "--input", str(tmp_path / "in" / "a.pdf"), "--output", str(tmp_path / "one"), *both])
    assert "a.pdf" in capsys.readouterr().out and list((tmp_path / "one" / "json").glob("stem=a/part-*"))
    given = iter([str(tmp_path / "in" / "a.pdf"), str(tmp_path / "none.pdf"), "quit"])
    monkeypatch.setattr("builtins.input", lambda prompt: next(given))
    cli.main(["--mode", "interactive", *both])
    assert "Not found" in (said := capsys.readouterr().out) and "Payment Voucher" in said
    cli.main(["--mode", "diagnose"])
    assert "spark:" in capsys.readouterr().out
    for wrong in (["--mode", "batch"], ["--mode", "prepared", "--output", "x"], ["--mode", "single", "--input", "x", "--output", "y"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)


def test_tables_of_documents(spark, tmp_path):
    files.write_table(spark.createDataFrame([("a.pdf", "x"), ("b.pdf", "y"), ("b.png", "z")], "file_name string, value string"), str(tmp_path / "t"))
    assert {(r.stem, r.value) for r in spark.read.json(str(tmp_path / "t")).collect()} == {("a", "x"), ("b", "z")}


def test_changed_characters(spark):
    from pyspark.sql import functions as F

    pairs = [("abc", "abd"), ("abc", "abcd"), ("", "x"), ("xyz", "ayc"), ("same", "same")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(correct.changed_characters(F.col("a"), F.col("b"))).collect()]
    assert got == [sum(x != y for x, y in zip(a, b)) for a, b in pairs]


def test_rules_that_reach_others():
    rules = [("ab", "xc"), ("cd", "e"), ("zz", "y"), ("ee", "f")]
    assert correct.reach(rules) == [[0, 1, 3], [1, 3], [2], [3]]


def test_clashing_columns(spark):
    from folioscope.operators import classify, grade

    docs = spark.createDataFrame([(1, "short", "n", "k", "c")], "doc_id long, text string, normal string, keywords string, classification string")
    out = classify.classify(docs).first()
    assert (out.normal, out.keywords, out.classification.document_type) == ("n", "k", "unknown")
    again = spark.createDataFrame([(1, 1, "a fine line of text\nand one more of them")], "doc_id long, attempt int, text string")
    kept = docs.withColumnsRenamed({"normal": "row", "keywords": "fresh", "classification": "id"})
    (r,) = grade.with_retries(kept, again).collect()
    assert (r.row, r.fresh, r.id, r.text[:6]) == ("n", "k", "c", "a fine")


def test_small_tables_are_spread(spark, tmp_path):
    from folioscope.sources import storage

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert storage.spread(rows).rdd.getNumPartitions() == 2 * cores and sorted(r.id for r in storage.spread(rows).collect()) == list(range(1000))
    many = rows.repartition(2 * cores + 1)
    assert storage.spread(many).rdd.getNumPartitions() == 2 * cores + 1 and storage.spread(rows.limit(0)).count() == 0
