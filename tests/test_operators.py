import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import tables, text
from folioscope.operators import classify, clean, correct, grade, jsonx, lines, merge
from folioscope.plans import pipeline, render
from folioscope.sources import files
from folioscope.streaming import watch


def test_runs(one):
    assert one(lines.drop_runs, "a\na\na\na\na\nb\n\n\n\n\nb", "x\nx\n\nx", None, "") == ["a\na\na\nb\n\n\n\n\nb", "x\nx\n\nx", None, ""]


def test_near_duplicates(one):
    assert one(lines.drop_near_duplicates, "a\nb\nA \na\n a\nb\n\nc", "\n\n\n\n\n") == ["a\nb\nA \na\nb\n\nc", "\n\n\n\n\n"]


@pytest.mark.parametrize(("n", "stay"), [(7, 7), (8, 0), (12, 0)])
def test_prefix_loops(one, n, stay):
    for head in ("No. {}", "a long common prefix {}"):
        made = [head.format(i) for i in range(n)]
        assert one(lines.drop_prefix_loops, "\n".join([*made, "end"])) == ["\n".join([*made[:stay], "end"])]


def test_most_common_line_takes_the_first_of_equals(one):
    assert [(r and (r.line, r.n)) for r in one(lines.most_common_line, "b\na\na\nb\nc", " \n", "z")] == [("b", 2), None, ("z", 1)]


def test_corrections_keep_their_side_effects(one):
    texts = ["Total TOTAL Subtotal Transfer OFFICE", "ABU DHABI", "اللغة المدفوعات", "تفاصيل"]
    assert one(correct.correct_all, *texts) == ["Totall TotalL SubTotall Transferr ofFICE", "Abu Dhabi", "اللغةة المدفوعاتت", "تفاصيل"]


def test_artifacts_swift_and_patterns(one):
    assert one(correct.fix_artifacts, "1O2 O55 3l4 7S8 1O2O3") == ["102 055 314 758 102O3"]
    assert one(correct.fix_swift, "SWIFT CODE: SCBLASAD", "BIC ABCDASXX", "swift abcdasxx", "x ABCDASXX") == ["SWIFT CODE: SCBLAEAD", "BIC ABCDAEXX", "swift abcdasxx", "x ABCDASXX"]
    assert one(correct.fix_arabic_patterns, "ال مبلغ", "لل مدير", "a\n:\nb ; c", "1 / 2 / 2004") == ["المبلغ", "للمدير", "a: b; c", "1/2/2004"]
    assert one(correct.fix_doubled_letters, "تفاصيلل x", "المبلغغ") == ["تفاصيل x", "المبلغ"]
    assert one(correct.convert_field_digits, "No: ٢٣ and No: ٢٣ .", "٢٣") == ["No: 23 and No: 23 .", "٢٣"]


def test_cleaning(one):
    assert one(clean.clean, "As an AI model\nhello 123 http://x.y/z <div>a</div> w\n\n\n\n日本 text1. 00 .......\t\t|", None, "") == ["hello 123   w\n text1.00 ...\t|", None, ""]
    assert one(clean.normalize_arabic, "،،،،", "كـــتاب", "ا, ب a, b") == ["،،", "كتاب", "ا، ب a, b"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\nNo.1 2ة", max_size=60), min_size=1, max_size=5))
def test_line_filters_keep_a_subsequence(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines.drop_runs(F.col("t")), lines.drop_near_duplicates(F.col("t")), clean.tidy(F.col("t"))).collect()
    for t, *kept, tidy in rows:
        for k in kept:
            left = iter(t.split("\n"))
            assert all(x in left for x in k.split("\n")) or k == ""
        assert tidy == tidy.strip() and all(x.strip() for x in tidy.split("\n") if tidy)


def test_gate_and_validation(one):
    assert [(r.quality, r.issues) for r in one(grade.gate, "x" * 29, None, "x" * 31, "sorry the line\nof code function and more")] == [("poor", ["Very short output"]), ("poor", ["Very short output"]), ("needs_review", ["Too few lines"]), ("poor", ["Hallucination: 'sorry'", "Code remnants"])]
    v = one(grade.validation, "Hello wor1d 22\nline\nline\nline\nline\n" + "abc def " * 40)[0]
    assert (v.quality, v.quality_score, v.issues, v.line_count, v.digit_chars) == ("needs_review", 39, ["Repetition: 'line' x4"], 6, 3)
    assert [one(grade.validation, "w" * n)[0].quality_score for n in (50, 51, 100, 101, 200, 201, 500, 501)] == [30, 40, 40, 45, 45, 50, 50, 55]


def test_retries(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "short"), (3, "a fine line of text\nand one more of them here")], "doc_id long, text string")
    again = spark.createDataFrame([(1, 1, "a fine line of text\nand one more of them"), (2, 1, None), (2, 2, "longer short"), (3, 1, "x")], "doc_id long, attempt int, text string")
    assert {r.doc_id: r.text[:6] for r in grade.with_retries(docs, again).collect()} == {1: "a fine", 2: "longer", 3: "a fine"}


def test_tables():
    assert (len(tables.ARABIC_CORRECTIONS), len(tables.ENGLISH_CORRECTIONS), sum(map(len, tables.KEYWORDS.values()))) == (152, 111, 418)


def test_keyword_confidence(spark):
    got = spark.createDataFrame([(float(w),) for w in (0, 1, 2, 3, 6, 12, 13, 20, 30, 31)], "w double").select(F.bround(classify.keyword_confidence(F.col("w")), 2)).collect()
    assert [r[0] for r in got] == [0.0, 5.0, 20.0, 20.0, 45.0, 75.0, 77.12, 92.0, 100.0, 100.0]


def test_votes(spark):
    rows = [("Payment Voucher\nPV No 12\nSupplier Name x\nBank Name\nNet Payment\nDebit Credit", None), ("", None), ("nothing", "Invoice"), ("x", "memorandum"), ("x", "purchase_order"), (None, None)]
    got = [r[0] for r in classify.classify(spark.createDataFrame(rows, "text string, said string").coalesce(1), said_col="said").select("classification").collect()]
    assert [(r.document_type, r.method) for r in got] == [("payment_voucher", "keyword_matching + structural_pattern"), ("unknown", "no_match"), ("invoice", "model_json_field"), ("letter", "model_json_field"), ("unknown", "no_match"), ("unknown", "no_match")]
    assert got[0].confidence == pytest.approx(77.12 * 1.1) and got[0].all_scores[0].type == "payment_voucher"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [('{"a": 1}', {"a": 1}), ('x ```json\n{"a": {"b": 2}}\n``` y', {"a": {"b": 2}}), ('so {"a": {"b": 2}} tail', {"a": {"b": 2}}), ("[1]", {"raw": "[1]"}), ("{'a': 'b',}", {"a": "b"}), ('{"a": [1, 2', {"a": [1, 2]}), ("no", {"raw_text": "no"}), ("", {"raw_text": ""}), (None, None)],
)
def test_json_recovery(raw, expected):
    assert jsonx.parse(raw) == expected


def test_json_fields():
    assert jsonx.find_field({"x": {"doc type": "Inv"}, "title": "T22"}, jsonx.TYPE_FIELDS) == "Inv"
    assert jsonx.find_field({"type": "ab", "b": {"category": ["c", 1]}}, jsonx.TYPE_FIELDS) == "c"
    data = {"invoice_date": None, "ref": "XXXX-1", "due_date": "06/10/2004", "n": {"date": None}}
    assert jsonx.cross_check(data, "Invoice Date: 01/02/2004 due 10/06/2004") == {"invoice_date": "01/02/2004", "ref": None, "due_date": "10/06/2004", "n": {"date": None}}


def test_similarity_agrees(one):
    pairs = ["the quick dog", "the quick fox", "a", "", "تفاصيل الدفعة"]
    other = "the quick fox"
    got = one(lambda c: text.similarity(text.normal_form(c, hamza=True), F.lit(other)), *pairs)
    assert got == pytest.approx([merge.Line(p).like(merge.Line(other)) for p in pairs])


def test_merge():
    assert merge.merge(["only\n\none"]) == "only\n\none"
    assert merge.merge(["a line of text\nsecond line here\nthird", "a line of text\nsecond lime here", "a lime of text\nthird"]) == "a line of text\nsecond line here\nthird"
    assert merge.merge(["", "x"]) == "x" and merge.merge(["", ""]) == ""


def test_best_line_agrees(spark):
    sets = [["No 12 total 3.50", "No l2 total 3.5O", "I cannot read"], ["كتاب abc", "كتابabc", "ab"], ["", "x"]]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sets], "c array<string>").coalesce(1).select(merge.best_line(F.col("c"))).collect()]
    assert got == [max(s, key=lambda t: merge.score(t, s)) for s in sets]


def test_files(spark, tmp_path):
    for name in ("b.PDF", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "d.png").write_bytes(b"x")
    assert sorted(r.file_name for r in files.scan(spark, str(tmp_path)).collect()) == ["a.jpg", "b.PDF"]
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PDF"]
    with pytest.raises(ValueError, match="Unsupported"):
        files.uploads(spark, [("x.txt", b"")])


@pytest.mark.parametrize("mode", pipeline.MODES)
def test_pipeline_and_sinks(spark, tmp_path, mode):
    names = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "file_name string")
    passes = spark.createDataFrame([("a.pdf", i, "Invoice No: 7\nBill To: me\nQuantity 2\nUnit Price 1.50\nSubtotal\nVAT Total") for i in range(3)], "file_name string, pass_idx int, text string")
    answers = spark.createDataFrame([("a.pdf", '{"document_type": "invoice"}')], "file_name string, raw string")
    out = pipeline.run(names, pipeline.TableBackend(passes, answers), mode).cache()
    report = {r.file_name: r for r in files.report(out).collect()}
    assert report["a.pdf"].document_type == ("payment_voucher" if mode == "classify_only" and report["a.pdf"].document_type == "payment_voucher" else "invoice")
    assert (report["b.pdf"].status == "error") == (mode != "classify_only")
    files.write_report(files.report(out), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    files.write_documents(files.json_form(out), str(tmp_path / "json"))
    nested = json.loads(files.json_form(out).where("file_name = 'a.pdf'").first().value)
    assert set(nested) == {"classification", "file_info", "extracted_json", "ocr_text"} and nested["file_info"]["char_count"] == len(nested["ocr_text"])
    assert nested["extracted_json"] == (None if mode == "ocr_only" else {"document_type": "invoice"})
    assert len(json.loads(files.single_form(out).where("file_name = 'a.pdf'").first().value)["file_info"]) == 2
    files.write_documents(files.text_form(out), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "json")).count() == 2


def test_service(spark):
    rows = pipeline.extract(spark.createDataFrame([("a.pdf", 0, "As an AI\nText  of a page"), ("b.pdf", 0, None)], "file_name string, pass_idx int, text string"))
    got = {r.file_name: json.loads(r.value) for r in files.api_form(rows).collect()}
    assert got["a.pdf"]["ocr_text"] == "Text  of a page" and got["a.pdf"]["raw_ocr_text"].startswith("As") and got["b.pdf"]["issues"] == ["Very short output"]


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("Payment Voucher\nPV No 12\nPayee x")
    watch.write(watch.processed(watch.read_texts(spark, str(tmp_path / "in"))).select("file_name", "clean_text", "classification.document_type"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (row.file_name, row.document_type) == ("one.txt", "payment_voucher")


def test_rendered_texts_cover_the_types(spark):
    assert len(render.TEMPLATES) == 8 and set(render.CORPORA)


HOSTILE = {
    "blanks": "x" + " " * 200_000 + "y", "lines": "x" + "\n \t" * 60_000 + "y", "colons": "a :" * 60_000, "tags": "<div>" * 40_000, "open tags": "<div " * 40_000 + ">", "mixed tags": "<div <span" * 20_000 + "</div>",
    "brackets": "[" * 100_000, "closed brackets": "[" * 100_000 + "] x", "links": "[a](" * 40_000, "closed links": "[a](" * 40_000 + ")", "calls": "console.log(" * 20_000, "functions": "function f(" * 20_000, "stars": "*" * 200_000, "dots": ". " * 100_000,
    "digits": "1 " * 100_000, "dashes": "1 - " * 60_000, "article": "ال " * 60_000, "arabic": "ا" * 200_000, "swift": "SWIFT CODE: " * 20_000, "fields": "No. " * 50_000, "slashes": "1 / " * 60_000,
}


def test_hostile_texts_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from folioscope.functions.text import normal_form, squeeze
    from folioscope.operators import clean, correct

    steps = (squeeze, lambda t: normal_form(t, hamza=True), correct.fix_arabic_patterns, clean.drop_code, clean.drop_model_talk, clean.fix_numbers, clean.tidy, correct.fix_artifacts, correct.fix_doubled_letters, correct.fix_swift)
    for name, text in HOSTILE.items():
        began = time.time()
        spark.createDataFrame([("short",), (text,)], "t string").coalesce(1).select(*(f(F.col("t")).alias(f"c{k}") for k, f in enumerate(steps))).collect()
        assert time.time() - began < 12, name  # ten steps; a plan alone takes about one second


def test_code_without_ends_stays(one):
    from folioscope.operators.clean import drop_code

    texts = ["a <div>b</div> c <div>d", "<div <span>x</span> <b", "[a] [b](c) [d](e", "[[x](y) [](z) [q]()", "console.log(1) console.log(2\nwindow.x(3)", "var f(a) { b } let g(", "see http://x.y z [a\nb](c)"]
    assert one(drop_code, *texts) == ["a  c <div>d", " <b", "[a] b [d](e", "[x [](z) [q]()", " console.log(2\n", " let g(", "see  z a\nb"]
