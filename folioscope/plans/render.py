"""Texts to run the engine on: documents rendered from relational rows, recognition passes derived from documents, and small corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.storage import dealt

# One template for each remainder of the order's key; {n} stands for a line end. Both dialects know concat, chr and cast.
TEMPLATES = [
    "Tax Invoice{n}Invoice No: {key}{n}Bill To: {name}{n}Quantity / Unit Price{n}{lines}{n}Subtotal{n}VAT{n}Total",
    "Payment Voucher{n}PV No {key}{n}Supplier Name: {name}{n}Bank Name: First Bank{n}Net Payment{n}Debit{n}Credit{n}سند دفع",
    "Account Statement{n}Opening Balance{n}Closing Balance{n}IBAN AE07 {key}{n}{dates}{n}رصيد افتتاحي",
    "Contract{n}First Party: {name}{n}Second Party: the bank{n}1. Scope of Work{n}2. Contract Value {key}{n}3. Signatures{n}Terms and Conditions{n}الطرف الأول",
    "Dear Sir {name}{n}Subject: order {key}{n}Ref No {key}{n}Yours sincerely{n}الموضوع",
    "Memorandum{n}From: {name}{n}To: board{n}Background{n}Recommendation {key}{n}مذكرة",
    "المادة {key}{n}الباب الأول{n}1 - نظام{n}2 - أحكام{n}3 - مرسوم ملكي{n}ماده 7",
    "order {key} for {name}",
]


def _expression(template: str) -> str:
    """The template as a concatenation."""
    values = {"{n}": "chr(10)", "{key}": "cast(o_orderkey as {s})", "{name}": "c_name", "{lines}": "coalesce(line_list, '')", "{dates}": "coalesce(date_list, '')"}
    parts, rest = [], template
    while rest:
        at = min((rest.find(k), k) for k in values if k in rest)[0] if any(k in rest for k in values) else len(rest)
        if at:
            parts.append("'" + rest[:at] + "'")
            rest = rest[at:]
            continue
        key = next(k for k in values if rest.startswith(k))
        parts.append(values[key])
        rest = rest[len(key) :]
    return "concat(" + ", ".join(parts) + ")"


def _case(string: str) -> str:
    whens = " ".join(f"when {i} then {_expression(t)}" for i, t in enumerate(TEMPLATES))
    return f"case o_orderkey % {len(TEMPLATES)} {whens} end".replace("{s}", string)


_LINE = "concat(cast(l_partkey as {s}), ' x ', cast(cast(l_quantity as int) as {s}), ' at ', cast(l_suppkey as {s}), '.50')"
_DAY = "concat('0', cast(l_linenumber as {s}), '/02/2004 ', cast(l_partkey as {s}), '.25')"


#: Texts for each part at most.
PART_TEXTS = 50_000


def rendered(spark: SparkSession, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, file_name, text): one text for each order, dealt by the key."""
    for t in ("orders", "customer", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"folioscope_{t}")
    # a text takes lines of one of the two kinds, or none, by its template
    kinds = {i: (name, x) for i, t in enumerate(TEMPLATES) for name, x in (("lines", _LINE), ("dates", _DAY)) if "{" + name + "}" in t}
    kind = "case " + " ".join(f"when l_orderkey % {len(TEMPLATES)} = {i} then {x}" for i, (_, x) in kinds.items()).replace("{s}", "string") + " end"
    # texts are short and the work on each is long, so they keep all partitions instead of being coalesced by size
    return spark.sql(
        f"with l as (select l_orderkey, array_join(transform(sort_array(collect_list(struct(l_linenumber, {kind} as v))), r -> r.v), chr(10)) as line_list from folioscope_lineitem"
        f" where l_orderkey % {len(TEMPLATES)} in ({', '.join(map(str, kinds))}) group by l_orderkey)"
        f" select o_orderkey as doc_id, concat('f', cast(o_orderkey as string), '.pdf') as file_name, {_case('string').replace('date_list', 'line_list')} as text"
        " from folioscope_orders join folioscope_customer on o_custkey = c_custkey left join l on l_orderkey = o_orderkey"
    ).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-spark.table("folioscope_orders").count() // PART_TEXTS)), key)


def rendered_sql() -> str:
    """The same for DuckDB."""
    listed = lambda x: f"string_agg({x}, chr(10) order by l_linenumber, {x})".replace("{s}", "varchar")
    return (
        f"with l as (select l_orderkey, {listed(_LINE)} as line_list, {listed(_DAY)} as date_list from lineitem group by l_orderkey)"
        f" select o_orderkey as doc_id, concat('f', cast(o_orderkey as varchar), '.pdf') as file_name, {_case('varchar')} as text"
        " from orders join customer on o_custkey = c_custkey left join l on l_orderkey = o_orderkey"
    )


def passes(docs: DataFrame) -> DataFrame:
    """(doc_id, pass_idx, text): three readings of each text, with letters misread in two of them and a line lost in the third."""
    return docs.selectExpr("doc_id", "inline(array(struct(0 as pass_idx, text as t), struct(1 as pass_idx, replace(text, 'th', 'tn') as t), struct(2 as pass_idx, regexp_replace(replace(text, 'on', 'an'), '^[^\\n]*\\n', '') as t)))").selectExpr("doc_id", "pass_idx", "t as text")


#: Small corpora, a row for each trap.
CORPORA: dict[str, list[str]] = {
    "runs": ["a\na", "a\na\na", "a\na\na\na\na", "a\na\n\na\na", "x\na\nx\na\nx\na\nx\na\nx", *("\n".join([f"abcdefghijklmnop {i}" for i in range(n)] + ["end"]) for n in (7, 8)), *("\n".join([f"No. {i}" for i in range(n)] + ["end"]) for n in (7, 8)), "", "\n\n"],
    "normal": ["أَحْمَدُ  إلى آخره", "ة ى ؤ ئ", "كـــتاب", "Mixed\t CASE  text", "", "plain"],
    "numbers": ["1O2", "O55", "3l4", "7S8", "1. 00", "2004 – 01 – 02", "1O2O3", "no digits", "12 - 3 - 4", "total 5. 25 and 6. 7"],
    "arabic": ["تغاضيل الكاتورة", "اللغة", "المدفوعات", "تفاصيل", "plain English", "فاتوره وفاثورة", ""],
    "english": ["Total TOTAL Subtotal", "Transfer OFFICE", "Abu Dhabi ABU DHABI", "Suplier Ammount", "nothing wrong here", "CLEARANE clearnce", ""],
    "talk": ["As an AI model I cannot\nreal line", "Please note that\nkept", "I cannot read this\nNote: This image is bad\nkept note: x", "kept\nLet me know if\nend", "Here is the extracted text\nabc"],
    "scripts": ["abc日本語def", "текст and text", "ไทย x", "한국어", "plain", "हिन्दी mixed தமிழ்"],
    "swift": ["SWIFT CODE: SCBLASAD", "BIC ABCDASXX", "swift abcdasxx", "SCBLAD33 here", "none"],
    "detached": ["ال مبلغ", "لل مدير", "a : b ; c", "1 / 2 / 2004", "تفاصيلل", "No: ٢٣ and No: ٢٣ "],
}


#: Corpora whose rows all together make the noise of `mixed`.
MIXED = ("scripts", "talk", "numbers", "arabic", "english", "swift", "detached")


def corpus(spark: SparkSession, name: str) -> DataFrame:
    """(doc_id, text) of a small corpus."""
    return spark.createDataFrame(list(enumerate(CORPORA[name])), "doc_id long, text string")


def noisy(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(doc_id, text): every document with a row of each of the corpora below it, chosen by doc_id."""
    text = F.col("text")
    for name in names:
        values = F.array(*(F.lit(x) for x in CORPORA[name]))
        text = F.concat(text, F.lit("\n"), F.get(values, (F.col("doc_id") % len(CORPORA[name])).cast("int")))
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "doc_id", "text").select("doc_id", text.alias("text"))


def noisy_sql(*names: str) -> str:
    text = "text"
    for name in names:
        values = ", ".join("'" + x.replace("'", "''") + "'" for x in CORPORA[name])
        text += f" || chr(10) || ([{values}])[doc_id % {len(CORPORA[name])} + 1]"
    return f"select doc_id, {text} as text from documents"


#: A value for each order by the remainder of its key; {key}, {day} and {month} are of the order. Expected values beside answers: what the type field says.
DATES = ["{day}/{month}/2004", "{day}-{month}-99", "{month}/{day}/20041", "no date", "2004/{month}/{day}", "", "{month}/{month}/2011"]
PATHS = ["/in/{key}.JPG", "/in/{key}.pdf", "/in/{key}.txt", "/in/{key}.tar.gz", "/in/{key}.TiFF", "/in/{key}", "/in/.png", "/in/{key}.jpeg", "/in.pdf/{key}"]
ANSWERS = [
    ('{"document_type": "Invoice", "date": null, "no": {key}}', '{"document_type": "Invoice", "date": null, "no": {key}}', "Invoice"),
    ('text ```json\n{"title": "Payment Voucher {key}", "amounts": [1, {key}]}\n``` tail', '{"title": "Payment Voucher {key}", "amounts": [1, {key}]}', "Payment Voucher {key}"),
    ('x {"a": {"category": "عقد {key}"}} y', '{"a": {"category": "عقد {key}"}}', "عقد {key}"),
    ('{"a": {key},}', '{"a": {key}}', None),
    ("[1, {key}]", '{"raw": "[1, {key}]"}', None),
    ("no json {key}", '{"raw_text": "no json {key}"}', None),
    ('{"document_type": "memorandum", "x": {"y": {key}}}', '{"document_type": "memorandum", "x": {"y": {key}}}', "memorandum"),
    ('{"type": "ab", "forms": {"form_name": ["purchase order", {key}]}}', '{"type": "ab", "forms": {"form_name": ["purchase order", {key}]}}', "purchase order"),
]


#: Broken answers: (raw, the object, how it is recovered, what was forgiven).
BROKEN = [
    ('{"no": {key}, "type": "invoice"}', '{"no": {key}, "type": "invoice"}', "whole", ""),
    ('Here it is: ```json\n{"no": {key}}\n``` done', '{"no": {key}}', "fenced", ""),
    ('Answer {"no": {key}} and {"no": 2}', '{"no": {key}}', "braces", ""),
    ('{"no": {key},}', '{"no": {key}}', "repaired", "comma"),
    ('{"a": [1, 2, {key},],}', '{"a": [1, 2, {key}]}', "repaired", "comma"),
    ('{"a": 1 "b": {key}}', '{"a": 1, "b": {key}}', "repaired", "comma"),
    ('{"a": "x" "b": {key}}', '{"a": "x", "b": {key}}', "repaired", "comma"),
    ('{"a": "x"\n"b": {key}}', '{"a": "x", "b": {key}}', "repaired", "comma"),
    ('{"a": 1,, "b": {key}}', '{"a": 1, "b": {key}}', "repaired", "comma"),
    ('{"a": ["x" "y"], "no": {key}}', '{"a": ["x", "y"], "no": {key}}', "repaired", "comma"),
    ("{'no': {key}, 'type': 'invoice'}", '{"no": {key}, "type": "invoice"}', "repaired", "quotes"),
    ("{'name': 'O'Hara', 'no': {key}}", '{"name": "O\'Hara", "no": {key}}', "repaired", "inner quotes,quotes"),
    ("{“no”: “{key}”}", '{"no": "{key}"}', "repaired", "quotes"),
    ('{no: {key}, type: invoice}', '{"no": {key}, "type": "invoice"}', "repaired", "bare"),
    ('{"paid": True, "due": None, "no": {key}}', '{"paid": true, "due": null, "no": {key}}', "repaired", "bare"),
    ('{"total": {key} AED, "vat": 5%}', '{"total": "{key} AED", "vat": "5%"}', "repaired", "bare"),
    ('{"date": {day}/{month}/2004, "no": {key}}', '{"date": "{day}/{month}/2004", "no": {key}}', "repaired", "bare"),
    ('{"no": {key}, // the number\n "type": "memo"}', '{"no": {key}, "type": "memo"}', "repaired", "comment"),
    ('{/* first */ "no": {key} # last\n}', '{"no": {key}}', "repaired", "comment"),
    ('{"no": {key}, "title": "cut of', '{"no": {key}, "title": "cut of"}', "repaired", "cut"),
    ('{"a": [1, {"b": {key}', '{"a": [1, {"b": {key}}]}', "repaired", "cut"),
    ('{"no": {key}, "la', '{"no": {key}, "la": ""}', "repaired", "colon,cut,value"),
    ('{"no": {key}, "date":', '{"no": {key}, "date": ""}', "repaired", "cut,value"),
    ('{"a": [1, {key}, "b": 2}', '{"a": [1, {key}, "b", 2]}', "repaired", "brackets,colon,comma"),
    ('{"a": {"b": {key}]}', '{"a": {"b": {key}}}', "repaired", "brackets,cut"),
    ('{"date": , "no": {key}}', '{"date": "", "no": {key}}', "repaired", "value"),
    ('{"no": {key}, "date": }', '{"no": {key}, "date": ""}', "repaired", "value"),
    ('{"no" {key}}', '{"no": {key}}', "repaired", "colon"),
    ('{"no" = {key}}', '{"no": {key}}', "repaired", "colon"),
    ('{"title": "the "big" one", "no": {key}}', '{"title": "the \\"big\\" one", "no": {key}}', "repaired", "inner quotes"),
    ('{"title": "two\nlines", "no": {key}}', '{"title": "two\\nlines", "no": {key}}', "repaired", "control"),
    ('{"rate": .5, "no": {key}}', '{"rate": 0.5, "no": {key}}', "repaired", "number"),
    ('{"rate": +1.5, "no": {key}}', '{"rate": 1.5, "no": {key}}', "repaired", "number"),
    ('Sure! {no: {key}} Anything else?', '{"no": {key}}', "repaired", "bare,text around"),
    ('{no: {key}} {no: 2}', '{"no": {key}}', "repaired", "bare,more"),
    ("```json\n{'no': {key}}\n```", '{"no": {key}}', "repaired", "quotes,text around"),
    ('{"نوع": "فاتورة", رقم: {key}}', '{"نوع": "فاتورة", "رقم": {key}}', "repaired", "bare"),
    ('["no", {key}', '{"raw_text": "[\\"no\\", {key}"}', "none", "no object"),
    ("no JSON in {key}", '{"raw_text": "no JSON in {key}"}', "none", "no JSON"),
    ("", '{"raw_text": ""}', "none", "no JSON"),
]


def by_order(values: list[str | None], string: str = "string") -> str:
    """SQL for the value of an order, for both dialects; null where it's None."""
    parts = {"key": f"cast(o_orderkey as {string})", "day": f"cast(o_orderkey % 28 + 1 as {string})", "month": f"cast(o_orderkey % 12 + 1 as {string})"}
    whens = []
    for i, v in enumerate(values):
        sql = "null" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        for k, x in parts.items():
            sql = sql.replace("{" + k + "}", f"' || {x} || '")
        whens.append(f"when {i} then {sql}")
    return f"case o_orderkey % {len(values)} {' '.join(whens)} end"


def of_orders(spark: SparkSession, sf_dir: str, values: list[str]) -> DataFrame:
    """(doc_id, text): a value for each order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as doc_id", f"{by_order(values)} as text")


def of_orders_sql(values: list[str]) -> str:
    return f"select o_orderkey as doc_id, {by_order(values, 'varchar')} as text from orders"
