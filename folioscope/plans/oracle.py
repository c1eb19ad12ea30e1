"""SQL of the queries, for DuckDB: windows and sums over unnested lines where the engine works within rows."""

from __future__ import annotations

from folioscope.functions.tables import ARABIC_CORRECTIONS, DIGITS_FROM, DIGITS_TO, DOCUMENT_TYPES, ENGLISH_CORRECTIONS, KEYWORDS, TYPE_PATTERNS
from folioscope.functions.text import FOLD_FROM, FOLD_TO, HAMZA_FROM, HAMZA_TO, MARKS, TATWEEL, normal_text
from folioscope.operators.classify import DETECTORS, keyword_weight
from folioscope.operators.clean import CODE, FOREIGN, MODEL_TALK
from folioscope.operators.correct import FIELD_PATTERNS
from folioscope.operators.grade import CODE_WORDS, GATE_MARKERS, REPORT_MARKERS
from folioscope.operators.merge import COUNTED, PRESENT
from folioscope.plans import render

DOCUMENTS = "select doc_id, text from documents"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _norm(x: str, hamza: bool = False, tatweel: bool = False) -> str:
    out = f"translate(regexp_replace(lower({x}), {_q(MARKS)}, '', 'g'), {_q(FOLD_FROM)}, {_q(FOLD_TO)})"
    if hamza:
        out = f"translate({out}, {_q(HAMZA_FROM)}, {_q(HAMZA_TO)})"
    if tatweel:
        out = f"replace({out}, {_q(TATWEEL)}, '')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _lines(source: str) -> str:
    """(doc_id, n, line, s) with stripped lines."""
    return f"select doc_id, n, line, {_strip('line')} as s from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from ({source}))"


def _joined(source: str, keep: str, name: str = "text") -> str:
    """Lines of `source` (doc_id, n, line, ...) put together again where `keep` holds."""
    return f"select doc_id, coalesce(string_agg(line, chr(10) order by n) filter ({keep}), '') as {name} from ({source}) group by doc_id"


def _runs(source: str, name: str = "text") -> str:
    marked = f"select *, sum(case when s = before then 0 else 1 end) over (partition by doc_id order by n) as island from (select *, lag(s) over (partition by doc_id order by n) as before from ({_lines(source)}))"
    return _joined(f"select *, row_number() over (partition by doc_id, island order by n) as k from ({marked})", "k <= 3 or s = ''", name)


def _near(source: str, name: str = "text") -> str:
    return _joined(f"select *, row_number() over (partition by doc_id, {_norm('s')} order by n) as k from ({_lines(source)})", "k <= 3 or s = ''", name)


def _loops(source: str, name: str = "text") -> str:
    keyed = f"select *, case when regexp_matches(s, '(?i)^No\\.?\\s*\\d+\\s*$') then 1 end as num, case when length(s) >= 15 then {_norm('left(s, 15)')} end as pre from ({_lines(source)})"
    for key, island in (("num", "i1"), ("pre", "i2")):
        keyed = f"select *, sum(case when {key} is not distinct from b_{key} then 0 else 1 end) over (partition by doc_id order by n) as {island} from (select *, lag({key}) over (partition by doc_id order by n) as b_{key} from ({keyed}))"
    sized = f"select *, count(*) over (partition by doc_id, i1) as c1, count(*) over (partition by doc_id, i2) as c2 from ({keyed})"
    return _joined(sized, "not ((num is not null and c1 >= 8) or (pre is not null and c2 >= 8))", name)


def _common(source: str) -> str:
    return f"select doc_id, arg_max(s, (c, -first)) as line, max(c) as n from (select doc_id, s, count(*) as c, min(n) as first from ({_lines(source)}) where s <> '' group by doc_id, s) group by doc_id"


def _any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {_q(w.lower())})" for w in words) + ")"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(pattern)}))"


def _validation(source: str) -> str:
    issues = f"list_filter([case when length(text) < 30 then 'Very short output' end, case when m.n > 3 then 'Repetition: ''' || left(m.line, 40) || ''' x' || m.n end, case when {_any('lower(text)', REPORT_MARKERS)} then 'Hallucination detected' end], lambda x: x is not null)"
    base = f"select d.*, coalesce(l.c, 0) as line_count, {issues} as iss, {_count('text', '[؀-ۿ]')} as arabic_chars, {_count('text', '[a-zA-Z]')} as english_chars, {_count('text', '[0-9]')} as digit_chars, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as words from ({source}) d left join ({_common(source)}) m using (doc_id) left join (select doc_id, count(*) as c from ({_lines(source)}) where s <> '' group by doc_id) l using (doc_id)"
    points = (
        "(case when length(text) > 500 then 25 when length(text) > 200 then 20 when length(text) > 100 then 15 when length(text) > 50 then 10 else 0 end)"
        " + (case when line_count > 10 then 15 when line_count > 5 then 10 when line_count > 3 then 5 else 0 end)"
        " + (case when arabic_chars + english_chars > 0 and len(words) > 0 then floor(len(list_distinct(words)) / len(words) * 20)::int else 0 end)"
        " + least(digit_chars, 10) + (case when arabic_chars > 0 and english_chars > 0 then 15 when arabic_chars + english_chars > 0 then 10 else 0 end) - 5 * len(iss)"
    )
    return f"select *, case when p >= 60 and len(iss) = 0 then 'excellent' when p >= 40 and len(iss) <= 1 then 'good' when p >= 20 then 'needs_review' else 'poor' end as quality from (select *, {points} as p from ({base}))"


def _validated(source: str) -> str:
    return f"select doc_id, quality, greatest(p, 0)::bigint as quality_score, array_to_string(iss, '; ') as issues, length(text) as char_count, arabic_chars::bigint as arabic_chars, english_chars::bigint as english_chars, digit_chars::bigint as digit_chars, line_count::bigint as line_count, round_even(arabic_chars / greatest(arabic_chars + english_chars, 1) * 100, 1) as arabic_ratio from ({_validation(source)})"


def _gate(source: str) -> str:
    marker = "case " + " ".join(f"when contains(lower(text), {_q(m.lower())}) then {_q('Hallucination: ' + chr(39) + m + chr(39))}" for m in GATE_MARKERS) + " end"
    letters = f"({_count('text', '[؀-ۿ]')} + {_count('text', '[a-zA-Z]')})"
    other = f"(length(text) - {letters} - {_count('text', '[' + chr(92) + 's0-9.,;:' + chr(92) + '-/()@#%&+=]')})"
    issues = f"list_filter([case when coalesce(l.c, 0) < 2 then 'Too few lines' end, case when m.n > 3 then 'Repetition: ''' || left(m.line, 40) || ''' x' || m.n end, {marker}, case when {_any('lower(text)', CODE_WORDS)} then 'Code remnants' end, case when {letters} > 0 and {other} > {letters} * 0.3::double then 'Excessive special characters' end], lambda x: x is not null)"
    base = f"select d.*, coalesce(l.c, 0) as c, case when length(text) < 30 then ['Very short output'] else {issues} end as iss from ({source}) d left join ({_common(source)}) m using (doc_id) left join (select doc_id, count(*) as c from ({_lines(source)}) where s <> '' group by doc_id) l using (doc_id)"
    return f"select doc_id, case when length(text) < 30 then 'poor' when len(iss) = 0 then case when length(text) > 200 and c > 5 then 'excellent' else 'good' end when len(iss) = 1 then 'needs_review' else 'poor' end as quality, array_to_string(iss, '; ') as issues from ({base})"


def _keywords() -> str:
    """(doc_id, document_type, ord, weighted, matches, confidence), of rendered texts; types without a hit too."""
    order = {t: i for i, (t, *_) in enumerate(DOCUMENT_TYPES)}
    rows = ", ".join(f"({_q(t)}, {order[t]}, {_q(normal_text(k))}, {keyword_weight(k)}::double)" for t, ks in KEYWORDS.items() for k in ks)
    w = "weighted"
    confidence = f"case when {w} >= 20 then 92.0::double + least({w} - 20, 10) * 0.8::double when {w} >= 12 then 75.0::double + ({w} - 12) * (17::double / 8) when {w} >= 6 then 45.0::double + ({w} - 6) * 5 when {w} >= 3 then 20.0::double + ({w} - 3) * (25::double / 3) when {w} >= 1 then 5.0::double + ({w} - 1) * 15 else 0.0::double end"
    return f"select *, {confidence} as confidence from (select doc_id, document_type, ord, coalesce(sum(weight) filter (contains(normal, key)), 0)::double as weighted, count(*) filter (contains(normal, key)) as matches from (select doc_id, {_norm('text', True, True)} as normal from r) cross join (values {rows}) as k(document_type, ord, key, weight) group by doc_id, document_type, ord)"


def _structure() -> str:
    """(doc_id, points of each detector) of rendered texts."""
    sums = []
    for kind, _, tests in DETECTORS:
        parts = []
        for points, pattern, *rest in tests:
            if not rest:
                hit = f"regexp_matches(normal, {_q(pattern)})"
            elif rest[0] == "first":
                hit = f"coalesce(regexp_matches(filled[1], {_q(pattern)}), false)"
            elif isinstance(rest[0], int):
                hit = f"len(list_filter(filled, lambda x: regexp_matches(x, {_q(pattern)}))) >= {rest[0]}"
            else:
                hit = f"regexp_matches(normal, {_q(pattern)}) and regexp_matches(normal, {_q(rest[0])})"
            parts.append(f"(case when {hit} then {points} else 0 end)")
        sums.append(f"({' + '.join(parts)})::bigint as {kind}")
    filled = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
    return f"select doc_id, {', '.join(sums)} from (select doc_id, {_norm('text', True, True)} as normal, {filled} as filled from r)"


def _opinions() -> tuple[str, str]:
    """(doc_id, k_type, k_conf, keyword_matches) of k, and (doc_id, s_type, s_conf) of s."""
    top = "greatest(" + ", ".join("case " + " ".join(f"when {kind} >= {p} then {c}::double" for p, c in steps) + " else 0.0::double end" for kind, steps, _ in DETECTORS) + ")"
    # of detectors with the largest confidence the first one: its own confidence has to be the largest
    first = "case " + " ".join(f"when (case {' '.join(f'when {kind} >= {p} then {c}::double' for p, c in steps)} else 0.0::double end) = s_conf then {_q(kind)}" for kind, steps, _ in DETECTORS) + " end"
    st = f"select doc_id, case when s_conf > 0 then {first} end as s_type, s_conf from (select *, {top} as s_conf from s)"
    kw = "select doc_id, case when c < 15 then 'unknown' else t end as k_type, round_even(c, 2) as k_conf, m as keyword_matches from (select doc_id, arg_max(document_type, (confidence, -ord)) as t, max(confidence) as c, arg_max(matches, (confidence, -ord)) as m from k group by doc_id)"
    return kw, st


def _vote() -> str:
    """Classification of rendered texts by keywords and structure."""
    kw, st = _opinions()
    names = "case document_type " + " ".join(f"when {_q(t)} then {_q(en)}" for t, _, en, _ in DOCUMENT_TYPES) + " end"
    chosen = "case when k_type = 'unknown' and s_type is null then 'unknown' when k_type = 'unknown' then s_type when s_type is null or s_type = k_type or k_conf >= s_conf then k_type else s_type end"
    conf = "case when k_type = 'unknown' then s_conf when s_type is null then k_conf when s_type = k_type then least(greatest(k_conf, s_conf) * 1.1::double, 100) else greatest(k_conf, s_conf) end"
    method = "case when k_type = 'unknown' and s_type is null then 'no_match' when k_type = 'unknown' then 'structural_pattern' when s_type is null then 'keyword_matching' when s_type = k_type then 'keyword_matching + structural_pattern' when k_conf >= s_conf then 'keyword_matching' else 'structural_pattern' end"
    return f"with r as ({render.rendered_sql()}), k as ({_keywords()}), s as ({_structure()}), v as (select doc_id, {chosen} as document_type, {conf} as confidence, {method} as method, case when k_type = 'unknown' and s_type is null then 0 else keyword_matches end as keyword_matches from ({kw}) join ({st}) using (doc_id)), c as (select *, {names} as name_en from v)"


def _full() -> str:
    """Rendered documents through merging, cleaning, grading and the vote of the model's field, keywords and structure."""
    kw, st = _opinions()
    kind = "case " + " ".join(f"when {' or '.join(f'contains(normal, {_q(p)})' for p in ps)} then {_q(t)}" for t, ps in TYPE_PATTERNS.items()) + " end"
    return f"""
    with r0 as materialized ({render.rendered_sql()}),
    made as materialized ({merged('select doc_id, text from r0')}),
    r as materialized ({cleaned('select doc_id, text from made')}),
    k as ({_keywords()}), s as ({_structure()}),
    f as (select doc_id, file_name, said, {_norm('said', True, True)} as normal from (select doc_id, file_name, split_part(text, chr(10), 1) as said from r0)),
    found as (
      select doc_id, 0 as ord, {kind} as t, 95.0::double as c, 'model_json_field' as m, said from f
      union all select doc_id, 1, k_type, k_conf, 'keyword_matching', '' from ({kw}) where k_type <> 'unknown'
      union all select doc_id, 2, s_type, s_conf, 'structural_pattern', '' from ({st})),
    counted as (select *, count(*) over (partition by doc_id, t) as n from found where t is not null),
    lead as (select doc_id, arg_max(t, (n, -ord)) as t, max(n) as n from counted group by doc_id),
    votes as (select counted.*, lead.n as most from counted join lead using (doc_id) where lead.n = 1 or counted.t = lead.t),
    chosen as (
      select doc_id, arg_max(t, (c, -ord)) as document_type, case when most > 1 then least(max(c) * case most when 2 then 1.1::double else 1.2::double end, 100.0::double) else max(c) end as confidence,
        case when most > 1 then string_agg(m, ' + ' order by ord) else arg_max(m, (c, -ord)) end as method, nullif(arg_max(said, (c, -ord)), '') as model_said
      from votes group by doc_id, most)
    select file_name, r.text as clean_ocr_text, '{{"document_type": "' || f.said || '", "invoice_date": null}}' as json_data, g.quality as gate, v.quality, coalesce(document_type, 'unknown') as document_type,
      coalesce(confidence, 0.0::double) as confidence, coalesce(method, 'no_match') as method, model_said
    from f join r using (doc_id) join ({_gate('select doc_id, text from r')}) g using (doc_id) join ({_validated('select doc_id, text from r')}) v using (doc_id) left join chosen using (doc_id)"""


def _report() -> str:
    quality = _validation("select doc_id, text from r")
    return f"{_vote()}, q as ({quality}), t as (select r.file_name, r.doc_id % 97 <> 0 as ok, c.*, q.quality from r join c using (doc_id) join q using (doc_id)), p as (select file_name, case when ok then 'success' else 'error' end as status, case when ok then document_type else 'error' end as document_type, case when ok then name_en else 'Error' end as type_en, case when ok then round_even(confidence, 4) else 0.0::double end as confidence, case when ok then method else '' end as method, 0.0::double as processing_time, case when ok then quality else 'error' end as quality from t)"


def _pairs(x: str) -> str:
    return f"case when length({x}) >= 2 then list_distinct(list_transform(range(1, length({x})), lambda i: substring({x}, i, 2))) else [{x}] end"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def _like(a: str, b: str) -> str:
    """Similarity of two lines, each a row with normal form x, pairs g and words w."""
    common = lambda c: f"len(list_intersect({a}.{c}, {b}.{c}))"
    dice = f"2.0::double * {common('g')} / (len({a}.g) + len({b}.g))"
    union = f"len(list_distinct(list_concat({a}.w, {b}.w)))"
    jaccard = f"case when {union} > 0 then {common('w')}::double / {union} else 0.0::double end"
    lengths = f"least(length({a}.x), length({b}.x))::double / greatest(length({a}.x), length({b}.x), 1)"
    return f"case when {a}.x = '' or {b}.x = '' then 0.0::double else 0.35::double * ({dice}) + 0.45::double * ({jaccard}) + 0.20::double * ({lengths}) end"


def _similarity() -> str:
    """Similarity of each line's normal form to the next one's."""
    lines = f"select doc_id, row_number() over (partition by doc_id order by n) - 1 as n, x, {_pairs('x')} as g, {_words('x')} as w from (select doc_id, n, {_norm('s', True)} as x from ({_lines(DOCUMENTS)}) where s <> '')"
    return f"with f as ({lines}) select a.doc_id, a.n::bigint as n, round_even({_like('a', 'b')}, 6) as similarity from f a join f b on a.doc_id = b.doc_id and b.n = a.n + 1"


def _line_score() -> str:
    """Score of a stripped line s among candidates of which the longest has `longest` characters."""
    score = "least(length(s), 200) * 0.3::double"
    for points, pattern, _ in COUNTED[:5]:
        score += f" + {points}::double * {_count('s', pattern)}"
    score += " - case when length(s) < 3 and longest >= 10 then 20.0::double else 0.0::double end"
    flag = lambda f: "(?i)" if "i" in f else ""
    for points, pattern, f in PRESENT[:3]:
        score += f" + case when regexp_matches(s, {_q(flag(f) + pattern)}) then {points}::double else 0.0::double end"
    for points, pattern, _ in COUNTED[5:]:
        score += f" + {points}::double * {_count('s', pattern)}"
    for points, pattern, f in PRESENT[3:]:
        score += f" + case when regexp_matches(s, {_q(flag(f) + pattern)}) then {points}::double else 0.0::double end"
    ar, en = _count("s", "[؀-ۿ]"), _count("s", "[a-zA-Z]")
    return score + f" + case when {ar} > 0 and {en} > 0 and least({ar}, {en}) > 0.1::double * greatest({ar}, {en}) then 2.0::double else 0.0::double end"


def _best_line() -> str:
    """Of each three lines in turn the best one."""
    threes = f"select *, max(length(s)) over (partition by doc_id, g) as longest from (select doc_id, s, (k - 1) // 3 as g, k from (select doc_id, s, row_number() over (partition by doc_id order by n) as k from ({_lines(DOCUMENTS)}) where s <> ''))"
    return f"select doc_id, g::bigint as n, arg_max(s, (score, -k)) as line from (select *, {_line_score()} as score from ({threes})) group by doc_id, g"


def merged(source: str) -> str:
    """Consensus (doc_id, text) of the three readings that render.passes derives of (doc_id, text).

    A recursion walks the lines of the longest reading and carries, for each other reading, the line after the last one taken; of the three candidates
    that a line then has at most, groups follow from their three similarities.
    """
    readings = f"select doc_id, unnest([text, replace(text, 'th', 'tn'), regexp_replace(replace(text, 'on', 'an'), '^[^\\n]*\\n', '')]) as text, unnest([0, 1, 2]) as p from (select doc_id, coalesce(text, '') as text from ({source}))"
    numbered = _lines(f"select doc_id || '/' || p as doc_id, text from ({readings})")
    lines = f"select split_part(doc_id, '/', 1) as d, split_part(doc_id, '/', 2)::int as p, row_number() over (partition by doc_id order by n) as k, line, s, {_norm('s', True)} as x from ({numbered}) where s <> ''"
    sim = lambda a, b: f"coalesce({_like(a, b)}, 0.0::double)"
    longest = "max(length(s)) filter (chosen) over (partition by d, i)"
    return f"""
    with recursive l as materialized (select *, {_pairs('x')} as g, {_words('x')} as w from ({lines})),
    base as materialized (select d, arg_max(p, (n, -p)) as p from (select d, p, count(*) as n from l group by d, p) group by d),
    b as materialized (select l.* from l join base using (d, p)),
    o as (select l.* from l join base on l.d = base.d and l.p <> base.p),
    sims as materialized (select b.d, o.p, b.k as i, list({_like('b', 'o')} order by o.k) as v from b join o on b.d = o.d group by b.d, o.p, b.k),
    walk(d, p, i, free, took) as (
      select d, p, 0::bigint, 1::bigint, null::bigint from (select distinct d, p from sims)
      union all
      select d, p, i, case when best > 0.3 then spot + 1 else free end, case when best > 0.3 then spot end
      from (select d, p, i, free, best, free + list_position(v[free:], best) - 1 as spot from (select walk.d, walk.p, sims.i, walk.free, sims.v, list_max(sims.v[walk.free:]) as best from walk join sims on sims.d = walk.d and sims.p = walk.p and sims.i = walk.i + 1))),
    c as materialized (select d, i, row_number() over (partition by d, i order by p) as r, line, s, x, g, w from (
      select d, p, k as i, line, s, x, g, w from b union all select l.d, l.p, walk.i, l.line, l.s, l.x, l.g, l.w from walk join l on l.d = walk.d and l.p = walk.p and l.k = walk.took)),
    m as (select a.d, a.i, case when b.r is null then null when {sim('a', 'b')} > 0.6 then 1 else 2 end as g2, case when c3.r is null then null when {sim('a', 'c3')} > 0.6 then 1 when not {sim('a', 'b')} > 0.6 and {sim('b', 'c3')} > 0.6 then 2 else 3 end as g3
      from (select * from c where r = 1) a left join (select * from c where r = 2) b using (d, i) left join (select * from c where r = 3) c3 using (d, i)),
    h as (select c.*, case r when 1 then 1 when 2 then g2 else g3 end as grp from c join m using (d, i)),
    z as (select *, count(*) over (partition by d, i, grp) as many, count(*) over (partition by d, i) as every from h),
    q as (select *, max(many) over (partition by d, i) as most, min(grp) filter (many > 1) over (partition by d, i) as lead from z),
    e as (select *, most = 1 or grp = lead as chosen from q),
    f as (select *, {longest} as longest, count(*) filter (chosen) over (partition by d, i) as pool from e),
    t as (select d, i, arg_max(line, (score, -r)) as line from (select *, {_line_score()} as score from f where chosen) group by d, i)
    select s.doc_id, coalesce(string_agg(t.line, chr(10) order by t.i), '') as text from ({source}) s left join t on t.d = s.doc_id::varchar group by s.doc_id"""


def _service() -> str:
    """Merged and cleaned documents with the grade of what is left."""
    merge = merged(DOCUMENTS)
    return (
        f"with made as materialized ({merge}), washed as materialized ({cleaned('select doc_id, text from made')})"
        f" select doc_id::varchar as file_name, washed.text as ocr_text, made.text as raw_ocr_text, 0.0::double as processing_time, length(washed.text) as char_count, v.quality, v.issues from made join washed using (doc_id) join ({_validated('select doc_id, text from washed')}) v using (doc_id)"
    )


def _chain(x: str, steps: list[tuple[str, str, str]]) -> str:
    for pattern, new, flags in steps:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(new)}, {_q('g' + flags)})"
    return x


def _of(source: str, x: str) -> str:
    """The text of `source` (doc_id, text) after an expression on it."""
    return f"select doc_id, {x} as text from ({source})"


def _in_turn(x: str, rules: list[tuple[str, str]], plain: bool) -> str:
    """Ordered replacements, all of them."""
    rows = ", ".join(f"{{'a': {_q(a)}, 'b': {_q(b)}}}" for a, b in rules)
    step = "replace(acc.b, r.a, r.b)" if plain else "regexp_replace(acc.b, '(?i)' || regexp_escape(r.a), r.b, 'g')"
    return f"list_reduce([{rows}], lambda acc, r: {{'a': '', 'b': {step}}}, {{'a': '', 'b': {x}}}).b"


_AR = "[\u0600-\u06ff]"


def _artifacts(x: str) -> str:
    return _chain(x, [(r"(\d)O(\d)", "\\1" + "0\\2", ""), (r"O(\d{2,})", "0\\1", ""), (r"(\d)l(\d)", "\\1" + "1\\2", ""), (r"(\d)S(\d)", "\\1" + "5\\2", "")])


def _doubled(x: str) -> str:
    """Without back references: each letter of the block by itself."""
    step = "regexp_replace(acc.b, r.a || r.a || '([^\u0600-\u06ff]|$)', r.a || '\\1', 'g')"
    return f"list_reduce(list_transform(range(1536, 1792), lambda c: {{'a': chr(c::int), 'b': ''}}), lambda acc, r: {{'a': '', 'b': {step}}}, {{'a': '', 'b': {x}}}).b"


def _swift(x: str) -> str:
    label = r"((?i:(?:SWIFT|BIC|S\.?W\.?I\.?F\.?T)\s*(?:CODE|COE|COD)?\s*:?\s*))"
    return _chain(x, [(r"\bSCBL(AS|AD)AD\b", "SCBLAEAD", ""), (r"\bSCBL(AS|AD)33\b", "SCBLAE33", ""), (label + r"([A-Z]{4})(?:AS|AD)(?:([A-Z]{5})|([A-Z]{2,4})([^A-Za-z]|$))", r"\1\2AE\3\4\5", "")])


def _patterns(x: str) -> str:
    """Where a detached word follows at once on another this differs, as matches can't share characters here."""
    al, ll = "ال", "لل"
    steps = [(rf"(^|\s){al}\s+({_AR})", rf"\1{al}\2", "m"), (rf"(^|\s){al}\s+{al}({_AR})", rf"\1{al}\2", "m"), (rf"(^|\s){ll}\s+({_AR})", rf"\1{ll}\2", "m")]
    steps += [(r"(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})", r"\1/\2/\3", ""), (r"(\d{4})\s*/\s*(\d{1,2})\s*/\s*(\d{1,2})", r"\1/\2/\3", ""), (r"\s+:\s+", ": ", ""), (r"\s+;\s+", "; ", "")]
    return _chain(x, [("(?m)" + p if f else p, n, "") for p, n, f in steps])


def _digits(source: str) -> str:
    for p in FIELD_PATTERNS:
        hit = lambda g, p=p: f"regexp_extract(text, {_q('(?i)' + p)}, {g})"
        source = _of(source, f"case when {hit(0)} <> '' then replace(text, {hit(0)}, {hit(1)} || translate({hit(2)}, {_q(DIGITS_FROM)}, {_q(DIGITS_TO)})) else text end")
    return source


def _normal_arabic(x: str) -> str:
    return f"regexp_replace(replace(replace(replace({x}, {_q(TATWEEL)}, ''), '،،', '،'), '؟؟', '؟'), '({_AR}),(\\s*{_AR})', '\\1،\\2', 'g')"


def _numbers(x: str) -> str:
    return _chain(x, [(r"(\d)\.\s+(\d{2})\b", r"\1.\2", ""), (r"(\d{1,4})\s*[-–—]\s*(\d{1,2})\s*[-–—]\s*(\d{1,4})", r"\1-\2-\3", "")])


def _code(x: str) -> str:
    return _chain(x, [(p, n.replace("$1", chr(92) + "1"), f) for p, n, f in CODE])


def _talk(x: str) -> str:
    return _chain(x, [("(?im)" + p, "", "") for p in MODEL_TALK])


def _scripts(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'[{FOREIGN}]+')}, '', 'g')"


def cleaned(source: str) -> str:
    """The whole cleaning of (doc_id, text)."""
    for step in (_scripts, _talk, _code):
        source = _of(source, step("text"))
    source = _loops(_near(_runs(source)))
    source = _of(_of(source, _artifacts("text")), _doubled("text"))
    source = _of(_of(source, _in_turn("text", ARABIC_CORRECTIONS, True)), _in_turn("text", ENGLISH_CORRECTIONS, False))
    source = _digits(_of(_of(source, _swift("text")), _patterns("text")))
    source = _of(_of(_of(source, _chain("text", [(r"\t{2,}", chr(9), "")])), _normal_arabic("text")), _numbers("text"))
    source = _of(source, _chain("text", [(r"\*{5,}", "", ""), (r"\.{5,}", "...", ""), (r"-{5,}", "—", ""), (r"\n{3,}", chr(10) * 2, ""), (r"\t{2,}", chr(9), "")]))
    filled = f"list_filter(string_split(text, chr(10)), lambda x: {_strip('x')} <> '')"
    return _of(_of(source, f"array_to_string({filled}, chr(10))"), _strip("text"))


def _all_scores() -> str:
    return f"{_vote()}, a as (select doc_id, document_type, round_even(confidence, 2) as score, matches, weighted, ord from k where doc_id in (select doc_id from v where method <> 'no_match')) select doc_id, row_number() over (partition by doc_id order by -score, ord) - 1 as rank, document_type, score, matches, weighted from a"


def _retries() -> str:
    """Two more readings of texts cut short, each taken if the text so far is poor and it is better."""
    base = "select doc_id, case when doc_id % 3 = 0 then left(text, 20) else text end as text from documents"
    fresh = {1: "select doc_id, left(text, doc_id % 12 + 18) as text from documents", 2: "select doc_id, left(text, 400) as text from documents where doc_id % 2 = 0"}
    for again in fresh.values():
        taken = "f.text is not null and a.quality = 'poor' and (b.quality <> 'poor' or length(f.text) > 1.2::double * length(d.text))"
        base = f"select d.doc_id, case when {taken} then f.text else d.text end as text from ({base}) d left join ({again}) f using (doc_id) left join ({_gate(base)}) a using (doc_id) left join ({_gate(again)}) b using (doc_id)"
    return base


def _answers() -> str:
    column = lambda k: render.by_order([row[k] for row in render.ANSWERS], "varchar")
    normal = _norm("said_type", True, True)
    kind = "case " + " ".join(f"when {' or '.join(f'contains(normal, {_q(p)})' for p in ps)} then {_q(t)}" for t, ps in TYPE_PATTERNS.items()) + " else 'unknown' end"
    return f"select doc_id, json_data, said_type, case when said_type is not null then {kind} end as document_type, case when said_type is null then null when {kind} = 'unknown' then 30.0::double else 95.0::double end as confidence from (select *, {normal} as normal from (select o_orderkey as doc_id, {column(1)} as json_data, {column(2)} as said_type from orders))"


def _recovered() -> str:
    column = lambda k: render.by_order([row[k] for row in render.BROKEN], "varchar")
    return f"select o_orderkey as doc_id, {column(1)} as json_data, {column(2)} as how, {column(3)} as reasons from orders"


def _pages() -> str:
    """Texts as pages of 64 pixels a row, each pixel with its neighbours."""
    near = ", ".join(f"{'lag' if by > 0 else 'lead'}(v, {abs(by)}) over o as n{k}" for k, by in enumerate((1, -1, 63, 64, 65, -63, -64, -65)))
    blurred = f"case when i // 64 between 1 and h - 2 and i % 64 between 1 and 62 then (2 * (5 * v + {' + '.join(f'n{k}' for k in range(8))}) + 13) // 26 else v end"
    return f"""with a as (select doc_id, regexp_extract_all(hex(encode(text)), '..') as x from documents where text is not null),
        b as (select doc_id, x, greatest((len(x) + 63) // 64, 1) as h from a),
        c as (select doc_id, h, unnest(list_concat(x, list_transform(range(h * 64 - len(x)), lambda k: 'FF'))) as s, unnest(range(h * 64)) as i from b),
        d as (select doc_id, h, i, ('0x' || s)::int as v from c),
        e as (select *, {near} from d window o as (partition by doc_id order by i)),
        f as (select *, {blurred} as m from e),
        g as (select doc_id, any_value(h)::bigint as height, sum(floor(greatest(0, least(255, m + 1.5 * (v - m)))))::bigint as sharp, sum(case when i % 64 = 0 then v else greatest(v, n0) end)::bigint as thick from f group by doc_id)
        select doc_id, height, sharp, thick from documents left join g using (doc_id)"""


def queries() -> dict[str, str]:
    noisy = render.noisy_sql
    english = _in_turn("text", ENGLISH_CORRECTIONS, False)
    runs = noisy("runs")
    return {
        "remove_repetitions": _runs(DOCUMENTS),
        "remove_near_duplicates": _near(DOCUMENTS),
        "prefix_loops": _loops(DOCUMENTS),
        "repetition_filters": _loops(_near(_runs(DOCUMENTS))),
        "validate_quality": _validated(DOCUMENTS),
        "quality_gate": _gate(DOCUMENTS),
        "quality_counts": f"select quality, count(*) as n from ({_validation(DOCUMENTS)}) group by quality",
        "quality_vs_label": f"select v.quality, l.quality as label, count(*) as n from ({_validation(DOCUMENTS)}) v join labels l using (doc_id) group by all",
        "clean_quality_counts": f"select a.quality as raw_quality, b.quality as clean_quality, count(*) as n from ({_validation(DOCUMENTS)}) a join ({_validation(_near(_runs(DOCUMENTS)))}) b using (doc_id) group by all",
        "quality_retries": _retries(),
        "most_common_line": _common(DOCUMENTS),
        "char_classes": f"select doc_id, {_count('text', '[؀-ۿ]')} as arabic_chars, {_count('text', '[a-zA-Z]')} as english_chars, {_count('text', '[0-9]')} as digit_chars from documents",
        "strip_code_garbage": f"select page_id, {_code('html')} as text from pages",
        "keyword_scores": f"with r as ({render.rendered_sql()}) select doc_id, document_type, weighted, matches, round_even(confidence, 2) as confidence from ({_keywords()}) where weighted > 0",
        "structure_scores": f"with r as ({render.rendered_sql()}) {_structure()}",
        "classify_vote": f"{_vote()} select doc_id, document_type, name_en, round_even(confidence, 4) as confidence, method, keyword_matches from c",
        "all_scores": _all_scores(),
        "type_report": f"{_report()} select * from p",
        "type_counts": f"{_report()} select type_en, count(*) as n, min(file_name) as first_seen from p group by type_en",
        "status_counts": f"{_report()} select count(*) filter (status = 'success') as ok, count(*) filter (status <> 'success') as failed from p",
        "line_similarity": _similarity(),
        "pick_best_line": _best_line(),
        "consensus_merge": merged(DOCUMENTS),
        "service_extract": _service(),
        "full_pipeline": _full(),
        "strip_scripts": f"select doc_id, {_scripts('text')} as clean from ({noisy('scripts')})",
        "strip_hallucinations": f"select doc_id, {_talk('text')} as clean from ({noisy('talk')})",
        "number_formats": f"select doc_id, {_artifacts('text')} as artifacts, {_numbers('text')} as numbers from ({noisy('numbers')})",
        "repetition_corpus": f"select a.doc_id, a.runs, b.near, c.loops from ({_runs(runs, 'runs')}) a join ({_near(runs, 'near')}) b using (doc_id) join ({_loops(runs, 'loops')}) c using (doc_id)",
        "normalize_variants": f"select doc_id, {_norm('text')} as plain, {_norm('text', True)} as matching, {_norm('text', True, True)} as classes, {_normal_arabic('text')} as output from ({noisy('normal')})",
        "arabic_corrections": f"select doc_id, {_in_turn('text', ARABIC_CORRECTIONS, True)} as fixed from ({noisy('arabic')})",
        "english_corrections": f"select doc_id, {english} as fixed from ({noisy('english')})",
        "changed_characters": f"select doc_id, len(list_filter(range(1, least(length(text), length(fixed)) + 1), lambda i: a[i] <> b[i])) as n from (select doc_id, text, fixed, string_split(text, '') as a, string_split(fixed, '') as b from (select doc_id, text, {english} as fixed from ({noisy('english')})))",
        "field_digits": f"select doc_id, text as digits from ({_digits(noisy('detached'))})",
        "arabic_patterns": f"select doc_id, {_patterns('text')} as patterns, {_doubled('text')} as doubled, {_normal_arabic('text')} as punctuation from ({noisy('detached')})",
        "swift_fix": f"select doc_id, {_swift('text')} as fixed from ({noisy('swift')})",
        "clean_text": cleaned(noisy(*render.MIXED)),
        "parse_json_response": _answers(),
        "broken_answers": _recovered(),
        "recovery_counts": f"select how, reason, count(*) as n from (select how, unnest(string_split(reasons, ',')) as reason from ({_recovered()})) group by how, reason",
        "page_steps": _pages(),
        "date_swap": f"select doc_id, nullif(regexp_replace(text, '^(\\d{{1,2}})([/-])(\\d{{1,2}})([/-])(\\d{{2,4}})$', '\\3\\2\\1\\4\\5'), text) as swapped from ({render.of_orders_sql(render.DATES)})",
        "file_filter": f"select doc_id, text as path, regexp_extract(text, '([^/]*)$', 1) as file_name from ({render.of_orders_sql(render.PATHS)}) where regexp_matches(lower(text), '[^/]\\.(jpg|jpeg|png|bmp|tiff|tif|pdf)$')",
        "cross_validate_json": "select o_orderkey, d as invoice_date, d as due_date, null::varchar as ref from (select o_orderkey, '0' || (o_orderkey % 9 + 1) || '/1' || (o_orderkey % 3) || '/2004' as d from orders)",
    }
