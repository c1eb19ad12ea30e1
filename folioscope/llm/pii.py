"""Operator 1: format-preserving pseudonyms by keyed Feistel networks, with DataFrame functions only.

Values that pass their kind's check are replaced by another valid value of the same format, by a permutation of all
values of that format under the key: equal values get equal pseudonyms in every document, different ones different pseudonyms.

    email   letters and digits of the local part, each class as one value of any length; dots and the domain stay. Labels are
            names' labels: of 63 characters at most and 127 of them, else what follows the @ is no domain
    iban    digits of the account part; letters stay, check digits are computed anew (mod 97)
    ip      IPv4 addresses, as 2 x 16 bits
    date    calendar dates of 1900 to 2099: year first, or day and month first (`day_first`; a date that is valid only in
            the other order keeps to days over 12); the separator and leading zeros stay
    ssn     area, group and serial of valid social security numbers
    phone   North American numbers with separators or +1: area, exchange and line; other numbers with +, and those with +1 whose area or
            exchange can't be one: all but the first digit
    card    13 to 19 digits with a valid Luhn digit: all between the first and the check digit, which is computed anew

A permutation may leave a value as it is (about once in as many values as the format has). A number that fails its
check stays. Null texts stay null; empty texts, repeated rows and columns of other names pass unchanged. Every row is
worked on by itself, without a shuffle. Time is in proportion to a value's length but for a sort of its characters, and no
pattern repeats a group without a bound, as the matcher's stack grows with each turn of a group. The key has no default: who knows it can undo the pseudonyms.
It is a literal of the plan (and of the event log), so pass one that is derived for the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let

ROUNDS = 8
FIRST_YEAR, YEARS = 1900, 200
#: Dates of 1900 to 2099 are 319 x 229 days.
DAY_RADIX = (319, 229)

_EDGE, _END = r"(?<![\w.+-])", r"(?![\w])"
#: Alternatives in order of precedence; each is also matched alone to tell a match's kind.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,}",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": _EDGE + r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})" + _END,
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "phone": r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]?\d{4}|\+1[2-9]\d{2}[2-9]\d{6}|\+[1-9](?:[ .-]?\(?\d{1,4}\)?){2,6})" + _END,
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}" + _END,
}
KINDS = tuple(PATTERNS)


def _combined() -> str:
    """All alternatives; the date's back references move with the groups before them (none)."""
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def _prf(key: str, tweak: str, turn: Column, x: Column) -> Column:
    """60 bits that depend on the key, the format, the round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), x.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, tweak: str) -> Column:
    """Struct (l, r): a permutation of pairs with l under a and r under b. a and b may depend on the value's format."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def turn(s: Column, i: Column) -> Column:
        even = (s["l"] + _prf(key, tweak, i, s["r"]) % a) % a
        odd = (s["r"] + _prf(key, tweak, i, s["l"]) % b) % b
        return F.struct(F.when(i % 2 == 0, even).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, odd).otherwise(s["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def feistel_int(x: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A permutation of the integers under a * b."""
    return let(feistel(F.floor(x / b), x % b, a, b, key, tweak), lambda s: s["l"] * b + s["r"])


def feistel_digits(digits: Column, key: str, tweak: str) -> Column:
    """A permutation of the strings of as many decimal digits, up to 36."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("long")
    half = lambda s: F.coalesce(F.nullif(s, F.lit("")), F.lit("0")).cast("long")

    def whole(d: Column) -> Column:
        pair = feistel(half(F.substring(d, F.lit(1), u)), half(F.substring(d, u + 1, n)), power(u), power(n - u), key, tweak)
        return let(F.struct(pair.alias("p")), lambda s: F.concat(F.when(u > 0, F.lpad(s["p"]["l"].cast("string"), u, "0")).otherwise(""), F.lpad(s["p"]["r"].cast("string"), n - u, "0")))

    return F.when(n > 0, let(digits, whole)).otherwise("")


def feistel_string(text: Column, key: str, tweak: str, letters: bool = False) -> Column:
    """A permutation of the strings of as many decimal digits, or letters a-z, of any length.

    The halves take turns: to each piece of one half is added, within the strings of its length, what key, round, piece number and the whole
    other half give. So every character depends on all others.
    """
    az, inner = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
    base, most, pattern = (26, 11, "[a-z]{1,11}") if letters else (10, 15, "[0-9]{1,15}")
    powers = F.array(*(F.lit(base**i) for i in range(1, most + 1)))
    number = (lambda c: F.conv(F.translate(c, az, inner), 26, 10).cast("long")) if letters else (lambda c: c.cast("long"))
    written = (lambda x: F.translate(F.lower(F.conv(x.cast("string"), 10, 26)), inner, az)) if letters else (lambda x: x.cast("string"))
    zero = az[0] if letters else "0"

    def moved(half: Column, digest: Column) -> Column:
        def piece(c: Column, j: Column) -> Column:
            m = F.element_at(powers, F.length(c))
            drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", digest, j.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")
            return F.lpad(written((number(c) + drawn % m) % m), F.length(c), zero)

        return F.array_join(F.transform(F.regexp_extract_all(half, F.lit(pattern), F.lit(0)), piece), "")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), F.when(even, s["r"]).otherwise(s["l"])).cast("binary"), 256)
        new = let(digest, lambda d: moved(F.when(even, s["l"]).otherwise(s["r"]), d))
        return let(new, lambda x: F.struct(F.when(even, x).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(x).alias("r")))

    u = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), u).alias("l"), F.substring(text, u + 1, F.length(text)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def weave(template: Column, digits: Column, letters: Column | None = None) -> Column:
    """template with its digits, and its letters in their case, replaced in turn; a character too many stays."""
    chars = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))

    def of(s: Column) -> Column:
        placed = lambda pattern, new: F.transform(F.filter(s["all"], lambda x: x["c"].rlike(pattern)), new)
        made = lambda x, c: F.struct(x["at"].alias("at"), c.alias("c"))
        parts = [placed("[0-9]", lambda x, k: made(x, F.coalesce(F.get(s["digits"], k), x["c"])))]
        if letters is None:
            parts.append(placed("[^0-9]", lambda x: x))
        else:
            new = lambda x, k: F.coalesce(F.get(s["letters"], k), x["c"])
            parts.append(placed("[A-Za-z]", lambda x, k: made(x, F.when(x["c"].rlike("[A-Z]"), F.upper(new(x, k))).otherwise(new(x, k)))))
            parts.append(placed("[^0-9A-Za-z]", lambda x: x))
        return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: x["c"]), "")

    every = F.transform(chars(template), lambda c, i: F.struct(i.alias("at"), c.alias("c")))
    return let(F.struct(every.alias("all"), chars(digits).alias("digits"), *([chars(letters).alias("letters")] if letters is not None else [])), of)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_sum(body: Column) -> Column:
    """Sum over digits to the left of the check digit; every second one from the right counts double."""
    n = F.length(body)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _luhn_digit(body: Column) -> Column:
    return ((10 - _luhn_sum(body) % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        body, check = F.substring(d, F.lit(1), n - 1), F.substring(d, n, F.lit(1))
        new = F.concat(F.substring(d, 1, 1), feistel_digits(F.substring(d, F.lit(2), n - 2), key, "card"))
        return F.when(_luhn_digit(body) == check, let(new, lambda b: weave(m, F.concat(b, _luhn_digit(b)))))

    return let(_digits(m), of)


def _mod97(s: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.regexp_extract_all(s, F.lit("."), F.lit(0)), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def of(s: Column) -> Column:
        rest = F.substring(s, F.lit(5), F.length(s))
        valid = (_mod97(F.concat(rest, F.substring(s, 1, 4))) == 1) & F.length(s).between(15, 34)
        new = weave(rest, feistel_digits(_digits(rest), key, "iban"))
        check = lambda r: F.lpad((98 - _mod97(F.concat(r, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.when(valid, let(new, lambda r: weave(m, F.concat(check(r), _digits(r)))))

    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def _ip(m: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        n = F.transform(p, lambda x: x.cast("int"))
        valid = F.forall(p, lambda x: ~x.rlike("^0.") & (x.cast("int") < 256))
        at = lambda i: F.element_at(n, i)
        pair = feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), 65536, 65536, key, "ip")
        return F.when(valid, let(pair, lambda s: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)))))

    return let(F.split(m, r"\."), of)


def _date(m: Column, key: str, day_first: bool) -> Column:
    epoch = F.to_date(F.lit(f"{FIRST_YEAR}-01-01"))
    late = [f"{mo:02d}{d}" for mo in range(1, 13) for d in (29, 30, 31) if d <= (31 if mo in (1, 3, 5, 7, 8, 10, 12) else 30) and mo != 2]
    number = lambda s: s.cast("int")
    made = lambda y, mo, d: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")

    def of(s: Column) -> Column:
        p, sep = s["p"], s["sep"]
        iso = F.length(F.element_at(p, 1)) == 4
        first, second, third = (number(F.element_at(p, i)) for i in (1, 2, 3))
        year = F.when(iso, first).otherwise(third)
        usual = F.when(iso, made(year, second, third)).otherwise(made(year, second, first) if day_first else made(year, first, second))
        other = F.when(~iso, made(year, first, second) if day_first else made(year, second, first))
        wide = F.forall(p, lambda x: F.length(x) >= 2)
        two = lambda x: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        written = lambda d, swap: F.when(iso, F.concat(F.year(d).cast("string"), sep, two(F.month(d)), sep, two(F.day(d)))).otherwise(F.concat(*((two(F.month(d)), sep, two(F.day(d))) if swap else (two(F.day(d)), sep, two(F.month(d)))), sep, F.year(d).cast("string")))
        in_range = lambda d: d.isNotNull() & F.year(d).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
        moved = F.date_add(epoch, feistel_int(F.datediff(usual, epoch).cast("long"), *DAY_RADIX, key, "date").cast("int"))
        # the other order alone is valid, so the day is over 12 and stays so: 13 to 28, other days, leap days
        y, mo, d = F.year(other) - FIRST_YEAR, F.month(other), F.day(other)
        days = feistel_int((y * 192 + (mo - 1) * 16 + d - 13).cast("long"), YEARS, 192, key, "date13")
        ends = F.array(*(F.lit(x) for x in late))
        last = feistel_int((y * len(late) + F.array_position(ends, F.concat(F.lpad(mo.cast("string"), 2, "0"), d.cast("string"))) - 1).cast("long"), YEARS, len(late), key, "date29")
        leap = feistel_int(F.floor((y - 4) / 4).cast("long"), 7, 7, key, "leap")
        moved_other = (
            F.when(d <= 28, let(days, lambda x: made((F.floor(x / 192) + FIRST_YEAR).cast("int"), (F.floor(x % 192 / 16) + 1).cast("int"), (x % 16 + 13).cast("int"))))
            .when(mo == 2, let(leap, lambda x: made((x * 4 + FIRST_YEAR + 4).cast("int"), F.lit(2), F.lit(29))))
            .otherwise(let(last, lambda x: let(F.element_at(ends, (x % len(late) + 1).cast("int")), lambda e: made((F.floor(x / len(late)) + FIRST_YEAR).cast("int"), number(F.substring(e, 1, 2)), number(F.substring(e, 3, 2))))))
        )
        return F.when(in_range(usual), let(moved, lambda x: written(x, not day_first))).when(usual.isNull() & in_range(other), let(moved_other, lambda x: written(x, day_first)))

    return let(F.struct(F.split(m, "[-/.]").alias("p"), F.regexp_extract(m, "[-/.]", 0).alias("sep")), of)


def _ssn(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        area, group, serial = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        slot = area - 1 - (area > 666).cast("int")  # 898 areas
        pair = feistel(slot * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

        def back(s: Column) -> Column:
            k = F.floor(s["l"] / 99) + 1
            return F.concat(F.lpad((k + (k >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

        return F.when(valid, let(pair, lambda s: weave(m, back(s))))

    return let(_digits(m), of)


def _phone(m: Column, key: str) -> Column:
    north = (F.length(_digits(m)) == 10) & ~m.startswith("+") | (F.length(_digits(m)) == 11) & m.rlike(r"^\+?1")

    def nanp(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        area, exchange, line = (F.substring(ten, a, n).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
        pair = feistel((area - 200) * 800 + exchange - 200, line, 640_000, 10_000, key, "nanp")
        new = lambda s: F.concat(F.when(F.length(d) == 11, "1").otherwise(""), (F.floor(s["l"] / 800) + 200).cast("string"), (s["l"] % 800 + 200).cast("string"), F.lpad(s["r"].cast("string"), 4, "0"))
        return F.when((area > 199) & (exchange > 199), let(pair, lambda s: weave(m, new(s))))

    def other(d: Column) -> Column:
        return F.when(F.length(d).between(8, 15), weave(m, F.concat(F.substring(d, 1, 1), feistel_digits(F.substring(d, F.lit(2), F.length(d)), key, "phone"))))

    # a number with +1 that can't be North American still is a number with +
    return F.coalesce(F.when(north, let(_digits(m), nanp)), F.when(m.startswith("+"), let(_digits(m), other)))


def _email(m: Column, key: str) -> Column:
    def of(s: Column) -> Column:
        letters = F.lower(F.regexp_replace(s, "[^A-Za-z]", ""))
        return F.concat(weave(s, feistel_string(_digits(s), key, "email"), feistel_string(letters, key, "email", letters=True)), F.substring(m, F.length(s) + 1, F.length(m)))

    return let(F.substring_index(m, "@", 1), of)


def _replaced(m: Column, key: str, day_first: bool) -> Column:
    """Struct (kind, out) of one match; kind is null if no check holds."""
    ways = {"email": _email(m, key), "iban": _iban(m, key), "ip": _ip(m, key), "date": _date(m, key, day_first), "ssn": _ssn(m, key), "phone": _phone(m, key), "card": _card(m, key)}

    def found(kind: str) -> Column:
        return F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), let(ways[kind], lambda x: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), x.alias("out")))))

    # a number that fails as one kind may hold as a later one
    return F.coalesce(*(found(kind) for kind in KINDS), F.struct(F.lit(None).cast("string").alias("kind"), m.alias("out")))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", day_first: bool = True, counts: bool = True) -> DataFrame:
    """docs with text_col pseudonymized, and with counts of replaced values n_<kind> (long) if asked for, in place of columns of that name."""
    pattern = F.lit(_combined())
    text = F.col(text_col).cast("string")
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: _replaced(m, key, day_first))
    held = F.when(text.rlike("[0-9@]"), hits)
    names = [c for c in docs.columns if not counts or c not in {f"n_{k}" for k in KINDS}]
    rows = docs.select(F.struct(*(F.col(c) for c in names)).alias("row"), text.alias("_text"), held.alias("_pii"))
    text, own = F.col("_text"), F.col("row")
    gaps = F.split(text, _combined(), -1)
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), F.col("_pii.out").alias("hit")), lambda x: F.array(x["gap"], F.coalesce(x["hit"], F.lit(""))))), "")
    changed = F.exists("_pii", lambda x: x["kind"].isNotNull())
    columns = [F.when(changed, joined).otherwise(text).alias(c) if c == text_col else own[c].alias(c) for c in names]
    if counts:
        columns += [F.coalesce(F.size(F.filter(F.col("_pii.kind"), _is(k))), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(*columns)
