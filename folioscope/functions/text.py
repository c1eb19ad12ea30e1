"""Column functions for text: white space, regular expressions, normal forms, similarity."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() knows it, inside a class of a (?U) expression.
SPACE = r"\s\x1c-\x1f"
#: The same characters, to be trimmed.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ARABIC = r"؀-ۿ"
#: Combining marks that normal forms drop.
MARKS = r"[ؗ-ًؚ-ْ]"
FOLD_FROM, FOLD_TO = "أإآةى", "اااهي"
HAMZA_FROM, HAMZA_TO = "ؤئ", "وي"
TATWEEL = "ـ"


def rx(pattern: str, flags: str = "") -> str:
    """A pattern with Unicode classes and \\n as the only line end."""
    return f"(?Ud{flags}){pattern}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sub(text: Column, pattern: str, new: str, flags: str = "") -> Column:
    return F.regexp_replace(text, F.lit(rx(pattern, flags)), F.lit(new))


def has(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def count(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(rx(pattern, flags)))


def count_chars(text: Column, some: str) -> Column:
    """How many characters are of the class (what stands in its brackets)."""
    # in ASCII the classes are the same without Unicode's, and faster
    rest = lambda t: F.when(plain(t), F.regexp_replace(t, f"[{some}]+", "")).otherwise(sub(t, f"[{some}]+", ""))
    return F.length(text) - F.length(rest(text))


def plain(text: Column) -> Column:
    """Is the text all ASCII?"""
    return F.octet_length(text) == F.length(text)


def holds_any(text: Column, *words: str) -> Column:
    """Does the text hold any of the strings?"""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def where(text: Column, sign: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """step(text) where the sign holds, a cheap test without which the step can't change anything; the text itself elsewhere."""
    return let(text, lambda t: F.when(sign(t), step(t)).otherwise(t))


def where_bound(text: Column, sign: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """where() of a text that is a column or bound already: each binding within another takes the analyzer a round, and it has but a hundred."""
    return F.when(sign(text), step(text)).otherwise(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rare_space(text: Column) -> Column:
    """A cheap test without which a text holds no white space but spaces and line ends."""
    return text.rlike(r"[\t\x0b-\r\x1c-\x1f]") | ~plain(text) & text.rlike(r"[\x80-\xa0\u1680\u2000-\u3000]")


def squeeze(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return strip(let(text, lambda t: F.when(rare_space(t), sub(t, r"\s{2,}|[\s&&[^ ]]", " ")).otherwise(F.regexp_replace(t, r"[ \n]{2,}|\n", " "))))


def split_words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    words = lambda t: F.when(rare_space(t), F.split(t, rx(f"[{SPACE}]+"), -1)).otherwise(F.split(t, "[ \\n]+", -1))
    return F.filter(let(text, words), lambda w: F.length(w) > 0)


def strings(values: list[str]) -> Column:
    """A constant array of strings, as one expression however many they are."""
    return F.split(F.lit("\x01".join(values)), "\x01", -1)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def filled_lines(text: Column) -> Column:
    """Stripped lines that aren't empty."""

    def of(t: Column) -> Column:
        # once the text's ends are stripped, lines are too unless white space stands beside a line end
        loose = rare_space(t) | holds_any(t, " \n", "\n ")
        return F.filter(F.when(loose, F.transform(split_lines(t), strip)).otherwise(split_lines(t)), lambda x: F.length(x) > 0)

    return let(strip(text), of)


def normal_form(text: Column, hamza: bool = False, tatweel: bool = False) -> Column:
    """Lower case without marks, with letter variants folded and white space squeezed.

    hamza folds carriers too; tatweel drops it. The defaults are for comparing lines and prefixes, hamza is for aligning
    lines, both are for classification.
    """
    return squeeze(fold(text, hamza, tatweel))


def fold(text: Column, hamza: bool = False, tatweel: bool = False) -> Column:
    """normal_form() before white space is squeezed; line ends stay, so it can be had of all lines at once."""
    low = F.lower(text)
    # what has no counterpart goes
    old, new = FOLD_FROM + (HAMZA_FROM if hamza else "") + (TATWEEL if tatweel else ""), FOLD_TO + (HAMZA_TO if hamza else "")
    folded = F.regexp_replace(low, MARKS, "")
    for i, c in enumerate(old):
        folded = F.replace(folded, F.lit(c), F.lit(new[i : i + 1]))
    return F.when(plain(text) | ~text.rlike(f"[{ARABIC}]"), low).otherwise(folded)


def normal_text(s: str) -> str:
    """normal_form(hamza=True, tatweel=True) of a constant."""
    s = re.sub(MARKS, "", s.lower()).translate(str.maketrans(FOLD_FROM + HAMZA_FROM, FOLD_TO + HAMZA_TO, TATWEEL))
    return " ".join(s.split())


def trie(words: list[str]) -> str:
    """An expression that matches where any of the words does, branching by character."""
    out, ends = [], "" in words
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    if ends:
        return ""  # a shorter word that matches is enough
    for c, rest in heads.items():
        q = c if c.isalnum() else f"\\x{{{ord(c):x}}}"
        inner = trie(rest)
        out.append(q + (f"(?:{inner})" if "|" in inner else inner))
    return "|".join(out)


def dispatch(words: list[str], most: int = 5) -> str:
    """trie() with its first branches in groups of `most`, each behind a look at the first character, so that few are tried at a place."""
    heads = sorted({w[0] for w in words})
    groups = [heads[i : i + most] for i in range(0, len(heads), most)]
    code = lambda c: f"\\x{{{ord(c):x}}}"
    return "|".join(f"(?=[{''.join(map(code, g))}])(?:{trie([w for w in words if w[0] in g])})" for g in groups)


def char_classes(text: Column) -> dict[str, Column]:
    """Letters of the Arabic block, Latin letters, digits."""
    return {"arabic_chars": arabic_chars(text), "english_chars": count_chars(text, "a-zA-Z"), "digit_chars": count_chars(text, r"\d")}


def arabic_chars(text: Column) -> Column:
    return F.when(plain(text), F.length(text) - F.length(text)).otherwise(count_chars(text, ARABIC))


def round_half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def bigrams(s: Column) -> Column:
    n = F.length(s)
    pairs = F.regexp_extract_all(s, F.lit(r"(?s)(?=(..))"), F.lit(1))
    return F.array_distinct(F.when(n >= 2, pairs).otherwise(F.array(s)))


def similarity(a: Column, b: Column) -> Column:
    """Of two lines in normal form: 0.35 Dice of bigrams, 0.45 Jaccard of words, 0.2 ratio of lengths; 0 if either is empty."""

    def both(x: Column) -> Column:
        dice = 2.0 * F.size(F.array_intersect(x["ga"], x["gb"])) / (F.size(x["ga"]) + F.size(x["gb"]))
        union = F.size(F.array_union(x["wa"], x["wb"]))
        words = F.when(union > 0, F.size(F.array_intersect(x["wa"], x["wb"])) / union).otherwise(0.0)
        lengths = F.least(x["na"], x["nb"]) / F.greatest(x["na"], x["nb"], F.lit(1))
        return 0.35 * dice + 0.45 * words + 0.20 * lengths

    parts = F.struct(bigrams(a).alias("ga"), bigrams(b).alias("gb"), split_words(a).alias("wa"), split_words(b).alias("wb"), F.length(a).alias("na"), F.length(b).alias("nb"))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(let(parts, both))


