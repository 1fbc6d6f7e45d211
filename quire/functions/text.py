"""Text expressions with the lengths and white space of a UTF-16 world.

Lengths count UTF-16 units; white space is the Unicode set, which neither trim() nor Java's \\s knows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends words and collapses to one space.
WS = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: What trimming takes from both ends: U+0085 besides.
TRIMMED = WS[:-1] + "\\u0085]"
NON_LATIN = "[\\u0400-\\u04FF\\u0600-\\u06FF\\u3040-\\u30FF\\u3400-\\u9FFF\\uAC00-\\uD7AF]"
#: Characters of two UTF-16 units.
ASTRAL = "[\\x{10000}-\\x{10FFFF}]"
ENGLISH_WORD = "[A-Za-z][A-Za-z'-]*"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf16_len(x: Column | str) -> Column:
    """Length in UTF-16 units: the code points, and once more those beyond the basic plane."""
    x = _col(x)
    return F.char_length(x) + F.regexp_count(x, F.lit(ASTRAL))


def uni_trim(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), f"^{TRIMMED}+|{TRIMMED}+$", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return uni_trim(F.regexp_replace(_col(x), f"{WS}+", " "))


def cut_units(x: Column | str, n: int) -> Column:
    """The first n UTF-16 units; a character of two units that would be parted is left out."""
    start = F.substring(_col(x), 1, n)
    # a second character after each one of two units makes code points count as units
    doubled = F.substring(F.regexp_replace(start, f"({ASTRAL})", "$1\uFFFF"), 1, n)
    parted = F.regexp_replace(doubled, f"{ASTRAL}$", "")
    return F.when(F.regexp_count(start, F.lit(ASTRAL)) == 0, start).otherwise(F.regexp_replace(parted, f"({ASTRAL})\uFFFF", "$1"))


def shorten(x: Column | str, n: int) -> Column:
    """Beyond n, cut to n with three dots."""
    x = _col(x)
    return F.when(utf16_len(x) <= n, x).otherwise(F.concat(cut_units(x, n - 3), F.lit("...")))


def ellipsis(x: Column | str, n: int) -> Column:
    """Collapsed; beyond n, cut to n with three dots."""
    return shorten(collapse(x), n)


def strip_tags(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), "<[^>]+>", " ")


def english_words(x: Column | str) -> Column:
    return F.regexp_count(_col(x), F.lit(ENGLISH_WORD))


def non_latin_chars(x: Column | str) -> Column:
    return F.regexp_count(_col(x), F.lit(NON_LATIN))


def longest_english_run(x: Column | str) -> Column:
    """Most English words in a row; a character of another script ends a run, digits and signs don't."""
    runs = F.split(_col(x), NON_LATIN)
    return F.array_max(F.transform(runs, english_words))


#: Names and codes of languages in which text in the source's script is suspicious.
RESIDUAL_LANGUAGES = tuple("zh chinese 中文 汉语 漢語 ja japanese 日本語 日语 日語 ko korean 한국어 韩语 韓語 ru russian русский 俄语 俄語 ar arabic العربية 阿拉伯语 阿拉伯語".split())


def checks_residual(language: Column | str) -> Column:
    """Whether text in the source's script is suspicious in this target language (by substring)."""
    return F.lower(uni_trim(language)).rlike("|".join(RESIDUAL_LANGUAGES))


def residual_counts(source: Column | str, translated: Column | str) -> Column:
    """What the residual rule counts, once for each pair: a struct of source_words, words, letters, others and run."""
    text = collapse(translated)
    return F.struct(
        english_words(source).alias("source_words"), english_words(text).alias("words"), F.regexp_count(text, F.lit("[A-Za-z]")).alias("letters"), non_latin_chars(text).alias("others"), longest_english_run(text).alias("run")
    )


def suspicious_counts(counts: Column, language: Column | str) -> Column:
    """The residual rule over residual_counts()."""
    letters, others = counts["letters"], counts["others"]
    share = F.coalesce(F.try_divide(letters, letters + others), F.lit(0.0))
    left = (counts["run"] >= 7) | ((letters >= 40) & (others == 0)) | ((counts["words"] >= 10) & (share >= 0.65))
    return checks_residual(language) & (counts["source_words"] >= 6) & (counts["words"] >= 7) & left


def suspicious_residual(source: Column | str, translated: Column | str, language: Column | str) -> Column:
    """Whether a translation seems to have kept its source's words."""
    return suspicious_counts(residual_counts(source, translated), language)


def keeps_source(source: str, translated: str, language: str) -> bool:
    """suspicious_residual() of one pair, for a task that translates."""
    if not any(name in language.strip().lower() for name in RESIDUAL_LANGUAGES):
        return False
    words = lambda t: len(re.findall(ENGLISH_WORD, t))
    n, letters, others = words(translated), len(re.findall("[A-Za-z]", translated)), len(re.findall(NON_LATIN, translated))
    if words(source) < 6 or n < 7:
        return False
    run = max(map(words, re.split(NON_LATIN, translated)))
    return run >= 7 or (letters >= 40 and not others) or (n >= 10 and letters >= 0.65 * (letters + others))


def _compact(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), f"{WS}+", "")


def _within(x: Column, most: int) -> Column:
    return (utf16_len(x) > 0) & (utf16_len(x) <= most)


BRACKETED = "^[\\[\\(（【].+[\\]\\)）】]$"


def extractor_pagebreak(x: Column | str) -> Column:
    """Page numbers, as block extraction knows them."""
    c = _compact(x)
    return _within(c, 12) & (c.rlike("^\\d{1,4}[a-zA-Z]?$") | c.rlike("(?i)^[ivxlcdm]+$"))


def extractor_marker(x: Column | str) -> Column:
    """Note markers, as block extraction knows them."""
    c = _compact(x)
    return _within(c, 10) & (c.rlike(BRACKETED) | c.rlike("^\\d{1,3}$") | c.rlike("^[a-zA-Z]$"))


def protected_marker(x: Column | str) -> Column:
    """Note markers that a translation must keep."""
    c = _compact(x)
    return _within(c, 10) & (c.rlike(BRACKETED) | c.rlike("^[0-9]+[.)]?$") | c.rlike("^[*†‡§¶]+$") | (c == "↩"))


def protected_pagebreak(x: Column | str) -> Column:
    """Page numbers that a translation must keep."""
    c = _compact(x)
    return _within(c, 12) & (protected_marker(x) | c.rlike("^[0-9]+$") | c.rlike("^[ivxlcdmIVXLCDM]+$"))


def token_set(x: Column | str) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_col(x), F.lit(""))), f"{WS}+"), lambda t: t != ""))


def redact(x: Column | str, key: str | None = None) -> Column:
    """Without configured keys, bearer tokens, api keys and sk- secrets."""
    x = _col(x)
    if key and key.strip():
        x = F.replace(x, F.lit(key.strip()), F.lit("[redacted]"))
    x = F.regexp_replace(x, "(?i)(Authorization\\s*[:=]\\s*Bearer\\s+)[^\\s,\\}\\]]+", "$1[redacted]")
    x = F.regexp_replace(x, "(?i)(api[_-]?key\\s*[:=]\\s*)[^\\s,\\}\\]]+", "$1[redacted]")
    return F.regexp_replace(x, "\\bsk-[A-Za-z0-9_\\-]{8,}\\b", "sk-[redacted]")


def sanitize_suffix(x: Column | str, most: int = 80, otherwise: str = "_translated") -> Column:
    """A part of a file name that is safe on all systems."""
    clean = collapse(F.regexp_replace(_col(x), "[\\\\/:*?\"<>|\\x00-\\x1F]", "_"))
    clean = F.regexp_replace(F.regexp_replace(clean, "[. ]+$", ""), "^\\.+", "")
    short = F.when(utf16_len(clean) > most, F.regexp_replace(cut_units(clean, most), "[. ]+$", "")).otherwise(clean)
    return F.when(short == "", otherwise).otherwise(short)


def sanitize_secret_name(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), "[^A-Za-z0-9_.-]", "_")


def sanitize_file_name(x: Column | str, otherwise: str = "translated.epub") -> Column:
    clean = uni_trim(F.regexp_replace(_col(x), "[\\\\/:*?\"<>|]", "_"))
    return F.when(clean == "", otherwise).otherwise(clean)
