"""Text functions as Column expressions; all run inside the JVM unless said otherwise."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}\p{M}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, and those letters; đ by hand, as it does not decompose."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in range(0xC0, min(0x2000, sys.maxunicode)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


@F.udf(StringType(), useArrow=True)
def nfc(text: str | None) -> str | None:
    """Canonical composition; Spark has no such function."""
    return None if text is None else unicodedata.normalize("NFC", text)


@F.udf(StringType(), useArrow=True)
def nfd(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFD", text)


@F.udf(StringType(), useArrow=True)
def nfkd(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKD", text)


def fold(x: Column | str) -> Column:
    """Lower case, with the one common letter whose folding is longer."""
    return F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))


def match_key(x: Column | str) -> Column:
    """Words of letters and digits, composed and in folded case, joined by one space."""
    return F.array_join(F.regexp_extract_all(fold(nfc(_c(x))), F.lit(WORD), F.lit(0)), " ")


def no_accents(x: Column | str) -> Column:
    return F.regexp_replace(F.translate(_c(x), *_bases()), r"\p{M}+", "")


def plain_letters(text: str) -> str:
    """no_accents() of a constant."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).translate({0x111: "d", 0x110: "D"})


def accentless_key(x: Column | str) -> Column:
    return no_accents(match_key(x))


def heading_key(x: Column | str) -> Column:
    """A heading without case, accents and leading numbering such as `2.`, `II.`, `1.3)`."""
    low = F.trim(no_accents(fold(nfkd(_c(x)))))
    bare = F.regexp_replace(low, r"^((?:\d+(?:\.\d+)*|[ivxlc]+|[a-h])[.):\-]+\s*|\d+(?:\.\d+)*\s+)", "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def slug(x: Column | str, default: str = "uncategorised", joint: str = "_", most: int | None = None) -> Column:
    s = F.regexp_replace(F.regexp_replace(no_accents(fold(x)), r"[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")
    s = F.substring(s, 1, most) if most else s
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def compact_key(x: Column | str) -> Column:
    return F.regexp_replace(no_accents(fold(x)), r"[^a-z0-9]+", "")


def flat(x: Column | str) -> Column:
    """White space, no-break spaces included, as single spaces."""
    return F.trim(F.regexp_replace(_c(x), r"[\s\u00a0]+", " "))


def checksum(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", *(_c(p) for p in parts)), 256)


def pair_fingerprint(question: Column | str, answer: Column | str) -> Column:
    """Of a question and its answer, blind to case and white space."""
    return checksum(fold(flat(F.coalesce(_c(question), F.lit("")))), fold(flat(F.coalesce(_c(answer), F.lit("")))))


def file_name(x: Column | str, most: int = 150) -> Column:
    """Without characters that file systems refuse."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(_c(x), r'[\\/*?:"<>|\r\n\t]+', " "), r"\s+", " ")), 1, most)


def chunks(x: Column | str, size: int) -> Column:
    """Consecutive pieces of size characters."""
    n = F.ceil(F.length(_c(x)) / size).cast("int")
    return F.when(F.length(_c(x)) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(_c(x), i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def markup_safe(x: Column | str) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], _c(x))


def year_in(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"(?:^|\D)(20\d{2})(?:\D|$)", 1), F.lit("")).cast("int")


def email(x: Column | str) -> Column:
    """Lower case and trimmed; null where it is no address."""
    low = F.lower(F.trim(_c(x)))
    return F.when(low.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), low)


def all_capitals(x: Column | str) -> Column:
    letters = F.regexp_replace(_c(x), r"[^\p{L}]", "")
    return (F.length(letters) > 0) & (letters == F.upper(letters))


def aliases_of(name: Column | str) -> Column:
    """A term, the term without parentheses, and with both kinds of name for a tumour."""
    bare = flat(F.regexp_replace(_c(name), r"\s*\([^()]*\)", " "))
    other = F.regexp_replace(bare, "(?i)^u ác(?: của)? ", "ung thư ")
    return F.array_distinct(F.filter(F.array(flat(name), bare, other), lambda a: F.length(a) > 0))


def clean_layout_text(x: Column | str) -> Column:
    """Text out of a page layout: control characters, space before punctuation, words parted at line ends, broken digit groups and slashes."""
    steps = [
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "),
        (r"\u00a0", " "),
        (r"(?<=\p{L})-\s*\n\s*(?=\p{Ll})", ""),
        (r"[ \t]+", " "),
        (r" +([,.;:!?%)\]])", "$1"),
        (r"([(\[]) +", "$1"),
        (r"(?<=\d)([.,]) +(?=\d{3}\b)", "$1"),
        (r" */ *", "/"),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, _c(x)))


def reflow(x: Column | str) -> Column:
    """Lines joined into paragraphs: a line ends one if it ends a sentence, or the next begins a list or is blank."""
    lines = F.transform(F.split(_c(x), "\n"), lambda p: F.trim(p))
    ends = lambda p: p.rlike(r"[.!?:…]$")
    listed = lambda p: p.rlike(r"^([-•*+]|\d+[.)])\s")
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, p: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.when(last(a).rlike(r"\p{L}-$"), F.concat(F.regexp_replace(last(a), "-$", ""), p)).otherwise(F.concat_ws(" ", last(a), p))))
    fresh = lambda a, p: (F.size(a) == 0) | (last(a) == "") | (p == "") | listed(p) | ends(last(a))
    folded = F.aggregate(lines, F.array().cast("array<string>"), lambda a, p: F.when(fresh(a, p), F.array_append(a, p)).otherwise(joined(a, p)))
    return F.array_join(F.filter(folded, lambda p: p != ""), "\n")


#: Lines of a journal's frame, and lines that say how to reach someone; on text without accents and case.
BOILERPLATE = r"^\d{1,4}$|^(trang|page)\s*\d+|issn|\bdoi\b|^(ngay nhan bai|ngay duyet|received|accepted)|^(tap chi|journal)\b.*\d|^https?://|@|^(bien tap|thu ky toa soan|lien he)\b"
CONTACT = r"(hotline|tong dai|so dien thoai|lien he|dia chi|website|email|fanpage)|(^|\D)0\d{2,3}[ .]?\d{3}[ .]?\d{3,4}(\D|$)"


def boilerplate(line: Column | str) -> Column:
    """Lines of a journal's frame: page numbers, identifiers, dates of receipt, addresses, issue lines."""
    return no_accents(fold(F.trim(_c(line)))).rlike(BOILERPLATE)


def contact(line: Column | str) -> Column:
    return no_accents(fold(_c(line))).rlike(CONTACT)


def sanitised(x: Column | str) -> Column:
    """Without mail addresses, links, phone numbers and dates."""
    steps = [(r"\S+@\S+\.\S+", " "), (r"https?://\S+", " "), (r"\b0\d{2,3}[ .]?\d{3}[ .]?\d{3,4}\b", " "), (r"\b\d{1,2}/\d{1,2}/\d{4}\b", " "), (r"[¹²³⁴-⁹]+", "")]
    return flat(reduce(lambda c, s: F.regexp_replace(c, *s), steps, _c(x)))


def _tone_pairs() -> dict[str, str]:
    """Vowel pairs with the tone mark on the first letter, and with it on the second: oa, oe, uy, ua, in small, large and first large letters."""
    marks = "\u0300\u0301\u0309\u0303\u0323"
    cased = [pair for first, second in ("oa", "oe", "uy", "ua") for pair in (first + second, (first + second).upper(), first.upper() + second)]
    return {unicodedata.normalize("NFC", a + mark + b): unicodedata.normalize("NFC", a + b + mark) for a, b in cased for mark in marks}


def tone_placement(x: Column | str) -> Column:
    """Tone marks of oa, oe, uy and ua on the second vowel, wherever the pair stands."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), _tone_pairs().items(), _c(x))


def lacks_tones(x: Column | str, share: float = 0.5) -> Column:
    """Whether more than share of the words are plain ASCII letters."""
    words = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}]+"), F.lit(0))
    return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: w.rlike("^[a-z]{2,}$"))) > share * F.size(words))


def with_tones(x: Column | str, phrases: dict[str, str]) -> Column:
    """Phrases typed without accents replaced by those with, longest first; texts already accented stay as they are."""
    out = _c(x)
    for plain in sorted(phrases, key=lambda p: (-len(p), p)):
        out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{N}}]){plain}(?![\p{{L}}\p{{N}}])", phrases[plain])
    return F.when(lacks_tones(x), out).otherwise(_c(x))


def ngrams(words: Column, least: int, most: int) -> Column:
    """All runs of least to most words, each joined by a space."""
    run = lambda n: lambda i: F.array_join(F.slice(words, i, n), " ")
    runs = [F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), run(n))).otherwise(F.array().cast("array<string>")) for n in range(most, least - 1, -1)]
    return F.concat(*runs)


def noun_phrases(x: Column | str, stop: list[str], least: int = 2, most: int = 4) -> Column:
    """Distinct word windows without stop words at either end and without numbers."""
    stops = F.array(*(F.lit(s) for s in stop))
    words = F.regexp_extract_all(fold(x), F.lit(WORD), F.lit(0))
    good = lambda p: ~p.rlike(r"\d") & ~F.array_contains(stops, F.substring_index(p, " ", 1)) & ~F.array_contains(stops, F.substring_index(p, " ", -1))
    return F.array_distinct(F.filter(ngrams(words, least, most), good))


def person_score(x: Column | str) -> Column:
    """0 to 1: how much a line looks like names of persons: capitalised words, two to six of them, few digits, separators."""
    parts = F.filter(F.transform(F.split(_c(x), r"[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    words = F.filter(F.split(F.trim(_c(x)), r"[\s,;]+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}[\p{L}\p{M}.*-]*$"))) / F.greatest(F.size(words), F.lit(1))
    fair = F.size(F.filter(parts, lambda p: F.size(F.split(p, " ")).between(2, 6))) / F.greatest(F.size(parts), F.lit(1))
    return F.round(F.when(F.size(words) == 0, 0.0).when(_c(x).rlike(r"\d{2,}|[.!?]$"), 0.2 * capital).otherwise(0.6 * capital + 0.4 * fair), 4)


def titled(hint: Column | str) -> Column:
    """A file name as a title: no extension, no hash at its end, separators as spaces."""
    base = F.regexp_replace(F.element_at(F.split(_c(hint), r"[/\\]"), -1), r"(?i)\.(pdf|txt|json)$", "")
    return flat(F.regexp_replace(F.regexp_replace(base, r"[_-][0-9a-f]{8,64}$", ""), r"[_-]+", " "))


def dated_name(name: Column | str) -> Column:
    """DDMMYYYY_anything_NNNN.txt as DDMMYYYY_NNNN.txt; other names as they are."""
    return F.regexp_replace(_c(name), r"^(\d{8})_.*_(\d{4})\.txt$", "$1_$2.txt")


def authors(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(x), r"[,;]"), lambda p: F.trim(p)), lambda a: a != "")


def supported(value: Column | str, source: Column | str) -> Column:
    """Whether a value of at least 3 letters or digits stands in the source, blind to case, accents and all else."""
    key = compact_key(value)
    return (F.length(key) >= 3) & compact_key(source).contains(key)
