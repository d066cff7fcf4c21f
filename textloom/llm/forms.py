"""Problem 6: one form for text that looks the same.

Skeleton: decompose, replace every character by the prototype of its look-alike class, decompose again.
Two texts of equal skeleton look alike. The *form* of a text is the readable representative of its class: its skeleton,
composed again, but for the words that stand for themselves (words of another script, Greek letters on their own).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from textloom.llm.arrow import map_batches

# Letters that look like Latin ones, after the public table of look-alikes of Unicode Technical Standard 39 (confusables).
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y",
}
GREEK = {
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "ι": "i", "κ": "k", "γ": "y", "η": "n", "τ": "t", "χ": "x", "ω": "w", "ς": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
LATIN = {"ð": "đ", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g"}
# Letters that look like Latin ones only among Latin letters.
NEAR = {
    "в": "b", "г": "r", "к": "k", "м": "m", "н": "h", "п": "n", "т": "t", "ь": "b",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "յ": "j", "զ": "q", "ց": "g", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z",
}
_SMALL = "LATIN LETTER SMALL CAPITAL "
NEAR |= {chr(c): n[-1].lower() for c in [*range(0x0250, 0x02B0), *range(0x1D00, 0x1D26), 0xA730, 0xA731] if (n := unicodedata.name(chr(c), "")).startswith(_SMALL) and len(n) == len(_SMALL) + 1}
#: Letters and digits in another dress (mathematical, letterlike, circled, Roman numerals): their prototypes are what they are made of.
DRESSED = {
    chr(c): plain
    for low, high, tags in ((0x2100, 0x2150, ("<font>",)), (0x2160, 0x2180, ("<compat>",)), (0x24B6, 0x24EA, ("<circle>",)), (0x1D400, 0x1D800, ("<font>",)))
    for c in range(low, high)
    if c not in (0x2139, 0x24C2) and unicodedata.decomposition(chr(c)).split(" ")[0] in tags and (plain := unicodedata.normalize("NFKC", chr(c))).isascii() and plain.isalnum()
}  # the two left out are shown as emoji
LOOKALIKES = CYRILLIC | GREEK | LATIN | NEAR

INVISIBLE = (
    r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
    r"\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f"
)
BLANKS = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\x0b\x0c\x85\u2028\u2029"
FULLWIDTH = r"\uff01-\uff5e\uffe0-\uffe6"
_MARKS = r"\u0300-\u036f"
_suspects = "".join(LOOKALIKES)
#: Nothing outside these classes and uncomposed accents can make a text differ from its form. Dressed letters are looked for by their blocks:
#: a class of many single characters beyond the basic plane is searched one by one.
ODD = re.compile(f"[{INVISIBLE}{BLANKS}{FULLWIDTH}{_suspects}\u2100-\u217f\u24b6-\u24e9\U0001d400-\U0001d7ff]")
_invisible, _blank, _wide = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{BLANKS}]"), re.compile(f"[{FULLWIDTH}]")
_word = re.compile(f"[^\\W_][^\\W_{_MARKS}]*(?:[{_MARKS}]+[^\\W_]*)*")
_suspect = re.compile(f"[{_suspects}]")
_PROTOTYPES = str.maketrans(LOOKALIKES | DRESSED)
_UNDRESSED = str.maketrans(DRESSED)
_emoji_joint = re.compile("(?<=[\u2600-\u27bf\U0001f000-\U0001faff\ufe0f])[\u200d\ufe0f]")


def skeleton(text: str) -> str:
    """Decompose, replace each character by its prototype, decompose again; not meant for reading. Invisible characters have no
    prototype, blanks that of the space."""
    text = _blank.sub(" ", _invisible.sub("", unicodedata.normalize("NFD", text)))
    text = _wide.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return unicodedata.normalize("NFD", text.translate(_PROTOTYPES))


def representative(text: str) -> str:
    """The composed skeleton. A composed text without characters of another prototype is its own, as its skeleton is only its decomposition."""
    if unicodedata.is_normalized("NFC", text) and not ODD.search(text):
        return text
    return unicodedata.normalize("NFC", skeleton(text))


def _own_word(word: str) -> bool:
    """Whether a word (decomposed) stands for itself: it has no look-alikes, it is a Greek letter on its own, or it is of another script.
    Words of look-alikes only are not of another script, unless some look like Latin letters only among such."""
    if not _suspect.search(word):
        return True
    letters = [c for c in word if c.isalpha()]
    if len(letters) == 1 and (letters[0] in GREEK or letters[0] in NEAR):
        return True
    latin = any(c not in LOOKALIKES and unicodedata.name(c, "").startswith("LATIN") for c in letters)
    return not (latin or all(c in LOOKALIKES and c not in NEAR for c in letters))


def form(text: str) -> str:
    """The one form of a text. Null is the caller's; an empty text is its own form."""
    if unicodedata.is_normalized("NFC", text) and not ODD.search(text):
        return text
    joints = {m.start() for m in _emoji_joint.finditer(text)}
    if joints:
        text = "".join(c for i, c in enumerate(text) if i in joints or not _invisible.match(c))
    else:
        text = _invisible.sub("", text)
    text = _blank.sub(" ", text)
    text = _wide.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text).translate(_UNDRESSED)
    text = unicodedata.normalize("NFC", text)
    if _suspect.search(text):
        text = unicodedata.normalize("NFC", _word.sub(lambda m: m[0] if _own_word(m[0]) else skeleton(m[0]), unicodedata.normalize("NFD", text)))
    return text


def one_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, changed): each row's text in its one form.

    Rows of null key or null text have a null form and changed false; empty text is unchanged; repeated rows stay
    repeated; other columns are not read. No shuffle.
    """

    def work():
        def step(columns):
            for k, t in zip(*columns):
                f = None if t is None else form(t)
                yield k, f, f != t

        return step

    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {df.schema[key].dataType.simpleString()}, form string, changed boolean")


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, skeleton_id, members): texts grouped by equal skeleton, one row per key.

    skeleton_id is a 128-bit digest of the skeleton, members the number of distinct keys of the class. Null
    texts belong to no class. Only digests are shuffled, and counts are pre-aggregated, so a class may hold any share of the rows.
    """

    def work():
        import xxhash

        def step(columns):
            for k, t in zip(*columns):
                if t is not None:
                    yield k, xxhash.xxh3_128_hexdigest(skeleton(t).encode("utf-8", "surrogatepass"))

        return step

    kind = df.schema[key].dataType.simpleString()
    ids = map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, skeleton_id string").distinct()
    return ids.join(ids.groupBy("skeleton_id").agg(F.count("*").alias("members")), "skeleton_id").select("key", "skeleton_id", "members")


def differing(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key): the distinct keys whose text is not in its one form.

    A text is proposed if it is not the composed skeleton of its own class; the form then checks that some difference stands inside a word
    or is no letter's. Null and empty texts never differ."""

    def work():
        def step(columns):
            for k, t in zip(*columns):
                if t and representative(t) != t and form(t) != t:
                    yield (k,)

        return step

    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {df.schema[key].dataType.simpleString()}").distinct()


@lru_cache(maxsize=1 << 16)
def line_key_form(line: str) -> str:
    """A line in its one form, lower case, blanks and digits of numbers made alike (problem 3)."""
    return _digits.sub("0", " ".join(form(line).lower().split()))


_digits = re.compile(r"\d\d*")  # a pattern that begins with a class is searched faster
