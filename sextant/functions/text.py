"""Text expressions: accent folding, normal forms, lines, tokens and control letters."""

from __future__ import annotations

import ctypes
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters replaced after composition. Fixed values.
REPLACED = {
    "\xa0": " ",  # no-break space
    "\u2009": " ",  # thin space
    "\u202f": " ",  # narrow no-break space
    "\xad": "",  # soft hyphen
    "\u200b": "",  # zero width space
    "\ufb01": "fi",  # latin small ligature fi
    "\ufb02": "fl",  # latin small ligature fl
    "\u2010": "-",  # hyphen
    "\u2011": "-",  # non-breaking hyphen
    "\uf0b7": "\u2022",  # private use
    "\uf0a7": "\u2022",  # private use
    "\uf02d": "-",  # private use
    "\t": " ",  # tab
}
#: Line ends of Python's splitlines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Words that the lexical ranking leaves out. Fixed values.
STOP_WORDS = ("de", "la", "el", "en", "y", "a", "los", "las", "un", "una", "por", "con", "para", "se", "que", "es", "del", "al", "lo", "su", "o", "como")
TOKEN, _STOPS = re.compile("[a-z0-9]+"), frozenset(STOP_WORDS)
#: What folding can change; a table of code points is slow on what it leaves as it is.
_BEYOND = re.compile("[^\\x00-\\x7f]+")
CONTROL_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# Latin letters and compatibility forms whose decomposition has one base character, from the Unicode data; longer ones are replaced one by one.
_BASES = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07))}
_ONE = {c: b for c, b in _BASES.items() if b != c and len(b) == 1}
_MORE = {c: b for c, b in _BASES.items() if b != c and len(b) > 1 and b.strip().isalnum()}


def fold(text: Column) -> Column:
    """Without accents: compatibility decomposition of Latin letters, combining marks dropped."""
    bare = F.regexp_replace(F.translate(text, "".join(_ONE), "".join(_ONE.values())), r"\p{M}+", "")
    whole = bare
    for c, b in _MORE.items():
        whole = F.replace(whole, F.lit(c), F.lit(b))
    return F.when(bare.rlike(f"[{''.join(_MORE)}]"), whole).otherwise(bare)


def match_form(text: Column) -> Column:
    """For matching regardless of case and accents: folded lower-case words of a-z and 0-9, one space apart."""
    folded = F.replace(F.lower(fold(text)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def upper_form(text: Column) -> Column:
    """Folded, without other non-ASCII characters, trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(fold(text), r"[^\x00-\x7F]", "")))


def tokens(text: Column) -> Column:
    """Folded lower-case runs of a-z and 0-9 without stop words, for lexical ranking."""
    found = F.regexp_extract_all(fold(F.lower(text)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


@cache
def _folding() -> dict[int, str | None]:
    """``fold`` as a table of code points."""
    marks = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"}
    return marks | {ord(c): b for c, b in (_ONE | _MORE).items()}


def tokens_of(text: str) -> list[str]:
    """The same as ``tokens``, for text that is in a Python task anyway."""
    lower = text.lower()
    folded = lower if lower.isascii() else _BEYOND.sub(lambda m: m.group().translate(_folding()), lower)
    return [t for t in TOKEN.findall(folded) if t not in _STOPS]


def let(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once even where ``f`` uses it often or within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: The first character that composition can change.
FIRST_COMPOSED = "\\u0300"


#: Texts of which Python objects are made at once.
ROWS = 128


@F.arrow_udf(T.StringType())
def _composed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.slice(at, ROWS).to_pylist()], pa.string()) for at in range(0, len(texts), ROWS)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        trim_memory()


def composed(text: Column) -> Column:
    """In the composed normal form. Spark has no built-in for it, but only texts with characters from U+0300 on go to Python."""
    return F.coalesce(_composed(F.when(text.rlike(f"[^\\x00-{FIRST_COMPOSED}]|{FIRST_COMPOSED}"), text)), text)


def clean_characters(text: Column, compose: bool = True) -> Column:
    """Composed (where ``compose``) and with odd spaces, hyphens, ligatures and bullets replaced."""
    out = composed(text) if compose else text
    single = {k: v for k, v in REPLACED.items() if len(v) <= 1}
    order = [k for k in single if single[k]] + [k for k in single if not single[k]]
    out = F.translate(out, "".join(order), "".join(single[k] for k in order))
    for k in (k for k in REPLACED if len(REPLACED[k]) > 1):
        out = F.replace(out, F.lit(k), F.lit(REPLACED[k]))
    return out


def lines(text: Column) -> Column:
    """Lines as of splitlines: no empty line after a final line end."""
    cut = F.split(text, LINE_END, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def is_upper(text: Column) -> Column:
    """Has a cased letter and no lower-case one."""
    return (text == F.upper(text)) & (text != F.lower(text))


def control_letter(number: Column) -> Column:
    """The control letter of an identity number."""
    return F.substring(F.lit(CONTROL_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def identity_is_valid(identity: Column) -> Column:
    """8 digits and letter, or X, Y, Z with 7 digits and letter: the letter is the control letter."""
    flat = F.upper(F.regexp_replace(identity, r"[\s-]", ""))
    number = F.translate(F.left(flat, F.lit(1)), "XYZ", "012")
    digits = F.concat(number, F.substring(flat, F.lit(2), F.length(flat) - 2)).try_cast("long")
    return control_letter(digits) == F.right(flat, F.lit(1))


def trim_memory() -> None:
    """Give what a worker has freed back to the system: workers are kept, and so would be their largest batch."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)
