"""Functions of one string column. Offsets and lengths are in code points; null stays null."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import letters as L

_SUBJOINED_CHARS = "".join(map(chr, range(0xF90, 0xFBD)))
_BASE_CHARS = "".join(chr(c - 0x50) for c in range(0xF90, 0xFBD))
#: Characters that NFC leaves alone in any order: letters and signs that neither combine nor are taken apart.
STABLE = "\u0000-\u007f\u00a0-\u017f\u0400-\u045f\u0904-\u0928\u092a-\u0930\u0932\u0933\u0935-\u0939\u093d-\u0950\u0964-\u0970\u2010-\u2027\u2030-\u205e\u3000-\u3029\u4e00-\u9fff\uff01-\uff5e"
#: What may not be in NFC yet: other characters, the block's composition exclusions, and two marks in a row.
_MAYBE_UNSTABLE = f"[^{STABLE.replace(chr(0), chr(92) + 'u0000')}{L.BLOCK}]|[{L.NOT_NFC}]|[\\u0f39\\u0f71\\u0f72\\u0f74\\u0f7a-\\u0f7d\\u0f80\\u0f84][\\u0f39\\u0f71-\\u0f84]"


def may_change(text: Column) -> Column:
    """Whether NFC or the loss of zero-width characters could change ``text``; false only if they cannot."""
    return text.rlike(_MAYBE_UNSTABLE)


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC. Only rows that may change are sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(_MAYBE_UNSTABLE), text)), text)


_NO_WIDTH = dict.fromkeys(map(ord, L.ZERO_WIDTH))


@F.pandas_udf(T.StringType())
def _normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFC", t).translate(_NO_WIDTH), na_action="ignore")


def normalize(text: Column) -> Column:
    """NFC without zero-width spaces and joiners. Only rows that may change are sent to Python; none of the others has such a character."""
    return F.coalesce(_normal(F.when(may_change(text), text)), text)


def strip(text: Column) -> Column:
    """``text`` without white space at its ends, of any kind."""
    return F.regexp_replace(text, f"^[{L.WHITE_SPACE}]+|[{L.WHITE_SPACE}]+$", "")


@lru_cache(65536)
def _begins(char: str) -> bool:
    """Whether NFC of a text never reaches back over ``char``."""
    if unicodedata.combining(char) or "\u1161" <= char <= "\u11ff":
        return False
    return unicodedata.is_normalized("NFC", char) and not unicodedata.category(char).startswith("M")


_HIDDEN = re.compile(f"[{L.ZERO_WIDTH}]")


def position_map_of(text: str) -> tuple[str, list[int]]:
    """The normalised text and, for each of its characters, the place in ``text`` it comes from: what a prefix of ``text`` adds to the length of its NFC."""
    out = unicodedata.normalize("NFC", text)
    if out == text:
        places = range(len(text))
        if not _HIDDEN.search(text):
            return text, [*places]
    else:
        # a character that neither combines nor is taken apart begins anew, so NFC grows from there on its own
        places, done, start, settled = [], 0, 0, 0
        for i, c in enumerate(text):
            if i > start and _begins(c):
                settled += len(unicodedata.normalize("NFC", text[start:i]))
                start = i
            size = settled + len(unicodedata.normalize("NFC", text[start : i + 1]))
            places += [i] * (size - done)
            done = size
    kept = [(c, p) for c, p in zip(out, [*places, *range(len(places), len(out))]) if c not in L.ZERO_WIDTH]
    return "".join(c for c, _ in kept), [p for _, p in kept]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _position_map(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: position_map_of(t)[1], na_action="ignore")


def position_map(text: Column) -> Column:
    """Place in ``text`` of each character of ``normalize(text)``."""
    identity = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(_position_map(F.when(text.rlike(_MAYBE_UNSTABLE), text)), F.when(text.isNotNull(), identity))


def starts_tibetan(text: Column) -> Column:
    return text.rlike(f"^[{L.BLOCK}]")


def has_tibetan(text: Column) -> Column:
    return text.rlike(f"[{L.BLOCK}]")


def is_numeral(syllable: Column) -> Column:
    return syllable.rlike(f"^[{L.NUMERAL}]+$")


def is_punctuation(syllable: Column) -> Column:
    """All of it is of the Tibetan block and none of it can be spelled; numerals count."""
    return syllable.rlike(f"^[{L.NOT_SPELLABLE}]+$")


def extract_tibetan(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{L.BLOCK}]", "")


def count_non_tibetan(text: Column) -> Column:
    """Characters beyond the block, white space left out; zero-width ones count."""
    return F.length(F.regexp_replace(text, f"[{L.BLOCK}{L.WHITE_SPACE}]", ""))


def split_syllables(text: Column) -> Column:
    """Syllables between tshegs and shads, stripped; white space inside stays."""
    parts = F.split(F.translate(text, L.SHAD + L.DOUBLE_SHAD + L.NB_TSHEG, L.TSHEG * 3), L.TSHEG, -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def split_headword(word: Column) -> Column:
    """Syllables between tshegs alone, stripped."""
    return F.filter(F.transform(F.split(word, L.TSHEG, -1), strip), lambda s: s != "")


def to_base(chars: Column) -> Column:
    """Subjoined letters as the letters they stand for."""
    return F.translate(chars, _SUBJOINED_CHARS, _BASE_CHARS)


def type_string(text: Column) -> Column:
    """One letter for each character: Base, Subjoined, Vowel, Mark (the rest of the block), Other."""
    out = F.regexp_replace(text, f"(?s)[^{L.BLOCK}]", "O")
    for letter, chars in (("B", L.BASE), ("S", L.SUBJOINED), ("V", L.VOWEL), ("M", L.BLOCK)):
        out = F.regexp_replace(out, f"[{chars}]", letter)
    return out


def keyword_in_context(text: Column, position: Column, word: Column, width: int = 20) -> Column:
    """The word in brackets with ``width`` characters on either side."""
    start = F.greatest(position - width, F.lit(0))
    end = F.least(position + F.length(word) + width, F.length(text))
    cut = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    stop = F.least(position + F.length(word), end)
    return F.concat(cut(start, position), F.lit("["), cut(position, stop), F.lit("]"), cut(stop, end))


def title_case(name: Column) -> Column:
    """``snake_case`` as ``Title Case``."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def severity_of(error_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in L.SEVERITIES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, error_type), F.lit("warning"))


def runs(line: Column) -> Column:
    """A line cut at tshegs and spaces, which are kept as runs of their own."""
    return F.regexp_extract_all(line, F.lit(f"{L.TSHEG}| |[^{L.TSHEG} ]+"), 0)


def recognised(text: Column) -> Column:
    """A recogniser's line: white space at its ends is stripped, and the mark that stands for a space becomes one."""
    return F.replace(strip(text), F.lit("§"), F.lit(" "))
