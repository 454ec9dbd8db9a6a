"""One form for text that looks the same but is stored in different characters.

Quick-check properties decide which stretches of a text may change. Those stretches, with the characters before and after that they may
combine with, are normalised; everything else is copied. Rows without such a stretch never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lineage import cut

# Compatibility decompositions whose two sides look the same.
SAME_LOOKING_TAGS = {"wide", "narrow", "noBreak", "compat", "initial", "medial", "final", "isolated"}

# Letters of other scripts that look like a Latin letter.
CYRILLIC_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y",
}
GREEK_LOOKALIKES = {
    "ο": "o", "ν": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
OTHER_LOOKALIKES = {
    "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "ʼ": "’", "ӏ": "l", "Ӏ": "I",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "յ": "j", "զ": "q", "Օ": "O", "Ս": "U",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T", "Ⲭ": "X",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

# Tibetan characters that a reader cannot tell apart.
TIBETAN_LOOKALIKES = {"༌": "་", "ཪ": "ར", "ྰ": "ཱ", "ༀ": "ཨོཾ", "༎": "།།"}

# CJK radicals without a decomposition, in code point order, and the ideographs they look like.
CJK_RADICALS = "⺁⺂⺃⺄⺅⺆⺈⺉⺊⺋⺌⺍⺎⺏⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺶⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻊⻋⻌⻍⻎⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲"
CJK_IDEOGRAPHS = "厂乛乚乙亻冂刀刂卜㔾小小兀尣尢巳幺彑彐忄㣺扌攵旡日月歺民氵氺灬爫爫丬牛犭王疋目示礻竹糹纟罓罒羊耂肀聿肉臼艹艹艹虎衤覀西见角讠贝足车辶辶辶钅長镸长门阜阝雨青韦页风飞食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀"

IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")


def _expand(char: str) -> str:
    """``char`` after those compatibility decompositions that keep its look, over and over."""
    tag, *codes = unicodedata.decomposition(char).split() or [""]
    if not tag.startswith("<") or tag.strip("<>") not in SAME_LOOKING_TAGS:
        return char
    parts = "".join(chr(int(code, 16)) for code in codes)
    if len(parts) > 1 and parts[0] == " ":  # spacing accents
        return char
    return "".join(map(_expand, parts))


@lru_cache(1)
def _tables() -> tuple[dict[int, str], dict[int, str], str, str]:
    """First folds (before decomposition), second folds (after it), and the regex classes of unstable characters and of combining marks."""
    assert len(CJK_RADICALS) == len(CJK_IDEOGRAPHS)
    second = {ord(a): b for t in (CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES, OTHER_LOOKALIKES, TIBETAN_LOOKALIKES) for a, b in t.items()}
    second |= {ord(a): b for a, b in zip(CJK_RADICALS, CJK_IDEOGRAPHS)}
    first: dict[int, str] = {}
    unstable, marks = set(second), set()
    assigned = [*map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x32000), *range(0xE0000, 0xE1000)))]  # beyond these, none has the properties asked for here
    first |= dict.fromkeys(map(ord, IGNORABLE.findall("".join(assigned))), "")
    unstable |= first.keys()
    for char in assigned:
        code = ord(char)
        if unicodedata.combining(char):
            marks.add(code)
        parts = unicodedata.decomposition(char).split()
        if code in first or not parts:
            continue
        if (other := _expand(char)) != char:
            first[code] = other
        stable = unicodedata.normalize("NFC", char) == char
        if code in first or not stable:
            unstable.add(code)
        if len(parts) == 2 and not parts[0].startswith("<"):
            if stable:
                unstable.add(int(parts[1], 16))  # quick check "maybe": it may join what stands before it
            if {int(x, 16) for x in parts} & second.keys():
                unstable.add(code)
    unstable |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    return first, second, _ranges(unstable), _ranges(marks - unstable)


def _ranges(codes: set[int]) -> str:
    """A character class without its brackets that Python and Java read alike."""
    runs: list[list[int]] = []
    for code in sorted(codes):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    text = lambda code: chr(code) if code > 0x2FF else "\\" + f"u{code:04X}"
    return "".join(text(a) + (f"-{text(b)}" if b > a else "") for a, b in runs)


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    _, _, unstable, marks = _tables()
    # What may change, or two marks that may stand in the wrong order, with all that may combine after it.
    stretch = re.compile(f"[{unstable}][{unstable}{marks}]*|[{marks}][{marks}][{unstable}{marks}]*")
    cyrillic = re.compile(r"\w*[Ѐ-ӿ]\w*")
    return stretch, cyrillic


#: Blocks whose stable characters make up most text; whatever else a text holds, it goes through the exact check.
COMMON_BLOCKS = ((0x0F00, 0x0FFF), (0x4E00, 0x9FFF), (0x0900, 0x0950), (0x0958, 0x0970), (0x2013, 0x2014), (0x2018, 0x2019), (0x201C, 0x201E), (0x3001, 0x3002), (0x300A, 0x300B))


def quick_check_pattern() -> str:
    """A Java regex that finds something in every text which is not in the one form yet (and in some that are).

    It has few ranges, for Java tries them one after another: a character beyond the stable ones of the common blocks, or two Tibetan marks in a row.
    """
    _, _, unstable, _ = _tables()
    moving = re.compile(f"[{unstable}]")
    stable = {c for a, b in COMMON_BLOCKS for c in range(a, b + 1) if not moving.match(chr(c)) and (unicodedata.category(chr(c)) != "Cn" or c > 0x4E00)}
    later = "".join(c for c in map(chr, range(0xF72, 0xF85)) if unicodedata.combining(c) >= 130)
    marks = "".join(c for c in map(chr, range(0xF18, 0xFC7)) if unicodedata.combining(c) and not moving.match(c) and c != "ཱ")
    return f"[^{_ranges(stable)}\\u0000-\\u007F]|[{marks}][{marks}ཱ]|ཱ[ཱ{''.join(c for c in marks if c not in later)}]"


_TO_CYRILLIC = {ord(b): a for a, b in CYRILLIC_LOOKALIKES.items()}


@lru_cache(200_000)
def _settle(stretch: str) -> str:
    first, second, _, _ = _tables()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", unicodedata.normalize("NFD", stretch.translate(first)).translate(second)))


def _settle_word(word: str) -> str:
    """A word with a letter that only Cyrillic has is written in Cyrillic throughout, if it can be."""
    out = unicodedata.normalize("NFD", word).translate(_TO_CYRILLIC)
    return word if re.search("[A-Za-z]", out) else unicodedata.normalize("NFC", out)


def normalize_text(text: str | None) -> str | None:
    """The one form of ``text``; null stays null. Equal-looking texts get the same form, and a text in that form is left as it is."""
    if not text or text.isascii():
        return text
    stretch, cyrillic = _patterns()
    parts, done = [], 0
    for m in stretch.finditer(text):
        start, end = m.span()
        while start > done and unicodedata.combining(text[start]):  # back to the character that the marks stand on
            start -= 1
        if start > done:
            start -= 1
        parts += text[done:start], _settle(text[start:end])
        done = end
    out = "".join(parts) + text[done:] if parts else text
    return cyrillic.sub(lambda m: _settle_word(m.group()), out) if not out.isascii() else out


@F.pandas_udf(T.StringType())
def _normalize(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(normalize_text, na_action="ignore")


def normalized(text: Column) -> Column:
    """The one form of a string column. Only rows that fail the quick check are sent to Python."""
    return F.coalesce(_normalize(F.when(text.rlike(quick_check_pattern()), text)), text)


def normalize_fields(words: DataFrame, requests: DataFrame) -> DataFrame:
    """``(field, record_id, original, canonical, changed)`` for word.word, word.word_normalized and check_requests.text.

    Null values stay as rows with null ``canonical`` and ``changed`` false; the empty text is its own form.
    """
    return _fields(words, requests).withColumn("canonical", normalized(F.col("original"))).withColumn("changed", F.coalesce(F.col("canonical") != F.col("original"), F.lit(False)))


def _fields(words: DataFrame, requests: DataFrame) -> DataFrame:
    # one projection per row, so the table is read once
    both = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col("id").cast("long").alias("record_id"), F.col(c).alias("original")) for f, c in (("word", "word"), ("word_normalized", "word_normalized")))))
    return words.select(both).unionByName(requests.select(F.lit("request").alias("field"), F.col("request_id").cast("long").alias("record_id"), F.col("text").alias("original")))


def look_alike_groups(fields: DataFrame) -> DataFrame:
    """``(field, form, spelling, record_id)``: fingerprints of 128 bits of the one form and of the stored text for every non-blank value."""
    print_ = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    kept = fields.where(F.col("original").isNotNull() & F.col("original").rlike(r"[^\s]"))
    return kept.select("field", print_(normalized(F.col("original"))).alias("form"), print_(F.col("original")).alias("spelling"), "record_id")


#: Records of one spelling that one task joins; a spelling with more is spread over so many tasks as it needs.
PER_TASK = 50_000
#: Spellings of forms with several of them that are broadcast to the records (about 100 bytes each).
BROADCAST_SPELLINGS = 500_000


def _several(groups: DataFrame) -> DataFrame:
    """``(field, form, spelling, n)`` of the spellings whose form has several, with the number of their records."""
    spellings = groups.groupBy("field", "form", "spelling").agg(F.count(F.lit(1)).alias("n"))
    forms = spellings.groupBy("field", "form").agg(F.min("spelling").alias("least"), F.max("spelling").alias("most")).where("least <> most").select("field", "form")
    return spellings.join(forms, ["field", "form"], "left_semi")


def look_alike_pairs(groups: DataFrame) -> DataFrame:
    """``(field, id_a, id_b)``: records of one field whose texts have the same form but are spelled differently.

    Pairs are formed between distinct spellings first, so any number of exact copies costs only the pairs that come out. A spelling with many records is salted by
    its records. ``groups`` is read several times: pass it with its lineage cut. Where the pairs are too many to be wanted, see ``look_alike_classes``.
    """
    several = cut(_several(groups))
    few = F.broadcast if several.count() <= BROADCAST_SPELLINGS else (lambda df: df)
    tasks = F.floor(F.col("n") / PER_TASK).cast("int")
    records = groups.join(few(several), ["field", "form", "spelling"]).withColumn("salt", F.pmod(F.xxhash64("record_id"), tasks + 1).cast("int"))
    a, b = (several.select("field", "form", F.col("spelling").alias(f"spelling_{x}"), tasks.alias(f"tasks_{x}")) for x in "ab")
    pairs = a.join(b, ["field", "form"]).where("spelling_a < spelling_b").withColumn("salt_a", F.explode(F.sequence(F.lit(0), "tasks_a")))
    left, right = (records.select("field", "form", F.col("spelling").alias(f"spelling_{x}"), F.col("salt").alias(f"salt_{x}"), F.col("record_id").alias(f"id_{x}")) for x in "ab")
    half = pairs.join(left.withColumnRenamed("id_a", "left_id"), ["field", "form", "spelling_a", "salt_a"]).withColumn("salt_b", F.explode(F.sequence(F.lit(0), "tasks_b")))
    met = half.join(right.withColumnRenamed("id_b", "right_id"), ["field", "form", "spelling_b", "salt_b"])
    return met.select("field", F.least("left_id", "right_id").alias("id_a"), F.greatest("left_id", "right_id").alias("id_b")).where("id_a < id_b")


def look_alike_classes(groups: DataFrame) -> DataFrame:
    """``(field, record_id, class_id, spelling_id, spellings, records)`` for every record whose form is spelled in several ways: the pairs, without writing them out.

    Two records are a pair if they share ``class_id`` and differ in ``spelling_id``; each is the least record id of its class or spelling.
    """
    spelled = groups.groupBy("field", "form", "spelling").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("spelling_id"))
    classes = spelled.groupBy("field", "form").agg(F.min("spelling_id").alias("class_id"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("records")).where("spellings > 1")
    few = F.broadcast if (named := cut(spelled.join(classes, ["field", "form"]).drop("n"))).count() <= BROADCAST_SPELLINGS else (lambda df: df)
    return groups.join(few(named), ["field", "form", "spelling"]).select("field", "record_id", "class_id", "spelling_id", "spellings", "records")
