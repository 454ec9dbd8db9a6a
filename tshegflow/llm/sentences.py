"""Sentence units of texts in any mixture of scripts, by a finite transducer.

Every character gets a symbol: its class, after a lexer with a few characters of context has told abbreviation points, decimals, ordinals,
quotation marks and empty lines apart. A deterministic transducer over these symbols decides the boundaries. It has few states, so a
block of text is a function from state to state: all blocks of an Arrow batch are reduced to such functions together, the functions are
composed by a parallel prefix scan, and a second pass with the known entry states emits the boundaries. A separator symbol that leads
every state to the start lets one scan run over all texts of a batch, and a text of any length over many blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unicode_forms import normalize_text

# Abbreviations that do not end a sentence, whatever follows.
ABBREVIATIONS = (
    "Dr Prof Mr Mrs Ms St Ven Rev Hon Gen Col Lt Capt Sgt Sr Jr Hr Fr Frl Mme Mlle MM Mgr Mt Messrs Sen Gov Rep Pres Maj Adm Cmdr Brig Supt Msgr "
    "ed eds ff ms mss vs viz ca approx cf e.g i.e resp "
    "Abb Abs Anm Aufl Hg Hrsg Jh Jhd Str Vgl bzw evtl ggf vgl sog geb gest "
    "env av apr éd c.-à-d p.ex par.ex акад проф им ул гр"
).split()
# Abbreviations before a number; before anything else they are words, or the number is missing.
BEFORE_NUMBERS = "vol vols no nos ch chap p pp fol fols ll fig figs art sec par v Bd Bde Nr Kap t стр рис гл см".split()
# Month names before which a number with a point is a day.
GERMAN_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Chinese verbs of saying that tie a quotation to the clause after it.
CHINESE_SAYING = "问道 说道 答道 喊道 叫道 写道 笑道 叹道 问 说 答 喊 道 曰".split()

SYMBOLS = (
    "DOC SPACE BLANK IGNORE LOWER UPPER CASELESS DIGIT OTHER OPEN CLOSE POINT MARK STRONG "  # MARK: ? ! and … in cased scripts; STRONG: ends whatever follows
    "TIB_BARE TIB_LETTER TIB_SIGN TIB_DIGIT SHAD SPACED"  # SPACED: letters of scripts that end sentences by white space alone
).split()
S = {name: i for i, name in enumerate(SYMBOLS)}
STATES = "START INSIDE BARE BARE_SPACE OPENING SHUT WEAK WEAK_SPACE STRONG STRONG_SPACE SPACED SPACED_SPACE".split()
Q = {name: i for i, name in enumerate(STATES)}
#: What the transducer writes at a character: the sentence before it has ended (BREAK), this character may be a sentence's last (END).
BREAK, END = 1, 2
BLOCK = 128
#: Characters without a look that may stand inside words.
UNSEEN = r"\u00ad\u034f\u200b-\u200d\u2060\ufeff"


@lru_cache(1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output, by symbol and state."""
    step = np.zeros((len(SYMBOLS), len(STATES)), np.int8)
    out = np.zeros((len(SYMBOLS), len(STATES)), np.int8)

    def rule(state: str, symbols: str, to: str, writes: int = 0) -> None:
        for name in symbols.split():
            step[S[name], Q[state]], out[S[name], Q[state]] = Q[to], writes

    word = "LOWER UPPER CASELESS DIGIT OTHER OPEN CLOSE TIB_LETTER TIB_DIGIT"
    # where a character leads that opens or continues a sentence
    leads = dict.fromkeys(word.split(), "INSIDE") | {"TIB_BARE": "BARE", "SPACED": "SPACED", "POINT": "WEAK", "MARK": "WEAK", "STRONG": "STRONG", "SHAD": "SHUT", "TIB_SIGN": "INSIDE"}
    for state in STATES:
        for name, to in leads.items():
            rule(state, name, to, END)
        rule(state, "SPACE", state)
        rule(state, "IGNORE", state, END)
        rule(state, "BLANK DOC", "START", BREAK)
    # Tibetan head signs open a sentence, and the shads after them are part of the opening
    for state in ("START", "SHUT", "WEAK", "WEAK_SPACE", "STRONG", "STRONG_SPACE", "BARE_SPACE"):
        rule(state, "TIB_SIGN", "OPENING", END | (BREAK if state != "START" else 0))
    rule("OPENING", "TIB_SIGN SHAD", "OPENING", END)
    rule("START", "SHAD", "SHUT", END)
    rule("START", "SPACE IGNORE", "START")
    # a letter after which spelling leaves out the shad: white space in its place ends the sentence, a shad after the space still belongs to it
    rule("BARE", "SPACE", "BARE_SPACE")
    for name in leads.keys() - {"SHAD", "TIB_SIGN"}:
        rule("BARE_SPACE", name, leads[name], END | BREAK)
    # scripts without marks: white space between two of their letters ends the sentence
    rule("SPACED", "SPACE", "SPACED_SPACE")
    rule("SPACED_SPACE", "SPACED", "SPACED", END | BREAK)
    # after a shad: more shads and closing marks belong to it, also after white space
    for name in leads.keys() - {"SHAD", "CLOSE", "TIB_SIGN"}:
        rule("SHUT", name, leads[name], END | BREAK)
    rule("SHUT", "SHAD CLOSE", "SHUT", END)
    # after . ? ! …: what follows decides
    for state in ("WEAK", "WEAK_SPACE"):
        rule(state, "UPPER CASELESS OPEN", "INSIDE", END | BREAK)
        rule(state, "TIB_LETTER TIB_DIGIT", "INSIDE", END | BREAK)
        rule(state, "TIB_BARE", "BARE", END | BREAK)
        rule(state, "SPACED", "SPACED", END | BREAK)
    rule("WEAK", "CLOSE POINT MARK", "WEAK", END)
    rule("WEAK", "SPACE", "WEAK_SPACE")
    rule("WEAK_SPACE", "DIGIT", "INSIDE", END | BREAK)
    rule("WEAK_SPACE", "CLOSE", "WEAK_SPACE", END)
    # after a full stop of a script without case
    for state in ("STRONG", "STRONG_SPACE"):
        for name in leads.keys() - {"STRONG", "CLOSE", "TIB_SIGN"}:
            rule(state, name, leads[name], END | BREAK)
        rule(state, "CLOSE STRONG", state, END)
    rule("STRONG", "POINT MARK", "STRONG", END)
    rule("STRONG", "SPACE", "STRONG_SPACE")
    return step, out


def _classify(char: str) -> str:
    code, category = ord(char), unicodedata.category(char)
    if char.isspace():
        return "SPACE"
    if category in ("Cf", "Mn", "Me") and not 0xF00 <= code <= 0xFFF or category == "Cc" or code == 0x34F:
        return "IGNORE"
    if 0xF00 <= code <= 0xFFF:
        if 0xF0D <= code <= 0xF12 or code == 0xF14:
            return "SHAD"
        if 0xF01 <= code <= 0xF0A or code in (0xFD0, 0xFD1, 0xFD3, 0xFD4):
            return "TIB_SIGN"
        if 0xF20 <= code <= 0xF33:
            return "TIB_DIGIT"
        if char in "ཀགཤ":
            return "TIB_BARE"
        return "TIB_LETTER"
    if (0xE01 <= code <= 0xE4E or 0xE81 <= code <= 0xECD) and char not in "ๆຯฯໆ":
        return "SPACED"
    if char == ".":
        return "POINT"
    if char in "?!‼⁇⁈⁉…":
        return "MARK"
    if char in "。！？｡．।॥።؟۔។៕၊။॥":
        return "STRONG"
    if char in "”’»)]}›\"'）］｝》〉」』】〕〗〙〛":
        return "CLOSE"
    if char in "“‘«([{‹„‚（［｛《〈「『【〔〖〘〚¿¡":
        return "OPEN"
    if category in ("Lu", "Lt"):
        return "UPPER"
    if category == "Ll":
        return "LOWER"
    if category in ("Lo", "Mc") or 0x2E80 <= code <= 0x2FDF:
        return "CASELESS"
    return "DIGIT" if category[0] == "N" else "OTHER"


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, S["OTHER"], np.int8)
    for code in (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)):
        table[code] = S[_classify(chr(code))]
    table[0x20000:0x323B0] = S["CASELESS"]
    return table


@lru_cache(1)
def _lexer() -> re.Pattern:
    blank = r"(?P<blank>\n[^\S\n]*(?:\n[^\S\n]*)+)"
    german = r"„[^“”„\n]*(?P<german>“)"
    unseen = "[" + UNSEEN + "]*"
    saying = "|".join(unseen.join(verb) for verb in CHINESE_SAYING)
    quoted = rf"(?P<quoted>[。！？…?!]+)[”」』](?=[^。！？“”「」：:，,；\n]+(?:{saying})(?:[。！？，,…\s]|\Z))"
    ellipsis = r"(?<=[⺀-鿿豈-﫿])(?P<ellipsis>…+)"
    point = r"(?P<point>\.)"
    apostrophe = r"(?<=\w)(?P<apostrophe>['’])(?=\w)"
    opener = r"(?:^|(?<=[\s(\[«“„]))(?P<opener>[\"'’])(?=\w)"
    return re.compile("|".join((blank, german, quoted, ellipsis, point, apostrophe, opener)), re.M)


_BEFORE = re.compile(rf"(?:[^\W\d_]|[{UNSEEN}\u0300-\u036f.\-])+$")
_NEXT_WORD = re.compile(rf"[\s{UNSEEN}]*([\w{UNSEEN}\u0300-\u036f]+)")
_KNOWN = {*ABBREVIATIONS} | {a[0].upper() + a[1:] for a in ABBREVIATIONS}
_NUMBERING = {*BEFORE_NUMBERS} | {a[0].upper() + a[1:] for a in BEFORE_NUMBERS}
#: A number, in figures or Roman, or a single letter.
_NUMBER_NEXT = re.compile(rf"[\s{UNSEEN}\u00a0(\[]*(?:\d|[IVXLCDMivxlcdm]+\b|[^\W\d_]\b)")


def _point(text: str, at: int) -> str:
    """The symbol of the point at ``at``."""
    before, after = text[at - 1] if at else "", text[at + 1] if at + 1 < len(text) else ""
    if "ऀ" <= before <= "ॿ":  # Devanagari abbreviations; its sentences end with a danda
        return "OTHER"
    if before.isdigit() and after.isdigit():
        return "OTHER"
    if before.isdigit():
        follow = _NEXT_WORD.match(text, at + 1)
        return "OTHER" if follow and normalize_text(follow.group(1)) in GERMAN_MONTHS else "POINT"
    if not (m := _BEFORE.search(text, max(0, at - 24), at)):
        return "POINT"
    word = normalize_text(m.group()).lstrip(".-")
    last = word.rpartition(".")[2]
    if "." in word and len(last) == 1 and not (after.isalpha() and after.isascii() and text[at + 2 : at + 3] == "."):
        # the last point of a.m., A.D.: an end if a sentence seems to follow, but z.B., i.e. and initials go on
        return "OTHER" if word in _KNOWN or all(len(x) == 1 and x.isupper() for x in word.split(".")) and word not in ("A.D", "B.C", "C.E", "B.C.E", "U.S") else "POINT"
    if last in _NUMBERING and len(last) > 1:
        return "OTHER" if _NUMBER_NEXT.match(text, at + 1) or after.islower() else "POINT"
    if word in _KNOWN or last in _KNOWN or len(last) == 1:
        return "OTHER"
    if after.islower():
        return "OTHER"
    return "POINT"


_FIXED = {"german": "CLOSE", "quoted": "OTHER", "ellipsis": "OTHER", "apostrophe": "OTHER", "opener": "OPEN", "blank": "BLANK"}


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _classes()[codes]
    for m in _lexer().finditer(text):
        kind = m.lastgroup
        a, b = m.span(kind)
        symbols[a:b] = S[_point(text, a) if kind == "point" else _FIXED[kind]]
    return symbols


def _scan(symbols: np.ndarray) -> np.ndarray:
    """The transducer's output over all symbols, computed block by block."""
    step, out = transducer()
    n = len(symbols)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, S["IGNORE"], np.int8)
    grid[:n] = symbols
    columns = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    # each block as a function of its entry state
    flat, width = step.ravel().astype(np.intp), len(STATES)
    function = np.tile(np.arange(width, dtype=np.intp), (blocks, 1))
    for column in columns:
        function = flat[column.astype(np.intp)[:, None] * width + function]
    # prefix scan: after round k, each function covers 2**k blocks
    reach, row = 1, np.arange(blocks)[:, None]
    while reach < blocks:
        later = function.copy()
        later[reach:] = function[row[reach:], function[:-reach]]
        function, reach = later, reach * 2
    state = np.full(blocks, Q["START"], np.intp)
    state[1:] = function[:-1, Q["START"]]
    written = np.empty_like(columns)
    wrote = out.ravel()
    for i, column in enumerate(columns):
        at = column.astype(np.intp) * width + state
        written[i] = wrote[at]
        state = flat[at]
    return written.T.ravel()[:n]


def split_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, first character and position after the last, for each sentence of ``texts``, in order."""
    symbols = [_symbols(t) for t in texts]
    lengths = np.array([len(x) + 1 for x in symbols])
    separator = np.array([S["DOC"]], np.int8)
    joined = np.concatenate([x for s in symbols for x in (s, separator)]) if symbols else separator[:0]
    written = _scan(joined)
    at = np.arange(len(joined))
    ends = np.where(written & END, at, -1)
    last = np.maximum.accumulate(ends) if len(ends) else ends
    breaks = np.flatnonzero(written & BREAK)
    stops = last[breaks - 1] if len(breaks) else breaks  # the last character before each break
    stops[breaks == 0] = -1
    solid = np.flatnonzero(written & END)
    begin = np.concatenate([[0], breaks[:-1]]) if len(breaks) else breaks
    first = np.searchsorted(solid, begin)
    starts = np.where(first < len(solid), solid[np.minimum(first, max(0, len(solid) - 1))], len(joined)) if len(solid) else np.full(len(breaks), len(joined))
    kept = starts <= stops
    starts, stops = starts[kept], stops[kept]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    text = np.searchsorted(offsets, starts, "right") - 1
    return text, starts - offsets[text], stops + 1 - offsets[text]


_SPAN = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))
#: Characters that are scanned at once; a longer text is one batch of its own.
BATCH_CHARS = 2_000_000


@F.pandas_udf(_SPAN)
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in batches:
        texts = ["" if t is None else t for t in series]
        out: list[list[dict]] = [[] for _ in texts]
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            for i, a, b in zip(*(x.tolist() for x in split_batch(texts[begin:end]))):
                out[begin + i].append({"start_pos": a, "end_pos": b})
            begin = end
        yield pd.Series(out)


def sentence_spans(text: Column) -> Column:
    """An array of ``(start_pos, end_pos)`` in code points. Null and blank texts have an empty array."""
    return _spans.asNondeterministic()(text)


def sentences(texts: DataFrame, kind: str | Column, record_id: str, text: str, with_text: bool = True) -> DataFrame:
    """``(record_kind, record_id, start_pos, end_pos[, sentence])``, one row for each sentence. Null and blank texts give none; repeated rows give their rows again."""
    base = texts.select((F.lit(kind) if isinstance(kind, str) else kind).alias("record_kind"), F.col(record_id).cast("long").alias("record_id"), F.col(text).alias("text"))
    base = base.where(F.col("text").rlike(r"\S"))
    kept = ["record_kind", "record_id", *["text"] * with_text]
    found = base.select(*kept, F.explode(sentence_spans(F.col("text"))).alias("s")).select(*kept, "s.start_pos", "s.end_pos")
    if with_text:
        found = found.withColumn("sentence", F.expr("substring(text, start_pos + 1, end_pos - start_pos)")).drop("text")
    return found


def request_and_page_sentences(requests: DataFrame, pages: DataFrame, with_text: bool = False) -> DataFrame:
    """Sentences of every text of ``check_requests`` and of every embedded text of ``page_content``."""
    own = requests.select(F.lit("request").alias("record_kind"), F.col("request_id").cast("long").alias("record_id"), "text")
    embedded = pages.where(F.col("text_layer") == "embedded").select(F.lit("page").alias("record_kind"), F.col("page_id").cast("long").alias("record_id"), "text")
    return sentences(own.unionByName(embedded), F.col("record_kind"), "record_id", "text", with_text)
