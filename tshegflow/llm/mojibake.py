"""Texts that were decoded with the wrong character encoding.

A multinomial classifier on hashed byte bigrams is fitted on clean texts and on the same texts garbled through every known encoding chain.
It names the chain of each suspect stretch; the chain is undone, and the result must decode strictly and read as clean text again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most texts that the classifier is fitted on; the fitted tables have a fixed size, whatever the corpus.
TRAINING_TEXTS = 2_000
#: Longest text that the classifier is fitted on, in characters; with the number of texts it bounds what the driver holds.
TRAINING_LENGTH = 20_000
BUCKETS = 1 << 16
SMOOTHING = 0.01
#: How many nats a chain must lead the clean class by.
MARGIN = 6.0
#: A bigram seen less often than this among clean texts makes a text a candidate.
COMMON_COUNT = 3
#: Nats per bigram that restored text may fall short of typical clean text.
SLACK = 3.0


def _single_byte(codec: str) -> tuple[Callable[[bytes], str], Callable[[str], bytes]]:
    """Decoder and encoder of a single-byte encoding in which undefined bytes become the control character of the same number."""
    to = {b: bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)}
    back = {ord(c): b for b, c in to.items()}

    def encode(text: str) -> bytes:
        try:
            return bytes(map(back.__getitem__, map(ord, text)))
        except KeyError:
            raise UnicodeError(codec) from None

    return lambda data: data.decode("latin-1").translate(to), encode


@dataclass(frozen=True)
class Chain:
    """``garble`` is what happened to a text, ``restore`` undoes it or raises UnicodeError; it is None where nothing can be undone."""

    name: str
    garble: Callable[[str], str]
    restore: Callable[[str], str] | None


def _utf8_as(name: str, decode: Callable[[bytes], str], encode: Callable[[str], bytes]) -> Chain:
    return Chain(f"utf-8 read as {name}", lambda t: decode(t.encode()), lambda t: encode(t).decode())


def _twice(name: str, decode: Callable[[bytes], str], encode: Callable[[str], bytes]) -> Chain:
    return Chain(f"utf-8 read as {name}, twice", lambda t: decode(decode(t.encode()).encode()), lambda t: encode(encode(t).decode()).decode())


def _python(codec: str) -> tuple[Callable[[bytes], str], Callable[[str], bytes]]:
    return lambda b: b.decode(codec, "replace"), lambda t: t.encode(codec)


CHAINS = (
    _utf8_as("latin-1", *_single_byte("latin-1")),
    _utf8_as("windows-1252", *_single_byte("cp1252")),
    _utf8_as("windows-1251", *_single_byte("cp1251")),
    _utf8_as("mac-roman", *_single_byte("mac-roman")),
    _utf8_as("cp437", *_single_byte("cp437")),
    _utf8_as("koi8-r", *_single_byte("koi8-r")),
    _utf8_as("gb18030", *_python("gb18030")),
    _twice("windows-1252", *_single_byte("cp1252")),
    _twice("latin-1", *_single_byte("latin-1")),
    *(Chain(f"gb18030 read as {name}", lambda t, d=decode: d(t.encode("gb18030")), lambda t, e=encode: e(t).decode("gb18030")) for name, (decode, encode) in (("latin-1", _single_byte("latin-1")), ("windows-1252", _single_byte("cp1252")))),
    Chain("windows-1252 read as cp437", lambda t: t.encode("cp1252", "replace").decode("cp437"), lambda t: t.encode("cp437").decode("cp1252")),
    Chain("utf-16 with bytes swapped", lambda t: t.encode("utf-16-le", "surrogatepass").decode("utf-16-be", "replace"), lambda t: t.encode("utf-16-be").decode("utf-16-le")),
    Chain("utf-8 read as ascii", lambda t: "".join("�" * (len(c.encode()) if ord(c) > 127 else 0) or c for c in t), None),
    Chain("windows-1252 read as utf-8", lambda t: t.encode("cp1252", "replace").decode("utf-8", "replace"), None),
)

# Tibetan and Devanagari never join other letters within a garbled stretch.
_STRETCH = re.compile(r"[ༀ-྿࿀-࿿ऀ-ॿ]+|[^\x00-\x7fༀ-࿿ऀ-ॿ]+")
_PARTS = re.compile(r"[⺀-鿿豈-﫿︰-￼“”‘’…—–]+|[^⺀-鿿豈-﫿︰-￼“”‘’…—–]+")


def _context(text: str, a: int, b: int) -> bytes:
    """The stretch with the ASCII characters beside it, as bytes."""
    left = text[a - 1] if a and text[a - 1].isascii() else " "
    right = text[b] if b < len(text) and text[b].isascii() else " "
    return (left + text[a:b] + right).encode("utf-8", "surrogatepass")


def _bigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    return (b[:-1] << 8 | b[1:]) % BUCKETS


#: One clean class for each, so that a rare script is not held against the frequent ones.
SCRIPTS = ("Tibetan", "Devanagari", "CJK", "other")


def _script(stretch: str) -> int:
    first = stretch[0]
    return 0 if "ༀ" <= first <= "࿿" else 1 if "ऀ" <= first <= "ॿ" else 2 if re.search("[⺀-鿿豈-﫿︰-￼]", stretch) else 3


class Classifier:
    """Log-probabilities of bigram buckets: the first rows are the clean classes by script, then come the chains."""

    def __init__(self, log_p: np.ndarray, common: np.ndarray, floors: np.ndarray):
        self.log_p, self.common, self.floors = log_p, common, floors
        self.unseen = log_p.min(1) + 1

    @classmethod
    def fit(cls, texts: list[str]) -> Classifier:
        counts = np.zeros((len(SCRIPTS) + len(CHAINS), BUCKETS))
        for start in range(0, len(texts), 100):
            some = texts[start : start + 100]
            for script, row in enumerate(counts[: len(SCRIPTS)]):
                row += cls._count(some, script)
            for row, chain in zip(counts[len(SCRIPTS) :], CHAINS):
                row += cls._count([chain.garble(t) for t in some])
        log_p = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)
        clean = counts[: len(SCRIPTS)]
        floors = (clean * log_p[: len(SCRIPTS)]).sum(1) / np.maximum(1.0, clean.sum(1)) - SLACK
        common = clean.sum(0) >= COMMON_COUNT
        buckets = np.arange(BUCKETS)
        common |= (buckets >> 8 < 128) & (buckets & 255 < 128)
        return cls(log_p, common, floors)

    @staticmethod
    def _count(texts: list[str], script: int | None = None) -> np.ndarray:
        # each stretch ends and begins with ASCII, so joining them adds bigrams of two ASCII characters only
        data = b"\n".join(_context(t, *m.span()) for t in texts for m in _STRETCH.finditer(t) if script is None or _script(m.group()) == script)
        return np.bincount(_bigrams(data), minlength=BUCKETS) if len(data) > 1 else np.zeros(BUCKETS, np.int64)

    def suspect(self, text: str) -> bool:
        """Whether a bigram occurs that is not common among clean texts."""
        if text.isascii():
            return False
        return not self.common[_bigrams(text.encode("utf-8", "surrogatepass"))].all()

    def scores(self, data: bytes) -> tuple[float, np.ndarray]:
        """Log-likelihood of the best clean class, and of each chain."""
        all_ = self.log_p[:, _bigrams(data)].sum(1)
        return float(all_[: len(SCRIPTS)].max()), all_[len(SCRIPTS) :]

    def reads_clean(self, text: str) -> bool:
        """Whether restored text is as likely under a clean class as clean text is, or has no bigram that clean texts lack."""
        slack, known = 0.0, True
        for m in _STRETCH.finditer(text):
            bigrams = _bigrams(_context(text, *m.span()))
            p = self.log_p[: len(SCRIPTS), bigrams]
            slack += float((p.sum(1) - self.floors * len(bigrams)).max())
            known = known and bool((p > self.unseen[: len(SCRIPTS), None]).any(0).all())
        return known or slack >= 0

    def undo(self, text: str, a: int, b: int) -> tuple[str, int] | None:
        """Restored stretch and chain of ``text[a:b]``; the stretch itself where its chain cannot be undone; None where it is clean."""
        clean, scores = self.scores(_context(text, a, b))
        lost = "�" in text[a:b]
        order = [int(r) for r in np.argsort(-scores, kind="stable") if scores[r] >= clean + MARGIN]
        for row in order:
            if CHAINS[row].restore is None:
                continue
            try:
                fixed = CHAINS[row].restore(text[a:b])
            except UnicodeError:
                continue
            if fixed != text[a:b] and self.reads_clean(text[max(0, a - 1) : a] + fixed + text[b : b + 1]):
                return fixed, row
        # what no chain restores: characters that were lost in decoding, or a two-byte decoding that ended in the middle
        if lost:
            return text[a:b], order[0] if order else len(CHAINS) - 1
        if order and CHAINS[order[0]].name.endswith("read as gb18030") and scores[order[0]] > clean + 4 * MARGIN:
            return text[a:b], order[0]
        return None

    def repair(self, text: str | None) -> tuple[bool, str | None, str | None, bool]:
        """Whether ``text`` is garbled, the chain, the restored text, and whether all of it could be restored."""
        if not text or not ("�" in text or self.suspect(text)):
            return False, None, text, True
        pieces: list[tuple[int, int, str, int]] = []
        chain_of: dict[int, int] = {}
        for m in _STRETCH.finditer(text):
            a, b = m.span()
            found = self.undo(text, a, b)
            spans = [(a, b, found)] if found else []
            if not found and (parts := [*_PARTS.finditer(text, a, b)])[1:]:
                spans = [(p.start(), p.end(), f) for p in parts if (f := self.undo(text, p.start(), p.end()))]
            for x, y, f in spans:
                pieces.append((x, y, *f))
                chain_of[f[1]] = chain_of.get(f[1], 0) + y - x
        if not pieces:
            return False, None, text, True
        chain = max(chain_of, key=lambda c: (chain_of[c], -c))
        out, done, whole = [], 0, True
        for x, y, fixed, _ in pieces:
            out += text[done:x], fixed
            done, whole = y, whole and fixed != text[x:y]
        return True, CHAINS[chain].name, "".join(out) + text[done:], whole


def training_texts(pages: DataFrame, limit: int = TRAINING_TEXTS) -> list[str]:
    """At most ``limit`` texts of at most ``TRAINING_LENGTH`` characters, spread over the corpus by hash, of the layers whose text was not imported."""
    rows = pages.where(F.col("text_layer").isin("embedded", "ocr") & F.col("text").rlike(r"\S") & (F.length("text") <= TRAINING_LENGTH)).select("text", F.xxhash64("page_id").alias("at"))
    texts = [r.text for r in rows.orderBy("at", "text").limit(limit).collect()]
    # leave out what shows damage by itself
    return [t for t in texts if "�" not in t and not re.search("[\x80-\x9f]", t)]


def fit(pages: DataFrame, limit: int = TRAINING_TEXTS) -> Classifier:
    """The classifier for these pages. An empty table gives one that only knows lost characters."""
    return Classifier.fit(training_texts(pages, limit))


_RESULT = T.StructType([
    T.StructField("garbled", T.BooleanType()),
    T.StructField("chain", T.StringType()),
    T.StructField("restored", T.StringType()),
    T.StructField("complete", T.BooleanType()),
])


def _repaired(df: DataFrame, text: str, model: Classifier) -> Column:
    shared = df.sparkSession.sparkContext.broadcast((model.log_p, model.common, model.floors))

    @F.pandas_udf(T.ArrayType(_RESULT))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Classifier(*shared.value)
        names = _RESULT.names
        clean = [None]
        for batch in batches:
            out = []
            for texts in batch:
                row = []
                for t in texts if texts is not None else clean:
                    garbled, chain, restored, complete = own.repair(t)
                    row.append(dict(zip(names, (True, chain, restored, complete))) if garbled else None)
                out.append(row)
            yield pd.Series(out)

    return run.asNondeterministic()(F.col(text))


def repair_pages(pages: DataFrame, model: Classifier) -> DataFrame:
    """``(record_kind, page_id, word_no, original, chain, restored, complete)``: one row for each garbled page text (``page``, word 0) and page word (``word``, from 1).

    ``complete`` is false where some of the text is lost; ``restored`` then holds what could be restored and the rest as it stands. Null and empty texts
    are never garbled; repeated rows give their rows again.
    """
    texts = F.concat(F.array(F.col("text")), F.coalesce(F.transform("words", lambda w: w["text"]), F.array().cast("array<string>")))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), texts.alias("texts"))
    done = base.withColumn("results", _repaired(base, "texts", model))
    each = done.select("page_id", "texts", F.posexplode("results").alias("word_no", "r")).where("r IS NOT NULL")
    return each.select(
        F.when(F.col("word_no") == 0, "page").otherwise("word").alias("record_kind"), "page_id", F.col("word_no").cast("int").alias("word_no"),
        F.get("texts", F.col("word_no")).alias("original"), "r.chain", "r.restored", "r.complete",
    )
