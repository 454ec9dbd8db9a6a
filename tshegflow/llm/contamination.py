"""Evaluation passages inside training texts, found by winnowed fingerprints.

Both sides are reduced to folded letters and fingerprinted: of every ``WINDOW`` neighbouring ``GRAM``-letter hashes the least is kept, so any shared span of
``WINDOW + GRAM - 1`` letters leaves a common fingerprint. The fingerprints of both sides are joined; hits are extended along their diagonals, and the stretches
that lie in the passage's order are chained; a document holds a passage if the chain covers enough of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lineage import cut
from . import bits

GRAM, WINDOW = 12, 8
#: An ideograph counts as so many letters.
PER_IDEOGRAPH = 3
#: Least share of a passage's fingerprints that a document must have to be looked at, and least share of its letters that the chain must cover.
CANDIDATE_SHARE, LEAST_COVERAGE = 0.08, 0.45
#: Shortest stretch of equal letters that counts, and the widest change inside running text that is bridged, in letters.
LEAST_RUN, BRIDGE = 7, 16
#: Shortest running stretch that counts, in letters: longer than a set phrase. In a passage that is shorter, its least coverage counts.
LEAST_STRETCH = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(1)
def _folds() -> np.ndarray:
    """Code point to folded letter; 0 where it is left out."""
    table = np.zeros(0x110000, np.uint32)
    for code in (*range(0x30, 0x3400), *range(0xA000, 0xD7A4), *range(0xF900, 0x20000)):
        char = chr(code)
        category = unicodedata.category(char)
        if category[0] not in "LN" and not (category in ("Mc", "Mn") and 0x900 <= code <= 0xFFF):
            continue
        base = unicodedata.normalize("NFKD", char).lower()
        base = next((c for c in base if unicodedata.category(c)[0] in "LNM"), "")
        table[code] = ord(base) if base else 0
    table[0x3400:0xA000] = np.arange(0x3400, 0xA000)
    table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
    for a, b in {"ཪ": "ར", "ྰ": "ཱ", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "ν": "v"}.items():
        table[ord(a)] = ord(b)
    return table


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters of all texts, the code point in its text that each came from, and where each text begins and the last ends."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    letters = _folds()[codes]
    at = np.flatnonzero(letters)
    letters = letters[at]
    wide = (letters >= 0x3400) & (letters < 0xA000) | (letters >= 0x20000)
    times = np.where(wide, PER_IDEOGRAPH, 1)
    if wide.any():
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at, letters = np.repeat(at, times), np.repeat(letters, times)
        letters = letters + (part.astype(np.uint32) << np.uint32(21))
    bounds = np.searchsorted(at, starts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return letters, at - starts[text], bounds


def _hashes(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of the gram at each place, by doubling; the largest value where the text ends within it."""
    h = {1: (letters.astype(np.uint64) + np.uint64(1)) * _BASE}
    mul = {1: np.uint64(0xD6E8FEB86659FD93)}
    with np.errstate(over="ignore"):
        size = 1
        while size * 2 <= GRAM:
            h[size * 2] = h[size][: len(h[size]) - size] * mul[size] + h[size][size:] if len(h[size]) > size else h[size][:0]
            mul[size * 2] = mul[size] * mul[size]
            size *= 2
        done, out = size, h[size]
        for part in sorted((s for s in h if s < size), reverse=True):
            if done + part <= GRAM:
                n = max(0, min(len(out), len(h[part]) - done))
                out = out[:n] * mul[part] + h[part][done : done + n]
                done += part
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    full = np.full(len(letters), _NONE, np.uint64)
    full[: len(out)] = out
    for k in range(1, GRAM):  # grams that would reach into the next text
        end = bounds[1:] - k
        full[end[(end >= 0) & (end >= bounds[:-1])]] = _NONE
    return full


def _slide(values: np.ndarray, width: int, pick: np.ufunc, back: bool) -> np.ndarray:
    """The least or greatest of ``width`` neighbours, from each place on or up to it."""
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        shifted = np.empty_like(out)
        if back:
            shifted[step:], shifted[:step] = out[:-step], out[:step]
        else:
            shifted[:-step], shifted[-step:] = out[step:], out[-step:]
        out, size = pick(out, shifted), size + step
    return out


def winnow(letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of all texts. A text shorter than a window keeps its least hash; one shorter than a gram has none."""
    hashes = _hashes(letters, bounds)
    if len(hashes) <= WINDOW:
        keep = np.flatnonzero(hashes != _NONE)
        return keep, hashes[keep]
    least = _slide(hashes, WINDOW, np.minimum, False)
    keep = np.flatnonzero((hashes == _slide(least, WINDOW, np.maximum, True)) & (hashes != _NONE))
    return keep, hashes[keep]


def _runs(passage: np.ndarray, text: np.ndarray, diagonal: int) -> np.ndarray:
    """(first letter in the passage, number of letters) of the equal stretches on a diagonal."""
    a, b = max(0, -diagonal), min(len(passage), len(text) - diagonal)
    if b - a < LEAST_RUN:
        return np.zeros((0, 2), np.int64)
    same = np.zeros(b - a + 2, np.int8)
    same[1:-1] = passage[a:b] == text[a + diagonal : b + diagonal]
    edges = np.flatnonzero(np.diff(same))
    runs = np.stack([edges[::2] + a, edges[1::2] - edges[::2]], 1)
    return runs[runs[:, 1] >= LEAST_RUN]


def _stretches(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int, int, int]]:
    """Running stretches, equal runs with nothing but small changes between them: (start and end in the text, start and end in the passage, letters).

    ``runs`` are (start in the text, start in the passage, letters), sorted. What may come before a run ends near its start, so runs are looked up by their end.
    """
    score = [n for _, _, n in runs]
    first = [*range(len(runs))]
    ends = [True] * len(runs)
    ending: dict[int, list[int]] = {}
    for j, (s, p, n) in enumerate(runs):
        came = -1
        for e0 in range(s - BRIDGE, s + LEAST_RUN):
            for i in ending.get(e0, ()):
                s0, p0, n0 = runs[i]
                if p0 >= p or s0 >= s:
                    continue
                gap, shift = p - p0 - n0, s - e0
                if gap <= BRIDGE and min(gap, shift) > -LEAST_RUN and (total := score[i] + n + max(gap, 0) + min(gap, shift, 0)) > score[j]:
                    score[j], first[j], came = total, first[i], i
        if came >= 0:
            ends[came] = False
        ending.setdefault(s + n, []).append(j)
    return sorted((runs[first[j]][0], s + n, runs[first[j]][1], p + n, score[j]) for j, (s, p, n) in enumerate(runs) if ends[j] and score[j] >= least)


def _cover(passage: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> tuple[float, int, int] | None:
    """Share of the passage that a chain of running stretches covers, and the chain's first and last letter in the text."""
    runs = sorted((p + d, p, n) for d in diagonals.tolist() for p, n in _runs(passage, text, d).tolist())
    if sum(n + BRIDGE for _, _, n in runs) < LEAST_COVERAGE * len(passage):
        return None  # bridged gaps and all, the runs are too few
    whole = _stretches(runs, least_stretch(len(passage)))
    if not whole:
        return None
    # stretches that follow each other in the passage's order, by the best chain that ends at each letter of the passage
    size = len(passage) + 1
    closed, opened = np.zeros(size), np.zeros(size, np.int64)
    running: list[tuple[int, int, float, int]] = []
    best = (0.0, 0, 0)
    for s, e, p, q, n in whole:
        still = []
        for e0, q0, total, begin in running:
            if e0 > s:
                still.append((e0, q0, total, begin))
            elif total > closed[q0]:
                closed[q0], opened[q0] = total, begin
        running = still
        total, begin = float(n), s
        reach = min(size, p + max(1, n // 4))
        laps = closed[:reach] - np.maximum(0, np.arange(reach) - p)
        at = int(laps.argmax())
        if closed[at] and n + laps[at] > total:
            total, begin = n + float(laps[at]), int(opened[at])
        for e0, q0, t0, b0 in running:
            lap = max(0, e0 - s, q0 - p)
            if lap < n // 4 and t0 + n - lap > total:
                total, begin = t0 + n - lap, b0
        running.append((e, q, total, begin))
        best = max(best, (total, begin, e - 1), key=lambda c: c[0])
    return min(1.0, best[0] / max(1, len(passage))), best[1], best[2]


def least_stretch(letters: int) -> int:
    """Shortest running stretch that counts in a passage of so many letters."""
    return min(LEAST_STRETCH, int(LEAST_COVERAGE * letters))


# ---- the join ------------------------------------------------------------------

BATCH_CHARS = 2_000_000
#: Fingerprints of passages that are broadcast (16 bytes each); beyond that, both sides are shuffled by fingerprint.
BROADCAST_PRINTS = 1_000_000
#: Candidates whose pairs of text and passage are broadcast.
BROADCAST_PAIRS = 200_000


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BATCH_CHARS):
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end


def _prints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place) of the fingerprints of all texts."""
    letters, _, bounds = fold(texts)
    at, hashes = winnow(letters, bounds)
    text = np.searchsorted(bounds, at, "right") - 1
    return text, hashes, at - bounds[text]


def _passage_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, texts = batch["passage_id"].to_numpy(), batch["passage"].tolist()
        for begin, end in _chunks(texts):
            text, hashes, at = _prints(texts[begin:end])
            each = np.bincount(text, minlength=end - begin)
            yield pd.DataFrame({"passage_id": ids[begin:end][text], "hash": hashes.view(np.int64), "at": at.astype(np.int32), "prints": each[text].astype(np.int32)})


def candidates(texts: DataFrame, prints: DataFrame, count: int, share: float | None = None) -> DataFrame:
    """``(text_id, passage_id, diagonals)``: texts that have at least ``share`` of a passage's fingerprints, and how far text and passage are shifted at each.

    ``texts`` has ``text_id`` and ``text``. Both sides meet on the fingerprint. Fingerprints of texts are first looked up in a filter of bounded size, so few of them
    are more than read. Copies of a text have one ``text_id`` and are put together before the shuffle.
    """
    words = texts.sparkSession.sparkContext.broadcast(bits.build(prints, count))

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found = batch["text_id"].to_numpy(), batch["text"].tolist()
            for begin, end in _chunks(found):
                text, hashes, at = _prints(found[begin:end])
                kept = bits.contains(words.value, hashes)
                if kept.any():
                    yield pd.DataFrame({"text_id": ids[begin:end][text[kept]], "hash": hashes[kept].view(np.int64), "place": at[kept].astype(np.int32)})

    found = texts.mapInPandas(marks, "text_id long, hash long, place int")
    met = found.join(F.broadcast(prints) if count <= BROADCAST_PRINTS else prints, "hash")
    pairs = met.groupBy("text_id", "passage_id").agg(F.size(F.collect_set("at")).alias("shared"), F.max("prints").alias("prints"), F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    return pairs.where(F.col("shared") >= (CANDIDATE_SHARE if share is None else share) * F.col("prints")).select("text_id", "passage_id", "diagonals")


_COVER = T.StructType([T.StructField("coverage", T.DoubleType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])


@lru_cache(4096)
def _letters(passage: str) -> np.ndarray:
    return fold([passage])[0]


@F.pandas_udf(_COVER)
def _extend(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, passages, diagonals in batches:
        rows = []
        for text, passage, shifts in zip(texts, passages, diagonals):
            letters, origin, _ = fold([text])
            found = _cover(_letters(passage), letters, np.sort(np.asarray(shifts, np.int64)))
            rows.append((round(found[0], 4), int(origin[found[1]]), int(origin[found[2]]) + 1) if found else (0.0, 0, 0))
        yield pd.DataFrame(rows, columns=["coverage", "start_pos", "end_pos"])


def leaks(documents: DataFrame, items: DataFrame, share: float | None = None) -> DataFrame:
    """``(doc_id, item_id, coverage, start_pos, end_pos)`` for every document that holds about half or more of an item's passage as running text.

    A stretch counts from ``LEAST_STRETCH`` letters on, or from the least coverage of a passage if that is shorter. A passage needs ``GRAM`` letters to have a
    fingerprint, and ``WINDOW + GRAM - 1`` for the guarantee that a text that holds it has a common one. Null and empty texts and passages match nothing; repeated
    documents give their rows again, repeated items count once, and an ``item_id`` with several passages gives a row for each that leaked. Other columns are ignored.
    """
    base = documents.where(F.col("text").rlike(r"\S")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id"))
    passages = cut(items.where(F.col("passage").rlike(r"\S")).select(F.col("item_id").cast("long").alias("item_id"), "passage").distinct().withColumn("passage_id", F.xxhash64("item_id", "passage")))
    prints = cut(passages.select("passage_id", "passage").mapInPandas(_passage_prints, "passage_id long, hash long, at int, prints int"))
    count = prints.count()
    pairs = cut(candidates(base.select("text_id", "text"), prints, count, share))
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    done = base.join(few(pairs), "text_id").join(passages, "passage_id").select("doc_id", "item_id", _extend.asNondeterministic()("text", "passage", "diagonals").alias("c"))
    return done.where(F.col("c.coverage") >= LEAST_COVERAGE).select("doc_id", "item_id", "c.coverage", "c.start_pos", "c.end_pos")
