"""Repair of text from scanned pages: running titles, page numbers, words broken at line ends, misread characters.

The text that was never scanned gives a word bigram model, of which the words and pairs are kept that the scanned pages can ask for. How a character is
misread is learned from the pages themselves: forms that the model lacks are met with known forms that differ in one place, and expectation maximisation
finds the confusions that explain them, each with its probability. A line is then read as a noisy channel: Viterbi picks the likeliest words over the known
words that each word could stand for, by confusion probability and bigram likelihood. Running titles are found across the pages of a job, by a skeleton in
which confusable characters coincide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lineage import cut, release
from . import bits

#: Marks that scanning puts between or in the place of characters.
SPECKS = "·'.,|!lI"
#: Probability of a speck in one given way.
CONFUSION = 1e-3
#: Rounds of expectation maximisation, and the expected count from which a confusion is a part of the channel.
ROUNDS, LEAST_EXPECTED = 4, 1.5
#: Probability of an ideograph that the model lacks.
UNKNOWN_IDEOGRAPH = 1e-8
#: Share of the pairs in a word's likelihood, and how often a word must be seen for its followers to get half of that.
PAIR_SHARE, BACKOFF = 0.7, 5
#: Entries of one model. Scanned pages that ask for more are read in parts, each of which ends with the page that reaches this or ``PART_TEXT`` characters.
MODEL_ENTRIES, PART_TEXT = 400_000, 2_000_000
#: Entries that a Python worker remembers between pages.
CACHED = 400_000

_CJK = "㐀-䶿一-鿿"
_TOKEN = re.compile(r"[ཀ-ྼ]+|[ऀ-ॣॱ-ॿ]+|[㐀-䶿一-鿿]|[^\W\d_ऀ-ྼ㐀-䶿一-鿿]+(?:[’'\-][^\W\d_ऀ-ྼ㐀-䶿一-鿿]+)*")
_SCRIPTS = {"tibetan": "ཀ-ྼ", "deva": "ऀ-ॣॱ-ॿ", "cjk": _CJK, "other": "a-zA-ZÀ-ɏЀ-ӿ"}
#: A mark that stands between two letters of a script in text that was never scanned.
_GENUINE = re.compile("|".join(f"(?<=[{letters}])(?P<{name}>[·'.,|!])(?=[{letters}])" for name, letters in _SCRIPTS.items()))


def tokens(text: str) -> list[str]:
    """The words of the model: Tibetan syllables, ideographs, and words of other scripts in lower case."""
    return [t.lower() for t in _TOKEN.findall(text)]


def script_of(word: str) -> str:
    c = word[0]
    return "tibetan" if "ཀ" <= c <= "ྼ" else "cjk" if "㐀" <= c <= "鿿" else "other"


def is_legible(word: str) -> bool:
    """Whether a word has letters and is more than a number with a letter, as folios have."""
    return any(c.isalpha() for c in word) and not _NUMBERED.fullmatch(word)


_NUMBERED = re.compile(r"\d+\w?")


def pair_key(a: str, b: str) -> int:
    return xxhash.xxh64_intdigest(f"{a}\0{b}") - (1 << 63)


def mark_key(script: str, mark: str) -> str:
    """The entry of the model that counts a mark between letters of a script."""
    return f"\0{script}{mark}"


def _triples(words: list[str]) -> Iterator[str]:
    """Neighbouring ideographs, three at a time: an ideograph alone says too little about what stands in its place."""
    for a, b, c in zip(words, words[1:], words[2:]):
        if "㐀" <= a <= "鿿" and "㐀" <= b <= "鿿" and "㐀" <= c <= "鿿":
            yield a + b + c


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({
            "word": [*words, *[None] * len(pairs)],
            "pair": pd.array([*[None] * len(words), *(pair_key(*p) for p in pairs)], dtype="Int64"),
            "n": [*words.values(), *pairs.values()],
        })
        words.clear()
        pairs.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            found = tokens(text)
            words.update(found)
            words.update(_triples(found))
            words.update(mark_key(m.lastgroup, m.group()) for m in _GENUINE.finditer(text))
            pairs.update(zip(found, found[1:]))
            if len(pairs) > 400_000:
                yield flush()
    if words:
        yield flush()


class Spelling:
    """How words that the model lacks are spelled: pairs of neighbouring characters over all distinct words, and by script the share of words that are new.

    Both are bounded by the alphabets.
    """

    def __init__(self, pairs: dict[tuple[str, str], int], new: dict[str, float]):
        self.pairs, self.new = pairs, new
        self.first: Counter[str] = Counter()
        for (a, _), n in pairs.items():
            self.first[a] += n
        self.floor = 0.1
        self.alphabet = self.floor * (len(self.first) + 1)

    def log_p(self, word: str) -> float:
        """Log-probability that a word of the text is ``word``, if it is new."""
        script = script_of(word)
        if script == "cjk":
            return log(UNKNOWN_IDEOGRAPH)
        p = log(self.new.get(script) or CONFUSION)
        for a, b in zip("\0" + word, word + "\0"):
            p += log((self.pairs.get((a, b), 0) + self.floor) / (self.first.get(a, 0) + self.alphabet))
        return p


class Model:
    """Counts of words and of pairs of neighbours as log-probabilities, the spelling of new words, and the channel: log-probabilities of confusions (seen, meant)."""

    def __init__(self, words: dict[str, int], pairs: dict[int, int], total: int, channel: dict[tuple[str, str], float], spelling: Spelling, longest: int = 0):
        self.words, self.pairs, self.total, self.channel, self.spelling, self.longest = words, pairs, max(1, total), channel, spelling, longest
        self.meant: dict[str, list[tuple[str, float]]] = {}
        for (seen, meant), p in sorted(channel.items()):
            self.meant.setdefault(seen, []).append((meant, p))
        self._readings: dict[str, list[tuple[str, float]]] = {}
        self._steps: dict[tuple[str | None, str], float] = {}

    def log_p(self, word: str, before: str | None) -> float:
        """Log-probability of ``word`` after ``before``."""
        p = self._steps.get((before, word))
        if p is None:
            if len(self._steps) > CACHED:
                self._steps.clear()
            p = self._steps[before, word] = self._log_p(word, before)
        return p

    def _log_p(self, word: str, before: str | None) -> float:
        n = self.words.get(word, 0)
        p = log(n / self.total) if n else self.spelling.log_p(word)
        if before and (m := self.words.get(before, 0)):
            share = PAIR_SHARE * m / (BACKOFF + m)
            both = self.pairs.get(pair_key(before, word), 0) if n else 0
            return log((1 - share) * n / self.total + share * both / m) if both else p + log(1 - share)
        return p

    def mark(self, script: str, mark: str) -> float:
        """Log-probability that a mark between two letters was meant."""
        return log((self.words.get(mark_key(script, mark), 0) + 0.01) / (self.total + 1))

    def readings(self, word: str) -> list[tuple[str, float]]:
        """What could have been misread as ``word``, with the log-probability of the channel: itself first, then known words."""
        known = self._readings.get(word)
        if known is None:
            best = {word: 0.0}
            if is_legible(word):
                for v, p in variants(word, self.meant):
                    if v in self.words and p > best.get(v, -1e9):
                        best[v] = p
            if "ཀ" <= word[0] <= "ྼ":  # two vowels are no spelling, whether a word with one of them is known or not
                for v in one_vowel(word):
                    best.setdefault(v, log(CONFUSION))
            known = [*best.items()]
            if len(self._readings) > CACHED:
                self._readings.clear()
            self._readings[word] = known
        return known


_VOWELS = "ིེོུ"


def variants(word: str, meant: dict[str, list[tuple[str, float]]]) -> Iterator[tuple[str, float]]:
    """``word`` with one confusion taken back, and the log-probability of that confusion. An apostrophe may be a speck."""
    for width in (1, 2):
        for i in range(len(word) - width + 1):
            for m, p in meant.get(word[i : i + width], ()):
                yield word[:i] + m + word[i + width :], p
    if "'" in word:
        yield word.replace("'", ""), log(CONFUSION)


def one_vowel(word: str) -> Iterator[str]:
    """``word`` without one of two neighbouring vowels."""
    for m in _EXTRA_VOWEL.finditer(word):
        yield word[: m.start()] + word[m.end() :]


_EXTRA_VOWEL = re.compile(f"[{_VOWELS}](?=[{_VOWELS}])|(?<=[{_VOWELS}])[{_VOWELS}]")


# ---- running titles ---------------------------------------------------------

_DIGITS = "0-9༠-༳०-९０-９"
#: A line with nothing but a number: bare, in brackets or dashes, with a letter for the side of the leaf, in Roman figures, or after a word for page.
_FRAME = r"[\s\[\](){}<>༼༽«»*|·\-–—]*"
PAGE_NUMBER = re.compile(
    rf"{_FRAME}(?:(?:page|seite|folio|སྤྱི་|ཤོག་གྲངས|ཤོག་ངོས|ཤོག|第|पृष्ठ)[\s.་]*|(?:fol|pp|p|s)\.\s*)?"
    rf"(?:[{_DIGITS}]+\s*[abrv]?\s*(?:页|頁)?|(?=[ivxlc])c{{0,3}}(?:x[cl]|l?x{{0,3}})(?:i[xv]|v?i{{0,3}})){_FRAME}", re.IGNORECASE
)


_SPECKS = "[·'.,|!]"
_NO_CASE = "ऀ-ॿༀ-࿿㐀-䶿一-鿿"
_BESIDE = rf"\s\[\]()༼༽\-–{_DIGITS}"
#: What no title has: marks that close or join a sentence, a tsheg at the end, words in lower case (``l`` may be a misread I). Implied by the shape, but quick to see.
_RUNNING = r"[།༎༑༔།॥।。，；：！？、“”«»?;:…]|་\s*$|(?:^|\s)[\p{Ll}&&[^l]]"
#: Words for page with nothing but numbers beside them are no titles.
_PAGE_WORDS = r"(?i:page|seite|folio|fol|pp|p|s|སྤྱི་?|ཤོག་?|ཤོག་གྲངས་?|ཤོག་ངོས་?|第|पृष्ठ|第?[页頁]|[ivxlc]+)"
_WORD_START, _NO_OTHER = r"[\p{Lu}·l1]", "&&[^ༀ-࿿㐀-䶿一-鿿]"
#: A title without specks and numbers beside it, by script: Tibetan, scripts with case (capitalised throughout), ideographs, Devanagari and others without case.
_TITLE = (
    rf"^(?!{_PAGE_WORDS}$)(?:(?=.{{2}})[ཀ-ྼ][ཀ-ྼ་ ཾ]*(?<!་)|(?=.{{3}}){_WORD_START}[\p{{L}}\p{{M}}’019\-]*(?: +{_WORD_START}[\p{{L}}\p{{M}}’01590\-]*)*(?<!-)"
    rf"|[一-鿿]{{2,}}|(?=.{{2}})[\p{{Lo}}{_NO_OTHER}][\p{{Lo}}\p{{M}}॰\u200c\u200d \-{_NO_OTHER}]*)$"
)


def _clear(line: Column) -> Column:
    """The line without specks. ``l`` and ``I`` are specks beside letters without case."""
    return F.regexp_replace(F.when(line.rlike(f"[{_NO_CASE}]"), F.translate(line, "lI", "··")).otherwise(line), _SPECKS, "·")


def _title_skeleton(line: Column, specks: bool) -> Column:
    """What is left of a title without numbers, separators and the differences between confusable characters.

    A speck may stand between two characters or in the place of one: with ``specks`` it counts as a character, else it is left out.
    One that touches a number or stands alone is in nothing's place.
    """
    out = F.regexp_replace(_clear(line), rf"(?<=[{_DIGITS}])·|·(?=[{_DIGITS}])|(?<!\S)·(?!\S)", "")
    out = F.regexp_replace(out, rf"[{_DIGITS}\s་\[\]()༼༽\-–]+", "")
    out = out if specks else F.translate(out, "·", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "vv", "w"), "rn", "m"), "ri", "n")
    out = F.regexp_replace(F.regexp_replace(out, "cl", "d"), "[ིེོུ]+", "ི")
    return F.translate(out, "པདམcIbཪ", "བངསelhར")


def _bare(line: Column) -> Column:
    """A title without specks and without the numbers beside it. A speck at a number or at white space is white space; one in the place of a word's capital is kept."""
    bare = F.regexp_replace(_clear(line), rf"(?<=[{_DIGITS}])·|(?<=\s)·(?!\p{{Ll}})|·(?=[\s{_DIGITS}])", " ")
    bare = F.regexp_replace(bare, r"(?<=\S)·|·(?!\p{Ll})", "")
    return F.trim(F.regexp_replace(bare, rf"^[{_BESIDE}]*[\s\])༽]|[\s\[(༼][{_BESIDE}]*$", ""))


def _is_firm(line: Column) -> Column:
    """Whether a line of a title's shape is clean enough to make a title: a full stop after capitalised words may be a speck, but may also close a sentence."""
    ended = F.regexp_replace(line, rf"[\s\[(][{_BESIDE}]*$", "").rlike(r"[.,!?]$")
    return line.rlike(f"[{_NO_CASE}]") | (line.rlike(r"^\P{L}*\p{Lu}") & ~ended)


def title_lines(lines: DataFrame) -> DataFrame:
    """``(page_id, line_no)`` of title lines that stand on two or more pages of a job.

    ``lines`` has ``page_id``, ``job_id``, ``line_no``, ``line``, one row for each solid line. Pages without a job have no titles.
    Lines of one skeleton are a title if one of them is firm. A title with one character misread beyond the skeleton is matched by one of its halves.
    """
    keys = F.array_distinct(F.array(_title_skeleton(F.col("line"), False), _title_skeleton(F.col("line"), True)))
    shaped = lines.where(F.col("job_id").isNotNull() & ~F.col("line").rlike(_RUNNING)).where(_bare(F.col("line")).rlike(_TITLE))
    named = shaped.select("page_id", "job_id", "line_no", _is_firm(F.col("line")).alias("firm"), F.explode(keys).alias("key")).where(F.length("key") > 1)
    titles = named.groupBy("job_id", "key").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.max("firm").alias("firm")).where("a < b AND firm").select("job_id", "key")
    cut_ = F.floor(F.length("key") / 2).cast("int")
    # two characters are matched whole
    pieces = [F.substring("key", F.lit(1), cut_), F.substring("key", cut_ + 1, F.length("key"))]
    halves = [F.struct(F.lit(part).alias("part"), F.when(F.length("key") > 2, half).otherwise(F.col("key")).alias("half")) for part, half in enumerate(pieces)]
    split = lambda df: df.withColumn("size", F.length("key")).select("*", F.inline(F.array(*halves)))
    # a job has few titles and each title few halves, so the right side is distinct before it meets the lines
    some = split(titles).select("job_id", "size", "part", "half").distinct()
    return split(named).join(some, ["job_id", "size", "part", "half"], "left_semi").select("page_id", "line_no").distinct()


# ---- one page ---------------------------------------------------------------

_HYPHENS = "-‐‑¬\u00ad"
_HYPHEN = re.compile(r"(?P<word>[^\W\d_][\w\-’'|·]*|\w)(?P<mark>[-‐‑¬­])\s*$")
_CONTINUES = re.compile(r"\s*(?P<word>[^\W\d_ༀ-࿿一-鿿][^\W_]*)")
_WORD = re.compile(
    rf"(?P<tibetan>[{re.escape(SPECKS)}]*[ཀ-ྼ][ཀ-ྼ{re.escape(SPECKS)}]*)"
    r"|(?P<deva>[ऀ-ॣॱ-ॿ]+(?:[·'.,|!][ऀ-ॣॱ-ॿ]+)*)|(?P<cjk>[㐀-䶿一-鿿](?:[·'.,|!](?=[㐀-䶿一-鿿]))?)"
    r"|(?P<other>[^\W_ༀ-࿿ऀ-ॿ㐀-䶿一-鿿|](?:[^\W_ༀ-࿿ऀ-ॿ㐀-䶿一-鿿]|[|·]|[’'\-](?=\w))*|\|(?:[^\W_ༀ-࿿ऀ-ॿ㐀-䶿一-鿿])+)"
)


_TIBETAN_LETTERS = "".join(map(chr, (*range(0xF40, 0xF6D), *range(0xF71, 0xF7E), *range(0xF90, 0xFBD))))
_LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâçèéêëîïôùûœāīūṛśṣṭḍṇṃḥ"
_RUN = re.compile(f"([{re.escape(SPECKS)}]+)")

#: A reading: its words, and the log-probability of the channel and of all but the first word.
Reading = tuple[tuple[str, ...], float]


class PageReader:
    """Decodes the lines of one page after another."""

    def __init__(self, model: Model):
        self.model = model
        self.epsilon = log(CONFUSION)

    def options(self, m: re.Match, word: str) -> list[Reading]:
        """What a word of a page may stand for, itself first."""
        chunk, kind = m.group(), m.lastgroup
        if kind == "tibetan" and _RUN.search(chunk):
            return self._speckled(chunk)
        if kind == "cjk" and len(chunk) > 1 or kind == "deva" and any(c in SPECKS for c in chunk):
            marks = [c for c in chunk if c in SPECKS]
            clean = "".join(c for c in chunk if c not in SPECKS)
            meant = sum(self.model.mark(kind, c) for c in marks)
            return [((word,), meant + self._own(word, clean)), *(((w,), p + self.epsilon * len(marks)) for w, p in self.model.readings(clean))]
        if kind == "other" and "·" in chunk:
            out = [((word,), self.model.mark("other", "·") * word.count("·") + self._own(word, word.replace("·", "")))]
            for w in (word.replace("·", ""), word.replace("·", " ")):
                out.append(((w,), self.epsilon * word.count("·")))
            return out + self._filled(word)
        return [((w,), p) for w, p in self.model.readings(word)]

    def _own(self, word: str, clean: str) -> float:
        """What a word costs that is written with a mark in it; such words are not counted, so the word itself stands for them, less what ``log_p`` takes off."""
        return self.model.log_p(clean, None) - self.model.spelling.log_p(word) if clean else 0.0

    def _filled(self, chunk: str) -> list[Reading]:
        """Known words with a letter in the place of the chunk's only speck."""
        if chunk.count("·") != 1:
            return []
        a, _, b = chunk.partition("·")
        return [((a + c + b,), self.epsilon) for c in _LATIN_LETTERS if a + c + b in self.model.words]

    def _speckled(self, chunk: str) -> list[Reading]:
        """A Tibetan chunk with specks: as it stands, and the likeliest words of a lattice in which each run of specks is nothing, a tsheg, or one letter.

        The best path to each cut is kept for each last word, so that the words beside the chunk can choose among them; paths grow with the runs and not with
        their combinations. A syllable without specks is no longer than the longest known one, unless it stands between two runs.
        """
        model, parts = self.model, _RUN.split(chunk)
        letters, marks = parts[::2], parts[1::2]
        stands = sum(model.mark("tibetan", c) for run in marks for c in run)
        solid = tuple(x for x in letters if x)
        as_is = sum(model.log_p(b, a) for a, b in zip(solid, solid[1:]))
        out = {(chunk,): stands + as_is + model.log_p(solid[0], None) - model.spelling.log_p(chunk)}
        # best[k]: last word of the words that end before run k, to (score, words)
        n = len(letters)
        best: list[dict[str | None, tuple[float, tuple[str, ...]]]] = [{} for _ in range(n + 1)]
        best[0][None] = (0.0, ())
        for i in range(n):
            if not best[i]:
                continue
            for word, j, channel in self._arcs(letters, i):
                cost = channel + (self.epsilon if j < n else 0.0)
                for last, (score, words) in best[i].items():
                    if not word:
                        total, new, path = score + cost, last, words
                    else:
                        total, new, path = score + cost + (model.log_p(word, last) if last else 0.0), word, (*words, word)
                    if total > best[j].get(new, (-1e300,))[0]:
                        best[j][new] = (total, path)
            best[i] = {}
        for score, words in best[n].values():
            if words and score > out.get(words, -1e300):
                out[words] = score
        return [*out.items()]

    def _arcs(self, letters: list[str], i: int) -> Iterator[tuple[str, int, float]]:
        """Words from cut ``i`` on: (word, cut where it ends, channel log-probability of the specks inside)."""
        known, longest = self.model.words, max(self.model.longest, len(letters[i]))
        word, channel = letters[i], 0.0
        yield from self._with_vowel(word, i + 1, channel)
        for j in range(i + 1, len(letters)):
            left, word, channel = word, word + letters[j], channel + self.epsilon
            if len(word) > longest + 1:
                return
            if len(word) <= longest:
                yield from self._with_vowel(word, j + 1, channel)
            for c in _TIBETAN_LETTERS if left or letters[j] else ():
                if left + c + letters[j] in known:
                    yield left + c + letters[j], j + 1, channel

    def _with_vowel(self, word: str, j: int, channel: float) -> Iterator[tuple[str, int, float]]:
        yield word, j, channel
        for less in one_vowel(word):
            yield less, j, channel + self.epsilon

    def read(self, words: list[re.Match], lowered: list[str]) -> list[tuple[tuple[str, ...], bool]]:
        """For each word its likeliest reading, by Viterbi over all words, and whether that differs from what stands there.

        A word with one reading settles all before it, so the search runs from one such word to the next.
        """
        every = [self.options(m, w) for m, w in zip(words, lowered)]
        out: list[tuple[tuple[str, ...], bool]] = []
        i, n = 0, len(words)
        before = None
        while i < n:
            if len(every[i]) == 1:
                out.append((every[i][0][0], False))
                before = every[i][0][0][-1]
                i += 1
                continue
            end = i + 1
            while end < n and len(every[end]) > 1:
                end += 1
            chosen = self._viterbi(every[i:end], before, every[end][0][0][0] if end < n else None)
            out += [(ws, ws != every[i + k][0][0]) for k, ws in enumerate(chosen)]
            before, i = chosen[-1][-1], end
        return out

    def _viterbi(self, slots: list[list[Reading]], before: str | None, after: str | None) -> list[tuple[str, ...]]:
        """The likeliest sequence of readings between two settled words."""
        log_p = self.model.log_p
        paths: list[tuple[float, int, str | None]] = [(0.0, 0, before)]
        back: list[list[int]] = []
        for slot in slots:
            row, ptr = [], []
            for k, (ws, channel) in enumerate(slot):
                first = ws[0]
                score, arg = paths[0][0] + log_p(first, paths[0][2]), 0
                for j in range(1, len(paths)):
                    if (s := paths[j][0] + log_p(first, paths[j][2])) > score:
                        score, arg = s, j
                row.append((score + channel, k, ws[-1]))
                ptr.append(arg)
            paths = row
            back.append(ptr)
        last = [s + (log_p(after, w) if after else 0.0) for s, _, w in paths]
        at = max(range(len(last)), key=lambda k: (last[k], -k))
        chosen = []
        for i in range(len(slots) - 1, -1, -1):
            chosen.append(slots[i][at][0])
            at = back[i][at]
        return chosen[::-1]

    def running(self, text: str, titles: list[int]) -> tuple[str, object, list[tuple[int, str]]]:
        """The running text of a page, the line of each of its places, and the faults of lines that are found on the way."""
        lines = text.split("\n")
        faults: list[tuple[int, str]] = [(n, "header") for n in titles]
        skip = {n - 1 for n in titles}
        for i in _margins(lines, skip):
            if PAGE_NUMBER.fullmatch(lines[i]):
                faults.append((i + 1, "page_number"))
                skip.add(i)
        running = [i for i in range(len(lines)) if i not in skip]
        joined, owner = self._join(lines, running, faults)
        return joined, owner, faults

    def page(self, text: str, titles: list[int]) -> tuple[list[tuple[int, str]], list[str]]:
        """Faults by line, and the repaired paragraphs."""
        joined, owner, faults = self.running(text, titles)
        words = [*_WORD.finditer(joined)]
        lowered = [m.group().lower() for m in words]
        parts, done = [], 0
        for m, (reading, changed) in zip(words, self.read(words, lowered)):
            if not changed:
                continue
            seen = m.group()
            new = ("་" if m.lastgroup == "tibetan" else " ").join(reading)
            first = next((k for k, (a, b) in enumerate(zip(seen.lower(), new)) if a != b), min(len(seen), len(new)))
            faults.append((owner(min(m.start() + first, m.end() - 1)) + 1, "misread"))
            if seen[:1].isupper() and new:
                new = new[0].upper() + new[1:] if not seen.isupper() else new.upper()
            tail = seen[len(seen.rstrip(SPECKS)) :] if m.lastgroup == "tibetan" else ""
            if tail and joined[m.end() : m.end() + 1] in (" ", "", "\n"):
                new += "།"
            parts += joined[done : m.start()], new
            done = m.end()
        repaired = "".join(parts) + joined[done:]
        return sorted(set(faults)), [p.strip() for p in repaired.split("\n\n") if p.strip()]

    def _join(self, lines: list[str], running: list[int], faults: list[tuple[int, str]]) -> tuple[str, object]:
        """The running lines as one text; words broken at a line's end are put together, and noted."""
        out: list[str] = []
        starts: list[tuple[int, int]] = []
        size = 0

        def add(piece: str, line: int) -> None:
            nonlocal size
            starts.append((size, line))
            out.append(piece)
            size += len(piece)

        held = 0
        for k, i in enumerate(running):
            line = lines[i][held:].lstrip() if held else lines[i]
            held = 0
            if not line.strip():
                add("\n\n", i)
                continue
            follow = lines[running[k + 1]] if k + 1 < len(running) else ""
            last = line.rstrip()[-1:]
            m = _HYPHEN.search(line) if last in _HYPHENS else None
            c = _CONTINUES.match(follow) if m else None
            if m and c and self._broken(m["word"], c["word"], m["mark"]):
                faults.append((i + 1, "hyphen"))
                add(line[: m.start("mark")], i)
                rest = re.match(r"\S*", follow[c.start("word") :]).group()
                add(rest, running[k + 1])
                held = c.start("word") + len(rest)
                add(" ", running[k + 1])
            elif m and c:
                add(line.rstrip(), i)
            elif last in "་。，；：！？、”》" or "一" <= last <= "鿿":
                add(line.rstrip(), i)
            else:
                add(line.rstrip() + " ", i)

        def owner(at: int) -> int:
            lo, hi = 0, len(starts)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if starts[mid][0] <= at else (lo, mid)
            return starts[lo][1]

        return "".join(out), owner

    def _broken(self, left: str, right: str, mark: str) -> bool:
        """Whether the mark between two parts of a word is there because of the line's end."""
        if mark in "¬­":
            return True
        n = self.model.words
        a, b = left.lower(), right.lower()
        head = a.rpartition("-")[2]
        whole, compound = n.get(a + b, 0) + n.get(head + b, 0), n.get(f"{a}-{b}", 0)
        if whole or compound:
            return whole >= compound
        if any(w in n for w, _ in variants(a + b, self.model.meant)):
            return True
        return not (head in n and b in n and len(head) > 2 and len(b) > 2)


def _margins(lines: list[str], titles: set[int]) -> list[int]:
    """Lines outside the running text: from either end of the page on, as long as they are blank, titles, numbers, or too short to be a line of the page's text."""
    solid = [len(x) for i, x in enumerate(lines) if x.strip() and i not in titles]
    short = sorted(solid)[len(solid) // 2] / 2 if solid else 0
    out: dict[int, None] = {}
    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        for i in order:
            out[i] = None
            if lines[i].strip() and i not in titles and len(lines[i]) > short and not PAGE_NUMBER.fullmatch(lines[i]):
                break
    return [i for i in out if i not in titles and lines[i].strip()]


_OUT = T.StructType([
    T.StructField("faults", T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("fault", T.StringType())]))),
    T.StructField("paragraphs", T.ArrayType(T.StringType())),
])


class _Maybe(dict):
    """Words that may be known; notes which are asked for."""

    def __init__(self, known: bits.Probe):
        super().__init__()
        self.known = known
        self.asked: set[str] = set()

    def __contains__(self, word: object) -> bool:
        if word in self.asked:
            return True
        if self.known(word_hash(word)):
            self.asked.add(word)
            return True
        return False

    def get(self, word: str, default: int = 0) -> int:
        return 1 if word in self else default


def word_hash(word: str) -> int:
    """What the JVM's xxhash64 gives for a string, without its sign."""
    return xxhash.xxh64_intdigest(word, seed=42)


class _Asking(PageReader):
    """Notes the words and the pairs of neighbours that a reader may ask for, of those that may be known."""

    def __init__(self, words: bits.Probe, pairs: bits.Probe, channel: dict[tuple[str, str], float], longest: int):
        super().__init__(Model(_Maybe(words), {}, 1, channel, Spelling({}, {}), longest))
        self.asked = self.model.words.asked
        self.may_follow = pairs
        self.pairs: set[int] = set()
        self.neighbours: set[tuple[str, str]] = set()
        self.joins = False
        self.seen: dict[str, tuple[bool, list[str], list[str]]] = {}

    def ask(self, words: Iterable[str]) -> list[str]:
        """The words of these that may be known."""
        known = self.model.words
        return [w for w in words if w in known]

    def meet(self, before: Iterable[str], after: list[str]) -> None:
        for a in before:
            for b in after:
                if self.may_follow(key := pair_key(a, b)):
                    self.pairs.add(key)

    def _broken(self, left: str, right: str, mark: str) -> bool:
        if mark in "¬\u00ad":
            return True
        self.undecided = True
        a, b = left.lower(), right.lower()
        head = a.rpartition("-")[2]
        self.ask((a + b, head + b, f"{a}-{b}", head, b, *(w for w, _ in variants(a + b, self.model.meant))))
        return self.joins

    def _speckled(self, chunk: str) -> list[Reading]:
        """All first and last words of the lattice, as readings; the pairs inside are noted."""
        letters, known = _RUN.split(chunk)[::2], self.model.words
        self.ask(mark_key("tibetan", c) for c in SPECKS)
        # words that may stand before each cut, through arcs without letters too
        last: list[set[str | None]] = [set() for _ in range(len(letters) + 1)]
        last[0].add(None)
        firsts: set[str] = set()
        for i in range(len(letters)):
            for w, j, _ in self._arcs(letters, i):
                if not w:
                    last[j] |= last[i]
                    continue
                if None in last[i]:
                    firsts.add(w)
                if w in known:
                    self.meet((b for b in last[i] if b and b in known), [w])
                last[j].add(w)
        solid = self.ask(x for x in letters if x)
        for a, b in zip(solid, solid[1:]):
            self.meet([a], [b])
        return [((chunk,), 0.0), *(((w,), 0.0) for w in sorted(firsts | (last[-1] - {None})))]

    def _ends(self, m: re.Match) -> tuple[bool, list[str], list[str]]:
        """Whether a word has several readings, and the first and last words of them that may be known."""
        if (r := self.seen.get(m.group())) is None:
            here = self.options(m, m.group().lower())
            if len(self.seen) > CACHED:
                self.seen.clear()
            r = self.seen[m.group()] = (len(here) > 1, self.ask({ws[0] for ws, _ in here}), self.ask({ws[-1] for ws, _ in here}))
        return r

    def note(self, text: str, titles: list[int]) -> None:
        for self.joins in (True, False):
            self.undecided = False
            before, before_open, chunk = [], False, ""
            for m in _WORD.finditer(self.running(text, titles)[0]):
                is_open, firsts, lasts = self._ends(m)
                two = (chunk, chunk := m.group())
                if (is_open or before_open) and two not in self.neighbours:
                    if len(self.neighbours) > CACHED:
                        self.neighbours.clear()
                    self.neighbours.add(two)
                    self.meet(before, firsts)
                before, before_open = lasts, is_open
            if not self.undecided:
                break


class _Forms(PageReader):
    """Counts the words of scanned pages, and their ideographs three at a time; words with specks are left out."""

    def __init__(self):
        super().__init__(Model({}, {}, 1, {}, Spelling({}, {})))

    def _broken(self, left: str, right: str, mark: str) -> bool:
        return mark in "¬\u00ad"

    def forms(self, text: str, titles: list[int]) -> Iterator[str]:
        joined = self.running(text, titles)[0]
        yield from _triples(tokens(joined))
        for m in _WORD.finditer(joined):
            word = m.group()
            if m.lastgroup != "cjk" and not (m.lastgroup == "tibetan" and _RUN.search(word)) and "·" not in word and is_legible(word):
                yield word.lower()


def _numbers(titles: object) -> list[int]:
    return [int(x) for x in titles] if titles is not None else []


def _scanned_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader, seen = _Forms(), Counter()
    for batch in batches:
        for text, titles in zip(batch["text"], batch["titles"]):
            seen.update(reader.forms(text, _numbers(titles)))
            if len(seen) > CACHED:
                yield pd.DataFrame({"form": [*seen], "n": [*seen.values()]})
                seen.clear()
    if seen:
        yield pd.DataFrame({"form": [*seen], "n": [*seen.values()]})


def read_scans(pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``(page_id, text, titles, at)`` of every scanned page; ``titles`` holds the numbers of title lines, or is null, and ``at`` rises along each stored partition.

    With ``lines``, the recognised lines, a page whose text is blank is made of its distinct lines in their order.
    """
    scans = pages.where(F.col("text_layer") == "ocr").select(F.col("page_id").cast("long").alias("page_id"), "job_id", F.coalesce("text", F.lit("")).alias("text"))
    if lines is not None:
        # a repeated line counts once, so only the lines of pages without text are gathered, and a page has a bounded number of them
        own = lines.select(F.col("page_id").cast("long").alias("page_id"), "line_no", F.col("text").alias("line")).where(F.col("line").isNotNull())
        blank = scans.where(F.trim("text") == "").select("page_id").distinct()
        kept = own.join(blank, "page_id", "left_semi").groupBy("page_id", "line_no").agg(F.min("line").alias("line"))
        made = kept.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("lines_text"))
        scans = scans.join(made, "page_id", "left").select("page_id", "job_id", F.when(F.trim("text") == "", F.coalesce("lines_text", "text")).otherwise(F.col("text")).alias("text"))
    each = scans.where(F.trim("text") != "").select("page_id", "job_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("page_id", "job_id", (F.col("at") + 1).cast("int").alias("line_no"), "line")
    titles = title_lines(each.where(F.trim("line") != "")).groupBy("page_id").agg(F.sort_array(F.collect_list("line_no")).alias("titles"))  # lines of one page
    return cut(scans.join(titles, "page_id", "left").select("page_id", "text", "titles", F.monotonically_increasing_id().alias("at")))


# ---- the channel --------------------------------------------------------------

#: What a confusion is taken for before any is learned, by script, and how many characters that weighs as much as.
_IS_TRIPLE = f"^[{_CJK}]{{3}}$"
START, PRIOR = {"cjk": 1e-7, "other": 1e-5}, 10_000


def _gaps(form: Column, width: int) -> Column:
    """Every place of a form with ``width`` characters left out: (key, part). Something must be left of it; of three ideographs only the middle one is left out."""
    n = F.length(form)
    gap = lambda i: F.struct(F.concat(F.substring(form, F.lit(1), i - 1), F.lit("\0"), F.substring(form, i + width, n)).alias("key"), F.substring(form, i, F.lit(width)).alias("part"))
    none = F.array().cast("array<struct<key: string, part: string>>")
    letters = F.when(n >= 2 * width, F.transform(F.sequence(F.lit(1), n - width + 1), gap)).otherwise(none)
    return F.when(form.rlike(_IS_TRIPLE), F.array(gap(F.lit(2))) if width == 1 else none).otherwise(letters)


def _is_word() -> Column:
    word = F.col("word")
    return word.isNotNull() & ~word.startswith("\0") & ~word.rlike(_IS_TRIPLE)


def learn_spelling(counts: DataFrame) -> Spelling:
    """From all distinct words but ideographs. What is collected are pairs of characters, and three numbers for each script."""
    words = counts.where(_is_word() & ~F.col("word").rlike(f"^[{_CJK}]")).select("word", "n")
    framed = F.concat(F.lit("\0"), F.col("word"), F.lit("\0"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(framed, i, F.lit(2)))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    script = F.when(F.col("word").rlike("^[ཀ-ྼ]"), "tibetan").otherwise("other")
    new = words.groupBy(script.alias("script")).agg((F.count_if(F.col("n") == 1) / F.sum("n")).alias("share")).collect()
    return Spelling({(r.p[0], r.p[1]): r.n for r in pairs}, {r.script: r.share for r in new})


def learn_channel(counts: DataFrame, scans: DataFrame, total: int, spelling: Spelling) -> dict[tuple[str, str], float]:
    """Log-probabilities of confusions (seen, meant), from all scanned pages.

    A form of the pages that the model lacks is met with every known form that differs from it in one place, of one character or two. It either is a new word, or
    one of those, misread; expectation maximisation weighs these by how usual the known form is and by the confusion it takes, and estimates each confusion
    from that: expected cases over all cases of what was meant. New words are near known ones too, names above all. How often, the forms show that text which
    was never scanned has once, met with its other forms: what they would explain, and twice its deviation, is taken off.
    Ideographs are judged between their two neighbours. The result holds pairs of one or two characters, so its size follows the alphabets and not the pages.
    """
    known = counts.where(F.col("word").isNotNull() & ~F.col("word").startswith("\0")).select("word", "n")
    forms = cut(scans.select("text", "titles").mapInPandas(_scanned_forms, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")))
    is_triple = F.col("form").rlike(_IS_TRIPLE)
    sums = lambda df: df.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(x) for x, c in (("triples", is_triple), ("words", ~is_triple)))).first()
    plain = F.col("form").rlike(_IS_TRIPLE) | ~F.col("form").rlike(f"^[{_CJK}]$")
    ours, theirs = sums(forms), sums(known.withColumnRenamed("word", "form").where(plain))
    scale = F.when(is_triple, ours.triples / max(1, theirs.triples)).otherwise(ours.words / max(1, theirs.words))
    strange = forms.join(known.select(F.col("word").alias("form")), "form", "left_anti").select("form", F.col("n").cast("double").alias("n"), F.lit(True).alias("scanned"))
    once = known.where("n = 1").select(F.col("word").alias("form")).where(plain).select("form", scale.alias("n"), F.lit(False).alias("scanned"))

    @F.pandas_udf("double")
    def new_word(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda w: 2.718281828459045 ** spelling.log_p(w))

    gaps = lambda df, form: df.select("*", F.inline(F.concat(_gaps(F.col(form), 1), _gaps(F.col(form), 2))))
    odd = gaps(strange.unionByName(once).withColumn("spelled", new_word.asNondeterministic()("form")), "form").withColumnRenamed("part", "seen")
    usual = gaps(known.withColumnRenamed("n", "m"), "word").withColumnRenamed("part", "meant")
    differs = (F.col("seen") != F.col("meant")) & (F.length("seen") + F.length("meant") < 4) & ~F.concat("seen", "meant").rlike("[-’']")
    near = odd.join(usual, "key").where(differs)
    near = near.withColumn("share", F.col("m") / F.when(is_triple, F.sum("m").over(Window.partitionBy("form", "key"))).otherwise(F.lit(max(1, total))))
    alone = known.where(F.col("word").rlike(f"^[{_CJK}]$")).select(F.col("word").alias("seen"), (F.col("n") / max(1, total)).alias("own"))
    null = F.when(is_triple, F.coalesce("own", F.lit(UNKNOWN_IDEOGRAPH))).otherwise(F.col("spelled"))
    start = F.when(is_triple, START["cjk"]).otherwise(START["other"])
    evidence = cut(near.join(alone, "seen", "left").select("form", "scanned", "n", "seen", "meant", "share", null.alias("null"), start.alias("start")))
    parts = forms.select("n", F.explode(F.when(is_triple, F.array(F.substring("form", 2, 1))).otherwise(F.concat(F.split("form", ""), F.transform(_gaps(F.col("form"), 2), lambda g: g["part"])))).alias("meant"))
    often = cut(parts.where("meant <> ''").groupBy("meant").agg(F.sum("n").alias("cases")))
    release(scans.sparkSession)
    channel = None
    for _ in range(ROUNDS):
        p = F.col("start") if channel is None else F.col("p")
        weighed = (evidence if channel is None else evidence.join(channel.select("seen", "meant", "p"), ["seen", "meant"])).withColumn("w", F.col("share") * p)
        posterior = F.col("n") * F.col("w") / (F.sum("w").over(Window.partitionBy("form", "scanned")) + F.col("null"))
        cases = weighed.withColumn("e", posterior).groupBy("seen", "meant").agg(F.sum(F.when(F.col("scanned"), F.col("e")).otherwise(0.0)).alias("e"), F.sum(F.when(F.col("scanned"), 0.0).otherwise(F.col("e"))).alias("usual"), F.max("start").alias("start"))
        expected = cases.select("seen", "meant", "start", F.greatest(F.lit(0.0), F.col("e") - F.col("usual") - 2 * F.sqrt("usual")).alias("expected"))
        p = (F.col("expected") + PRIOR * F.col("start")) / (F.coalesce("cases", F.lit(0)) + F.col("expected") + PRIOR)
        channel = expected.join(often, "meant", "left").select("seen", "meant", "expected", p.alias("p"))
    rows = cut(channel.where(F.col("expected") >= LEAST_EXPECTED)).collect()  # collected from its plan, the shuffle files of all rounds would stay
    return {(r.seen, r.meant): log(r.p) for r in rows}


# ---- the model, as far as pages ask for it ---------------------------------------


class Corpus:
    """Counts of all text that was not scanned, kept as a table, and the channel learned from the scanned pages."""

    def __init__(self, pages: DataFrame, scans: DataFrame):
        texts = pages.where((F.col("text_layer") != "ocr") & F.col("text").rlike(r"\S")).select("text")
        self.counts = cut(texts.mapInPandas(_partial_counts, "word string, pair long, n long").groupBy("word", "pair").agg(F.sum("n").alias("n")))
        row = self.counts.agg(F.sum(F.when(_is_word(), F.col("n"))).alias("total"), F.max(F.when(F.col("word").rlike("^[ཀ-ྼ]"), F.length("word"))).alias("longest")).first()
        self.total, self.longest = int(row.total or 0), int(row.longest or 0)
        size = self.counts.agg(F.count("word").alias("words"), F.count("pair").alias("pairs")).first()
        self.known_words = bits.build(self.counts.select(F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("hash")), size.words)
        self.known_pairs = bits.build(self.counts.select(F.col("pair").alias("hash")), size.pairs)
        self.spelling = learn_spelling(self.counts)
        release(scans.sparkSession)
        self.channel = learn_channel(self.counts, scans, self.total, self.spelling)

    def asked(self, scans: DataFrame) -> DataFrame:
        """``(part, words, pairs)``: what each part of ``scans`` can ask for, nothing twice; nothing else of the counts could change a reading.

        A part is a run of neighbouring pages, named by the ``at`` of the first. It is stored, so entries are kept in arrays, which take less room than rows.
        """
        channel, longest, most_entries, most_text = self.channel, self.longest, MODEL_ENTRIES, PART_TEXT
        probes = scans.sparkSession.sparkContext.broadcast((self.known_words, self.known_pairs))

        def asked_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known_words, known_pairs = probes.value
            reader = _Asking(bits.Probe(known_words), bits.Probe(known_pairs), channel, longest)
            part, size = None, 0

            def flush() -> pd.DataFrame:
                out = pd.DataFrame({"part": [part], "words": [[*reader.asked]], "pairs": [[*reader.pairs]]})
                reader.asked.clear()
                reader.pairs.clear()
                reader.seen.clear()
                reader.neighbours.clear()
                return out

            for batch in batches:
                for at, text, titles in zip(batch["at"], batch["text"], batch["titles"]):
                    part = at if part is None else part
                    reader.note(text, _numbers(titles))
                    size += len(text)
                    if size >= most_text or len(reader.asked) + len(reader.pairs) >= most_entries:
                        yield flush()
                        part, size = None, 0
            if part is not None:
                yield flush()

        return cut(scans.select("at", "text", "titles").mapInPandas(asked_by, "part long, words array<string>, pairs array<long>"))

    def entries(self, asked: DataFrame) -> DataFrame:
        """``(part, word, pair, n)``: the counts of what is asked for. ``pair`` is 0 for words, as pandas would make fractions of numbers beside nulls."""
        words = self.counts.where("pair IS NULL").select("word", "n").join(asked.select("part", F.explode("words").alias("word")), "word")
        pairs = self.counts.where("pair IS NOT NULL").select("pair", "n").join(asked.select("part", F.explode("pairs").alias("pair")), "pair")
        return words.select("part", "word", F.lit(0).cast("long").alias("pair"), "n").unionByName(pairs.select("part", F.lit(None).cast("string").alias("word"), "pair", "n"))

    def model(self, scans: DataFrame, asked: DataFrame | None = None) -> Model | None:
        """One model for all of ``scans``, made on the driver. None if they ask for more than ``MODEL_ENTRIES``."""
        asked = self.asked(scans) if asked is None else asked
        if (asked.agg(F.sum(F.size("words") + F.size("pairs")).alias("n")).first().n or 0) > MODEL_ENTRIES:
            return None
        found = self.entries(asked).select("word", "pair", "n").distinct().toArrow().to_pandas()
        return _model(found, self.total, self.channel, self.spelling, self.longest)


def _model(entries: pd.DataFrame, *rest: object) -> Model:
    is_word = entries["word"].notna()
    words, pairs = entries[is_word], entries[~is_word]
    return Model(dict(zip(words["word"], words["n"].tolist())), dict(zip(pairs["pair"].tolist(), pairs["n"].tolist())), *rest)


def repair(pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``(page_id, faults, paragraphs)`` for every scanned page; ``faults`` holds ``(line_no, fault)``.

    Null and blank texts give empty arrays; with ``lines``, see ``read_scans``. Every line of a page's text is looked at; lines are those that line feeds part.
    Other columns of ``pages`` are ignored. Repeated rows of a page give its rows again.
    """
    scans = read_scans(pages, lines)
    corpus = Corpus(pages, scans)
    asked = corpus.asked(scans)
    release(scans.sparkSession)  # here, because Py4J lets go of what Python has dropped some time later
    model = corpus.model(scans, asked)
    return repair_parts(scans, corpus, asked) if model is None else repair_scans(scans, model)


def repair_parts(scans: DataFrame, corpus: Corpus, asked: DataFrame) -> DataFrame:
    """The rows of ``repair`` for any number of pages: each part meets its model where it is read, and the driver gets one number for each part."""
    starts = np.sort(asked.select("part").toArrow()["part"].to_numpy())
    shared = scans.sparkSession.sparkContext.broadcast((corpus.total, corpus.channel, corpus.spelling, corpus.longest))

    @F.pandas_udf("long")
    def part_of(at: pd.Series) -> pd.Series:
        return pd.Series(starts[np.searchsorted(starts, at.to_numpy(), "right") - 1])

    def read(pages: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": pages["page_id"], **_read(PageReader(_model(entries, *shared.value)), pages["text"], pages["titles"])})

    # ids go to pandas and back as strings, because an id may be null
    parted = scans.select(F.col("page_id").cast("string").alias("page_id"), "text", "titles", part_of("at").alias("part"))
    schema = T.StructType([T.StructField("page_id", T.StringType()), *_OUT.fields])
    done = parted.groupBy("part").cogroup(corpus.entries(asked).groupBy("part")).applyInPandas(read, schema)
    return done.select(F.col("page_id").cast("long").alias("page_id"), "faults", "paragraphs")


def _read(reader: PageReader, texts: pd.Series, heads: pd.Series) -> dict[str, list]:
    rows = [reader.page(t, _numbers(h)) for t, h in zip(texts, heads)]
    return {"faults": [[{"line_no": a, "fault": b} for a, b in f] for f, _ in rows], "paragraphs": [p for _, p in rows]}


def repair_scans(scans: DataFrame, model: Model) -> DataFrame:
    """The rows of ``repair`` for the pages that ``read_scans`` gave, by a model that every worker holds."""
    shared = scans.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.total, model.channel, model.spelling, model.longest))

    @F.pandas_udf(_OUT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader = PageReader(Model(*shared.value))
        for texts, heads in batches:
            yield pd.DataFrame(_read(reader, texts, heads))

    return scans.select("page_id", run.asNondeterministic()("text", "titles").alias("r")).select("page_id", "r.faults", "r.paragraphs")


def faults(repaired: DataFrame) -> DataFrame:
    """``(page_id, line_no, fault)``, one row for each fault of a line."""
    return repaired.select("page_id", F.inline("faults"))


def paragraphs(repaired: DataFrame) -> DataFrame:
    """``(page_id, paragraph_no, paragraph)``: the repaired running text, numbered from 1 within the page."""
    found = repaired.select("page_id", F.posexplode("paragraphs").alias("n", "paragraph"))
    return found.select("page_id", (F.col("n") + 1).alias("paragraph_no"), "paragraph")
