"""One object for those who check texts of all kinds against one lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import lexicon, syllables
from .streaming import checks


class Checker:
    """Checks tables of texts. ``words`` are the headwords of a lexicon, in the column ``word``; without them no word is unknown."""

    def __init__(self, words: DataFrame | None = None, word: str = "word_normalized"):
        self.inventory = None if words is None else lexicon.inventory(words, word)

    def parse(self, syllable_rows: DataFrame, syllable: str = "syllable") -> DataFrame:
        """The rows with the parts of their syllable."""
        return syllables.parse(syllable_rows, syllable)

    def check(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """All faults of all texts; a stream of texts is checked as it arrives, without information rows."""
        if texts.isStreaming:
            return checks.check_stream(texts, self.inventory, key, text)
        return syllables.check_texts(texts, self.inventory, key, text)

    def log(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row of figures for each text."""
        return syllables.check_log(texts, self.check(texts, key, text), key, text)

    def check_syllables(self, syllable_rows: DataFrame, syllable: str = "syllable") -> DataFrame:
        """The outcome of each distinct syllable."""
        return syllables.outcomes(syllable_rows.select(F.col(syllable).alias("syllable")), self.inventory)
