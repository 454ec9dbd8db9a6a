"""Checking texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import syllables


def check_stream(texts: DataFrame, inventory: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The faults of ``syllables.check_texts`` for a stream of whole texts, without the information rows.

    Every token carries the one before it, so no state is kept and nothing is shuffled; ``inventory`` is a static table. The same plan works on a batch.
    """
    tokens = syllables.tokenize(texts, key, text)
    judged = syllables.judge(syllables.parse(tokens), inventory).drop("context")
    before = syllables.judge(syllables.parse(judged.select(*(F.col(c).alias("token" if c == "syllable" else c) for c in judged.columns if c not in ("kind", "parts", "error_type", "severity", "component", "message", "corpus_hit")), F.struct("kind", "parts", "error_type", "severity", "component", "message", "corpus_hit").alias("own")).withColumn("syllable", F.col("before"))), inventory)
    return syllables.token_errors(before.select("doc_id", "token_no", "position", F.col("token").alias("syllable"), "own.*", F.when(F.col("before").isNotNull(), F.col("context")).alias("before_context")))
