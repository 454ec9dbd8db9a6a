"""A corpus made of ``lineitem`` in which every syllable's outcome is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# Syllables and their outcomes without a corpus - kind, error type, component, suffix and post-suffix for the particle after them.
GOLDEN = tuple(
    tuple(None if f == "." else f for f in row.split())
    for row in """
བོད syllable . . ད .|ཡིག syllable . . ག .|སྐད syllable . . ད .|ཀྱི syllable . . - .|གི syllable . . - .|གྱི syllable . . - .|འི syllable . . - .|ཡི syllable . . - .
ཀྱིས syllable . . ས .|གིས syllable . . ས .|གྱིས syllable . . ས .|སུ syllable . . - .|ཏུ syllable . . - .|དུ syllable . . - .|རུ syllable . . - .|ན syllable . . - .
ལ syllable . . - .|ཤིག syllable . . ག .|ཞིག syllable . . ག .|ཤིང syllable . . ང .|ཡུལ syllable . . ལ .|དེབ syllable . . བ .|ཚོགས syllable . . ག ས|དགའ syllable . . འ .
ཁྱི syllable . . - .|རྒྱལ syllable . . ལ .|བསྒྲུབས syllable . . བ ས|ནའང exception . . འ .|གཀར syllable invalid_prefix_combination prefix . .|བོདབ syllable unparsed_characters structure . .
ལའར syllable invalid_post_suffix structure . .|ཨེརྡ syllable consonant_after_vowel structure . .|ཨེཨོརོ syllable multiple_vowels structure . .|ཕ༹ཀལ syllable unusual_mark_position pattern . .
ཀྰ syllable encoding_error encoding . .|ཀིུ syllable double_vowel pattern . .|ཀཁགངཅཆཇཉ syllable syllable_too_long pattern . .|ེབ syllable missing_root root . .|ཧཧིབ syllable unparsed_characters structure . .
པདྨ syllable unparsed_characters structure . .|བྱབབ syllable unparsed_characters structure . .|༢༠༢༦ skipped . . . .|༄༅ skipped . . . .|abc other . . . .|ཡིབ syllable . . བ .|མཐོའི syllable . . འ .
སྐདའི syllable invalid_post_suffix structure . .|ཀཔ syllable invalid_suffix suffix . .|ངྲ syllable invalid_subscript_combination subscript . .|ཀཁགངཅཆ syllable too_many_consonants structure . .
""".replace("\n", "|").strip("|").split("|")
)
# The check that finds the fault of each faulty syllable of the corpus.
STAGES = {
    "pattern": "ཕ༹ཀལ ཀྰ ཀིུ ཀཁགངཅཆཇཉ".split(), "completeness": "བོདབ ལའར ཨེརྡ ཨེཨོརོ སྐདའི ཀཁགངཅཆ".split(), "component": "གཀར ེབ ཧཧིབ པདྨ བྱབབ ཀཔ ངྲ".split(),
}
# Syllable, then prefix, superscript, root, subscripts, vowel, suffix, suffix vowel, post-suffix and what is left; a dot where there is none.
GOLDEN_PARTS = """
བོད . . བ . ོ ད . . .|ཡིག . . ཡ . ི ག . . .|སྐད . ས ཀ . . ད . . .|ཀྱི . . ཀ ྱ ི . . . .|གི . . ག . ི . . . .|གྱི . . ག ྱ ི . . . .|འི . . འ . ི . . . .|ཡི . . ཡ . ི . . . .|ཀྱིས . . ཀ ྱ ི ས . . .|གིས . . ག . ི ས . . .
གྱིས . . ག ྱ ི ས . . .|སུ . . ས . ུ . . . .|ཏུ . . ཏ . ུ . . . .|དུ . . ད . ུ . . . .|རུ . . ར . ུ . . . .|ན . . ན . . . . . .|ལ . . ལ . . . . . .|ཤིག . . ཤ . ི ག . . .|ཞིག . . ཞ . ི ག . . .|ཤིང . . ཤ . ི ང . . .
ཡུལ . . ཡ . ུ ལ . . .|དེབ . . ད . ེ བ . . .|ཚོགས . . ཚ . ོ ག . ས .|དགའ ད . ག . . འ . . .|ཁྱི . . ཁ ྱ ི . . . .|རྒྱལ . ར ག ྱ . ལ . . .|བསྒྲུབས བ ས ག ྲ ུ བ . ས .|ནའང . . ན . . འ . . ང|གཀར ག . ཀ . . ར . . .
བོདབ . . བ . ོ ད . . བ|ལའར . . ལ . . འ . . ར|ཨེརྡ . ར ད . . . . . .|ཨེཨོརོ . . ཨ . ེ ཨ . . ོརོ|ཕ༹ཀལ . . ཕ . . . . . ༹ཀལ|ཀྰ . . ཀ ྰ . . . . .|ཀིུ . . ཀ . ི . . . ུ|ཀཁགངཅཆཇཉ . . ཀ . . ཁ . . གངཅཆཇཉ|ེབ . . . . ེ བ . . .
ཧཧིབ . . ཧ . ི བ . . ཧ|པདྨ . . པ . . ད . . ྨ|བྱབབ . . བ ྱ . བ . . བ|ཡིབ . . ཡ . ི བ . . .|མཐོའི མ . ཐ . ོ འ ི . .|སྐདའི . ས ཀ . . ད . . འི|ཀཔ . . ཀ . . པ . . .|ངྲ . . ང ྲ . . . . .|ཀཁགངཅཆ . . ཀ . . ཁ . . གངཅཆ
"""
DELIMITERS = ("\u0f0b", "\u0f0b", "\u0f0b", "\u0f0d ", "\u200b\u0f0b", "\n")


def golden(spark: SparkSession) -> DataFrame:
    """``(atom, syllable, kind, error_type, component, suffix, post_suffix)``."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(GOLDEN)], "atom int, syllable string, kind string, error_type string, component string, suffix string, post_suffix string")


def atoms(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` with the token that each row stands for."""
    rows = table(spark, folder, "lineitem")
    atom = F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber"), F.lit(50))
    lits = lambda xs: F.array(*map(F.lit, xs))
    token = F.concat(F.get(lits([r[0] for r in GOLDEN]), atom.cast("int")), F.get(lits(DELIMITERS), F.pmod("l_partkey", F.lit(6)).cast("int")))
    return rows.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", token.alias("tok"))


def texts(spark: SparkSession, folder: str, by_page: bool = False) -> DataFrame:
    """``(doc_id[, page_number], text)``: the tokens of an order, in order. An order has a handful of rows."""
    rows = atoms(spark, folder)
    keys = ["doc_id"]
    if by_page:
        rows = rows.withColumn("page_number", (1 + F.floor(F.col("l_linenumber") / 3)).cast("int"))
        keys.append("page_number")
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "tok")))
    return rows.groupBy(keys).agg(parts.alias("parts")).select(*keys, F.array_join(F.transform("parts", lambda p: p["tok"]), "").alias("text"))
