"""Parts of syllables, their faults, and particles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tshegflow.functions import letters as L
from tshegflow.functions import text as X
from tshegflow.operators import lexicon, syllables
from tshegflow.plans import synthetic
from tshegflow.streaming.checks import check_stream

# syllable: prefix superscript root subscripts vowel suffix suffix_vowel post_suffix unparsed; a dot where there is none
PARSED = """
བོད . . བ . ོ ད . . .|སྐད . ས ཀ . . ད . . .|ལ . . ལ . . . . . .|བསྒྲུབས བ ས ག ྲ ུ བ . ས .|ཚོགས . . ཚ . ོ ག . ས .|དགའ ད . ག . . འ . . .|ཁྱི . . ཁ ྱ ི . . . .|མཐོའི མ . ཐ . ོ འ ི . .
ངསྐ . ས ཀ . . . . . .|ེབ . . . . ེ བ . . .|ཧཧིབ . . ཧ . ི བ . . ཧ|བྱབབ . . བ ྱ . བ . . བ|ལངའི . . ལ . . འ ི . ང|གང . . ག . . ང . . .|དཀ ད . ཀ . . . . . .|ྐི . . ཀ . ི . . . .|རྒྱལ . ར ག ྱ . ལ . . .
འི . . འ . ི . . . .|ལའི . . ལ . . འ ི . .|སྐདའི . ས ཀ . . ད . . འི|་ . . . . . . . . ་
"""


def test_parts(spark):
    rows = [r.split() for r in PARSED.replace("\n", "|").split("|") if r]
    got = {r.syllable: r.parts.asDict() for r in syllables.parse(spark.createDataFrame([(r[0],) for r in rows], "syllable string")).collect()}
    want = {s: {p: (("" if p in ("subscripts", "unparsed") else None) if w == "." else w) for p, w in zip(syllables.PARTS, parts)} for s, *parts in rows}
    assert got == want


def test_golden_outcomes(spark):
    golden = synthetic.golden(spark)
    got = {r.syllable: (r.kind, r.error_type, r.component, *((r.context.suffix, r.context.post_suffix) if r.context else (None, None))) for r in syllables.outcomes(golden).collect()}
    assert got == {r.syllable: (r.kind, r.error_type, r.component, r.suffix, r.post_suffix) for r in golden.collect()}


def test_more_outcomes(spark):
    cases = {"ཪ": "encoding_error", "ཨོཾ": "unparsed_characters", "བོད\r": "unparsed_characters", "ལངའི": "unparsed_characters", "ངསྐ": None, "": None}
    got = {r.syllable: r.error_type for r in syllables.outcomes(spark.createDataFrame([(s,) for s in cases], "syllable string")).collect()}
    assert got == cases


def test_corpus_has_three_states(spark):
    words = spark.createDataFrame([(s,) for s in ("ཡིབ", "གཀར", "པདྨ", "ཀིུ")], "syllable string")
    seed = lexicon.inventory(spark.createDataFrame([(w,) for w in L.SEED_WORDS], "word_normalized string"))
    hit = lambda inventory: {r.syllable: (r.error_type, r.corpus_hit) for r in syllables.outcomes(words, inventory).collect()}
    assert hit(seed) == {"ཡིབ": ("unknown_word", False), "གཀར": ("invalid_prefix_combination", False), "པདྨ": ("unparsed_characters", True), "ཀིུ": ("double_vowel", None)}
    assert hit(seed.limit(0))["ཡིབ"] == (None, None)


PARTICLES = {
    "བོད་ཀྱི་": [], "ཚོགས་ཀྱི་": [], "བོད་གི་": [(4, "གི", "ཀྱི")], "ཁྱི་དུ་": [(4, "དུ", "ར")], "གཀར་ཀྱི་": [], "ཀྱི་བོད་": [], "བོད་༢༠༢༦་གི་": [], "བོད། གི་": [(5, "གི", "ཀྱི")],
    "ཤིང་ས་": [], "བོད\u200b་གི་": [(5, "གི", "ཀྱི")], "ཡུལ་ཏུ་": [],
}


def test_particles(spark):
    texts = spark.createDataFrame([*enumerate(PARTICLES)], "doc_id long, text string")
    found = syllables.check_texts(texts).cache()
    got = {t: [] for t in PARTICLES}
    for r in found.where("component = 'particle'").orderBy("doc_id", "position").collect():
        got[[*PARTICLES][r.doc_id]].append((r.position, r.word, r.suggestion))
    assert got == PARTICLES
    key = lambda r: (r.doc_id, r.position, r.error_type)
    assert sorted(check_stream(texts).collect(), key=key) == sorted(found.where("severity <> 'info'").collect(), key=key)


def test_syllables_beyond_the_broadcast(spark):
    """The most frequent syllables are looked up and the others judged in place: the rows stay the same."""
    texts = synthetic.texts(spark, "/root/testdata/sf0.001").unionByName(spark.createDataFrame([(-1, "ཡིབ་abc་ཀིུ"), (-2, "ནའང་ གི་x"), (-3, None)], "doc_id long, text string"))
    inventory = spark.createDataFrame([("བོད",), ("གཀར",), ("ཀྱི",), (None,)], "syllable string")
    before = syllables.BROADCAST_SYLLABLES
    try:
        rows = []
        for most in (before, 3, 0):
            syllables.BROADCAST_SYLLABLES = most
            rows.append(sorted(map(str, syllables.check_texts(texts, inventory).collect())))
    finally:
        syllables.BROADCAST_SYLLABLES = before
    assert rows[0] and rows[0] == rows[1] == rows[2]


def test_tokens_stand_where_their_letters_are(spark):
    """Against the definition, for texts that normalisation changes and for others, shorter and longer than a chunk."""
    cases = ["", "་་", "བོད་ཡིག", " བོད\u200b་ཡིག། abc", "གྷ་ཀ", "é ü་中文 字", "डॉ. क़ ख", "བོད་" * 200, "།\n" + "ཀ ཁ་" * 333, None]
    texts = spark.createDataFrame([*enumerate(cases)], "doc_id long, text string").withColumn("token_no", F.lit("clash"))
    got = {}
    for r in syllables.tokenize(texts).orderBy("doc_id", "token_no").collect():
        got.setdefault(r.doc_id, []).append((r.syllable, r.position, r.before))
    for i, text in enumerate(cases):
        normal, places = X.position_map_of(text or "")
        found = [(m.group(), places[m.start()]) for m in re.finditer(f"[^{L.TOKEN_DELIMITERS}]+", normal)]
        assert got.get(i, []) == [(s, p, found[k - 1][0] if k else None) for k, (s, p) in enumerate(found)]


def test_null_empty_long_and_extra_columns(spark):
    long = "བོད་ཡིག་" * 60_000
    texts = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 2), (3, long, "x", 3), (3, long, "x", 3)], "doc_id long, text string, error_type string, parts int")
    assert syllables.check_texts(texts).count() == 0
    log = {r.doc_id: r.text_length for r in syllables.check_log(texts, syllables.check_texts(texts)).collect()}
    assert log == {1: 0, 2: 0, 3: len(long)}
    assert syllables.check_texts(texts.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, "བོད་གི་"), (2, "གཀར་ཡིག་"), (3, "བོད་ཀྱི་")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
    query = check_stream(stream).writeStream.format("memory").queryName("checked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.doc_id, r.word, r.error_type) for r in spark.table("checked").select("doc_id", "word", "error_type").collect()}
    assert got == {(1, "གི", "wrong_particle_form"), (2, "གཀར", "invalid_prefix_combination")}


def test_messages(spark):
    texts = spark.createDataFrame([(1, "བོད་གི་"), (2, "ཁྱི་ཀྱིས་ x"), (3, "ཪ"), (4, "པདྨ")], "doc_id long, text string")
    got = sorted((r.doc_id, r.message) for r in syllables.check_texts(texts).collect())
    assert got == [
        (1, "Wrong relational particle 'གི' after a word ending in ད (da) (expected ཀྱི)"), (2, "1 non-Tibetan character(s) were skipped during spell checking"),
        (2, "Wrong agentive particle 'ཀྱིས' after a word ending in no suffix"), (3, "Wrong ra character (U+0F6A instead of U+0F62)"), (4, "Characters 'ྨ' could not be assigned to any syllable component"),
    ]
