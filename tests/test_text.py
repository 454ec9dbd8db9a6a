"""Functions of one string."""

from __future__ import annotations

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tshegflow.functions import letters as L
from tshegflow.functions import text as X
from tshegflow.plans import registry


def _one(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(column(F.col("t"))).collect()]


def test_position_map(spark):
    cases = {"": [], "བོད​ཡིག": [0, 1, 2, 4, 5, 6], "ཀ​ག‌ང": [0, 2, 4], "ཀ​‍ག": [0, 3], "​ཀ": [1], "གྷ": [0, 0], None: None, "abc": [0, 1, 2]}
    assert _one(spark, X.position_map, *cases) == list(cases.values())


@given(st.text(alphabet="ཀགགྷཱཱིིུ༹ྷ​aẹ́é가각़न ", max_size=12))
@settings(max_examples=300, deadline=None)
def test_position_map_counts_prefixes(text):
    """By the definition: what each prefix adds to the length of its NFC."""
    whole, places, before = unicodedata.normalize("NFC", text), [], 0
    for i in range(len(text)):
        size = len(unicodedata.normalize("NFC", text[: i + 1]))
        places += [i] * (size - before)
        before = size
    if whole == text:
        places = list(range(len(text)))
    places += range(len(places), len(whole))
    kept = [(c, p) for c, p in zip(whole, places) if c not in L.ZERO_WIDTH]
    assert X.position_map_of(text) == ("".join(c for c, _ in kept), [p for _, p in kept])


def test_position_map_of_every_text(spark):
    """All rows come out, the texts that NFC changes by the definition: what each prefix adds to the length of its NFC."""
    folder = "/root/testdata/sf0.01"
    texts = {r.request_id: r.text for r in spark.read.parquet(f"{folder}/check_requests.parquet").select("request_id", "text").collect()}
    rows = [(r.request_id, r.value) for r in registry.queries()["fn_position_map"](spark, folder).collect()]
    got, changed = dict(rows), 0
    assert len(rows) == spark.read.parquet(f"{folder}/check_requests.parquet").count() and set(got) == set(texts)
    for i, text in texts.items():
        if text is None:
            assert got[i] is None
            continue
        whole, places, before = unicodedata.normalize("NFC", text), range(len(text)), 0
        if whole != text:
            changed, places = changed + 1, []
            for k in range(len(text)):
                size = len(unicodedata.normalize("NFC", text[: k + 1]))
                places += [k] * (size - before)
                before = size
            places += range(len(places), len(whole))
        assert got[i] == ",".join(str(p) for c, p in zip(whole, places) if c not in L.ZERO_WIDTH)
    assert changed and None in texts.values()


def test_normalize_runs_only_where_needed(spark):
    rows = ["བོད་", "གྷ", "བོ​ད", "é", "ཀཱི", "", None]
    want = [None if r is None else unicodedata.normalize("NFC", r).translate(dict.fromkeys(map(ord, L.ZERO_WIDTH))) for r in rows]
    assert _one(spark, X.normalize, *rows) == want


def test_counts_and_classes(spark):
    assert _one(spark, X.count_non_tibetan, "བོད ABC123", "བོ​ད", "　\t", "", None) == [6, 1, 0, 0, None]
    assert _one(spark, X.type_string, "སྐད་ཨོཾx", "ༀ") == ["BSBMBVMO", "M"]
    assert _one(spark, X.is_numeral, "༢༠༢༦", "༢ཀ", "") == [True, False, False]
    assert _one(spark, X.is_punctuation, "༄༅", "༢༠", "ཀ", "") == [True, True, False, False]
    assert _one(spark, X.split_syllables, "བོད་ཡིག།༎ ཀ ཁ ་", "") == [["བོད", "ཡིག", "ཀ ཁ"], []]
    assert _one(spark, X.to_base, "ྐྱོ") == ["ཀཡོ"]


def test_keyword_in_context(spark):
    df = spark.createDataFrame([("0123456789abcdefghijklmnopqrstuvwxyz", 22, "mn"), ("abc", 0, "ab"), ("abc", 2, "cde")], "t string, p int, w string")
    got = [r[0] for r in df.select(X.keyword_in_context(F.col("t"), F.col("p"), F.col("w"), 4)).collect()]
    assert got == ["ijkl[mn]opqr", "[ab]c", "ab[c]"]


def test_stable_characters_are_left_alone():
    """Every one, and every two of them in a row, is in NFC; the block's own cases are tested above."""
    stable = [c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{X.STABLE}]", c)]
    assert all(unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) for c in stable if c not in "\u094d")
    later = [c for c in stable if unicodedata.category(c).startswith("M")]
    assert all(unicodedata.normalize("NFC", a + b) == a + b for a in stable for b in later)
