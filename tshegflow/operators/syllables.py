"""From texts to syllables, and from syllables to their parts and faults.

A syllable's parts and faults depend on nothing but its letters, so they are worked out once for each distinct syllable, by patterns that name the parts.
Whether a particle suits the word before it depends on the parts of the syllable before, which every token carries along. No window is needed, and a
stream is checked by the same plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import letters as L
from ..functions import text as X
from ..sources.lineage import cut

B, S, V = f"[{L.BASE}]", f"[{L.SUBJOINED}]", f"[{L.VOWEL}]"
PARTS = ("prefix", "superscript", "root", "subscripts", "vowel", "suffix", "suffix_vowel", "post_suffix", "unparsed")
#: Syllables whose outcomes are broadcast, the most frequent ones. Rarer ones are judged where they stand.
BROADCAST_SYLLABLES = 300_000

_TOKENS = T.StructType([T.StructField("syllables", T.ArrayType(T.StringType())), T.StructField("positions", T.ArrayType(T.IntegerType()))])
_PIECE = re.compile(f"[^{L.TOKEN_DELIMITERS}]+")
_D = L.TOKEN_DELIMITERS


@F.pandas_udf(_TOKENS)
def _tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        syllables, positions = [], []
        for text in texts:
            normal, places = X.position_map_of(text or "")
            found = [m.span() for m in _PIECE.finditer(normal)]
            syllables.append([normal[a:b] for a, b in found])
            positions.append([places[a] for a, _ in found])
        yield pd.DataFrame({"syllables": syllables, "positions": positions})


def tokenize(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, token_no, syllable, position, before)``: the tokens of each text, where they start in it, and the token before.

    Null and empty texts have no tokens. Texts with one key are separate texts only if the key is unique. Places are found in Arrow batches: adding up lengths by
    higher-order functions of the JVM took twice the time of the whole query.
    """
    base = texts.select(F.col(key).alias("doc_id"), _tokens.asNondeterministic()(F.col(text)).alias("t"))
    each = F.transform("t.syllables", lambda s, i: F.struct(s.alias("syllable"), F.get("t.positions", i).alias("position"), F.get("t.syllables", i - 1).alias("before")))
    return base.select("doc_id", F.posexplode(each).alias("token_no", "t")).select("doc_id", "token_no", "t.syllable", "t.position", "t.before")


def distinct_syllables(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(syllable, n)``: the distinct tokens with Tibetan letters, without leaving the JVM where texts are in NFC. Others need no outcome."""
    each = texts.select(F.explode(F.regexp_extract_all(X.normalize(F.col(text)), F.lit(f"[^{_D}]*?[{L.BLOCK}&&[^{_D}]][^{_D}]*+"), 0)).alias("syllable"))
    return each.groupBy("syllable").agg(F.count(F.lit(1)).alias("n"))


def _class(chars: str) -> str:
    return f"[{chars}]"


_PRE = _class(L.PREFIXES)
_STACK = "|".join(f"{s}{_class(''.join(chr(ord(r) + 0x50) for r in roots))}" for s, roots in L.SUPERSCRIPT_ROOTS.items())
_TAIL = f"(?:({B})([{L.POST_SUFFIXES}])?)?(.*)"
_NOT_V, _NOT_BV, _NOT_BSV = f"[^{L.VOWEL}]", f"[^{L.BASE}{L.VOWEL}]", f"[^{L.BASE}{L.SUBJOINED}{L.VOWEL}]"

# Each shape: the pattern, and where its groups go. "lead" is what stands unexplained before the prefix. The first shape that fits is taken.
_STACKED = (rf".*?({_PRE})?(?=(?:{_STACK}))(.)(.)({S}*)({V})?{_TAIL}", "prefix superscript root subscripts vowel suffix post_suffix unparsed")
_SHAPES_VOWEL = (
    (rf"{_NOT_V}*?({_PRE})?({B})({_NOT_BV}*{S}{_NOT_BV}*)({V}){_TAIL}", "prefix root subscripts vowel suffix post_suffix unparsed"),
    (rf"{_NOT_BSV}*({S})({_NOT_BV}*)({V}){_TAIL}", "root subscripts vowel suffix post_suffix unparsed"),
    (rf"({_NOT_V}*?)({_PRE})?({B})({_NOT_BSV}*)({V}){_TAIL}", "lead prefix root - vowel suffix post_suffix unparsed"),
    (rf"{_NOT_BSV}*({V}){_TAIL}", "vowel suffix post_suffix unparsed"),
)
_SHAPES_BARE = (
    (rf"({B}|{S})", "root"),
    (rf"({B})({S}+){_TAIL}", "root subscripts suffix post_suffix unparsed"),
    (rf"({_PRE})(?![{L.SUFFIXES}])({B})", "prefix root"),
    (rf"({_PRE})({B})(?=[{L.BASE}{L.SUBJOINED}])({S}*){_TAIL}", "prefix root subscripts suffix post_suffix unparsed"),
    (rf"({B}|{S})({S}*){_TAIL}", "root subscripts suffix post_suffix unparsed"),
    (r"(.*)", "unparsed"),
)
_SHAPES_STEM = (
    (rf"({B}|{S})", "root"),
    (rf"({B})({S}+)(.*)", "root subscripts unparsed"),
    (rf"({_PRE})({B})({S}*)(.*)", "prefix root subscripts unparsed"),
    (rf"({B}|{S})({S}*)(.*)", "root subscripts unparsed"),
    (r"(.*)", "unparsed"),
)


def _no_part() -> Column:
    return F.lit(None).cast("string")


_SLOTS = ("lead", "prefix", "superscript", "root", "subscripts", "vowel", "suffix", "post_suffix", "unparsed")


def _fit(x: Column, shapes: tuple[tuple[str, str], ...]) -> Column:
    """The slots by the first shape that fits all of ``x``, as one string."""
    out = None
    for pattern, names in reversed(shapes):
        whole = f"(?s)^{pattern}$"
        at = {n: f"${i}" for i, n in enumerate(names.split(), 1)}
        slots = F.regexp_replace(x, whole, "\u0001".join(at.get(s, "") for s in _SLOTS))
        out = slots if out is None else F.when(x.rlike(whole), slots).otherwise(out)
    return out


def _plain(x: Column, bare: tuple[tuple[str, str], ...]) -> Column:
    return F.when(x.rlike(_STACK), _fit(x, (_STACKED,))).when(x.rlike(V), _fit(x, _SHAPES_VOWEL)).otherwise(_fit(x, bare))


def _parts(slots: Column) -> Column:
    get = lambda n: slots[_SLOTS.index(n)]
    some = lambda c: F.when(c != "", c)
    lead = F.regexp_replace(get("lead"), f"[^{L.BASE}]", "")
    return F.struct(
        some(get("prefix")).alias("prefix"), some(get("superscript")).alias("superscript"), some(X.to_base(get("root"))).alias("root"), F.regexp_replace(get("subscripts"), f"[^{L.SUBJOINED}]", "").alias("subscripts"),
        some(get("vowel")).alias("vowel"), some(get("suffix")).alias("suffix"), _no_part().alias("suffix_vowel"), some(get("post_suffix")).alias("post_suffix"), F.concat(lead, get("unparsed")).alias("unparsed"),
    )


def parse(syllables: DataFrame, syllable: str = "syllable") -> DataFrame:
    """``syllables`` with ``parts``: prefix, superscript, root, subscripts, vowel, suffix, suffix_vowel, post_suffix (null where there is none), unparsed.

    ``subscripts`` and ``unparsed`` are strings, empty where there are none. A syllable that ends in achung with a suffix vowel is parsed as its stem, unless
    the stem has a suffix of its own.
    """
    x = F.col(syllable)
    ends = x.rlike(f"(?s)^..*{L.ACHUNG}[{L.ACHUNG_VOWELS}]$")
    stem = F.when(ends, F.substring(x, F.lit(1), F.length(x) - 2))
    slots = lambda c: _settled(F.split(c, "\u0001", -1))
    staged = syllables.withColumn("_stem", slots(_plain(stem, _SHAPES_STEM))).withColumn("_full", slots(_plain(x, _SHAPES_BARE)))
    staged = staged.withColumn("_stem", F.when(F.col("_stem").isNotNull(), _parts(F.col("_stem")))).withColumn("_full", _parts(F.col("_full")))
    with_vowel = F.struct(*(F.lit(L.ACHUNG).alias(p) if p == "suffix" else F.substring(x, -1, 1).alias(p) if p == "suffix_vowel" else F.lit(None).cast("string").alias(p) if p == "post_suffix" else F.col(f"_stem.{p}").alias(p) for p in PARTS))
    parts = F.when(x == "", None).when(ends & F.col("_stem.suffix").isNull(), with_vowel).otherwise(F.col("_full"))
    return staged.withColumn("parts", _settled(parts)).drop("_stem", "_full")


def _settled(c: Column) -> Column:
    """``c``, worked out here: what is asked of it later is not folded into the expression that makes it, which would grow with every step."""
    return F.when(F.spark_partition_id() >= 0, c)


def _message(key: str, *parts: Column) -> Column:
    """The message ``key`` with its places filled in, those that are null by nothing."""
    fixed = L.MESSAGES[key].split("{}")
    return F.concat(F.lit(fixed[0]), *(x for p, f in zip(parts, fixed[1:]) for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit(f))))


def _fault(error_type: str, severity: str, component: str, message: Column | None = None) -> Column:
    told = _message(error_type) if message is None else message
    return F.struct(F.lit(error_type).alias("error_type"), F.lit(severity).alias("severity"), F.lit(component).alias("component"), told.alias("message"))


def _first(*cases: tuple[Column, Column]) -> Column:
    return reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))


def _count(x: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(x, f"[^{chars}]", ""))


def pattern_fault(x: Column) -> Column:
    """The first fault that the letters show by themselves; null if there is none."""
    return _first(
        (_count(x, L.BLOCK) >= 8, _fault("syllable_too_long", "error", "pattern", _message("syllable_too_long", _count(x, L.BLOCK)))),
        (x.contains(L.WRONG_A), _fault("encoding_error", "critical", "encoding", _message("wrong_a"))),
        (x.contains(L.WRONG_RA), _fault("encoding_error", "critical", "encoding", _message("wrong_ra"))),
        (x.rlike(V + V), _fault("double_vowel", "error", "pattern")),
        (x.rlike(L.TSA_PHRU + B), _fault("unusual_mark_position", "error", "pattern")),
    )


def completeness_fault(x: Column, parts: Column) -> Column:
    """The most basic fault in how the letters fill the parts; null if there is none."""
    suffix, post = parts["suffix"], parts["post_suffix"]
    vowels = _count(x, L.VOWEL)
    second_on_achung = (vowels == 2) & x.rlike(f"{L.ACHUNG}[{L.ACHUNG_VOWELS}]{_NOT_V}*$")
    after_vowel = F.regexp_replace(x, f"(?s)^{_NOT_V}*", "")
    places = F.when(suffix.isNotNull(), 1).otherwise(0) + F.when(post.isNotNull(), 1).otherwise(0)
    last = F.regexp_extract(x, f"(?s).*({B})", 1)
    return _first(
        ((vowels > 1) & ~second_on_achung & (x.rlike(f"{V}{_NOT_V}+{V}") | (vowels > 2)), _fault("multiple_vowels", "error", "structure", _message("multiple_vowels", vowels))),
        (x.rlike(f"(?s){V}.*{S}"), _fault("consonant_after_vowel", "error", "structure", _message("consonant_after_vowel", F.regexp_extract(x, f"(?s)^{_NOT_V}*{V}[^{L.SUBJOINED}]*({S})", 1)))),
        (_count(after_vowel, L.BASE) > places, _fault("unparsed_characters", "error", "structure", _message("too_many_after_vowel", _count(after_vowel, L.BASE), places))),
        (_count(x, L.BASE) > 5, _fault("too_many_consonants", "error", "structure", _message("too_many_consonants", _count(x, L.BASE)))),
        ((last != "") & post.isNotNull() & (last != post), _fault("unparsed_characters", "error", "structure", _message("trailing_consonant", last))),
        ((last != "") & post.isNull() & suffix.isNotNull() & F.call_function("substring_index", x, suffix, F.lit(-1)).rlike(B), _fault("invalid_post_suffix", "error", "structure", _message("after_suffix", last))),
    )


def _pairs(table: dict[str, str]) -> list[str]:
    return [a + r for a, roots in table.items() for r in roots]


def component_fault(parts: Column) -> Column:
    """The first fault of the parts against each other; null if there is none."""
    root = parts["root"]
    prefixes, subscripts = _pairs(L.PREFIX_ROOTS), _pairs(L.SUBSCRIPT_ROOTS)
    wrong_sub = F.get(F.filter(F.split(parts["subscripts"], ""), lambda s: (s != "") & ~F.concat(s, root).isin(subscripts)), F.lit(0))
    return _first(
        (root.isNull(), _fault("missing_root", "error", "root")),
        (parts["prefix"].isNotNull() & parts["superscript"].isNull() & ~F.concat(parts["prefix"], root).isin(prefixes), _fault("invalid_prefix_combination", "error", "prefix", _message("invalid_prefix_combination", parts["prefix"], root))),
        (wrong_sub.isNotNull(), _fault("invalid_subscript_combination", "error", "subscript", _message("invalid_subscript_combination", wrong_sub, root))),
        (~parts["suffix"].isin(*L.SUFFIXES), _fault("invalid_suffix", "error", "suffix", _message("invalid_suffix", parts["suffix"]))),
        (parts["unparsed"] != "", _fault("unparsed_characters", "error", "structure", _message("unparsed_characters", parts["unparsed"]))),
    )


OUTCOME = ("kind", "parts", "error_type", "severity", "component", "message", "corpus_hit", "context")


def outcomes(syllables: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """For each distinct non-null ``syllable``: ``kind``, ``parts``, ``error_type``, ``severity``, ``component``, ``message``, ``corpus_hit``, ``context``.

    ``kind`` is other (no Tibetan), skipped (numerals and signs), exception, or syllable. ``inventory`` has the known syllables in its first column; with none,
    or an empty one, ``corpus_hit`` is null and no word is unknown. ``context`` is what a particle after the syllable looks at: null where it has none to look
    at, else suffix (``-`` for none) and post-suffix.
    """
    return judge(parse(syllables.select("syllable").where(F.col("syllable").isNotNull()).distinct()), inventory)


def judge(parsed: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """The columns of ``outcomes`` for every row of ``parsed``, whose own columns stay; rows are not made distinct, so it runs on a stream as well."""
    x = F.col("syllable")
    own = [c for c in parsed.columns if c != "parts"]
    base = parsed
    kind = F.when(~X.has_tibetan(x), "other").when(X.is_numeral(x) | X.is_punctuation(x), "skipped").when(x.isin(*L.EXCEPTIONS), "exception").otherwise("syllable")
    base = base.withColumn("kind", kind)
    parts = F.col("parts")
    plain = F.when(F.col("kind") == "syllable", F.coalesce(pattern_fault(x), completeness_fault(x, parts)))
    base = base.withColumn("_plain", _settled(plain)).withColumn("_component", _settled(F.when((F.col("kind") == "syllable") & F.col("_plain").isNull(), component_fault(parts))))
    if inventory is None:
        base = base.withColumn("_hit", F.lit(None).cast("boolean"))
    else:
        known = inventory.select(F.col(inventory.columns[0]).alias("_entry")).where(F.col("_entry").isNotNull()).distinct().withColumn("_known", F.lit(True))
        any_ = known.limit(1).agg((F.count(F.lit(1)) > 0).alias("_available"))
        # rows without a syllable ask for nothing, each by a key of its own, so that they do not gather in one task
        asked = F.coalesce(x, F.concat(F.lit("\0"), F.rand().cast("string")))
        base = base.withColumn("_asked", asked).join(known, F.col("_asked") == F.col("_entry"), "left").drop("_asked", "_entry").crossJoin(F.broadcast(any_))
        base = base.withColumn("_hit", F.when(F.col("_available"), F.coalesce("_known", F.lit(False)))).drop("_known", "_available")
    unknown = F.when((F.col("kind") == "syllable") & F.col("_plain").isNull() & F.col("_component").isNull() & ~F.col("_hit"), F.struct(F.lit("unknown_word").alias("error_type"), F.lit("warning").alias("severity"), _no_part().alias("component"), _message("unknown_word", x).alias("message")))
    fault = F.coalesce("_plain", "_component", unknown)
    base = base.withColumn("_fault", _settled(fault))
    looked_up = F.col("_component").isNotNull() | (F.col("_fault.error_type") == "unknown_word")
    context = F.when(F.col("kind").isin("syllable", "exception") & F.col("_fault").isNull(), F.struct(F.coalesce(parts["suffix"], F.lit(L.NO_SUFFIX)).alias("suffix"), parts["post_suffix"].alias("post_suffix")))
    return base.select(*own, "kind", "parts", "_fault.error_type", "_fault.severity", "_fault.component", "_fault.message", F.when(looked_up, F.col("_hit")).alias("corpus_hit"), _settled(context).alias("context"))


# ---- particles --------------------------------------------------------------


def _particle_rules() -> tuple[Column, Column, Column]:
    """Maps: particle to its class, particle to the suffixes it follows, class and suffix to the expected particle."""
    lits = lambda pairs: F.create_map(*(F.lit(x) for p in pairs for x in p))
    expected: dict[str, str] = {}
    for particle, kind, after in L.PARTICLES:
        for s in after or "":
            expected.setdefault(kind + s, particle)
    expected |= {kind + s: p for (kind, s), p in L.PREFERRED.items()}
    return lits((p, k) for p, k, _ in L.PARTICLES), lits((p, a) for p, _, a in L.PARTICLES if a), lits(expected.items())


def particle_fault(syllable: Column, context: Column) -> Column:
    """``(category, suggestion)`` where ``syllable`` is a particle that does not suit the word before it; null else. Suggestion may be null."""
    kinds, follows, expected = _particle_rules()
    after = F.try_element_at(follows, syllable)
    suits = F.coalesce(after.contains(context["post_suffix"]), F.lit(False)) | after.contains(context["suffix"])
    kind = F.try_element_at(kinds, syllable)
    return F.when(context.isNotNull() & after.isNotNull() & ~suits, F.struct(kind.alias("category"), F.try_element_at(expected, F.concat(kind, context["suffix"])).alias("suggestion")))


# ---- texts ------------------------------------------------------------------


def known_outcomes(counts: DataFrame, inventory: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Outcomes of the most frequent of ``(syllable, n)``, at most ``BROADCAST_SYLLABLES``, and whether these are all."""
    counts = cut(counts)
    all_of_them = counts.count() <= BROADCAST_SYLLABLES
    return outcomes(counts if all_of_them else counts.orderBy(F.desc("n"), "syllable").limit(BROADCAST_SYLLABLES), inventory), all_of_them


def checked_tokens(tokens: DataFrame, inventory: DataFrame | None = None, known: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """``tokens`` with the outcome of each syllable and the context that the token before it gives.

    ``known`` are outcomes that are there already, and whether they are all; they are broadcast. Syllables beyond them are judged where they stand, so tokens are
    never shuffled, and no frequent syllable gathers in one task.
    """
    if known is None:
        seen = tokens.where(X.has_tibetan(F.col("syllable"))).groupBy("syllable").agg(F.count(F.lit(1)).alias("n"))
        known = known_outcomes(seen, inventory)
    few, whole = known
    for place in ("syllable", "before"):
        side = few.select(F.col("syllable").alias(place), F.struct(*OUTCOME).alias(f"_{place}"))
        tokens = tokens.join(F.broadcast(side), place, "left")
    if not whole:
        for place in ("syllable", "before"):
            rare = F.when(F.col(f"_{place}").isNull() & X.has_tibetan(F.col(place)), F.col(place))
            kept = [F.col(c).alias("_syllable_kept" if c == "syllable" else c) for c in tokens.columns]
            judged = judge(parse(tokens.select(*kept, rare.alias("syllable"))), inventory)
            own = F.coalesce(f"_{place}", F.when(F.col("syllable").isNotNull(), F.struct(*OUTCOME)))
            tokens = judged.select(*(own.alias(c) if c == f"_{place}" else F.col("_syllable_kept").alias(c) if c == "syllable" else F.col(c) for c in tokens.columns))
    kind = F.coalesce("_syllable.kind", F.lit("other")).alias("kind")
    return tokens.select("doc_id", "token_no", "syllable", "position", "before", kind, *(f"_syllable.{c}" for c in OUTCOME if c not in ("kind", "context")), F.col("_before.context").alias("before_context"))


def token_errors(checked: DataFrame) -> DataFrame:
    """``(doc_id, position, word, error_type, severity, component, message, corpus_hit, category, suggestion)``, one row for each fault of a token."""
    labels = F.create_map(*(F.lit(x) for pair in L.SUFFIX_LABELS.items() for x in pair))
    wrong = F.when(F.col("error_type").isNull() & F.col("kind").isin("syllable", "exception"), particle_fault(F.col("syllable"), F.col("before_context")))
    found = checked.withColumn("particle", _settled(wrong)).where("error_type IS NOT NULL OR particle IS NOT NULL")
    bad = F.col("particle").isNotNull()
    hint = F.concat(F.lit(" (expected "), F.col("particle.suggestion"), F.lit(")"))
    suffix = F.col("before_context.suffix")
    told = _message("wrong_particle_form", F.col("particle.category"), F.col("syllable"), F.coalesce(F.try_element_at(labels, suffix), suffix), hint)
    return found.select(
        "doc_id", "position", F.col("syllable").alias("word"), F.when(bad, "wrong_particle_form").otherwise(F.col("error_type")).alias("error_type"), F.when(bad, "error").otherwise(F.col("severity")).alias("severity"),
        F.when(bad, "particle").otherwise(F.col("component")).alias("component"), F.when(bad, told).otherwise(F.col("message")).alias("message"), "corpus_hit", "particle.category", "particle.suggestion",
    )


def info_rows(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, skipped)`` for texts with characters that the check skips."""
    return texts.select(F.col(key).alias("doc_id"), X.count_non_tibetan(F.col(text)).alias("skipped")).where("skipped > 0")


def check_texts(texts: DataFrame, inventory: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All faults of all texts, and an information row at position 0 for each text with characters that are skipped.

    Null and empty texts have none. ``key`` must be unique for faults to be told apart.
    """
    known = known_outcomes(distinct_syllables(texts, text), inventory)
    faults = token_errors(checked_tokens(tokenize(texts, key, text), inventory, known))
    info = info_rows(texts, key, text).select(
        "doc_id", F.lit(0).alias("position"), F.lit("").alias("word"), F.lit("non_tibetan_skipped").alias("error_type"), F.lit("info").alias("severity"),
        _no_part().alias("component"), _message("non_tibetan_skipped", F.col("skipped")).alias("message"), F.lit(None).cast("boolean").alias("corpus_hit"), _no_part().alias("category"), _no_part().alias("suggestion"),
    )
    return faults.unionByName(info)


def check_log(texts: DataFrame, errors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: length, errors, structural errors, unknown words, corpus hits, and whether the corpus was asked at all."""
    severity = F.col("severity")
    counted = errors.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("error_count"), F.count_if(~severity.isin("warning", "info")).alias("structural_errors"), F.count_if(F.col("error_type") == "unknown_word").alias("unknown_words"),
        F.count_if(F.coalesce("corpus_hit", F.lit(False))).alias("corpus_hits"), F.bool_or(F.col("corpus_hit").isNotNull()).alias("dict_active"),
    )
    base = texts.select(F.col(key).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("text_length"))
    return base.join(counted, "doc_id", "left").na.fill(0, ["error_count", "structural_errors", "unknown_words", "corpus_hits"]).na.fill(False, ["dict_active"])
