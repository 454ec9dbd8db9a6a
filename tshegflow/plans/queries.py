"""The queries of the core, by name. Each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import text as X
from ..operators import boxes, jobs, lexicon, pages, reports, syllables
from ..sources.tables import table
from . import synthetic

Query = Callable[[SparkSession, str], DataFrame]


# ---- functions, over the submitted texts -------------------------------------


def _scalar(column: Callable[[Column], Column], spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "check_requests").select("request_id", column(F.col("text")).alias("value"))


SCALARS: dict[str, Callable[[Column], Column]] = {
    "fn_normalize": X.normalize,
    "fn_char_class": X.starts_tibetan,
    "fn_extract_tibetan": X.extract_tibetan,
    "fn_non_tibetan_count": lambda t: X.count_non_tibetan(t).cast("long"),
    "fn_split_simple": lambda t: F.array_join(X.split_syllables(t), "|"),
    "fn_type_string": X.type_string,
    "fn_base_form": X.to_base,
    "fn_recognised": X.recognised,
}


def fn_position_map(spark: SparkSession, folder: str) -> DataFrame:
    """The map of every text. A null text has a null map."""
    return _scalar(lambda t: F.array_join(X.position_map(t), ","), spark, folder)


def fn_format_error_type(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "spell_errors").select("error_type").where("error_type IS NOT NULL").distinct().select("error_type", X.title_case(F.col("error_type")).alias("label"))


def fn_severity_map(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "spell_errors").where("error_type IS NOT NULL").groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).select("error_type", X.severity_of(F.col("error_type")).alias("severity"), "n")


def fn_kwic(spark: SparkSession, folder: str) -> DataFrame:
    return reports.contexts(table(spark, folder, "spell_errors"), table(spark, folder, "page_content"))


def fn_token_kind(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("syllable")
    kind = F.when(~X.has_tibetan(x), "other").when(X.is_numeral(x), "numeral").when(X.is_punctuation(x), "punctuation").when(x.isin(*L.EXCEPTIONS), "exception").otherwise("syllable")
    return _request_tokens(spark, folder).groupBy("syllable").agg(F.count(F.lit(1)).alias("n")).select("syllable", kind.alias("kind"), "n")


def rule_stack_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every letter over, under and before every root letter, and whether the check of the parts lets it pass."""
    roots = [chr(c) for c in range(0xF40, 0xF6D) if c not in (0xF43, 0xF48, 0xF4D, 0xF52, 0xF57, 0xF5C, 0xF69, 0xF6A, 0xF6B, 0xF6C)]
    rows = [(kind, a, r) for kind, letters in (("superscript", L.SUPERSCRIPTS), ("subscript", "".join(L.SUBSCRIPT_ROOTS)), ("prefix", L.PREFIXES)) for a in letters for r in roots]
    none, kind = F.lit(None).cast("string"), F.col("kind")
    stacked = F.when(kind == "superscript", F.concat("letter", F.translate("root", "".join(roots), "".join(chr(ord(r) + 0x50) for r in roots)))).otherwise(F.lit("ཀ"))
    parsed = syllables.parse(spark.createDataFrame(rows, "kind string, letter string, root string").withColumn("syllable", stacked)).withColumnRenamed("parts", "stack")
    parts = F.struct(
        F.when(kind == "prefix", F.col("letter")).alias("prefix"), none.alias("superscript"), F.col("root").alias("root"), F.when(kind == "subscript", F.col("letter")).otherwise(F.lit("")).alias("subscripts"),
        none.alias("vowel"), none.alias("suffix"), none.alias("suffix_vowel"), none.alias("post_suffix"), F.lit("").alias("unparsed"),
    )
    passes = F.when(kind == "superscript", F.coalesce((F.col("stack.superscript") == F.col("letter")) & (F.col("stack.root") == F.col("root")), F.lit(False))).otherwise(syllables.component_fault(F.col("parts")).isNull())
    return parsed.withColumn("parts", parts).select("kind", "letter", "root", passes.alias("valid"))


# ---- sources and gates ---------------------------------------------------------


def src_text_length_gate(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length("text")
    return table(spark, folder, "check_requests").select("request_id", n.cast("long").alias("n"), F.coalesce((n >= 1) & (n <= 100_000), F.lit(False)).alias("accepted"))


def src_upload_gate(spark: SparkSession, folder: str) -> DataFrame:
    return pages.upload_gate(table(spark, folder, "jobs"))


def src_sync_route(spark: SparkSession, folder: str) -> DataFrame:
    return pages.sync_route(table(spark, folder, "jobs"))


# ---- the check over the synthetic corpus ---------------------------------------


def _request_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.tokenize(table(spark, folder, "check_requests"), "request_id")


def tok_positions(spark: SparkSession, folder: str) -> DataFrame:
    return _request_tokens(spark, folder).select(F.col("doc_id").alias("request_id"), "token_no", "syllable", "position")


def _synthetic_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.tokenize(synthetic.texts(spark, folder))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.checked_tokens(_synthetic_tokens(spark, folder))


def check_text_errors(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.check_texts(synthetic.texts(spark, folder)).select("doc_id", "position", "word", "error_type", "severity", "component")


def _check_log(spark: SparkSession, folder: str) -> DataFrame:
    texts = synthetic.texts(spark, folder)
    return syllables.check_log(texts, syllables.check_texts(texts, lexicon.inventory(table(spark, folder, "word"))))


def agg_check_log(spark: SparkSession, folder: str) -> DataFrame:
    return _check_log(spark, folder)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.log_lines(_check_log(spark, folder), "text")


def err_messages(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.outcomes(_synthetic_tokens(spark, folder)).where("error_type IS NOT NULL").select("syllable", "error_type", "message")


def particle_messages(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.token_errors(_judged(spark, folder)).where("component = 'particle'").groupBy("word", "message").agg(F.count(F.lit(1)).alias("n"))


def particle_errors(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.token_errors(_judged(spark, folder)).where("component = 'particle'").select("doc_id", "position", "word")


def particle_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.token_errors(_judged(spark, folder)).where("component = 'particle'").groupBy("word", "category", "suggestion").agg(F.count(F.lit(1)).alias("n"))


def info_rows(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.info_rows(table(spark, folder, "check_requests"), "request_id").select(F.col("doc_id").alias("request_id"), F.col("skipped").cast("long").alias("skipped"))


def tok_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def parse_components(spark: SparkSession, folder: str) -> DataFrame:
    known = syllables.outcomes(_synthetic_tokens(spark, folder))
    return known.where(F.col("kind").isin("syllable", "exception")).select("syllable", *(F.coalesce(f"parts.{p}", F.lit("")).alias(p) for p in syllables.PARTS))


def check_syllable_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return syllables.outcomes(_synthetic_tokens(spark, folder)).select("syllable", "kind", "error_type", "severity", "component")


def _errors_of(components: tuple[str, ...], spark: SparkSession, folder: str) -> DataFrame:
    found = _judged(spark, folder).where(F.col("component").isin(*components))
    if "structure" in components:
        # the same components also come out of the last step, for syllables whose letters fill their parts
        found = found.where(syllables.completeness_fault(F.col("syllable"), F.col("parts")).isNotNull())
    return found.groupBy("syllable", "error_type", "severity", "component").agg(F.count(F.lit(1)).alias("n"))


def err_component(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("syllable")
    left = syllables.pattern_fault(x).isNull() & syllables.completeness_fault(x, F.col("parts")).isNull()
    return _judged(spark, folder).where(F.col("error_type").isNotNull() & left).groupBy("syllable", "error_type", "severity", "component").agg(F.count(F.lit(1)).alias("n"))


def dict_lookup_tristate(spark: SparkSession, folder: str) -> DataFrame:
    """What the check says of each syllable with the lexicon and with an empty one; a hit is null where nothing was looked up."""
    inventory, tokens = lexicon.inventory(table(spark, folder, "word")), _synthetic_tokens(spark, folder).select("syllable").distinct()
    each = [syllables.outcomes(tokens, known).select(F.lit(name).alias("lexicon"), "syllable", "error_type", "corpus_hit") for name, known in (("loaded", inventory), ("empty", inventory.limit(0)))]
    return each[0].unionByName(each[1])


def parity_type_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _parity(spark, folder)[0]


def parity_count_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _parity(spark, folder)[1]


def _parity(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    whole = syllables.token_errors(syllables.checked_tokens(_synthetic_tokens(spark, folder)))
    texts = synthetic.texts(spark, folder, by_page=True).select(F.struct("doc_id", "page_number").alias("key"), "text")
    paged = syllables.token_errors(syllables.checked_tokens(syllables.tokenize(texts, "key"))).withColumn("doc_id", F.col("doc_id.doc_id"))
    return reports.parity(paged, whole)


# ---- the check over submitted texts and pages -----------------------------------


def request_errors(spark: SparkSession, folder: str) -> DataFrame:
    inventory = lexicon.inventory(table(spark, folder, "word"))
    return syllables.check_texts(table(spark, folder, "check_requests"), inventory, "request_id")


def page_check_log(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "page_content").select("page_id", "text")
    return syllables.check_log(texts, syllables.check_texts(texts, lexicon.inventory(table(spark, folder, "word")), "page_id"), "page_id")


# ---- lexicon --------------------------------------------------------------------


def dict_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.inventory(table(spark, folder, "word"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.statistics(table(spark, folder, "word"))


def corpus_cross_reference(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "word")
    each = words.select(F.explode(F.array("word", "word_normalized")).alias("word"), F.col("first_seen_in").alias("source_key"))
    return lexicon.cross_reference(each, table(spark, folder, "lexicon_source"))


def corpus_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.new_headwords(table(spark, folder, "spell_errors"), table(spark, folder, "word"))


def _loaded(replace: bool, spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lexicon after the words of the errors were written to it; a page stands for a source, every second one of them new."""
    order = table(spark, folder, "lexicon_source")
    keyed = order.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("reader_"), "source_key")).otherwise(F.col("source_key")).alias("source_key"))
    read = table(spark, folder, "spell_errors").select("word", (1 + F.pmod("page_number", F.lit(6))).alias("id")).join(keyed, "id").select("word", "source_key")
    words = table(spark, folder, "word")
    links = words.where("first_seen_in IS NOT NULL").select("word", F.col("first_seen_in").alias("source_key"))
    return lexicon.load(lexicon.cross_reference(read, keyed), words, order, links, replace)


def _load(which: int, replace: bool, spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(replace, spark, folder)[which]


def seed_upsert(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "word")
    return lexicon.load(lexicon.seed(spark), words, table(spark, folder, "lexicon_source"), words.select("word", F.col("first_seen_in").alias("source_key")).where("source_key IS NOT NULL"))[0]


def _legacy(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "word").select("word", F.to_json(F.array("first_seen_in", F.lit("ri_bo_list"), F.lower("dialect"))).alias("sources"))


def migrate_sources(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.legacy_sources(_legacy(spark, folder))


def migrate_word_source(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.legacy_word_sources(_legacy(spark, folder), table(spark, folder, "word"), table(spark, folder, "lexicon_source"))


# ---- pages and documents ----------------------------------------------------------


def _pages(operator: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    return operator(table(spark, folder, "page_content"))


def _marked(operator: Callable[[DataFrame, DataFrame], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    return operator(table(spark, folder, "page_content"), table(spark, folder, "spell_errors"))


def pdf_route_fonts(spark: SparkSession, folder: str) -> DataFrame:
    """The route where every seventh document, by its size, embeds a font that cannot be trusted."""
    fonts = F.when(F.col("file_size") % 7 == 0, F.array(F.lit("Jomolhari"), F.lit("MicrosoftHimalaya"))).otherwise(F.array(F.lit("Jomolhari")))
    return pages.route(table(spark, folder, "page_content"), table(spark, folder, "jobs").select(F.col("id").alias("job_id"), fonts.alias("fonts")))


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.text_of_lines(table(spark, folder, "ocr_lines"))


def pdf_scanned_highlights(spark: SparkSession, folder: str) -> DataFrame:
    return pages.scanned_highlights(table(spark, folder, "ocr_lines"), table(spark, folder, "page_content"), table(spark, folder, "spell_errors"))


def _errors(operator: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    return operator(table(spark, folder, "spell_errors"))


def _changelogs(spark: SparkSession, folder: str) -> DataFrame:
    """Changelogs made of ``lineitem``: an order is a file, and each row a line of it."""
    rows = table(spark, folder, "lineitem")
    k, p, s = F.pmod("l_partkey", F.lit(8)).cast("int"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    kinds = F.array(F.concat(F.lit("## [1."), s, F.lit(".0] - 2024-01-01")), F.lit("### Added"), F.lit("### Fixed"), F.concat(F.lit("- item "), p), F.concat(F.lit("  more "), p), F.lit("## [Unreleased]"), F.lit("### Notes"), F.concat(F.lit("- entry "), p))
    return rows.select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("line_no"), F.get(kinds, k).alias("line")).distinct()


def changelog_parse(spark: SparkSession, folder: str) -> DataFrame:
    return reports.changelog_items(_changelogs(spark, folder))


def changelog_unreleased(spark: SparkSession, folder: str) -> DataFrame:
    return reports.unreleased(_changelogs(spark, folder))


def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.latest(table(spark, folder, "jobs"))


# ---- boxes ----------------------------------------------------------------------


def ocr_box_filter(spark: SparkSession, folder: str) -> DataFrame:
    return boxes.large_enough(table(spark, folder, "ocr_lines").select("line_id", "page_id", "width", "height"), table(spark, folder, "page_content"))


def ocr_rotation_angle(spark: SparkSession, folder: str) -> DataFrame:
    """Angles made of the boxes' places: a page's lines lean a little, some stand."""
    angles = table(spark, folder, "ocr_lines").select("page_id", (F.pmod(F.col("x") * 7 + F.col("y"), F.lit(91)) * 1.0).alias("angle"))
    return boxes.rotation(angles)


def ocr_centers(spark: SparkSession, folder: str) -> DataFrame:
    return boxes.centers(table(spark, folder, "ocr_lines"))


def ocr_line_groups(spark: SparkSession, folder: str) -> DataFrame:
    lines = ocr_centers(spark, folder).select("page_id", F.col("line_id").alias("box_no"), F.col("x_center").alias("x"), F.col("y_center").alias("y"))
    return boxes.line_groups(lines)


def ocr_merged_lines(spark: SparkSession, folder: str) -> DataFrame:
    return boxes.merged(ocr_centers(spark, folder), ocr_line_groups(spark, folder))


def ocr_line_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return boxes.line_threshold(table(spark, folder, "ocr_lines"))


def ocr_curved_share(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose width is divisible by five stand for curved ones."""
    return boxes.curved_share(table(spark, folder, "ocr_lines").select("page_id", (F.col("width") % 5 == 0).alias("curved")))


def ocr_paired(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each page, by number, against the lines of its text."""
    once = table(spark, folder, "ocr_lines").select("page_id", "line_no", "text").distinct()
    left = once.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("items"))
    right = table(spark, folder, "page_content").where("text IS NOT NULL").select("page_id", F.split("text", "\n", -1).alias("items"))
    return boxes.paired(left, right)


def queries() -> dict[str, Query]:
    plain = (
        fn_position_map, fn_format_error_type, fn_severity_map, fn_kwic, fn_token_kind, rule_stack_pairs, src_text_length_gate, src_upload_gate, src_sync_route, tok_positions, check_text_errors, agg_check_log,
        particle_errors, particle_suggestions, info_rows, tok_kind_counts, parse_components, check_syllable_outcome, err_component, dict_lookup_tristate, parity_type_diff, parity_count_diff, request_errors, page_check_log,
        dict_inventory, corpus_stats, corpus_cross_reference, corpus_upsert, migrate_sources, migrate_word_source, pdf_scanned_highlights, changelog_parse, job_status, ocr_box_filter, ocr_rotation_angle, ocr_line_groups,
        log_lines, err_messages, particle_messages, seed_upsert, pdf_route_fonts, page_text, changelog_unreleased, ocr_centers, ocr_merged_lines, ocr_line_threshold, ocr_curved_share, ocr_paired,
    )
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {name: partial(_scalar, column) for name, column in SCALARS.items()}
    out |= {"err_pattern": partial(_errors_of, ("pattern", "encoding")), "err_completeness": partial(_errors_of, ("structure",))}
    out |= {name: partial(_pages, f) for name, f in (("pdf_pua_ratio", pages.private_use), ("pdf_phantom_counts", pages.phantoms), ("pdf_is_scanned", pages.scanned), ("pdf_route", pages.route), ("doc_page_blocks", pages.page_blocks), ("page_words", pages.word_boxes))}
    out |= {name: partial(_load, which, replace) for name, which, replace in (("corpus_load_words", 0, False), ("corpus_load_sources", 1, False), ("corpus_load_links", 2, False), ("corpus_replace_words", 0, True), ("corpus_replace_links", 2, True))}
    out |= {name: partial(_marked, f) for name, f in (("pdf_digital_matches", pages.digital_matches), ("doc_runs", pages.document_runs), ("pdf_digital_boxes", pages.digital_boxes))}
    errors = (("pdf_page_errors", pages.page_errors), ("agg_severity", reports.severity_counts), ("ui_severity_split", reports.severity_split), ("ui_spans", reports.spans), ("freq_corpus", reports.frequent_words), ("top_unknown_words", reports.top_unknown_words), ("errors_filled", pages.filled_errors), ("console_report", reports.console_report))
    return out | {name: partial(_errors, f) for name, f in errors}
