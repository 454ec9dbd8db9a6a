"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lineage import cut
from ..sources.tables import table
from . import contamination, mixing, mojibake, residue, scan_repair, sentences, term_counts, unicode_forms

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    fields = unicode_forms._fields(table(spark, folder, "word"), table(spark, folder, "check_requests"))
    return unicode_forms.look_alike_pairs(cut(unicode_forms.look_alike_groups(fields)))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    fields = unicode_forms._fields(table(spark, folder, "word"), table(spark, folder, "check_requests"))
    return unicode_forms.look_alike_classes(cut(unicode_forms.look_alike_groups(fields)))


def p1_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return unicode_forms.normalize_fields(table(spark, folder, "word"), table(spark, folder, "check_requests"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.request_and_page_sentences(table(spark, folder, "check_requests"), table(spark, folder, "page_content"))


def p2_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.request_and_page_sentences(table(spark, folder, "check_requests"), table(spark, folder, "page_content"), with_text=True)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.faults(scan_repair.repair(table(spark, folder, "page_content")))


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.paragraphs(scan_repair.repair(table(spark, folder, "page_content"), table(spark, folder, "ocr_lines")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_restored(spark, folder).select("record_kind", "page_id", "word_no")


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_content")
    return mojibake.repair_pages(pages, mojibake.fit(pages))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts.marked_terms(p5_term_counts(spark, folder))


def p5_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, folder, "word"), table(spark, folder, "spell_errors"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_residues(spark, folder).select("doc_id")


def p8_residues(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residues(table(spark, folder, "documents")).withColumn("kinds", F.array_join("kinds", ","))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_classes, p1_normalized, p2_found, p2_sentences, p3_found, p3_paragraphs, p4_found, p4_restored, p5_found, p5_term_counts, p6_found, p6_leaks, p7_selection, p7_shares, p8_found, p8_residues)}
