"""Counting and showing errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

SEVERITIES = ("critical", "error", "warning", "info")
# The categories of a changelog.
CATEGORIES = ("Added", "Changed", "Deprecated", "Removed", "Fixed", "Security")


def once(errors: DataFrame) -> DataFrame:
    """``errors`` without rows repeated under one ``id``."""
    return errors.dropDuplicates(["id"])


def severity_counts(errors: DataFrame) -> DataFrame:
    """``(job_id, critical, error, warning, info)``."""
    return once(errors).groupBy("job_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def severity_split(errors: DataFrame) -> DataFrame:
    """``(job_id, structural, warnings, infos)`` of the errors with a place, as a reader sees them."""
    s = F.col("severity")
    return once(errors).where("position >= 0").groupBy("job_id").agg(F.count_if(s.isin("error", "critical")).alias("structural"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "info").alias("infos"))


def contexts(errors: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, context)``: each error's word with what stands around its place on the page. Errors without a page, or beyond its text, have none."""
    own = once(errors).where((F.col("word") != "") & (F.col("position") >= 0)).select("id", "job_id", "page_number", "word", "position")
    met = own.join(pages.select("job_id", "page_number", "text"), ["job_id", "page_number"]).where(F.col("position") < F.length("text"))
    return met.select("id", X.keyword_in_context(F.col("text"), F.col("position"), F.col("word")).alias("context"))


def spans(errors: DataFrame) -> DataFrame:
    """``(job_id, page_number, start_pos, end_pos, id)``: the stretches of a page that belong to one error, where a later error paints over an earlier one.

    Later is by ``created_at``, then ``id``. Errors without a page, place or word paint nothing; information rows neither.
    """
    own = once(errors).where((F.col("word") != "") & F.col("page_number").isNotNull() & (F.col("position") >= 0) & (F.col("severity") != "info"))
    cells = own.select("job_id", "page_number", "id", "created_at", F.explode(F.sequence(F.col("position"), F.col("position") + F.length("word") - 1)).alias("at"))
    painted = cells.groupBy("job_id", "page_number", "at").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    island = F.col("at") - F.row_number().over(Window.partitionBy("job_id", "page_number", "id").orderBy("at"))
    return painted.withColumn("island", island).groupBy("job_id", "page_number", "id", "island").agg(F.min("at").alias("start_pos"), (F.max("at") + 1).alias("end_pos")).drop("island")


def frequent_words(errors: DataFrame, least: int = 3) -> DataFrame:
    """``(word, n)`` for words that occur at least ``least`` times."""
    return once(errors).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def top_unknown_words(errors: DataFrame, k: int = 100) -> DataFrame:
    """``(word, n)``: the ``k`` unknown words met most often; ties by the word."""
    return once(errors).where((F.col("error_type") == "unknown_word") & (F.col("word") != "")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def parity(left: DataFrame, right: DataFrame, tolerated: str = "unknown_word", tolerance: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two checks of the same documents against each other.

    First ``(doc_id, error_type)``: types that the right check finds in a document and the left does not. Then ``(doc_id, left_errors, right_errors, difference,
    within)``: counts without the tolerated type.
    """
    kinds = right.select("doc_id", "error_type").distinct().join(left.select("doc_id", "error_type").distinct(), ["doc_id", "error_type"], "left_anti")
    count = lambda df, name: df.groupBy("doc_id").agg(F.count_if(F.col("error_type") != tolerated).alias(name))
    both = count(left, "left_errors").join(count(right, "right_errors"), "doc_id", "full").na.fill(0)
    diff = F.abs(F.col("left_errors") - F.col("right_errors"))
    return kinds, both.select("doc_id", "left_errors", "right_errors", diff.alias("difference"), (diff <= tolerance).alias("within"))


def changelog_items(lines: DataFrame) -> DataFrame:
    """``(file_id, version, released, category, item_no, item)`` from the lines ``(file_id, line_no, line)`` of changelogs.

    A heading of an unknown category, or a new version, ends the category before it; indented lines go on with the item above.
    """
    line = F.col("line")
    version = F.regexp_extract(line, r"^## \[([^\]]+)\]", 1)
    is_version, is_category, is_item = version != "", line.rlike("^### ."), line.rlike("^- .")
    order = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    category = F.trim(F.regexp_extract(line, "^### (.+)", 1))
    marked = lines.withColumn("version", F.last(F.when(is_version, version), True).over(order)).withColumn("v", F.sum(F.when(is_version, 1).otherwise(0)).over(order))
    marked = marked.withColumn("released", F.last(F.when(is_version, F.struct(F.regexp_extract(line, r"^## \[[^\]]+\]\s*-\s*(\d{4}-\d{2}-\d{2})", 1).alias("d"))), True).over(order)["d"])
    state = F.when(is_version, F.lit("")).when(is_category, F.when(category.isin(*CATEGORIES), category).otherwise(F.lit("")))
    marked = marked.withColumn("category", F.last(state, True).over(order)).withColumn("c", F.sum(F.when(is_version | is_category, 1).otherwise(0)).over(order))
    marked = marked.withColumn("item_no", F.sum(F.when(is_item, 1).otherwise(0)).over(Window.partitionBy("file_id", "c").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    kept = marked.where((F.col("v") > 0) & (F.col("category") != "") & (F.col("item_no") > 0) & (is_item | line.rlike("^  .")))
    words = F.array_sort(F.collect_list(F.struct("line_no", F.trim(F.regexp_extract(line, "^(?:- |  )(.+)", 1)).alias("t"))))
    grouped = kept.groupBy("file_id", "version", "released", "category", "c", "item_no").agg(words.alias("w"))
    return grouped.select("file_id", "version", F.when(F.col("released") != "", F.col("released")).alias("released"), "category", F.col("item_no").cast("int").alias("item_no"), F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("item"))


def unreleased(lines: DataFrame) -> DataFrame:
    """``(file_id, version, at)``: the versions that a reader lists without items, which are the unreleased ones, by the line they open on."""
    version = F.regexp_extract("line", r"^## \[([^\]]+)\]", 1)
    return lines.where(version == "Unreleased").select("file_id", version.alias("version"), F.col("line_no").alias("at"))


def log_lines(log: DataFrame, source: str) -> DataFrame:
    """``(doc_id, line)``: one line of structured log for each row of ``syllables.check_log``."""
    pairs = (("text_length", "text_length"), ("error_count", "error_count"), ("phase1_errors", "structural_errors"), ("unknown_words", "unknown_words"), ("corpus_hits", "corpus_hits"), ("dict_active", "dict_active"))
    inside = [F.concat(F.lit(f'"{name}": '), F.col(column).cast("string")) for name, column in pairs]
    return log.select("doc_id", F.concat(F.lit(f'spellcheck_result {{"source": "{source}", '), F.concat_ws(", ", *inside), F.lit("}")).alias("line"))


def console_report(errors: DataFrame) -> DataFrame:
    """``(job_id, report, exit_code)``: the summary of each job's errors as a reader sees it at a console; severities without errors are left out."""
    counts = severity_counts(errors).select("job_id", *SEVERITIES)
    total = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    lines = [F.when(F.col(s) > 0, F.concat(F.lit(f"  {s.upper()}: "), F.col(s).cast("string"))) for s in ("critical", "error", "info")]
    report = F.concat_ws("\n", F.concat(F.lit("Total errors found: "), total.cast("string")), *lines)
    return counts.select("job_id", report.alias("report"), F.when(total == 0, 0).otherwise(1).alias("exit_code"))
