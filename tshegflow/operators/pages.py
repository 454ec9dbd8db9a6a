"""Pages of documents: how they are read, and where their errors are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import text as X

SCAN_CHARS_PER_PAGE, SCAN_PAGES = 10, 3
#: Share of private-use characters beyond which a text layer is broken, as a fraction.
PRIVATE_USE = (5, 100)
PHANTOMS_AT_LEAST = 3
SYNC_PAGES = 15
MAX_UPLOAD = 50 * 1024 * 1024
DPI, POINTS = 300, 72


def upload_gate(jobs: DataFrame) -> DataFrame:
    """``(id, status_code)``: 400 for a name that is not a PDF's or an empty file, 413 for one beyond 50 MiB, 422 without a page count, else 200."""
    name, size = F.col("file_name"), F.coalesce("file_size", F.lit(0))
    code = F.when(~F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False)), 400).when(size <= 0, 400).when(size > MAX_UPLOAD, 413).when(F.col("page_count").isNull(), 422).otherwise(200)
    return jobs.select("id", code.alias("status_code"))


def sync_route(jobs: DataFrame) -> DataFrame:
    """``(id, mode)``: whether a job is done at once or queued, by its pages."""
    return jobs.select("id", F.when(F.col("page_count") <= SYNC_PAGES, "sync").otherwise("async").alias("mode"))


def private_use(pages: DataFrame) -> DataFrame:
    """``(job_id, private_use, characters, broken)``, white space left out; exactly the threshold is not broken."""
    text = F.coalesce("text", F.lit(""))
    solid = F.regexp_replace(text, f"[{L.WHITE_SPACE}]", "")
    n, d = PRIVATE_USE
    sums = pages.groupBy("job_id").agg(F.sum(F.length(F.regexp_replace(solid, "[^\\ue000-\\uf8ff]", ""))).cast("long").alias("private_use"), F.sum(F.length(solid)).cast("long").alias("characters"))
    return sums.withColumn("broken", (F.col("characters") > 0) & (F.col("private_use") * d > F.col("characters") * n))


def _occurrences(text: Column, word: Column | str) -> Column:
    w = F.lit(word) if isinstance(word, str) else word
    return ((F.length(text) - F.length(F.replace(text, w, F.lit("")))) / F.length(w)).cast("long")


def phantoms(pages: DataFrame) -> DataFrame:
    """``(job_id, phantom_1, phantom_2)``: how often each letter sequence of broken fonts occurs in the job's pages put together, also across a page's end.

    Sequences are two or three letters, none of them twice, so besides the pages only the two characters before each page matter.
    """
    edge = max(map(len, L.PHANTOMS)) - 1
    solid = pages.where(F.coalesce("text", F.lit("")) != "").select("job_id", "page_number", "page_id", "text", F.right("text", F.lit(edge)).alias("tail"), F.left("text", F.lit(edge)).alias("head"))
    order = Window.partitionBy("job_id").orderBy("page_number", "page_id")
    ends = solid.select("job_id", "page_number", "page_id", "tail", "head").withColumn("held", F.right(F.concat(F.coalesce(F.lag("tail", 2).over(order), F.lit("")), F.coalesce(F.lag("tail", 1).over(order), F.lit(""))), F.lit(edge)))
    within = [F.sum(_occurrences(F.col("text"), p)).alias(f"in_{i}") for i, p in enumerate(L.PHANTOMS, 1)]
    across = [F.sum(_occurrences(F.concat("held", "head"), p) - _occurrences(F.col("held"), p) - _occurrences(F.col("head"), p)).alias(f"over_{i}") for i, p in enumerate(L.PHANTOMS, 1)]
    both = pages.select("job_id").distinct().join(solid.groupBy("job_id").agg(*within), "job_id", "left").join(ends.groupBy("job_id").agg(*across), "job_id", "left")
    return both.select("job_id", *((F.coalesce(f"in_{i}", F.lit(0)) + F.coalesce(f"over_{i}", F.lit(0))).cast("long").alias(f"phantom_{i}") for i in range(1, len(L.PHANTOMS) + 1)))


def scanned(pages: DataFrame) -> DataFrame:
    """``(job_id, pages_seen, characters, is_scanned)``: too few characters on the first three pages."""
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("page_number", "page_id"))
    sample = pages.select("job_id", "page_number", "page_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).withColumn("r", first).where(F.col("r") <= SCAN_PAGES)
    sums = sample.groupBy("job_id").agg(F.count(F.lit(1)).alias("pages_seen"), F.sum("n").cast("long").alias("characters"))
    return sums.withColumn("is_scanned", F.col("characters") < SCAN_CHARS_PER_PAGE * F.greatest("pages_seen", F.lit(1)))


def has_bad_font(fonts: Column) -> Column:
    """Whether an array of font names has one whose text layer cannot be trusted."""
    return F.arrays_overlap(fonts, F.array(*map(F.lit, L.BAD_FONTS)))


def route(pages: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """``(job_id, route, reason)``: ``ocr`` for scans, fonts and text layers that cannot be trusted, else ``digital``.

    ``fonts`` has ``job_id`` and ``fonts``, the names of the fonts that a document embeds; jobs without a row there are not judged by it.
    """
    facts = scanned(pages).select("job_id", "is_scanned").join(private_use(pages).select("job_id", "broken"), "job_id").join(phantoms(pages), "job_id")
    font = F.lit(False)
    if fonts is not None:
        bad = fonts.groupBy("job_id").agg(F.bool_or(has_bad_font(F.col("fonts"))).alias("bad_font"))
        facts, font = facts.join(bad, "job_id", "left"), F.coalesce("bad_font", F.lit(False))
    many = F.greatest(*(F.col(f"phantom_{i}") for i in range(1, len(L.PHANTOMS) + 1))) >= PHANTOMS_AT_LEAST
    reason = F.when(F.col("is_scanned"), "scanned").when(font, "font").when(F.col("broken"), "private_use").when(many, "phantoms").otherwise("text")
    return facts.select("job_id", F.when(reason == "text", "digital").otherwise("ocr").alias("route"), reason.alias("reason"))


def word_boxes(pages: DataFrame) -> DataFrame:
    """``(page_id, word_no, word, x0, y0, x1, y1)``: the words of each page that are not blank, numbered from 1 as they stand in the list."""
    each = pages.select("page_id", F.posexplode("words").alias("at", "w"))
    return each.where(F.col("w.text").rlike(f"[^{L.WHITE_SPACE}]")).select("page_id", (F.col("at") + 1).alias("word_no"), F.col("w.text").alias("word"), "w.x0", "w.y0", "w.x1", "w.y1")


def digital_boxes(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """``(page_id, word_no, word, x0, y0, x1, y1)``: the stretch of each word's box in which a marked syllable stands first, by its share of the word's characters."""
    own = pages.where(F.col("text_layer") != "ocr").select("page_id", "job_id", "page_number", "words")
    marked = error_words(errors).withColumnRenamed("word", "mark").join(own.select("page_id", "job_id", "page_number"), ["job_id", "page_number"]).select("page_id", "mark")
    met = word_boxes(own).join(marked, "page_id").where(F.contains("word", "mark"))
    n, at, wide = F.length("word"), F.call_function("locate", F.col("mark"), F.col("word")), F.col("x1") - F.col("x0")
    left, right = F.col("x0") + wide * (at - 1) / n, F.col("x0") + wide * (at - 1 + F.length("mark")) / n
    return met.select("page_id", "word_no", F.col("mark").alias("word"), F.round(left, 4).alias("x0"), "y0", F.round(right, 4).alias("x1"), "y1")


def text_of_lines(lines: DataFrame) -> DataFrame:
    """``(page_id, text)``: the recognised lines of each page that are not empty, in order, joined by line feeds; repeated lines once."""
    once = lines.where(F.col("text") != "").select("page_id", "line_no", "text").distinct()
    return once.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def filled_errors(errors: DataFrame) -> DataFrame:
    """``(id, word, page, error_type, severity, message, component, corpus_hit)``: errors with defaults for what is missing, repeated rows once."""
    default = lambda name, value: F.coalesce(name, F.lit(value)).alias(name)
    return errors.dropDuplicates(["id"]).select("id", default("word", ""), F.col("page_number").alias("page"), default("error_type", "unknown"), default("severity", "error"), "message", "component", "corpus_hit")


def error_words(errors: DataFrame) -> DataFrame:
    """``(job_id, page_number, word)``: the distinct words that are marked on each page, warnings among them. Rows without a word or a page mark nothing."""
    return errors.where((F.col("word") != "") & F.col("page_number").isNotNull()).select("job_id", "page_number", "word").distinct()


def page_errors(errors: DataFrame) -> DataFrame:
    """``(job_id, page_number, error_count, words)``: each page's errors, repeated rows once, with defaults for what is missing. ``words`` are sorted and joined."""
    once = errors.where(F.col("page_number").isNotNull()).dropDuplicates(["id"])
    named = F.sort_array(F.collect_list(F.when(F.col("word") != "", F.col("word"))))
    return once.groupBy("job_id", "page_number").agg(F.count(F.lit(1)).alias("error_count"), F.count_if(F.coalesce("component", F.lit("")) == "").alias("without_component"), F.array_join(named, " ").alias("words"))


def scanned_highlights(lines: DataFrame, pages: DataFrame, errors: DataFrame) -> DataFrame:
    """``(page_id, line_no, x0, y0, x1, y1)``: recognised lines with a marked syllable, as boxes in points within the page. Lines are split at tshegs only.

    Repeated lines come out once; boxes without an area are left out.
    """
    marked = error_words(errors).join(pages.where(F.col("text_layer") == "ocr").select("page_id", "job_id", "page_number", F.col("width").alias("page_width"), F.col("height").alias("page_height")), ["job_id", "page_number"])
    once = lines.select("page_id", "line_no", "text", "x", "y", "width", "height").distinct()
    each = once.select("*", F.explode(F.array_distinct(F.split("text", L.TSHEG, -1))).alias("word")).where("word <> ''")
    hit = each.join(marked, ["page_id", "word"]).select("page_id", "line_no", "x", "y", "width", "height", "page_width", "page_height").distinct()
    fit = lambda v, most: F.greatest(F.lit(0.0), F.least(v * POINTS / DPI, most))
    boxes = hit.select(
        "page_id", "line_no", fit(F.col("x"), F.col("page_width")).alias("x0"), fit(F.col("y"), F.col("page_height")).alias("y0"),
        fit(F.col("x") + F.col("width"), F.col("page_width")).alias("x1"), fit(F.col("y") + F.col("height"), F.col("page_height")).alias("y1"),
    )
    return boxes.where("x1 > x0 AND y1 > y0")


def digital_matches(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """``(page_id, word, matches)``: how often each marked word occurs in its page's text layer, also within other words."""
    own = pages.where((F.col("text_layer") != "ocr") & (F.col("text") != "")).select("page_id", "job_id", "page_number", "text")
    return own.join(error_words(errors), ["job_id", "page_number"]).where(F.contains("text", "word")).select("page_id", "word", _occurrences(F.col("text"), F.col("word")).alias("matches"))


def document_runs(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """``(page_id, line_no, run_no, run, is_error)``: the runs of each line, marked where they are a marked word exactly. Blank lines have none."""
    lines = pages.select("page_id", "job_id", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    each = lines.select("page_id", "job_id", "page_number", (F.col("line_no") + 1).alias("line_no"), F.posexplode(X.runs(F.col("line"))).alias("run_no", "run"))
    marked = error_words(errors).select("job_id", "page_number", F.col("word").alias("run"), F.lit(True).alias("is_error"))
    done = each.join(marked, ["job_id", "page_number", "run"], "left")
    return done.select("page_id", "line_no", (F.col("run_no") + 1).alias("run_no"), "run", F.coalesce("is_error", F.lit(False)).alias("is_error"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, heading, is_blank, lines, page_break)``: the frame of each page in a document; every page but a job's last ends in a page break."""
    last = pages.groupBy("job_id").agg(F.max("page_number").alias("last_page"))
    blank = ~F.coalesce(F.col("text").rlike(f"[^{L.WHITE_SPACE}]"), F.lit(False))
    lines = F.when(blank, 0).otherwise(F.size(F.split("text", "\n", -1)))
    return pages.join(last, "job_id").select("page_id", F.concat(F.lit("Page "), F.col("page_number")).alias("heading"), blank.alias("is_blank"), lines.alias("lines"), (F.col("page_number") < F.col("last_page")).alias("page_break"))
