"""Lexicon, pages, reports and boxes on small fixtures."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from tshegflow.checker import Checker
from tshegflow.functions import letters as L
from tshegflow.operators import boxes, lexicon, pages, reports
from tshegflow.sources import documents, texts
from tshegflow.sources.lineage import cut


def _pages(spark, texts, layer="embedded"):
    rows = [(i, "j", i, t, layer, 600.0, 800.0) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "page_id long, job_id string, page_number int, text string, text_layer string, width double, height double")


def test_private_use_threshold_is_strict(spark):
    broken = lambda *t: pages.private_use(_pages(spark, t)).first().broken
    assert [broken("a" * 95 + "" * 5), broken("a" * 94 + "" * 6), broken("", None), broken(*["" * 10 + "a" * 10] * 5), broken(" \n")] == [False, True, False, True, False]


def test_phantoms_count_across_pages(spark):
    p = L.PHANTOMS[0]
    count = lambda *t: tuple(pages.phantoms(_pages(spark, t)).first())[1:]
    assert count(p * 2) == (2, 0)
    assert count(p[:1], "", None, p[1:], p[:2], p[2:] + "x") == (2, 0)
    assert count(*p) == (1, 0)
    assert count(L.PHANTOMS[1] * 3, "") == (0, 3)


def test_route(spark):
    route = lambda *t: tuple(pages.route(_pages(spark, t)).first())[1:]
    assert route("short") == ("ocr", "scanned")
    assert route("a" * 94 + "" * 6) == ("ocr", "private_use")
    assert route("x" * 50 + L.PHANTOMS[0] * 2, L.PHANTOMS[0] + "y" * 40) == ("ocr", "phantoms")
    assert route("long enough to be text") == ("digital", "text")


ERRORS = "id string, job_id string, word string, position int, page_number int, error_type string, severity string, message string, component string, corpus_hit boolean, created_at timestamp"


def _errors(spark, rows):
    at = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, "j", w, p, n, "t", s, None, None, None, at + dt.timedelta(seconds=k)) for k, (i, w, p, n, s) in enumerate(rows)], ERRORS)


def test_scanned_highlights(spark):
    lines = spark.createDataFrame([(n, 1, n, t, 300, 300 * n, 300, 60) for n, t in enumerate(["གཀར་ཡིག", "བོད་གཀར་", "ཡིག་གི་", "གཀར།"], 1)] * 2, "line_id long, page_id long, line_no int, text string, x int, y int, width int, height int")
    got = pages.scanned_highlights(lines, _pages(spark, ["x"], "ocr"), _errors(spark, [("a", "གཀར", 0, 1, "error")])).orderBy("line_no").collect()
    assert [(r.line_no, r.x0, r.x1, r.y1) for r in got] == [(1, 72.0, 144.0, 86.4), (2, 72.0, 144.0, 158.4)]


def test_runs_rebuild_the_text(spark):
    text = "བོད་གཀར་ གཀར།\n\nཡིག"
    got = pages.document_runs(_pages(spark, [text]), _errors(spark, [("a", "གཀར", 0, 1, "error")])).orderBy("line_no", "run_no").collect()
    assert [r.run for r in got if r.is_error] == ["གཀར"]
    assert "\n".join("".join(r.run for r in got if r.line_no == n) for n in (1, 2, 3)) == text


def test_spans_later_error_paints_over(spark):
    rows = [("a", "xxxxxx", 0, 1, "error"), ("b", "yy", 2, 1, "error"), ("b", "yy", 2, 1, "error"), ("c", "zz", 9, 1, "warning"), ("d", "qq", 1, 1, "info"), ("e", "", 3, 1, "error"), ("f", "uu", 1, None, "error")]
    got = {(r.start_pos, r.end_pos, r.id) for r in reports.spans(_errors(spark, rows)).collect()}
    assert got == {(0, 2, "a"), (2, 4, "b"), (4, 6, "a"), (9, 11, "c")}


def test_cross_reference(spark):
    words = spark.createDataFrame([("བོད", "a"), ("བོད ", "b"), ("བོད", "b"), ("ཡིག", "a"), ("abc", "a"), ("abc", "b"), (None, "a"), ("ཡིག", None), ("ཡིག", "z")], "word string, source_key string")
    order = spark.createDataFrame([(2, "a"), (1, "b")], "id int, source_key string")
    assert [tuple(r) for r in lexicon.cross_reference(words, order).collect()] == [("བོད", 2, "b,a", "b")]


def test_lexicon_counts_and_upsert(spark):
    words = spark.createDataFrame([(w,) for w in ("བོད", "བོད་ཡིག", "སྤྱན་རས་གཟིགས", "སངས་རྒྱས")], "word_normalized string")
    assert tuple(lexicon.statistics(words).first()) == (True, 4, 7)
    assert tuple(lexicon.statistics(words.limit(0)).first()) == (False, 0, 0)
    existing = words.selectExpr("word_normalized AS word", "word_normalized", "1 AS times_seen")
    incoming = spark.createDataFrame([("བོད",), (" ཡིག",), ("ཡིག",), (None,), ("x",)], "word string")
    assert [tuple(r) for r in lexicon.upsert(existing, incoming).where("times_seen IS NULL").collect()] == [("ཡིག", "ཡིག", None)]


def test_line_groups(spark):
    centers = spark.createDataFrame([(1, n, x, y) for n, (x, y) in enumerate([(50, 100), (10, 110), (30, 118), (5, 200), (1, 219), (9, 400)])] + [(2, 0, 1, 1), (3, 1, None, 2)], "page_id long, box_no long, x int, y int")
    got = boxes.line_groups(centers).where("page_id = 1").orderBy("line_no", "place").collect()
    assert [(r.line_no, r.x) for r in got] == [(1, 9), (2, 1), (2, 5), (3, 10), (3, 30), (3, 50)]


def test_parity(spark):
    schema = "doc_id int, error_type string"
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "unknown_word")], schema)
    right = spark.createDataFrame([(1, "a"), (1, "c"), (3, "a")], schema)
    kinds, counts = reports.parity(left, right)
    assert {tuple(r) for r in kinds.collect()} == {(1, "c"), (3, "a")}
    assert {tuple(r) for r in counts.collect()} == {(1, 2, 2, 0, True), (2, 0, 0, 0, True), (3, 0, 1, 1, False)}


def test_cut_survives_reuse(spark):
    df = cut(spark.range(10).selectExpr("id", "id % 3 AS k"))
    assert df.groupBy("k").count().count() == 3 and df.count() == 10


def test_text_files(spark, tmp_path):
    """Plain text, Markdown, RTF and an unknown ending; a byte order mark, bytes that are no UTF-8, an empty file."""
    files = {"a.txt": "བོད་ཡིག".encode(), "b.md": "\ufeff# Title".encode(), "c.rtf": rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}\f0 Caf\'e9 \u3926?\u3964? A\par B\tab {\*\generator X;}\{x\} \u-10179?\u-8704?}", "d.xyz": b"ok\xff", "e.txt": b"", "f.RTF": b"no rtf"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file_name: (r.format, r.text) for r in texts.read_texts(spark, str(tmp_path)).collect()}
    assert got == {
        "a.txt": ("text", "བོད་ཡིག"), "b.md": ("markdown", "# Title"), "c.rtf": ("rtf", "Café ཝོ A\nB\t{x} 😀".replace("ཝོ", chr(3926) + chr(3964))), "d.xyz": ("text", "ok\ufffd"), "f.RTF": ("rtf", "no rtf"),
    }
    (tmp_path / "CHANGELOG.md").write_text("# Log\n## [Unreleased]\n## [1.0.0] - 2024-02-01\n### Fixed\n- one\n  more\n")
    lines = texts.lines_of(texts.read_texts(spark, str(tmp_path / "CHANGELOG.md")))
    assert [(r.version, r.item) for r in reports.changelog_items(lines).collect()] == [("1.0.0", "one more")] and [(r.version, r.at) for r in reports.unreleased(lines).collect()] == [("Unreleased", 1)]


def test_loading_the_lexicon(spark):
    incoming = spark.createDataFrame([("ཀ", "a,b", "a"), ("ཁ", "b", "b"), ("ཁ", "c", "c"), (None, "a", "a")], "word string, sources string, first_seen_in string").withColumn("word_normalized", F.lit("clash"))
    words = spark.createDataFrame([("ཀ", "x", None)], "word string, word_normalized string, first_seen_in string").withColumn("id", F.lit(1))
    sources, links = spark.createDataFrame([("a", "A")], "source_key string, display_name string"), spark.createDataFrame([("ཀ", "a")], "word string, source_key string")
    rows = lambda tables: [sorted(map(tuple, t.collect()), key=str) for t in tables]
    assert rows(lexicon.load(incoming, words, sources, links)) == [[("ཀ", "x", None), ("ཁ", "ཁ", "b")], [("a", "A"), ("b", "b"), ("c", "c")], [("ཀ", "a"), ("ཀ", "b"), ("ཁ", "b"), ("ཁ", "c")]]
    assert rows(lexicon.load(incoming, words, sources, links, replace=True))[0] == [("ཀ", "ཀ", "a"), ("ཁ", "ཁ", "b")]
    again = lexicon.load(incoming, *lexicon.load(incoming, words, sources, links))
    assert rows(again) == rows(lexicon.load(incoming, words, sources, links))
    assert rows(lexicon.load(incoming.limit(0), words, sources, links))[0] == [("ཀ", "x", None)] and lexicon.seed(spark).count() == 52


def test_words_and_boxes_of_pages(spark):
    word = "struct<text: string, x0: double, y0: double, x1: double, y1: double>"
    rows = [(1, "j", 1, "embedded", [("བོད་ཡིག", 0.0, 0.0, 70.0, 9.0), (" ", 0.0, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)]), (2, "j", 2, "ocr", [("བོད", 0.0, 0.0, 3.0, 1.0)]), (3, None, None, None, None)]
    own = spark.createDataFrame(rows, f"page_id long, job_id string, page_number int, text_layer string, words array<{word}>")
    errors = spark.createDataFrame([("j", 1, "ཡིག"), ("j", 2, "བོད"), ("j", 1, ""), ("j", None, "བོད")], "job_id string, page_number int, word string")
    assert sorted((r.page_id, r.word_no) for r in pages.word_boxes(own).collect()) == [(1, 1), (2, 1)]
    assert [(r.page_id, r.word_no, r.word, r.x0, r.x1) for r in pages.digital_boxes(own, errors).collect()] == [(1, 1, "ཡིག", 40.0, 70.0)]
    assert pages.digital_boxes(own.limit(0), errors).count() == 0
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (1, 3, ""), (1, 4, None)], "page_id long, line_no int, text string")
    assert [r.text for r in pages.text_of_lines(lines).collect()] == ["a\nb"]


def test_boxes_of_lines(spark):
    schema = "page_id long, line_id long, x int, y int, width int, height int"
    lines = spark.createDataFrame([(1, 1, 0, 0, 400, 11), (1, 1, 0, 0, 400, 11), (1, 2, 0, 50, 100, 10), (1, 3, 300, 52, 101, 10), (2, 4, 5, 5, 10, 10)], schema)
    centers = boxes.centers(lines)
    assert {(r.line_id, r.x_center, r.y_center) for r in centers.collect()} == {(1, 200, 5), (2, 50, 55), (3, 350, 57), (4, 10, 10)}
    groups = boxes.line_groups(centers.select("page_id", F.col("line_id").alias("box_no"), F.col("x_center").alias("x"), F.col("y_center").alias("y")))
    got = sorted((r.page_id, r.line_no, r.x, r.y, r.width, r.height) for r in boxes.merged(centers, groups).collect())
    assert got == [(1, 1, 0, 50, 401, 12), (1, 2, 0, 0, 400, 11), (2, 1, 5, 5, 10, 10)]
    assert {r.page_id: (r.boxes, r.threshold) for r in boxes.line_threshold(lines).collect()} == {1: (2, 15.0), 2: (0, 0.0)}
    assert boxes.line_threshold(lines.limit(0)).count() == 0 and boxes.merged(centers.limit(0), groups).count() == 0
    assert [(r.lines, r.share) for r in boxes.curved_share(spark.createDataFrame([(1, True), (1, None), (1, False)], "page_id long, curved boolean")).collect()] == [(3, round(1 / 3, 6))]
    one, two = (spark.createDataFrame([(1, x)], "page_id long, items array<string>") for x in (["a", "b", "c"], ["x", None]))
    assert [(r.place, r.left, r.right) for r in boxes.paired(one, two).collect()] == [(1, "a", "x"), (2, "b", None)] and boxes.paired(one, two.limit(0)).count() == 0


def test_routes_and_reports(spark):
    own = spark.createDataFrame([("a", 1, 1, "བོད་ཡིག་" * 9), ("b", 2, 1, "བོད་ཡིག་" * 9), ("c", 3, 1, None)], "job_id string, page_id long, page_number int, text string")
    fonts = spark.createDataFrame([("a", ["Jomolhari"]), ("b", ["X", "MicrosoftHimalaya"]), ("b", None), ("c", ["MicrosoftHimalaya"])], "job_id string, fonts array<string>")
    assert {r.job_id: r.reason for r in pages.route(own, fonts).collect()} == {"a": "text", "b": "font", "c": "scanned"}
    errors = spark.createDataFrame([("1", "j", "critical"), ("1", "j", "critical"), ("2", "j", "warning"), ("3", "k", None)], "id string, job_id string, severity string")
    got = {r.job_id: (r.report, r.exit_code) for r in reports.console_report(errors).collect()}
    assert got == {"j": ("Total errors found: 2\n  CRITICAL: 1", 1), "k": ("Total errors found: 0", 0)}


def test_word_documents(spark):
    own = spark.createDataFrame([("j", 2, 5, "བོད་ཡིག <x>\nb"), ("j", 1, 4, " "), ("k", 1, 6, None), (None, 1, 7, "x")], "job_id string, page_number int, page_id long, text string").withColumn("marked", F.lit(1))
    errors = spark.createDataFrame([("j", 2, "ཡིག"), ("j", 2, "ཡིག"), ("j", 1, "")], "job_id string, page_number int, word string")
    got = {r.job_id: bytes(r.content) for r in documents.word_documents(own, errors).collect()}
    assert set(got) == {"j", "k"}
    with zipfile.ZipFile(io.BytesIO(got["j"])) as packed:
        body = ElementTree.fromstring(packed.read("word/document.xml"))
    name = lambda tag: "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}" + tag
    assert ["".join(t.text for t in p.iter(name("t"))) for p in body.iter(name("p"))] == ["Page 1", "[no text]", "", "Page 2", "བོད་ཡིག <x>", "b"]
    assert [r.find(name("t")).text for r in body.iter(name("r")) if r.find(name("rPr")) is not None] == ["ཡིག"]
    assert documents.word_documents(own.limit(0), errors).count() == 0


def test_checker(spark):
    texts_ = spark.createDataFrame([(1, "བོད་གི་x"), (2, None)], "doc_id long, text string")
    words = spark.createDataFrame([("བོད",)], "word_normalized string")
    kinds = lambda checker: sorted((r.doc_id, r.error_type) for r in checker.check(texts_).collect())
    assert kinds(Checker()) == [(1, "non_tibetan_skipped"), (1, "wrong_particle_form")] and kinds(Checker(words)) == [(1, "non_tibetan_skipped"), (1, "unknown_word")]
    assert {r.doc_id: r.error_count for r in Checker(words).log(texts_).collect()} == {1: 2, 2: 0}
    rows = spark.createDataFrame([("བོད",)], "syllable string")
    assert Checker().parse(rows).first().parts.root == "བ" and Checker(words.limit(0)).check_syllables(rows).first().error_type is None
