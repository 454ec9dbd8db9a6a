"""Pages as word-processor documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pages import error_words

# The parts that a word-processor document must have.
_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>"""
_RELATIONS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""
_OPEN = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>"""
_MARK, _HEADING, _BREAK = "<w:rPr><w:color w:val=\"FF0000\"/><w:u w:val=\"single\"/></w:rPr>", "<w:pPr><w:outlineLvl w:val=\"1\"/></w:pPr>", "<w:p><w:r><w:br w:type=\"page\"/></w:r></w:p>"
BLANK_PAGE = "[no text]"


def _run(text: str, marked: bool) -> str:
    clean = "".join(c for c in text if c >= " " or c == "\t")
    return f"<w:r>{_MARK if marked else ''}<w:t xml:space=\"preserve\">{escape(clean)}</w:t></w:r>"


def document(pages: list[tuple[int, str | None, set[str]]]) -> bytes:
    """A document of ``(page number, text, marked words)``: a heading for each page, its lines with the marked words in red, a page break after all but the last."""
    body = []
    for i, (number, text, marked) in enumerate(pages):
        body.append(f"<w:p>{_HEADING}{_run(f'Page {number}', False)}</w:p>")
        if not (text or "").strip():
            body.append(f"<w:p>{_run(BLANK_PAGE, False)}</w:p>")
        else:
            for line in text.split("\n"):
                pieces = [p for p in line.replace("\u0f0b", "\0\u0f0b\0").replace(" ", "\0 \0").split("\0") if p]
                body.append("<w:p>" + "".join(_run(p, p in marked) for p in pieces) + "</w:p>")
        if i < len(pages) - 1:
            body.append(_BREAK)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS), ("word/document.xml", _OPEN + "".join(body) + "</w:body></w:document>")):
            packed.writestr(zipfile.ZipInfo(name), part)
    return out.getvalue()


def word_documents(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """``(job_id, content)``: each job's pages as one document, by page number. A document is bounded by the size of a file that was uploaded.

    Blank and null pages have a line that says so; pages without a number come first. Rows without a job give no document.
    """
    marked = error_words(errors).groupBy("job_id", "page_number").agg(F.collect_set("word").alias("marked"))
    each = pages.where("job_id IS NOT NULL").select("job_id", "page_number", "page_id", "text").join(marked, ["job_id", "page_number"], "left")

    def build(jobs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in jobs:
            content = [document([(p["page_number"], p["text"], set(p["marked"] if p["marked"] is not None else ())) for p in own]) for own in batch["pages"]]
            yield pd.DataFrame({"job_id": batch["job_id"], "content": content})

    return each.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "text", "marked"))).alias("pages")).mapInPandas(build, "job_id string, content binary")
