"""Text files as rows: plain text, Markdown and RTF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control words of RTF that open a group without text, and those that stand for a character.
RTF_HIDDEN = (
    "fonttbl colortbl stylesheet info pict header headerl headerr headerf footer footerl footerr footerf ftnsep ftnsepc aftnsep aftnsepc listtable listoverridetable revtbl rsidtbl generator themedata "
    "colorschememapping latentstyles datastore xmlnstbl object fldinst mmathPr bkmkstart bkmkend"
).split()
RTF_CHARACTERS = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "emspace": "\u2003", "enspace": "\u2002", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(r"\\u(?P<code>-?\d+) ?|\\'(?P<byte>[0-9a-fA-F]{2})|\\(?P<word>[a-zA-Z]+)(?P<number>-?\d+)? ?|\\(?P<sign>[^a-zA-Z])|(?P<brace>[{}])|(?P<text>[^\\{}\r\n]+)|[\r\n]+")
_RTF_CODE_PAGES = {"1250": "cp1250", "1251": "cp1251", "1252": "cp1252", "65001": "utf-8", "936": "gb18030", "950": "cp950", "932": "cp932"}


def rtf_text(source: str) -> str:
    """The text of an RTF document. What is no RTF comes back as it is."""
    if not source.lstrip().startswith("{\\rtf"):
        return source
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, skip_after, pending = False, 1, 0
    code_page, held = "cp1252", bytearray()

    def flush() -> None:
        if held:
            out.append(held.decode(code_page, "replace"))
            held.clear()

    for m in _RTF.finditer(source):
        if m["byte"] is None:
            flush()
        if m["brace"] == "{":
            stack.append((hidden, skip_after))
            pending = 0
        elif m["brace"] == "}":
            hidden, skip_after = stack.pop() if stack else (hidden, skip_after)
            pending = 0
        elif m["sign"] is not None:
            if m["sign"] == "*":
                hidden = True
            elif not hidden and m["sign"] in "\\{}":
                out.append(m["sign"])
            elif not hidden and m["sign"] == "~":
                out.append("\u00a0")
            elif not hidden and m["sign"] in "\r\n":
                out.append("\n")
        elif m["word"] is not None:
            word = m["word"]
            if word in RTF_HIDDEN:
                hidden = True
            elif word == "ansicpg" and m["number"] in _RTF_CODE_PAGES:
                code_page = _RTF_CODE_PAGES[m["number"]]
            elif word == "uc" and m["number"]:
                skip_after = int(m["number"])
            elif not hidden and word in RTF_CHARACTERS:
                out.append(RTF_CHARACTERS[word])
        elif m["code"] is not None:
            if not hidden:
                out.append(chr(int(m["code"]) % 0x10000))
            pending = skip_after
        elif m["byte"] is not None:
            if pending:
                pending -= 1
            elif not hidden:
                held.append(int(m["byte"], 16))
        elif m["text"] is not None:
            text, pending = m["text"][pending:], max(0, pending - len(m["text"]))
            if not hidden:
                out.append(text)
    flush()
    # characters beyond the first plane are written as two halves
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@F.pandas_udf(T.StringType())
def _rtf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(rtf_text, na_action="ignore")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, file_name, format, text)``: each file whole, decoded from UTF-8, without a byte order mark. Files that end in ``.rtf`` are reduced to their text.

    Other endings, known or not, are read as text; undecodable bytes become U+FFFD. The file source leaves empty files out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    is_rtf = F.lower("file_name").endswith(".rtf")
    raw = F.regexp_replace("raw", "^\ufeff", "")
    text = F.coalesce(_rtf.asNondeterministic()(F.when(is_rtf, raw)), raw)
    return files.select("path", "file_name", F.when(is_rtf, "rtf").when(F.lower("file_name").endswith(".md"), "markdown").otherwise("text").alias("format"), text.alias("text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """``(file_id, line_no, line)`` of ``read_texts``, as ``reports.changelog_items`` takes them."""
    return texts.select(F.col("file_name").alias("file_id"), F.posexplode(F.split("text", "\r?\n", -1)).alias("line_no", "line"))
