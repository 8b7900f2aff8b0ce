"""Files as documents."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomelattice.functions.text import file_name
from tomelattice.sources.charset import decode

try:
    import pypdf
except ImportError:  # PDF text is an optional extra
    pypdf = None

#: Font sizes from which text is a heading of level 1, 2 and 3.
PDF_HEADINGS = (16.0, 14.0, 12.0)


def html_to_markdown(text: str) -> str:
    """Headings of HTML as Markdown, other tags gone, blocks on lines of their own."""
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", text)
    text = re.sub(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", lambda m: f"\n{'#' * int(m[1])} {re.sub('<[^>]*>', '', m[2]).strip()}\n", text)
    text = re.sub(r"(?i)<(?:br|/p|/div|/li|/tr)\b[^>]*>", "\n", text)
    text = html.unescape(re.sub(r"<[^>]*>", "", text))
    return re.sub(r"\n[ \t]*\n\s*", "\n\n", text).strip()


def pdf_to_markdown(data: bytes) -> str:
    """Text blocks of a PDF, by font size as headings, by font name bold or italic; pages joined by a rule.

    Neighbouring pieces of the same style, whose sizes differ by less than a point, are one block.
    Needs pypdf.
    """
    if pypdf is None:
        raise RuntimeError("STORAGE_009: reading PDF needs pypdf")
    import io

    pages = []
    for page in pypdf.PdfReader(io.BytesIO(data)).pages:
        blocks: list[list] = []

        def visit(text, cm, tm, font, size, blocks=blocks):
            name = str((font or {}).get("/BaseFont", "")).lower()
            style = ("bold" in name, "italic" in name or "oblique" in name)
            if text.strip():
                if blocks and blocks[-1][1] == style and abs(blocks[-1][2] - size) < 1:
                    blocks[-1][0] += text
                else:
                    blocks.append([text, style, size])

        page.extract_text(visitor_text=visit)
        out = []
        for text, (bold, italic), size in blocks:
            body = text.strip().replace("*", "\\*")
            level = next((i for i, s in enumerate(PDF_HEADINGS, 1) if size >= s), 0)
            stars = "*" * (2 * bold + italic)
            out.append(f"{'#' * level} {body}" if level else stars + body + stars)
        pages.append("\n".join(out))
    return "\n\n---\n\n".join(pages).strip()


def extract(path: str, data: bytes, charset: str | None = None) -> tuple[str | None, str | None, str | None]:
    """(text, charset, error) of a file, by the suffix of its name: DOCX, PDF and HTML as Markdown, all else as it is."""
    from tomelattice.sources.docx import to_markdown

    low = path.lower()
    try:
        if low.endswith(".docx"):
            return to_markdown(data), "UTF-8", None
        if low.endswith(".pdf"):
            return pdf_to_markdown(data), "UTF-8", None
        text, found = decode(data, charset)
        return (html_to_markdown(text) if low.endswith((".html", ".htm")) else text), found, None
    except Exception as e:
        return None, None, f"{type(e).__name__}: {e}"


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("text", "charset", "error")]))
def extracted(path: pd.Series, data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(p, bytes(b)) if b is not None else (None, None, None) for p, b in zip(path, data)], columns=["text", "charset", "error"])


def read_documents(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(file_path, name, md5, n_bytes, modified, content, charset, error): one row a file.

    A file that can't be read as its kind has an error and no content; md5 is of its bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(list(paths))
    rows = files.withColumn("x", extracted("path", "content"))
    return rows.select(F.col("path").alias("file_path"), file_name("path").alias("name"), F.md5("content").alias("md5"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"), F.col("x.text").alias("content"), F.col("x.charset").alias("charset"), F.col("x.error").alias("error"))


def read_text(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_path, content) of UTF-8 files, each whole."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
