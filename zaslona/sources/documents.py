"""Documents from files: text, Word, PDF; and results to files."""

from __future__ import annotations

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD_TOKEN = re.compile(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>|(</w:p>|<w:br(?:\s[^>]*)?/?>)|(<w:tab(?:\s[^>]*)?/?>)", re.S)


class NotReadable(ValueError):
    """A file that holds no document of its kind."""


def docx_text(content: bytes) -> str:
    """The text of a Word file: paragraphs and breaks as lines, tabs as tabs."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "word/document.xml" not in names:
                raise NotReadable("no word/document.xml in the file")
            xml = z.read("word/document.xml").decode("utf-8")
    except zipfile.BadZipFile as e:
        raise NotReadable("not a .docx file") from e
    parts = [html.unescape(m[1]) if m[1] is not None else "\n" if m[2] else "\t" for m in _WORD_TOKEN.finditer(xml)]
    return re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip()


def pdf_text(content: bytes) -> str:
    """The text of a PDF, with a reader if one is installed."""
    try:
        import pypdf
    except ImportError as e:
        raise NotReadable("reading PDF needs the pypdf package") from e
    reader = pypdf.PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise NotReadable("the PDF has a password")
    pages = [re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", p.extract_text() or "")) for p in reader.pages]
    if not "".join(pages).strip():
        raise NotReadable("the PDF has no text layer")
    return "\n\n".join(pages)


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", "replace").removeprefix("\ufeff")


#: Characters that ``joined`` puts into one text at most.
JOIN_LIMIT = 64 << 20


def extracted(files: DataFrame) -> DataFrame:
    """Rows (path, content, ...) with text and error in place of content, by extension: .docx, .pdf, else text."""

    @F.pandas_udf("struct<text string, error string>")
    def read(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for p, c in zip(path, content):
            name = p.lower()
            reader = docx_text if name.endswith(".docx") else pdf_text if name.endswith(".pdf") else plain_text
            try:
                rows.append((reader(c), None))
            except NotReadable as e:
                rows.append((None, str(e)))
            except Exception as e:  # a reader's own errors on broken files
                rows.append((None, f"unreadable {name.rpartition('.')[2].upper()}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    return files.withColumn("__x", read("path", "content")).select(*[c for c in files.columns if c not in ("content", "text", "error")], "__x.text", "__x.error")


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Files as rows (path, text, error)."""
    return extracted(spark.read.format("binaryFile").load(list(paths)).select("path", "content"))


def read_text(spark: SparkSession, *paths: str) -> DataFrame:
    """Text files whole, without a byte order mark."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def joined(docs: DataFrame) -> DataFrame:
    """Documents of one small set as a single text, in the order of their paths. A set beyond ``JOIN_LIMIT`` is refused."""
    size = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).head()[0]
    if size > JOIN_LIMIT:
        raise ValueError(f"{size} characters are too many for one text; redact the documents each on its own")
    return docs.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda d: d["text"]), "\n").alias("text"))


def write_text(df: DataFrame, path: str, text_col: str = "redacted") -> None:
    df.select(F.col(text_col).alias("value")).write.text(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.json(path)
