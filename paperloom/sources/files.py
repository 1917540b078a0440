"""Folders of text files as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import SETTINGS
from ..functions.text import basename, extension, file_type, strip
from ..operators.structure import likely_delimiter

#: Endings of text and Markdown files.
TEXTS = (".txt", ".md")


def endings(extensions: tuple[str, ...]) -> str:
    """A pattern of file names with one of the endings in either case, for a reader's pathGlobFilter."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = SETTINGS.extensions) -> DataFrame:
    """The files of a folder with one of the endings, not of those below it: path, modificationTime, length, content.

    Others aren't opened: the reader is given a pattern of the endings in either case. Spark's reader leaves out empty files, which have
    no text, and names that begin with '_' or '.'; ``names`` has them all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", endings(extensions)).load(path)
    return files.where(extension(F.col("path")).isin(*extensions))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files of a folder, wherever it is: the folder's listing alone, without contents."""
    context = spark.sparkContext
    folder_ = context._jvm.org.apache.hadoop.fs.Path(path)
    found = folder_.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(folder_)
    return spark.createDataFrame([(f.getPath().toString(), f.getLen()) for f in found if f.isFile()], "path string, length bigint")


def listing(files: DataFrame) -> DataFrame:
    """(name, type) of files, by lower-cased name. Contents aren't read."""
    rows = files.select(basename(F.col("path")).alias("name"))
    ending = extension(F.col("name"))
    return rows.where(ending.isin(*SETTINGS.extensions)).select("name", file_type(ending).alias("type")).orderBy(F.lower("name"), "name")


def decoded(content: Column) -> Column:
    """(text, encoding) of bytes: UTF-8 if they are valid, else Latin-1, which any bytes are."""
    valid = F.is_valid_utf8(content.cast("string"))
    text = F.when(valid, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    # Text files are read with all line ends as one.
    plain = F.regexp_replace(text, "\r\n|\r", "\n")
    return F.struct(plain.alias("text"), F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"))


def texts(files: DataFrame) -> DataFrame:
    """(source, text, encoding, file_type, content_format, likely_delimiter) of text and Markdown files that aren't blank."""
    rows = files.where(extension(F.col("path")).isin(*TEXTS)).select("path", decoded(F.col("content")).alias("d"))
    delimiter = likely_delimiter(F.col("d.text"))
    out = rows.select(F.col("path").alias("source"), "d.text", "d.encoding", F.lit("txt").alias("file_type"), delimiter.alias("likely_delimiter"))
    return out.withColumn("content_format", F.when(F.col("likely_delimiter").isNotNull(), "tabular_text")).where(strip(F.col("text")) != "")


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The text of a DOCX file: headers, body, footers; paragraphs end with blank lines, tabs and breaks are kept."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        parts = [n for n in sorted(names) if re.fullmatch(r"word/header\d*\.xml", n)] + [n for n in names if n == "word/document.xml"] + [n for n in sorted(names) if re.fullmatch(r"word/footer\d*\.xml", n)]
        for name in parts:
            for e in ElementTree.fromstring(z.read(name)).iter():
                if e.tag == f"{_WORD}t":
                    out.append(e.text or "")
                elif e.tag == f"{_WORD}tab":
                    out.append("\t")
                elif e.tag in (f"{_WORD}br", f"{_WORD}cr"):
                    out.append("\n")
                elif e.tag == f"{_WORD}p":
                    out.append("\n\n")
    return "".join(out).strip()


def docx(files: DataFrame) -> DataFrame:
    """(source, text, file_type, error) of DOCX files. One that can't be read gets an error, and doesn't stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((path, docx_text(content), None))
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file goes into its row
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(["docx"] * len(rows)), pa.array([r[2] for r in rows], pa.string())], names=["source", "text", "file_type", "error"])

    picked = files.where(extension(F.col("path")) == ".docx").select("path", "content")
    return picked.mapInArrow(run, "source string, text string, file_type string, error string")
