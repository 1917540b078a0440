"""Text files that are too long for a row, as windows of characters.

Spark's text reader deals a file out in splits. Their lines are put together again in pieces, and prefix sums over pieces and splits say where each
begins in the whole text; pieces are then dealt to windows of equal numbers of characters, each with some of what comes before and after. No row and no
task holds a file, and a file that has a third of all bytes is as many windows.

Lines end with "\\n", "\\r\\n" or "\\r", as in files that are read whole. A file is UTF-8 if all of it is, else Latin-1. A byte order mark, which the
reader drops, and a missing last line end are told from the file's size, so that the text is the file's to the last character. A file needs a "\\n"
within what fits into a row (2 GB)."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.stored import stored
from .files import TEXTS, endings

#: Bytes of a piece; characters of a window.
PIECE, WINDOW = 1 << 20, 1 << 20
#: The beginnings of splits are as far apart as the session's spark.sql.files.maxPartitionBytes says.
_PIECES = "source string, size bigint, block bigint, piece bigint, content binary"


def pieces(spark: SparkSession, path: str, over: int = 0, piece: int = PIECE) -> DataFrame:
    """(source, size, block, piece, content) of a folder's text and Markdown files of more than ``over`` bytes, source as in ``files.folder``: whole lines of a split, in order; the last line of a file has an end, whether it has one there or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"source": [unquote(key[0])], "size": [key[1]], "block": [key[2]], "piece": [n], "content": pa.array([b"".join(held)], pa.binary())}, schema)

        schema = pa.schema([("source", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("piece", pa.int64()), ("content", pa.binary())])
        key, held, length, n = None, [], 0, 0
        for batch in batches:
            for *k, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (k != key or length >= piece):
                    yield row()
                    held, length, n = [], 0, n + 1
                if k != key:
                    key, n = k, 0
                held += (line, b"\n")
                length += len(line) + 1
        if held:
            yield row()

    reader = spark.read.option("recursiveFileLookup", "false").option("pathGlobFilter", endings(TEXTS)).option("lineSep", "\n")
    # The size is known of the listing: other files aren't opened.
    lines = reader.text(path).where(F.col("_metadata.file_size") > over).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(run, _PIECES)


def _ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _plain(content: Column, valid: Column) -> Column:
    return _ends(F.when(valid, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1")))


def windows(spark: SparkSession, path: str, before: int, after: int, over: int = 0, piece: int = PIECE, window: int = WINDOW) -> DataFrame:
    """(source, encoding, chars, w, base, text) of a folder's files of more than ``over`` bytes: text begins at the character base of the whole, at most ``before`` characters before the
    window's own, and ends ``after`` characters behind them; chars: of the whole file. Stored."""
    content = F.col("content")
    cut = pieces(spark, path, over, piece).withColumn("valid", F.is_valid_utf8(content.cast("string")))
    cut = cut.withColumns({"n8": F.length(_ends(content.cast("string"))), "n1": F.octet_length(_ends(content.cast("string"))), "bytes": F.octet_length(content), "cr": F.endswith(content, F.unhex(F.lit("0D0A")))})
    cut = stored(cut)
    facts = cut.drop("content")
    whole = facts.groupBy("source", "size").agg(F.sum("bytes").alias("total"), F.bool_and("valid").alias("utf8"), F.max(F.struct("block", "piece")).alias("last"), F.min(F.struct("block", "piece")).alias("first"))
    # What the reader has left out: a mark of three bytes, and the end that the last line was given.
    whole = whole.withColumn("mark", F.col("size") - F.col("total") >= 2).withColumn("open", F.pmod(F.col("size") - F.col("total"), F.lit(3)) == 2).drop("size", "total")
    here = F.struct("block", "piece")
    facts = facts.join(whole, "source").withColumns({"mark": F.col("mark") & (here == F.col("first")), "open": F.col("open") & (here == F.col("last"))})
    chars = F.when(F.col("utf8"), F.col("n8")).otherwise(F.col("n1")) + F.when(F.col("mark"), F.when(F.col("utf8"), 1).otherwise(3)).otherwise(0) - F.when(F.col("open") & ~F.col("cr"), 1).otherwise(0)
    facts = facts.select("source", "block", "piece", "utf8", "mark", "open", chars.alias("n"))
    # Two levels of prefix sums: pieces within a split, and splits within a file.
    inside, over = Window.partitionBy("source", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    splits = facts.groupBy("source", "block").agg(F.sum("n").alias("n"))
    splits = splits.select("source", "block", F.coalesce(F.sum("n").over(over.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"), F.sum("n").over(over).alias("chars"))
    facts = facts.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(splits, ["source", "block"])
    facts = facts.select("source", "block", "piece", "utf8", "mark", "open", "chars", (F.col("begin") + F.col("own")).alias("at"), "n").where("n > 0")
    rows = cut.select("source", "block", "piece", "content").join(facts, ["source", "block", "piece"])
    exact = F.concat(F.unhex(F.when(F.col("mark"), "EFBBBF").otherwise("")), F.when(F.col("open"), F.substring(content, F.lit(1), F.octet_length(content) - 1)).otherwise(content))
    lo, hi = F.greatest(F.lit(0), F.floor((F.col("at") - after) / window)), F.least(F.floor((F.col("at") + F.col("n") - 1 + before) / window), F.floor((F.col("chars") - 1) / window))
    dealt = rows.select("source", "utf8", "chars", "at", "n", _plain(exact, F.col("utf8")).alias("text"), F.explode(F.sequence(lo, hi)).alias("w"))
    start = F.greatest(F.col("at"), F.col("w") * window - before)
    part = F.substring(F.col("text"), (start - F.col("at") + 1).cast("int"), (F.least(F.col("at") + F.col("n"), (F.col("w") + 1) * window + after) - start).cast("int"))
    gathered = dealt.select("source", "utf8", "chars", "w", start.alias("start"), part.alias("part")).where("part <> ''").groupBy("source", "utf8", "chars", "w").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return stored(gathered.select("source", F.when(F.col("utf8"), "utf-8").otherwise("latin-1").alias("encoding"), "chars", "w", F.greatest(F.lit(0), F.col("w") * window - before).alias("base"), text.alias("text")))
