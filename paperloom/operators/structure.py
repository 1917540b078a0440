"""Line types, content blocks and delimited text. All of it stays within a text's row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import let, once
from ..functions.text import SPACE, SPACES, is_upper, strip

# A heading's numbering, a list item's mark, the delimiters in their order.
NUMBERED = f"^(?:[IVXLC]+\\.|\\p{{Nd}}+\\.|[A-Z]\\.){SPACE}+"
ITEM = "^(?:[*\\-•+]|\\p{Nd}+[.)])"
DELIMITERS = [",", "\t", ";", "|"]
SHORT = 100


def line_type(line: Column) -> Column:
    """heading, list_item, paragraph, or blank."""
    return _bare_type(strip(line))


def _bare_type(bare: Column) -> Column:
    heading = (F.length(bare) < SHORT) & (is_upper(bare) | F.endswith(bare, F.lit(":")) | bare.rlike(NUMBERED))
    return F.when(bare == "", "blank").when(heading, "heading").when(bare.rlike(ITEM), "list_item").otherwise("paragraph")


def with_blocks(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with blocks: array of (content_type, text). Lines of one type in a row are a block; a blank line ends it."""
    shown = F.coalesce(F.col(text).rlike(f"[^{SPACES}]"), F.lit(False))
    rows = once(texts, __lines=F.when(shown, F.split(F.col(text), "\n", -1)).otherwise(F.array().cast("array<string>")))
    rows = once(rows, __types=F.transform(F.transform("__lines", _bared), _bare_type))
    begins = lambda t, i: (t != "blank") & ((i == 0) | (F.get("__types", i - 1) != t))
    rows = once(rows, __starts=F.array_compact(F.transform("__types", lambda t, i: F.when(begins(t, i), i))))

    def block(start: Column, k: Column) -> Column:
        until = F.coalesce(F.get("__starts", k + 1), F.size("__lines"))
        n = F.size(F.filter(F.slice("__types", start + 1, until - start), lambda t: t != "blank"))
        return F.struct(F.get("__types", start).alias("content_type"), F.array_join(F.slice("__lines", start + 1, n), "\n").alias("text"))

    return rows.withColumn("blocks", F.transform("__starts", block)).drop("__lines", "__types", "__starts")


def _bared(line: Column) -> Column:
    """A line without white space at its ends; most lines have none, which two letters tell."""
    end = lambda c: F.contains(F.lit(SPACES), c)
    return F.when((line == "") | end(F.left(line, F.lit(1))) | end(F.right(line, F.lit(1))), strip(line)).otherwise(line)


def content_blocks(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, content_type, block_text), a row for each block."""
    rows = with_blocks(texts.select(key, text), text).select(key, F.posexplode("blocks").alias("block_no", "b"))
    return rows.select(key, "block_no", "b.content_type", F.col("b.text").alias("block_text"))


def content_types(blocks: Column) -> Column:
    """The different types of some blocks, sorted and joined; 'unknown' for none."""
    types = F.array_join(F.array_sort(F.array_distinct(F.transform(blocks, lambda b: b["content_type"]))), ", ")
    return F.when(F.size(blocks) == 0, "unknown").otherwise(types)


def last_headings(blocks: Column, most: int = 3) -> Column:
    """The last headings, joined in order; null for none."""
    headings = F.transform(F.filter(blocks, lambda b: b["content_type"] == "heading"), lambda b: b["text"])
    kept = F.slice(headings, F.greatest(F.size(headings) - most + 1, F.lit(1)), most)
    return F.when(F.size(headings) > 0, F.array_join(kept, " > "))


def _sample(text: Column) -> Column:
    """A text's lines, how many there are, and the first 20 of them."""
    return let(F.split(strip(text), "\n", -1), lambda lines: F.struct(F.size(lines).alias("n"), F.slice(lines, 1, 20).alias("first")))


def _counts(sample: Column) -> Column:
    return F.when(sample["n"] > 5, F.array(*(F.size(_having(sample["first"], d)) for d in DELIMITERS)))


def delimiter_counts(text: Column) -> Column:
    """For each delimiter the lines with it, of a text's first 20 lines; null for a text of five lines or fewer."""
    return let(_sample(text), _counts)


def _having(lines: Column, delimiter: str) -> Column:
    return F.filter(lines, lambda x: F.contains(x, F.lit(delimiter)) & (strip(x) != ""))


def likely_delimiter(text: Column) -> Column:
    """The delimiter in most of the first lines, at least in half of them; ties go by the delimiters' order; null for none."""

    def best(c: Column) -> Column:
        most = F.array_max(c["counts"])
        enough = most >= F.greatest(F.lit(1), F.floor(c["size"] * 0.5))
        return F.when(enough & (most > 0), F.get(F.array(*map(F.lit, DELIMITERS)), (F.array_position(c["counts"], most) - 1).cast("int")))

    return let(_sample(text), lambda s: let(F.struct(_counts(s).alias("counts"), F.least(s["n"], F.lit(20)).alias("size")), best))
