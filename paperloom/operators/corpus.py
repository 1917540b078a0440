"""The catalogue of sources, and a sample of the whole corpus that stays within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SETTINGS
from ..functions.text import basename, page_number


def catalog(chunks: DataFrame) -> DataFrame:
    """(source, pages, chunk_count, full_path) of each source, for sorting by source.

    Pages are made distinct before they are gathered, so that a group gathers its pages and not its chunks."""
    path = F.coalesce("source", F.lit("Unknown Source"))
    page = F.when(F.col("page").cast("string").rlike("^[0-9]+$"), F.col("page").cast("int"))
    pages = chunks.groupBy(path.alias("full_path"), page.alias("page")).agg(F.count("*").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ", ")
    rows = pages.groupBy("full_path").agg(joined.alias("pages"), F.sum("n").alias("chunk_count"))
    return rows.select(basename(F.col("full_path")).alias("source"), F.when(F.col("pages") == "", "N/A").otherwise(F.col("pages")).alias("pages"), "chunk_count", "full_path")


def sources(chunks: DataFrame) -> DataFrame:
    """The different sources that aren't empty."""
    return chunks.select("source").where(F.coalesce("source", F.lit("")) != "").distinct()


def page_count(pages: Column, chunk_count: Column) -> Column:
    """How many pages a catalogue row shows: those listed, or else the chunks."""
    return F.when(F.coalesce(pages, F.lit("N/A")).isin("N/A", ""), F.coalesce(chunk_count, F.lit(0))).otherwise(F.size(F.split(pages, ",", -1)))


#: Rows of a source that are ranked at first; up to so many Spark takes a group's first rows before it shuffles them.
ROUNDS = 1000


def sample(chunks: DataFrame, budget: int | None = None) -> DataFrame:
    """(round, source, piece): sources in turn give their next chunk until the pieces reach the budget; the last may go beyond it.

    chunks: source, page, chunk_index, page_content. A source's first piece begins with its name; equal places go by the text's hash.
    Only lengths are ranked. A piece has a character at least, so no more pieces than the budget's characters can be taken: the
    running sum meets in one task over so many rows at most, and their texts are then fetched by a broadcast of their keys."""
    limit = max(SETTINGS.sample_chars if budget is None else budget, 0)
    rows = chunks.where(F.coalesce(F.length("page_content"), F.lit(0)) > 0)
    rows = rows.select(F.coalesce("source", F.lit("Unknown")).alias("source"), page_number(F.col("page")).alias("page"), F.coalesce("chunk_index", F.lit(0)).alias("i"), F.md5("page_content").alias("name"), "page_content")
    head = F.when(F.col("round") == 1, F.concat(F.lit("--- "), basename(F.col("source")), F.lit(" ---\n"))).otherwise("")
    own = Window.partitionBy("source").orderBy("page", "i", "name")
    ranked = rows.select("source", "page", "i", "name", F.length("page_content").alias("n")).withColumn("round", F.row_number().over(own))

    def first(rounds: int) -> DataFrame:
        return ranked.where(F.col("round") <= rounds).withColumn("n", F.col("n") + F.length(head) + 1).orderBy("round", "source").limit(limit)

    taken = first(min(limit, ROUNDS))
    if limit > ROUNDS and (taken.agg(F.sum("n")).first()[0] or 0) < limit:
        taken = first(limit)
    before = F.sum("n").over(Window.orderBy("round", "source").rowsBetween(Window.unboundedPreceding, -1))
    # Equal rows have equal keys: one of them is fetched for each of their rounds.
    keys = taken.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit).select("source", "page", "i", "name", "round")
    texts = rows.join(F.broadcast(keys), ["source", "page", "i", "name"]).dropDuplicates(["source", "round"])
    return texts.select("round", "source", F.concat(head, F.col("page_content"), F.lit("\n")).alias("piece"))


def sample_text(chunks: DataFrame, budget: int | None = None) -> DataFrame:
    """One row: the sample's pieces as one text."""
    kept = sample(chunks, budget)
    parts = F.array_sort(F.collect_list(F.struct("round", "source", "piece")))
    return kept.agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("excerpts"))


def samples(chunks: DataFrame, group: str, budget: int | None = None) -> DataFrame:
    """(group, excerpts): of each group of sources a sample as ``sample_text`` gives for all; every source has one group, and a group few sources.

    A group's first pieces, no more than ``ROUNDS`` of a source and no more than the budget has characters, are summed up in one task by their lengths; texts are
    fetched for those alone that are taken, and cut to the budget, so that a group's row is bounded."""
    limit = max(SETTINGS.sample_chars if budget is None else budget, 0)
    rows = chunks.where(F.coalesce(F.length("page_content"), F.lit(0)) > 0)
    rows = rows.select(F.col(group).alias("__group"), F.coalesce("source", F.lit("Unknown")).alias("source"), page_number(F.col("page")).alias("page"), F.coalesce("chunk_index", F.lit(0)).alias("i"), F.md5("page_content").alias("name"), "page_content")
    head = F.when(F.col("round") == 1, F.concat(F.lit("--- "), basename(F.col("source")), F.lit(" ---\n"))).otherwise("")
    own = Window.partitionBy("source").orderBy("page", "i", "name")
    keys = rows.select("__group", "source", "page", "i", "name", F.length("page_content").alias("n")).withColumn("round", F.row_number().over(own)).where(F.col("round") <= min(limit, ROUNDS))
    keys = keys.withColumn("n", F.col("n") + F.length(head) + 1)
    before = F.sum("n").over(Window.partitionBy("__group").orderBy("round", "source").rowsBetween(Window.unboundedPreceding, -1))
    taken = keys.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit).select("source", "page", "i", "name", "round")
    texts = rows.join(taken, ["source", "page", "i", "name"]).dropDuplicates(["source", "round"])
    parts = F.array_sort(F.collect_list(F.struct("round", "source", F.left(F.concat(head, F.col("page_content"), F.lit("\n")), F.lit(limit)).alias("piece"))))
    return texts.groupBy(F.col("__group").alias(group)).agg(F.left(F.array_join(F.transform(parts, lambda p: p["piece"]), ""), F.lit(limit)).alias("excerpts"))


def first_chunks(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """One row: the first chunks by source, page and index as one text, which is searched for bills when an index is built."""
    first = chunks.orderBy("source", page_number(F.col("page")), F.coalesce("chunk_index", F.lit(0)), "page_content").limit(most or SETTINGS.scanned_chunks)
    parts = F.array_sort(F.collect_list(F.struct("source", page_number(F.col("page")).alias("page"), F.coalesce("chunk_index", F.lit(0)).alias("i"), "page_content")))
    return first.agg(F.array_join(F.transform(parts, lambda p: p["page_content"]), "\n").alias("text"))
