"""The training-text pipeline: toxicity, line dedup, near-dedup, decontamination and packing, one after the other.

Every stage works on all rows that the one before it has kept, and returns the columns of documents; the last one
returns the packed pieces. ``run`` stores what a stage returns before the next one reads it, and deletes it once that one's is stored.

Defined cases, for every stage: an empty table gives an empty table; other columns of documents, whatever their names, are kept (by all but
the last, which ignores them); rows are taken one by one, so that ties and repeated rows have the same fate, but for near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, lines, minhash, packing, toxicity
from paperloom.llm.sizes import discard, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, by a model of labelled rows, is below the threshold. A null or empty text has no terms and stays."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their hosts' boilerplate lines; n_chars follows the text. A null text stays null; a null host is a host; a document
    of boilerplate alone stays, as an empty text."""
    cleaned = lines.drop_lines(docs)
    return cleaned.selectExpr(*("cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least id. Texts without words are no copies of one another; of rows that repeat
    an id one stays; rows with a null id all stay."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. A null or empty text stays."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in sequences. A null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express trained scores, consistent samples or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).transform(stored)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
