"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its rank, plus an
offset of 0 to 1 that its source's hash gives, over its source's rows. All rows are sorted by fractional rank and
cut into shards of equal counts, so that each shard holds every source in proportion. (With one offset for all, sources
of one row would all stand in the middle.) The law that holds is ``rows``: counts at most one apart.

Both rankings are made in buckets of bounded size (see ranks.py), so that a source with a third of all rows is
spread over tasks. Texts are left out of every shuffle.

Defined cases: a null text is empty, a null source is a source; repeated rows are placed one by one; fewer rows
than shards leave shards empty; equal fractional ranks go by source, then rank; equal rows of one source by id, checksum and
size, and rows that are alike in these are interchangeable. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranks import ranked
from .sizes import stored

SHARDS, SEED = 8, 20


def shard(documents: DataFrame, *, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of each document; size: UTF-8 bytes of the text, and one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole).cast("bigint").alias("text_crc32")).transform(stored)
    shuffled = (F.xxhash64(F.lit(seed), "doc_id").cast("double") + 2.0**63) / 2.0**64 * (1 - 2.0**-52)
    own = ranked(rows, ["source"], shuffled, ["doc_id", "text_crc32", "size"], "own", "of").transform(stored)
    offset = (F.pmod(F.xxhash64(F.lit(seed + 1), "source"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    fraction = (F.col("own") + offset) / F.col("of")
    placed = ranked(own, [], fraction, ["source", "own"], "place")
    n = rows.count()
    # Whole numbers: a shard begins at the least place that belongs to it, its number times n over shards, rounded up.
    number = F.expr(f"cast((place * {shards}L) div {max(n, 1)}L as int)")
    first = F.expr(f"(cast((place * {shards}L) div {max(n, 1)}L as bigint) * {n}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "source", "size", "text_crc32", number.alias("shard"), (F.col("place") - first).cast("bigint").alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
