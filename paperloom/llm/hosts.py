"""Host-level quality rules, by DataFrame functions alone.

Each text is measured and held against two base rules; failures are counted by host. A host's failure rate is
shrunk towards all hosts' by a beta prior whose mean and strength are fitted to the hosts' rates by moments. A
host whose shrunk rate is above ``limit`` loses all its documents, others only those that fail themselves.

Texts are measured once and the measures, without the texts, stored in the checkpoint folder. Three-word
windows are compared by 64-bit hashes within one text. Host sums are made before the shuffle, so that a large
host is one row from each task; the rejected hosts are broadcast if they are few.

Defined cases: a null text has no words and fails; a null host is a host; repeated rows count and are judged one
by one; with one host, or hosts that all fail alike, a host's rate is the common rate; a text of any length is
measured whole, in its row; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .sizes import if_small, stored

LIMIT = 0.5
STRONGEST = 1e6
_SPACE = "[\\x20\\x09-\\x0D]+"


def measures(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents without the text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rest = [c for c in documents.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = documents.select(
        *rest, F.filter(F.split(whole, _SPACE, -1), lambda x: x != "").alias("__words"), lines.alias("__lines"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
    )
    n = F.size("__words")
    window = lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))
    step = step.select(
        *rest, "n_symbols", n.cast("bigint").alias("n_words"), F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).alias("__windows"),
    )
    # Only a text with a repeated window is sorted.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.withColumn("__sorted", F.when(repeats, F.array_sort(placed))).drop("__windows")
    twice = F.filter("__sorted", lambda x, k: (F.get("__sorted", k - 1)["h"] == x["h"]) | F.coalesce(F.get("__sorted", k + 1)["h"] == x["h"], F.lit(False)))
    step = step.withColumn("__at", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("__sorted")
    covered = F.aggregate(F.transform("__at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return step.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n, failures, rate): each host's documents, failures and shrunk rate."""
    sums = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("failures")).transform(stored)
    rate = F.col("failures") / F.col("n")
    prior = sums.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread")).first()
    mean, spread = prior["mean"] or 0.0, prior["spread"] or 0.0
    strength = min(STRONGEST, max(0.0, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else STRONGEST
    return sums.select("host", "n", "failures", ((F.col("failures") + mean * strength) / (F.col("n") + strength)).alias("rate"))


def judge(documents: DataFrame, *, host: str = "source", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """documents without the text, the measures, base_failed and kept. Such columns of the documents give way."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    judged = measures(documents.select(*(c for c in documents.columns if c not in made)), text).withColumn("base_failed", base_failed()).transform(stored)
    bad = host_rates(judged, host, "base_failed").where(F.col("rate") > limit).select(F.col("host").alias("__bad"), F.lit(True).alias("__rejected"))
    joined = judged.join(if_small(bad), F.col(host).eqNullSafe(F.col("__bad")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__rejected").isNull()).drop("__bad", "__rejected")


def op6_host_rules(spark, sf_dir: str) -> DataFrame:
    return query(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


def query(documents: DataFrame) -> DataFrame:
    return judge(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM places
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
sums AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM j GROUP BY source),
prior AS (SELECT avg(f / n) AS mean, var_pop(f / n) AS spread FROM sums),
strength AS (
  SELECT mean, CASE WHEN spread > 1e-12 THEN least({STRONGEST}, greatest(0, mean * (1 - mean) / spread - 1)) ELSE {STRONGEST} END AS s FROM prior
), bad AS (SELECT source FROM sums, strength WHERE (f + mean * s) / (n + s) > {LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM j.source) AS kept
FROM j
"""
