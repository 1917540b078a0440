"""Source divergence audit: how the sources of a language differ from one another, and in which terms from the language.

Terms are counted in one scan. A task sums up what it has read by language, source and term, and forgets it whenever
it holds ``HELD`` sums, so that a common term or a large source is a row or so from each task. The kept terms of a
language are those in ``LEAST`` of its documents. From then on there is a row, a posting, for each source and kept term of it, and
no text is read again.

*Pairs.* Of the terms that neither source has, all have the same f; of those that one has, f hangs on that one's count alone; so

    sum of f = V f(0, 0) + sum over g's terms (f(p, 0) - f(0, 0)) + sum over s's terms (f(0, q) - f(0, 0))
             + sum over the terms of both (f(p, q) - f(p, 0) - f(0, q) + f(0, 0)),

where 0 stands for the probability of an absent term. The middle sums come from each source's counts (a row for each different count),
the last one from the postings: a term's postings are cut into blocks of ``BLOCK`` sources, a task sums up the products of two
blocks of a term for all terms it has, and a row for each pair of sources leaves it. A pair is only made up as far as it is a result.

*Terms.* A source's postings are put into buckets by count, so that a bucket has one p. f falls as the language's q grows towards p,
so that f at the least q of a bucket (if that is below p) bounds the bucket. Buckets are taken in the order of their bounds: first
as many as hold ``top`` terms above q surely, whose values give the source's k-th; then the rest of those whose bound isn't strictly below it. What
is left unseen is strictly below. So there are two steps however many terms there are, and only the top of each task is shuffled.

All arithmetic is on integers: probabilities by decimal division, sums of f as decimals of 38 digits. Text is cut as bytes, as UTF-8 has bytes of 128 and more
for all that isn't ASCII.

Defined cases: a null text, language or source is an empty one; a text without words makes its group occur; a language without
kept terms has no term rows, and value 0 for all pairs; with one source it has no pairs; equal values go by the item's UTF-8; repeated rows
count as documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .sizes import if_small, small, small_batches, stored

LEAST, TOP, UNIT = 3, 200, 1_000_000_000
#: Sums that a task holds before it hands them on.
HELD = 400_000
#: Sources of a term that one row of postings holds.
BLOCK = 1024
#: Pairs of postings whose products are formed at once.
AT_ONCE = 1 << 20
#: Parts of a language's sources where there are too many groups for a broadcast.
SALTS = 256

_TERMS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def counted(documents: DataFrame, *, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, df): what each term occurs in each group and in how many of its documents; of every group, a row with a null term."""
    small_batches(documents.sparkSession)

    def batch(sums: dict) -> pa.RecordBatch:
        flat = [(*group, t, n, df[t]) for group, (n_of, df) in sums.items() for t, n in n_of.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], names=["lang", "source", "term", "n", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(2)), b.column(2), strict=True):
                if (lang, source) not in sums:
                    sums[lang, source] = Counter({None: 0}), Counter()
                n_of, df = sums[lang, source]
                words = (text.as_py() or b"").translate(_TERMS).split()
                n_of.update(words)
                df.update(set(words))
            if sum(len(n) for n, _ in sums.values()) > HELD:
                yield batch(sums)
                sums = {}
        if sums:
            yield batch(sums)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    made = rows.mapInArrow(run, "lang string, source string, term binary, n bigint, df bigint")
    return made.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))



def _p(n: str, total: str, terms: str) -> str:
    """The probability of a term; n + 1 times UNIT may be beyond a long."""
    return f"(1 + cast({n} + 1 as decimal(19,0)) * {UNIT}bd div cast({total} + {terms} as decimal(19,0)))"


def _f(p: str, q: str) -> str:
    """floor((p - q)**2 / q); p and q are UNIT + 1 at most, so that the square is a long."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _times(k: str, value: str) -> str:
    return f"cast(cast({k} as decimal(19,0)) * cast({value} as decimal(19,0)) as decimal(38,0))"


def postings_of(counts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Two stored tables. Postings: lang, source, term, p, q (the language's). Groups: lang, source, terms (kept ones of the language), sources (of the
    language) and zero (the group's p of an absent term; null if no term is kept)."""
    there = counts.where("term is not null")
    terms = there.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df").transform(stored)
    found = there.select("lang", "source", "term", "n").join(terms, ["lang", "term"]).transform(stored)
    groups = counts.where("term is null").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all")), "lang", "left")
    groups = groups.join(found.groupBy("lang", "source").agg(F.sum("n").alias("has")), ["lang", "source"], "left").join(langs, "lang")
    groups = groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("has", F.lit(0)).alias("has"), F.coalesce("all", F.lit(0)).alias("all"), "sources")
    groups = groups.withColumn("zero", F.when(F.col("terms") > 0, F.expr(_p("0L", "has", "terms")))).transform(stored)
    placed = found.join(if_small(groups), ["lang", "source"])
    return placed.select("lang", "source", "term", F.expr(_p("n", "has", "terms")).alias("p"), F.expr(_p("total", "all", "terms")).alias("q"), "zero").transform(stored), groups


def _beside(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each of the rows (lang, source, ...) with each other source of its language, as item, and that one's zero, as zero_i."""
    others = groups.select(F.col("lang").alias("__lang"), F.col("source").alias("item"), F.col("zero").alias("zero_i"))
    same = (F.col("lang") == F.col("__lang")) & (F.col("source") != F.col("item"))
    if small(others):
        return rows.join(F.broadcast(others), same).drop("__lang")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    others = others.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(others, same & (F.col("__salt") == F.col("__other"))).drop("__lang", "__salt", "__other")


def _common(postings: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, source, item, value): for each pair, summed by task, what the terms of both add to what each one's terms alone say."""
    cut = groups.select("lang", "source", F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / block)).cast("int").alias("block"))
    several = not groups.where(F.col("sources") > block).isEmpty()
    rows = postings.join(if_small(cut), ["lang", "source"]) if several else postings.withColumn("block", F.lit(0))
    blocks = rows.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("source", "p", "zero")).alias("a"))
    if several:
        blocks = blocks.transform(stored)
        both = blocks.select("lang", "term", "a").join(blocks.select("lang", "term", F.col("a").alias("b")), ["lang", "term"])
    else:
        both = blocks.withColumn("b", F.col("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}

        def batch() -> pa.RecordBatch:
            flat = [(*k, Decimal(v)) for k, v in total.items()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.decimal128(38, 0))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], names=["lang", "source", "item", "value"])

        for b in batches:
            (size_a, name_a, p, zero_p), (size_b, name_b, q, zero_q) = _lists(b.column(1)), _lists(b.column(2))
            langs, names = pa.chunked_array([b.column(0)]).dictionary_encode().combine_chunks(), pa.chunked_array([name_a, name_b]).dictionary_encode()
            code_a, code_b = (x.indices.to_numpy().astype(np.int64) for x in names.chunks)
            lang, names, n = langs.indices.to_numpy().astype(np.int64), names.chunk(0).dictionary.to_pylist(), len(names.chunk(0).dictionary)
            langs = langs.dictionary.to_pylist()
            for low, high in _chunks(size_a * size_b, AT_ONCE):
                row, i, j = _each_pair(size_a, size_b, low, high)
                on = code_a[i] != code_b[j]
                row, i, j = row[on], i[on], j[on]
                value = _whole(p[i], q[j]) - _whole(p[i], zero_q[j]) - _whole(zero_p[i], q[j]) + _whole(zero_p[i], zero_q[j])
                key, at = np.unique((lang[row] * n + code_a[i]) * n + code_b[j], return_inverse=True)
                upper, lower = np.zeros((2, len(key)), np.int64)
                np.add.at(upper, at, value >> 32)
                np.add.at(lower, at, value & 0xFFFFFFFF)
                for k, u, v in zip(key.tolist(), upper.tolist(), lower.tolist(), strict=True):
                    pair = langs[k // n // n], names[k // n % n], names[k % n]
                    total[pair] = total.get(pair, 0) + (u << 32) + v
            if len(total) > HELD:
                yield batch()
                total.clear()
        if total:
            yield batch()

    return both.select("lang", "a", "b").mapInArrow(run, "lang string, source string, item string, value decimal(38,0)")


def _whole(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a column of blocks: their sizes, and all their sources, p and zero."""
    flat = column.flatten()
    return column.value_lengths().to_numpy().astype(np.int64), flat.field("source"), flat.field("p").to_numpy(), flat.field("zero").to_numpy()


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to so much at most, or one row."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def _each_pair(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and the two places, in the flat lists, of each pair of entries of two lists in one row."""
    first_a, first_b = np.cumsum(a) - a, np.cumsum(b) - b
    n = (a * b)[low:high]
    row = np.repeat(np.arange(low, high), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, first_a[row] + k // b[row], first_b[row] + k % b[row]


def pairs(postings: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language; value is a decimal."""
    both = _beside(groups.select("lang", "source", "terms", "zero"), groups)
    absent = both.select("lang", "source", "item", F.expr(f"coalesce({_times('terms', _f('zero', 'zero_i'))}, 0)").cast("decimal(38,0)").alias("value"))
    counts = postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("k")).transform(stored)
    beside = _beside(counts, groups)
    own, others = (f"{_f('p', 'zero_i')} - {_f('zero', 'zero_i')}", f"{_f('zero_i', 'p')} - {_f('zero_i', 'zero')}")
    value = lambda of: F.expr(_times("k", f"({of})")).alias("value")
    left = beside.select("lang", "source", "item", value(own))
    right = beside.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), value(others))
    parts = absent.unionByName(left).unionByName(right).unionByName(_common(postings, groups, block))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _top(rows: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return rows.select("lang", "source", "term", "value").withColumn("rank", place).where(F.col("rank") <= top)


def top_terms(postings: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank) of each group's terms of the greatest f, where p is above q."""
    above = postings.where("p > q")
    buckets = above.groupBy("lang", "source", "p").agg(F.count("*").alias("k"), F.min("q").alias("least")).withColumn("bound", F.expr(_f("p", "least")))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "p").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("k").over(best_first), F.lit(0))).select("lang", "source", "p", "bound", "before").transform(stored)
    seen = lambda some: above.join(some.select("lang", "source", "p"), ["lang", "source", "p"]).withColumn("value", F.expr(_f("p", "q")))
    first = _top(seen(if_small(buckets.where(F.col("before") < top))), top).transform(stored)
    kth = first.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
    unseen = buckets.where(F.col("before") >= top).join(if_small(kth), ["lang", "source"]).where("bound >= kth").transform(stored)
    if unseen.isEmpty():
        return first
    return _top(first.drop("rank").unionByName(seen(if_small(unseen)).select("lang", "source", "term", "value")), top)


def audit(documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' ranks the other sources of the language, part 'term' the group's terms."""
    postings, groups = postings_of(counted(documents, text=text, lang=lang, source=source).transform(stored), least)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    of_pairs = pairs(postings, groups, block).withColumn("rank", place).select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")
    of_terms = top_terms(postings, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("value").cast("bigint").alias("value"), "rank")
    return of_pairs.unionByName(of_terms)


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST}
), own AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*)::HUGEINT AS terms, sum(total)::HUGEINT AS has FROM kept GROUP BY lang),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM own WHERE own.lang = g.lang AND own.source = g.source), 0)::HUGEINT AS has
  FROM (SELECT DISTINCT lang, source FROM d) g
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(o.n, 0) + 1) // (g.has + l.terms) AS p,
         1 + {UNIT}::HUGEINT * (k.total + 1) // (l.has + l.terms) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY a.lang, a.source, b.source
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT *, 'pair' AS part FROM pair UNION ALL BY NAME SELECT *, 'term' AS part FROM term)
) WHERE part = 'pair' OR rank <= {TOP}
"""
