"""Chat formatting by cumulative-snapshot collapse.

A log that writes a conversation out after every turn holds many prefixes of its last state. Each turn is hashed
with its position; the running exclusive-or of these hashes is a rolling hash of the turns so far. A
conversation whose whole hash is a proper prefix's hash of a longer one is dropped by an anti-join; of equal
conversations that of the least id stays. The others are rendered.

Hashes are made before the shuffle by conversation, so that texts are only moved to be rendered. Prefixes are
made distinct before the join, so that a very common first turn is one row.

Defined cases: turns are ordered by turn, role and text; a null role or text is empty, a null turn comes first, a
null id is a conversation; repeated turns are turns. Two 64-bit hashes make a chance match of about 2**-128 for
each pair. ``<|`` in a text is written ``< |``, so that no text can open a turn. Texts of any length are whole; turns that are
alike in turn and role go by a hash of the text. An empty table
gives no rows. Other columns are ignored, those named like results too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .sizes import stored


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, n, of, p, q): each conversation's prefixes of n turns, of its turns, and their rolling hashes."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.md5("text").alias("name"), *(F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (0, 1)))
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "name")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("of", F.count("*").over(own))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "n", "of", F.bit_xor(F.xxhash64("h0", "n")).over(so_far).alias("p"), F.bit_xor(F.xxhash64("h1", "n")).over(so_far).alias("q"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the conversations that aren't a longer one's beginning, one of each group of equal ones."""
    prefixes = hashed(turns).transform(stored)
    whole = prefixes.where("n = of").groupBy("n", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.where("n < of").select("n", "p", "q").distinct()
    return whole.join(proper, ["n", "p", "q"], "left_anti").select("conv_id", F.col("n").cast("bigint").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """kept, and each conversation's turns as one text."""
    ids = kept.select(F.col("conv_id").alias("__id"), "n_turns", "n_copies")
    clean = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select("conv_id", "turn", "role", "text").join(ids, F.col("conv_id").eqNullSafe(F.col("__id")))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(F.coalesce("text", F.lit(""))).alias("name"), F.concat(F.lit("<|im_start|>"), clean("role"), F.lit("\n"), clean("text"), F.lit("<|im_end|>\n")).alias("line"))
    gathered = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda x: x["line"]), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    return render(turns, maximal(turns).transform(stored))


def op10_chat(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn, coalesce(role, ''), md5(coalesce(text, ''))) AS turns
  FROM conversations GROUP BY conv_id
), one AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, turns FROM c GROUP BY n_turns, turns),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM one))
SELECT conv_id, n_turns, n_copies,
       list_reduce(list_prepend('', list_transform(turns, lambda x: '<|im_start|>' || replace(x.r, '<|', '< |') || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10))), lambda a, b: a || b) AS text
FROM one WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = one.turns)
"""
