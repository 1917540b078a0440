"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages with the line, divided by the
host's pages; lines above ``ratio`` and on ``least`` pages or more are boilerplate there and are dropped. A page
is a distinct text: copies of one page count once, or a group of copies would make its own text boilerplate.

Only hashes of lines are shuffled, each once for a page. The hosts' boilerplate hashes are broadcast if they are few in rows and
bytes, a row for each host, dealt to slots so that a line is looked up among few. If they aren't, pages' line hashes are
joined to them by host and line, and each page to its own; no row then holds more than a page's lines.

Defined cases: lines are compared without white space around them; blank lines are never dropped; a null text
stays null and isn't a page; a null host is a host; repeated rows are one page and are all cleaned; a page of
boilerplate alone becomes an empty text; a text of any length is cut into its lines whole; an empty table gives no rows. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .sizes import if_small, small, stored

RATIO, LEAST = 0.02, 3
SPACE = " \t\r\f\v"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) == ""


def _counted(pages: DataFrame, host: str, text: str, ratio: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(host, page, line) of each page and line hash, and (host, line) of the boilerplate."""
    lines = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), _key))
    each = pages.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), lines.alias("lines"))
    # Line 0 stands for the page itself, so that one shuffle makes both counts.
    rows = each.select("host", "page", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), "lines")).alias("line")).distinct()
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.col("line") == 0)).transform(stored)
    totals = counts.where("line = 0").select(F.col("host").alias("of"), F.col("n").alias("total"))
    frequent = counts.where("line <> 0").join(if_small(totals), F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("total"))
    return rows, frequent.select("host", "line").transform(stored)


def boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, line): the hashes of each host's boilerplate lines."""
    return _counted(pages, host, text, ratio, least)[1]


#: Slots of a host's boilerplate lines, and the most lines that are broadcast.
SLOTS, BROADCAST = 64, 500_000


def drop_lines(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, counts: bool = False, broadcast: int = BROADCAST) -> DataFrame:
    """The pages without boilerplate lines; counts: also n_lines and n_dropped. Such columns of the pages give way."""
    rows, frequent = _counted(pages, host, text, ratio, least)
    names = [c for c in pages.columns if not counts or c not in ("n_lines", "n_dropped")]
    step = pages.select(*names)
    slot = lambda key: F.pmod(key, F.lit(SLOTS)).cast("int")
    if small(frequent, broadcast):
        parts = frequent.groupBy("host", slot(F.col("line")).alias("slot")).agg(F.collect_list("line").alias("lines"))
        found = parts.groupBy(F.col("host").alias("__host")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "lines"))).alias("slots"))
        found = found.select("__host", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.try_element_at("slots", k)).alias("__drop"))
        joined = step.join(F.broadcast(found), F.col(host).eqNullSafe(F.col("__host")), "left")
        gone = lambda key: F.array_contains(F.get("__drop", slot(key)), key)
    else:
        own = rows.join(frequent.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")) & (rows["line"] == frequent["line"]))
        own = own.groupBy(F.col("host").alias("__host"), F.col("page").alias("__page")).agg(F.collect_list(rows["line"]).alias("__drop"))
        joined = step.join(own, F.col(host).eqNullSafe(F.col("__host")) & (F.xxhash64(text) == F.col("__page")), "left")
        gone = lambda key: F.array_contains("__drop", key)
    keyed = F.transform(_lines(F.col(text)), lambda x: F.struct(x.alias("line"), F.when(~_blank(x), _key(x)).alias("key")))
    kept = F.transform(F.filter(keyed, lambda x: ~F.coalesce(gone(x["key"]), F.lit(False))), lambda x: x["line"])
    out = joined.withColumn("__kept", kept)
    cleaned = [F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")).alias(c) if c == text else F.col(c) for c in names]
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text)))).cast("bigint")
    extra = [n.alias("n_lines"), (n - F.when(F.col(text).isNull(), 0).otherwise(F.size("__kept"))).alias("n_dropped")] if counts else []
    return out.select(*cleaned, *extra)


def op4_lines(spark, sf_dir: str) -> DataFrame:
    return drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), counts=True)


SQL = f"""
WITH lines AS (
  SELECT DISTINCT source, text, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
), totals AS (
  SELECT source, count(DISTINCT text) AS total FROM documents GROUP BY source
), boilerplate AS (
  SELECT source, line FROM (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line)
  JOIN totals USING (source) WHERE n >= {LEAST} AND n > {RATIO} * total
), numbered AS (
  SELECT doc_id, source, p, line, EXISTS (SELECT 1 FROM boilerplate b WHERE b.source = d.source AND b.line = trim(d.line, ' ' || chr(9) || chr(13) || chr(12) || chr(11))) AS gone
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) d
)
SELECT doc_id, source, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS text
FROM numbered GROUP BY doc_id, source
"""
