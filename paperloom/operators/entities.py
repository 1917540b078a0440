"""Named entities: by patterns, and from a model's JSON answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import ENTITY_TYPES, SETTINGS, STOPWORDS
from ..functions.candidates import MONTH
from ..functions.once import once
from ..functions.text import strip

# Patterns.
PATTERNS = {
    "organization": "\\b(?:[A-Z][A-Za-z0-9&.]*\\s){0,4}[A-Z][A-Za-z0-9&.]*\\s(?:Inc|Ltd|LLC|Corp|Corporation|Company|University|Institute)\\.?\\b",
    "date": f"\\b(?:\\d{{4}}-\\d{{2}}-\\d{{2}}|(?:{MONTH})\\s+\\d{{1,2}},?\\s+\\d{{4}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}})\\b",
    "amount": "(?:[$€£¥]\\s?\\d[\\d,]*(?:\\.\\d+)?(?:\\s?(?:million|billion|thousand|k|M|B))?\\b|\\b\\d[\\d,]*(?:\\.\\d+)?\\s?%)",
    "person": "\\b(?:[A-Z][a-zA-Z]+(?:\\s+|$)){2,3}",
}
PUNCTUATION = ".,;:"


def heuristic_mentions(texts: DataFrame, key: str = "doc_id", text: str = "text", flags: str = "(?U)") -> DataFrame:
    """(key, kind, i, entity): each mention, in the order in which they are counted. A person is left out who begins with a stopword
    or has a name in common with an organisation of the same text. flags: of the patterns; (?U) for Unicode classes."""
    found = {k: F.regexp_extract_all(text, F.lit(flags + p), F.lit(0)) for k, p in PATTERNS.items()}
    found["organization"] = F.transform(found["organization"], lambda m: F.btrim(strip(m), F.lit(PUNCTUATION)))
    rows = once(texts.select(key, text), **found).drop(text)
    orgs = F.array_distinct(F.transform("organization", F.lower))

    def person(m: Column) -> Column:
        low = F.lower(m)
        return ~F.split_part(m, F.lit(" "), F.lit(1)).isin(STOPWORDS) & ~F.exists("__orgs", lambda o: F.contains(o, low) | F.contains(low, o))

    rows = once(rows, __orgs=orgs)
    rows = once(rows.withColumnRenamed("person", "__runs"), person=F.filter(F.transform("__runs", strip), person))
    kinds = [F.transform(k, lambda m, i: F.struct(m.alias("m"), i.alias("i"))) for k in PATTERNS]
    labelled = [F.transform(c, _labelled(k, n)) for n, (k, c) in enumerate(zip(PATTERNS, kinds, strict=True))]
    rows = rows.select(key, F.explode(F.concat(*labelled)).alias("x"))
    entity = F.btrim(strip(F.col("x.m")), F.lit(PUNCTUATION))
    return rows.select(key, F.col("x.kind").alias("type"), F.struct("x.n", "x.i").alias("at"), entity.alias("entity")).where((F.col("entity") != "") & ~F.col("entity").isin(STOPWORDS))


def _labelled(kind: str, n: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), x["i"].alias("i"), x["m"].alias("m"))


def heuristic(texts: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None, flags: str = "(?U)") -> DataFrame:
    """(key, rank, text, type, mentions): each text's most frequent entities; equal counts go by first mention. A person needs two."""
    mentions = heuristic_mentions(texts, key, text, flags)
    counted = mentions.groupBy(key, F.lower("entity").alias("low"), "type").agg(F.count("*").alias("mentions"), F.min(F.struct("at", "entity")).alias("first"))
    kept = counted.where((F.col("type") != "person") | (F.col("mentions") >= 2))
    # A text has few entities that recur; the arrays hold one entry for each.
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("o"), "first", "type"))), 1, most or SETTINGS.most_entities)
    ranked = kept.groupBy(key).agg(ordered.alias("top")).select(key, F.posexplode("top").alias("i", "e"))
    return ranked.select(key, (F.col("i") + 1).alias("rank"), F.col("e.first.entity").alias("text"), F.col("e.type").alias("type"), (-F.col("e.o")).alias("mentions"))


def parsed(answer: Column, most: int | None = None) -> Column:
    """array of (text, type) of a model's answer; null if it holds no JSON array with an entity."""
    bare = strip(answer)
    open_ = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, "(?i)^```(?:json)?\\s*", ""), "\\s*```$", "")).otherwise(bare)
    body = F.regexp_extract(open_, "(?s)(\\[.*\\])", 1)
    items = F.filter(F.from_json(body, "array<string>"), lambda x: x.rlike("^\\s*\\{"))

    def entity(item: Column) -> Column:
        raw = F.get_json_object(item, "$.text")
        # A null in JSON reads as the word None; a missing text as nothing.
        null = item.rlike('"text"\\s*:\\s*null')
        text = strip(F.when(raw.isNotNull(), raw).when(null, "None").otherwise(""))
        kind = F.lower(strip(F.coalesce(F.get_json_object(item, "$.type"), F.lit("other"))))
        return F.struct(text.alias("text"), F.when(kind.isin(ENTITY_TYPES), kind).otherwise("other").alias("type"))

    named = F.filter(F.transform(items, entity), lambda e: e["text"] != "")
    keys = F.transform(named, lambda e: F.lower(e["text"]))
    first = F.filter(named, lambda e, i: F.array_position(keys, F.lower(e["text"])) == i + 1)
    out = F.slice(first, 1, most or SETTINGS.most_entities)
    return F.when(F.size(out) > 0, out)
