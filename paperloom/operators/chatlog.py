"""Chat histories as plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import cite_label, strip


def export(messages: DataFrame, key: str = "conv_id", title: str = "Chat History") -> DataFrame:
    """(key, text): each conversation's messages in order. messages: key, turn, role, text, and cites: array of (source, page, quote), or null.

    Whoever isn't the user is the assistant; an assistant's message ends with a rule."""
    quote = lambda c: F.when(F.coalesce(c["quote"], F.lit("")) == "", "").otherwise(F.concat(F.lit(': "'), strip(c["quote"]), F.lit('"')))
    lines = F.array_join(F.transform("cites", lambda c: F.concat(F.lit("  - "), cite_label(c["source"], c["page"]), quote(c), F.lit("\n"))), "")
    cites = F.when(F.coalesce(F.size("cites"), F.lit(0)) > 0, F.concat(F.lit("Citations:\n"), lines)).otherwise("")
    said = F.coalesce("text", F.lit(""))
    piece = F.when(F.col("role") == "user", F.concat(F.lit("User: "), said, F.lit("\n"))).otherwise(F.concat(F.lit("Assistant: "), said, F.lit("\n"), cites, F.lit("-" * 50 + "\n\n")))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", piece.alias("piece"))))
    body = F.array_join(F.transform(turns, lambda t: t["piece"]), "")
    return messages.groupBy(key).agg(F.concat(F.lit(title + "\n" + "=" * 50 + "\n\n"), body).alias("text"))
