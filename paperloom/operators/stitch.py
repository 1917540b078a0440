"""Stitching overlapping chunks back into pages and documents."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..config import SETTINGS
from ..functions.stored import stored
from ..functions.text import page_number


def stitched(chunks: Column, most: int | None = None) -> Column:
    """An ordered array of chunks as one text. Of each chunk the longest beginning that ends the text so far, up to ``most``
    characters, is left out; without one a blank line goes between. A shared letter counts as an overlap too.

    Only the end of the text so far is carried from chunk to chunk, and the parts are joined once, so that a text of many chunks isn't
    copied for each."""
    limit = most or SETTINGS.chunk_overlap

    def joined(state: Column, chunk: Column) -> Column:
        reach = F.least(F.length(state["tail"]), F.length(chunk), F.lit(limit))
        lengths = F.when(reach > 0, F.sequence(F.lit(1), F.greatest(reach, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        # The beginning is cut off once, and not for every length.
        ends = F.array(F.struct(state["tail"].alias("tail"), F.left(chunk, F.lit(limit)).alias("head"), lengths.alias("lengths")))
        n = F.transform(ends, lambda e: F.coalesce(F.array_max(F.filter(e["lengths"], lambda k: F.right(e["tail"], k) == F.left(e["head"], k))), F.lit(0)))
        # What is added: nothing for an empty chunk (-1), all after a blank line (0), or what follows the overlap.
        step = F.transform(n, lambda k: F.struct(F.when(chunk == "", -1).otherwise(k).alias("cut")))
        after = lambda cut: F.when(cut == -1, state["tail"]).otherwise(F.right(F.concat(state["tail"], F.when(cut > 0, F.substr(chunk, cut + 1)).otherwise(F.concat(F.lit("\n\n"), chunk))), F.lit(limit)))
        return F.get(F.transform(step, lambda x: F.struct(after(x["cut"]).alias("tail"), F.array_append(state["cuts"], x["cut"]).alias("cuts"))), F.lit(0))

    first = F.coalesce(F.get(chunks, F.lit(0)), F.lit(""))
    rest = F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))
    start = F.struct(F.right(first, F.lit(limit)).alias("tail"), F.array().cast("array<int>").alias("cuts"))
    cuts = F.aggregate(rest, start, joined, lambda s: s["cuts"])
    piece = lambda p: F.when(p["cut"] == -1, "").when(p["cut"] > 0, F.substr(p["chunk"], p["cut"] + 1)).otherwise(F.concat(F.lit("\n\n"), p["chunk"]))
    return F.concat(first, F.array_join(F.transform(F.zip_with(rest, cuts, lambda c, k: F.struct(c.alias("chunk"), k.alias("cut"))), piece), ""))


def overlap(before: str, chunk: str, limit: int) -> int:
    """The characters of the longest beginning of the chunk, up to limit, that ends the text before it."""
    return next((n for n in range(min(len(before), len(chunk), limit), 0, -1) if before.endswith(chunk[:n])), 0)


def _on(before: str, chunk: str, limit: int) -> tuple[str, str]:
    """What a chunk adds to a text, and the text's new end."""
    n = overlap(before, chunk, limit)
    added = chunk[n:] if n else "\n\n" + chunk
    return added, (before + added)[-limit:]


@dataclass(frozen=True)
class Segment:
    """What some consecutive chunks of a page do to any text before them.

    A text always ends with its last chunk, so that a chunk no longer than what is known of the text's end is cut alike whatever stood before. Only the
    others are open: (text from the last open chunk to here, chunk), each longer than what was known, so that there are at most ``limit`` of them
    however many chunks there are. known: the text from the last open chunk on."""

    open: tuple[tuple[str, str], ...] = ()
    known: str = ""

    def then(self, chunk: str, limit: int) -> Segment:
        if self.open and min(len(chunk), limit) <= len(self.known):
            return Segment(self.open, _on(self.known, chunk, limit)[1])
        return Segment((*self.open, (self.known, chunk[:limit])), chunk[-limit:])

    def after(self, before: str | None, limit: int) -> str:
        """The end of the text after these chunks, if it ended so before them; None: they begin it."""
        for between, chunk in self.open:
            if before is None:
                before = ""
                continue
            before = (before + between)[-limit:]
            n = overlap(before, chunk, limit)
            before = before[:-n] if n else (before + "\n\n")[-limit:]
        return ((before or "") + self.known)[-limit:]


def _places(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], str]]:
    return zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True)


def pieces(chunks: DataFrame, source: str = "source", limit: int | None = None) -> DataFrame:
    """(source, page, part, place, piece): what each chunk adds to its source's text. A source's pieces by part, then place, are its text.

    chunks: source, page, chunk_index, page_content. Chunks without text are left out; a page that is no number is page 0. A page's chunks, stitched,
    follow one another; pages are parted by a blank line.

    Chunks are sorted by ranges over all sources, so that a large one is many parts. Each part says first what it does to any text before it (a
    ``Segment`` where one page fills it, else the end of its last page), the parts' words are put together in order on the driver (one for each part), and then
    each part is cut, knowing how the text before it ends. No task gets a source, and no row either."""
    limit = limit or SETTINGS.chunk_overlap
    rows = chunks.where(F.coalesce(F.length("page_content"), F.lit(0)) > 0)
    rows = rows.select(F.coalesce(source, F.lit("Unknown")).alias("source"), page_number(F.col("page")).cast("bigint").alias("page"), F.coalesce("chunk_index", F.lit(0)).alias("i"), "page_content")
    order = ["source", "page", "i", "page_content"]
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)).select("source", "page", "page_content")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, segment = None, None, Segment()
        for batch in batches:
            for at, chunk in _places(batch):
                if last is None:
                    first, segment = at, segment.then(chunk, limit)
                elif at != last:
                    # A page that begins inside the part has nothing before it.
                    segment = Segment((), chunk[-limit:])
                else:
                    segment = segment.then(chunk, limit) if segment.open else Segment((), _on(segment.known, chunk, limit)[1])
                last = at
        if last is not None:
            opens, known = json.dumps(segment.open), segment.known
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((TaskContext.get().partitionId(), *first, *last, opens, known), kinds, strict=True)], names=["part", "source", "page", "last_source", "last_page", "open", "known"])

    said = sorted(sorted_.mapInArrow(sums, "part int, source string, page bigint, last_source string, last_page bigint, open string, known string").collect())
    begins, at, before = {}, None, ""
    for r in said:
        begins[r["part"]] = (at, before)
        # The part's first page goes on from the part before, if that ends in it.
        goes_on = (r["source"], r["page"]) == at
        before = Segment(tuple(map(tuple, json.loads(r["open"]))), r["known"]).after(before if goes_on else None, limit)
        at = r["last_source"], r["last_page"]
    shared = chunks.sparkSession.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        (at, before), place = shared.value.get(part, (None, "")), 0
        for batch in batches:
            out = []
            for now, chunk in _places(batch):
                if now == at:
                    added, before = _on(before, chunk, limit)
                else:
                    added, before = ("\n\n" if at and at[0] == now[0] else "") + chunk, chunk[-limit:]
                    at = now
                out.append(added)
            n = len(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(out, pa.string())], names=["source", "page", "part", "place", "piece"])
            place += n

    return sorted_.mapInArrow(cut, "source string, page bigint, part int, place bigint, piece string")


def reassemble(chunks: DataFrame, source: str = "source") -> DataFrame:
    """(source, text): each source's chunks as one text. Only here, where a text is a value, is a source one row; ``pieces`` has it in rows."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "place", "piece")))
    return pieces(chunks, source).groupBy("source").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("text"))
