"""Recursive chunks of texts that no row holds, the same as of the whole text.

Where a chunk begins, and which separator cuts there, decides all that follows: the chunk's end and where the next one begins, never further on
than a chunk's size. So a window of the text is a map: from each place where a chunk may begin near its start to the first place behind it. The maps
are put together in groups, the groups in a file's order, and each window learns where its first chunk begins; then all windows cut at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import SETTINGS
from ..functions.stored import discard, stored
from ..functions.text import strip
from ..sources import large
from .chunking import SEPARATORS, described
from .structure import likely_delimiter

#: Windows whose maps are put together in one task.
GROUP = 512
_FAR = 1 << 62
State = tuple[int, int]  # the character where a chunk begins, and the number of the separator that cuts


class Cutter:
    """One window: its text from character ``base`` on, its own part up to ``stop``, and the first place of each separator behind the text."""

    def __init__(self, text: str, base: int, stop: int, chars: int, behind: list[int | None], size: int, overlap: int) -> None:
        self.text, self.base, self.stop, self.chars, self.behind, self.size, self.overlap = text, base, stop, chars, behind, size, overlap

    def find(self, level: int, at: int) -> int:
        """The first place of a separator from ``at`` on."""
        if (i := self.text.find(SEPARATORS[level], at - self.base)) >= 0:
            return i + self.base
        beyond = self.behind[level]
        return _FAR if beyond is None else beyond

    def end(self, at: int, level: int) -> int:
        """Where the part of the outer separators ends that is being cut at ``at``."""
        outer = {0: (), 1: (0,), 2: (1,), 3: (1, 2)}[level]
        return min([self.chars, *(self.find(k, at + 1) for k in outer)])

    def at(self, place: int, text: str) -> bool:
        return self.text.startswith(text, place - self.base)

    def step(self, state: State) -> tuple[int, State]:
        """The end of the chunk that begins at a state (its beginning, if there is none), and the next state."""
        begin, level = state
        end, size = self.end(begin, level), self.size
        if level == 3 and end - begin > size:
            stop = begin + size
            return stop, (stop - min(self.overlap, size - 1), 3)
        starts, here = [], begin
        while level < 3 and here < end:
            there = min(end, self.find(level, here + 1))
            if there - here > size:  # too long for this separator: cut by the next one that is in it
                return here, (here, next((k for k in range(level + 1, 3) if self.find(k, here) < there), 3))
            if there - begin > size:
                while starts and (here - starts[0] > self.overlap or there - starts[0] > size):
                    starts.pop(0)
                return here, (starts[0] if starts else here, level)
            starts.append(here)
            here = there
        return end, (end, next((k for k in range(3) if end < self.chars and self.at(end, SEPARATORS[k])), 3))

    def inside(self, state: State) -> bool:
        return state[0] < min(self.stop, self.chars)

    def entries(self, first: int) -> Iterator[State]:
        """Where a chunk may begin that follows one of the window before."""
        for at in range(first, min(first + self.size + 1, self.stop, self.chars)):
            line, blank = self.at(at, "\n"), self.at(at, " ")
            if self.at(at, "\n\n"):
                yield at, 0
            if line:
                yield at, 1
            k = at - self.base + 1
            row = self.base + max(0, self.text.rfind("\n", 0, k))
            word = self.base + max(0, self.text.rfind("\n", 0, k), self.text.rfind(" ", 0, k))
            if (line or blank) and min(self.chars, self.find(1, at + 1)) - row > self.size:
                yield at, 2
            if self.end(at, 3) - word > self.size:
                yield at, 3

    def map(self, entries: Iterator[State]) -> dict[State, State]:
        """For each entry the first state behind the window."""
        known: dict[State, State] = {}
        out = {}
        for entry in entries:
            path, state = [], entry
            while state not in known and self.inside(state):
                path.append(state)
                state = self.step(state)[1]
            state = known.get(state, state)
            known.update(dict.fromkeys(path, state))
            out[entry] = state
        return out

    def chunks(self, state: State) -> Iterator[str]:
        while self.inside(state):
            stop, after = self.step(state)
            if chunk := self.text[state[0] - self.base : stop - self.base].strip():
                yield chunk
            state = after


_FACTS = ["source", "w", "base", "chars", "text", "b0", "b1", "b2", "top"]
_MAPS = "source string, w bigint, g bigint, came array<bigint>, came_level array<int>, went array<bigint>, went_level array<int>"
_ENTRY = "source string, w bigint, at bigint, level int"


def _cutter(r, size: int, overlap: int, window: int) -> Cutter:
    return Cutter(r.text, r.base, (r.w + 1) * window, r.chars, [None if pd.isna(b) else int(b) for b in (r.b0, r.b1, r.b2)] + [None], size, overlap)


def _pairs(r) -> dict[State, State]:
    return dict(zip(zip(r.came, r.came_level, strict=True), zip(r.went, r.went_level, strict=True), strict=True))


def _maps(frames: Iterator[pd.DataFrame], size: int, overlap: int, window: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            c = _cutter(r, size, overlap, window)
            m = c.map(iter([(0, int(r.top))]) if r.w == 0 else c.entries(r.w * window))
            rows.append((r.source, r.w, r.w // GROUP, [s[0] for s in m], [s[1] for s in m], [s[0] for s in m.values()], [s[1] for s in m.values()]))
        yield pd.DataFrame(rows, columns=["source", "w", "g", "came", "came_level", "went", "went_level"])


def _together(frame: pd.DataFrame) -> pd.DataFrame:
    """The map of a group of windows."""
    first, *others = frame.sort_values("w").itertuples()
    m = _pairs(first)
    for r in others:
        n = _pairs(r)
        m = {a: n.get(b, b) for a, b in m.items()}
    return pd.DataFrame([(first.source, first.g, first.g, [s[0] for s in m], [s[1] for s in m], [s[0] for s in m.values()], [s[1] for s in m.values()])], columns=["source", "w", "g", "came", "came_level", "went", "went_level"])


def _entered(frame: pd.DataFrame) -> pd.DataFrame:
    """(source, w, at, level): where each of consecutive windows, or groups of them, is entered. The first row's entry is given, or its only one."""
    rows, state = [], None
    for r in frame.sort_values("w").itertuples():
        m = _pairs(r)
        if state is None:
            state = next(iter(m)) if pd.isna(getattr(r, "at", None)) else (int(r.at), int(r.level))
        rows.append((r.source, r.w, *state))
        state = m[state] if state in m else state
    return pd.DataFrame(rows, columns=["source", "w", "at", "level"])


def _behind(windows: DataFrame, window: int, after: int) -> DataFrame:
    """windows with b0 to b2, the first place of each separator that begins behind the window's text or at its end, and top, the first
    separator that the whole text has."""
    own = (F.col("w") * window - F.col("base")).cast("int")

    def place(k: int, skip: int):
        found = F.instr(F.substring(F.col("text"), own + 1 + skip, F.lit(window + 1 - skip)), SEPARATORS[k])
        return F.when(found > 0, found - 1 + skip + F.col("w") * window)

    firsts = windows.select("source", "w", *(place(k, 0).alias(f"f{k}") for k in range(3)), *(place(k, after - 1).alias(f"s{k}") for k in range(3)))
    by = Window.partitionBy("source")
    back = by.orderBy(F.desc("w"))
    seen = [F.coalesce(F.lag(f"s{k}").over(back), F.min(f"f{k}").over(back.rowsBetween(Window.unboundedPreceding, -2))).alias(f"b{k}") for k in range(3)]
    has = [F.min(f"f{k}").over(by).isNotNull() for k in range(3)]
    facts = firsts.select("source", "w", *seen, F.when(has[0], 0).when(has[1], 1).when(has[2], 2).otherwise(3).alias("top"))
    return windows.join(facts, ["source", "w"])


def chunks(spark: SparkSession, path: str, size: int | None = None, overlap: int | None = None, over: int = 0, piece: int = large.PIECE, window: int = large.WINDOW) -> DataFrame:
    """The rows that ``recursive_chunks`` gives for the texts of a folder's files of more than ``over`` bytes, however long they are. Other columns: source, encoding, file_type,
    content_format and likely_delimiter; the delimiter is told from the first window."""
    size, overlap = size or SETTINGS.chunk_size, SETTINGS.chunk_overlap if overlap is None else overlap
    after = 2 * size + 4
    if window < after:
        raise ValueError(f"a window has to hold {after} characters at least")
    read = large.windows(spark, path, size + 1, after, over, piece, window)
    ready = stored(_behind(read, window, after))
    discard(read)
    given = {"size": size, "overlap": overlap, "window": window}
    maps = stored(ready.select(*_FACTS).mapInPandas(partial(_maps, **given), _MAPS))
    groups = maps.groupBy("source", "g").applyInPandas(_together, _MAPS)
    entries = groups.groupBy("source").applyInPandas(_entered, _ENTRY).withColumnRenamed("w", "g")
    begun = maps.join(entries, ["source", "g"]).groupBy("source", "g").applyInPandas(_entered, _ENTRY)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(r.source, r.w, list(_cutter(r, **given).chunks((int(r.at), int(r.level))))) for r in frame.itertuples()], columns=["source", "w", "chunks"])

    found = stored(ready.select(*_FACTS).join(begun, ["source", "w"]).mapInPandas(cut, "source string, w bigint, chunks array<string>"))
    counts = found.select("source", "w", F.coalesce(F.sum(F.size("chunks")).over(Window.partitionBy("source").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    heads = ready.where("w = 0").select("source", "encoding", F.lit("txt").alias("file_type"), likely_delimiter(strip(F.col("text"))).alias("likely_delimiter"))
    heads = heads.withColumn("content_format", F.when(F.col("likely_delimiter").isNotNull(), "tabular_text"))
    keep = ["source", "encoding", "file_type", "content_format", "likely_delimiter"]
    rows = found.join(counts, ["source", "w"]).join(heads, "source").select(*keep, "first", F.posexplode("chunks").alias("k", "page_content"))
    return described(rows.select(*keep, (F.col("first") + F.col("k")).cast("int").alias("chunk_index"), "page_content", F.lit("recursive").alias("split_method")), keep)
