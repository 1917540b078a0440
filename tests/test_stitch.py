"""Stitching by parts against one fold over each source's chunks."""

import random

import pytest

from paperloom.operators import stitch


def fold(chunks, limit):
    """One chunk after the other, the whole text at hand."""
    text = None
    for chunk in chunks:
        if text is None:
            text = chunk
            continue
        n = next((n for n in range(min(len(text), len(chunk), limit), 0, -1) if text[-n:] == chunk[:n]), 0)
        text += chunk[n:] if n else "\n\n" + chunk
    return text


@pytest.mark.parametrize("seed", range(40))
def test_segments_compose(seed):
    """Wherever a run of chunks is cut, its parts do to any text before them what the chunks do one after the other."""
    draw = random.Random(seed)
    limit = draw.choice([1, 3, 8])
    chunks = ["".join(draw.choice("ab\n") for _ in range(draw.choice([1, 2, 3, 9, 20]))) for _ in range(30)]
    for at in range(len(chunks) + 1):
        segment = stitch.Segment()
        for c in chunks[at:]:
            segment = segment.then(c, limit)
        assert len(segment.open) <= limit + 1
        whole = fold(chunks, limit)
        before = fold(chunks[:at], limit)
        assert segment.after(before and before[-limit:], limit) == whole[-limit:]


@pytest.mark.parametrize("parts, size", [(1, 5), (7, 3), (40, 30)])
def test_large_sources_are_many_parts(spark, parts, size):
    draw = random.Random(parts)
    rows = []
    for source, n in (("big", 400), ("small", 3), (None, 5), ("b", 1), ("pages", 60)):
        for i in range(n):
            page = str(i // 10) if source == "pages" else None
            rows.append((source, page, i, "".join(draw.choice("ab é") for _ in range(draw.randrange(size)))))
    draw.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    chunks = spark.createDataFrame(rows, "source string, page string, chunk_index int, page_content string")
    made = stitch.pieces(chunks, limit=4).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts == 1 or len({r.part for r in made if r.source == "big"}) > parts // 3
    got = {}
    for r in sorted(made, key=lambda r: (r.part, r.place)):
        got[r.source] = got.get(r.source, "") + r.piece
    pages = {}
    for source, page, i, text in rows:
        if text:
            pages.setdefault(source or "Unknown", {}).setdefault(int(page or 0), []).append((i, text))
    assert got == {s: "\n\n".join(fold([t for _, t in sorted(p[k])], 4) for k in sorted(p)) for s, p in pages.items()}


def test_nothing_to_stitch(spark):
    none = spark.createDataFrame([("a", "1", 0, ""), ("a", None, 1, None)], "source string, page string, chunk_index int, page_content string")
    assert stitch.reassemble(none).collect() == []
