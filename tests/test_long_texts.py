import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking, long_texts
from paperloom.plans import app, providers
from paperloom.sources import files, large, store


def text(seed, ends="\n", n=150):
    """Paragraphs, lines, long lines, long words and runs of blank lines."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeäß漢😀", k=r.choice([1, 3, 5, 8])))
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.05:
            out.append("x" * r.choice([90, 150, 700]) if r.random() < 0.5 else "".join(word() for _ in range(60)))
        elif kind < 0.15:
            out.append(" ".join(word() for _ in range(r.choice([30, 60, 300]))))
        elif kind < 0.4:
            out += [""] * r.choice([1, 1, 2, 5])
        else:
            out.append(" ".join(word() for _ in range(r.randint(1, 15))))
    return ends.join(out)


@pytest.fixture
def split(spark):
    """Splits of 4000 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "100"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


CASES = {
    "plain.txt": text(1).encode(), "ended.txt": (text(2) + "\n").encode(), "blank end.txt": (text(3) + "\n\n\n").encode(), "crlf.txt": text(4, "\r\n").encode(),
    "marked.txt": b"\xef\xbb\xbf" + text(5).encode(), "marked_end.md": b"\xef\xbb\xbf" + (text(6) + "\n").encode(), "latin.txt": ("Grüße an alle\n\n" * 300).encode("latin-1"),
    "latin_mark.txt": b"\xef\xbb\xbf" + "é so\nund\n".encode("latin-1") * 500, "cr_end.txt": text(7).encode() + b"\r", "mixed.txt": text(8, "\r").encode() + b"\n" + text(9).encode(),
    "one_line.txt": ("word " * 3000).encode(), "one_word.txt": b"y" * 4000, "late_space.txt": b"z" * 5000 + b" " + b"z" * 4000 + b"\nend", "lines.txt": b"a b c\n" * 700,
    "small.txt": b"a", "spaces.txt": b" \n \n\n" * 400, "100%+a,b.txt": text(10).encode(),
}


@pytest.fixture
def folder(tmp_path):
    for name, content in CASES.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_windows_hold_the_text_to_the_last_character(split, folder):
    rows = large.windows(split, str(folder), before=7, after=30, piece=200, window=500).collect()
    whole = {r.source: r for r in files.folder(split, str(folder)).select(F.col("path").alias("source"), files.decoded(F.col("content")).alias("d")).collect()}
    assert {r.source for r in rows} == set(whole) and len(rows) > 100
    for r in rows:
        t, w = whole[r.source].d.text, r.w
        assert (r.encoding, r.chars, r.base) == (whole[r.source].d.encoding, len(t), max(0, w * 500 - 7))
        assert r.text == t[r.base : (w + 1) * 500 + 30], (r.source, w)
    assert {(r.source, r.w) for r in rows} == {(s, w) for s, r in whole.items() for w in range(-(-len(r.d.text) // 500))}


@pytest.mark.parametrize(("size", "overlap", "window"), [(80, 15, 200), (60, 0, 333), (100, 90, 1000)])
def test_chunks_are_those_of_the_whole_text(split, folder, size, overlap, window, monkeypatch):
    monkeypatch.setattr(long_texts, "GROUP", 3)
    mine = long_texts.chunks(split, str(folder), size, overlap, piece=300, window=window)
    read = files.texts(files.folder(split, str(folder)))
    theirs = chunking.recursive_chunks(read, size, overlap).select(mine.columns)
    found, expected = ({(r.source, r.chunk_index): r for r in t.collect()} for t in (mine, theirs))
    assert len(expected) > 900
    for source in {s for s, _ in expected}:
        a, b = ([r.page_content for (s, _), r in sorted(t.items()) if s == source] for t in (found, expected))
        assert a == b, source
    assert found == expected


def test_files_of_few_bytes_and_other_endings_are_not_read(spark, folder):
    (folder / "other.csv").write_bytes(b"a" * 9000)
    found = {r.source.rsplit("/", 1)[1] for r in large.pieces(spark, str(folder), over=8000).select("source").distinct().collect()}
    assert found == {n for n, c in CASES.items() if len(c) > 8000}


def test_index_cuts_long_files_in_windows(spark, folder, tmp_path_factory):
    embedder, out = providers.HashedEmbedder(), tmp_path_factory.mktemp("stores")
    rows = []
    for name, whole in (("one", 1 << 30), ("two", 8000)):
        app.index(spark, str(folder), str(out / name), embedder, whole=whole)
        rows.append({(r.source, r.chunk_index): r for r in store.read(spark, str(out / name)).select("source", "chunk_index", "page_content", "split_method", "encoding", "context_headings").collect()})
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_a_window_has_to_hold_two_chunks(spark, folder):
    with pytest.raises(ValueError, match="at least"):
        long_texts.chunks(spark, str(folder), 100, 10, window=100)
