import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunking, corpus, entities, stitch, structure


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("line,kind", [("TITLE", "heading"), ("Title:", "heading"), ("IV. Part", "heading"), ("1. Foo", "heading"), ("1) x", "list_item"), ("1. " + "x" * 120, "list_item"), ("• x", "list_item"), ("- x", "list_item"), ("plain", "paragraph"), ("  ", "blank"), ("1.x", "list_item"), ("12", "paragraph")])
def test_line_type(spark, line, kind):
    assert one(spark, line, structure.line_type) == kind


def blocks(spark, text):
    rows = structure.with_blocks(spark.createDataFrame([(text,)], "text string")).first().blocks
    return [(b.content_type, b.text) for b in rows]


def test_blocks(spark):
    assert blocks(spark, "A:\nx\n y\n\nz\n- i\n- j") == [("heading", "A:"), ("paragraph", "x\n y"), ("paragraph", "z"), ("list_item", "- i\n- j")]
    assert blocks(spark, "") == [] and blocks(spark, None) == [] and blocks(spark, " \n ") == []


@pytest.mark.parametrize("text,delimiter", [("a,b\n" * 5, None), ("a,b\n" * 6 + "x", ","), ("a,b;c\n" * 7, ","), ("a;b\n\n\na\nb\nc\nd", None), ("a|b\n" * 4 + "c\nd", "|"), ("a\tb\n" * 6, "\t")])
def test_delimiter(spark, text, delimiter):
    assert one(spark, text, structure.likely_delimiter) == delimiter


def folded(chunks, most=200):
    done = chunks[0] if chunks else ""
    for c in chunks[1:]:
        n = next((k for k in range(min(len(done), len(c), most), 0, -1) if done[-k:] == c[:k]), 0)
        done = done if not c else done + c[n:] if n else done + "\n\n" + c
    return done


@pytest.mark.parametrize("chunks", [["abcde", "cdefg"], ["abc", "xyz"], ["the", "energy"], ["", "a"], ["a", ""], [], ["x" * 300, "x" * 300]])
def test_stitch(spark, chunks):
    row = spark.createDataFrame([(chunks,)], "c array<string>").select(stitch.stitched(F.col("c")).alias("x")).first()
    assert row.x == folded(chunks)


def test_sample_budgets(spark):
    rows = spark.createDataFrame([("b/x.txt", 1, 0, "one"), ("b/x.txt", 2, 0, "two"), ("a/x.txt", 1, 0, "three"), ("c", 1, 0, "")], "source string, page int, chunk_index int, page_content string")

    def loop(budget):
        queues = {"a/x.txt": ["three"], "b/x.txt": ["one", "two"]}
        out, used, begun = [], 0, set()
        while used < budget and any(queues.values()):
            for s in sorted(queues):
                if queues[s] and used < budget:
                    piece = ("" if s in begun else "--- x.txt ---\n") + queues[s].pop(0) + "\n"
                    begun.add(s)
                    out.append(piece)
                    used += len(piece)
        return "".join(out)

    for budget in (0, 1, 19, 20, 21, 40, 6000):
        assert (corpus.sample_text(rows, budget).first().excerpts or "") == loop(budget)


@given(st.lists(st.sampled_from(["word", "x" * 30, "\n", "\n\n", "é", "."]), max_size=60))
@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_chunks_fit_and_keep_every_word(parts):
    text = " ".join(parts)
    chunks = chunking.recursive_split(text, 40, 10)
    assert all(0 < len(c) <= 40 for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))


def test_chunk_columns(spark):
    rows = chunking.recursive_chunks(spark.createDataFrame([(1, "HEAD\nbody"), (2, ""), (3, None)], "doc_id int, text string")).collect()
    assert [(r.doc_id, r.context_headings, r.content_types_in_chunk) for r in rows] == [(1, "HEAD", "heading, paragraph")]


def test_topics():
    assert chunking.topics([]) == [] and chunking.topics([[1.0]]) == [0] and chunking.topics([[0.0], [1.0], [2.0]]) == [0, 0, 0]
    label = chunking.topics([[0.0], [0.1], [9.0], [9.1]])
    assert label[0] == label[1] != label[2] == label[3]


def test_heuristic_entities(spark):
    text = "Acme Corp met Jane Roe . Jane Roe left Acme Corp on March 3, 2025 with $5 million and 7%. The Man came."
    rows = entities.heuristic(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("rank").collect()
    found = [(r.text, r.type, r.mentions) for r in rows]
    assert found[0] == ("Acme Corp", "organization", 2) and ("Jane Roe", "person", 2) in found and ("March 3, 2025", "date", 1) in found
    assert {r.text for r in rows if r.type == "amount"} == {"$5 million", "7%"} and all(r.text != "The Man" for r in rows)


@pytest.mark.parametrize("answer,found", [
    ('```json\n[{"text": "A", "type": "PERSON"}, {"text": "a", "type": "date"}]\n```', [("A", "person")]), ('so: [{"text": null}, {"type": "date"}, 5, {"text": "B", "type": "odd"}] end', [("None", "other"), ("B", "other")]),
    ("[]", None), ("no", None), ("[broken", None), (None, None),
])
def test_entity_json(spark, answer, found):
    got = one(spark, answer, entities.parsed)
    assert (got and [(e.text, e.type) for e in got]) == found


def test_names_and_money(spark):
    rows = spark.createDataFrame([("C:\\a\\b.TXT", -2.5), ("", 1234.565), (None, None), ("x/.md", 0.0)], "p string, v double")
    got = [tuple(r) for r in rows.select(T.basename(F.col("p")), T.extension(F.col("p")), T.money(F.col("v")), T.percent(F.col("v"))).collect()]
    assert got == [("b.TXT", ".txt", "-$2.50", 0.0), ("Unknown", "", "$1234.57", 100.0), ("Unknown", "", "—", 0.0), (".md", "", "$0.00", 0.0)]
