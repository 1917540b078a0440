"""Summaries of many sources in a tree."""

import re

from paperloom.config import SETTINGS, SUMMARY_PROMPT
from paperloom.operators import corpus
from paperloom.plans import app
from paperloom.sources import store


class Reader:
    """Says how long a prompt was and which sources it speaks of."""

    def __init__(self, log):
        self.log = str(log)

    def generate(self, prompt, schema=None):
        with open(self.log, "a") as f:
            f.write(f"{len(prompt)}\n")
        return "x" * 3000


def table(spark, n):
    return spark.range(n).selectExpr("concat('folder/a rather long name of document ', id, '.txt') AS source", "1 AS page", "0 AS chunk_index", "repeat(concat('text of ', id, ' '), 20) AS page_content")


def test_prompts_are_bounded_for_100_000_sources(spark, tmp_path):
    chunks = table(spark, 100_000)
    log = tmp_path / "log"
    row = app.summaries(chunks, Reader(log), per_leaf=500).collect()
    assert len(row) == 1 and row[0].summary == "x" * 3000 and row[0].error is None
    sizes = [int(x) for x in log.read_text().split()]
    # 200 leaves, and 25, 4 and 1 prompts above them.
    assert len(sizes) == 200 + 25 + 4 + 1
    assert max(sizes) <= len(SUMMARY_PROMPT) + SETTINGS.sample_chars + 2 * (app.NAME_CHARS + 40)


def test_one_prompt_for_few_sources(spark):
    """The sample of the whole, and all names."""

    class Echo:
        def generate(self, prompt, schema=None):
            return prompt

    chunks = table(spark, 7)
    told = app.summaries(chunks, Echo()).first().summary
    sample = corpus.sample_text(chunks).first().excerpts
    assert told == SUMMARY_PROMPT.replace("{document_names}", ", ".join(f"a rather long name of document {i}.txt" for i in range(7))).replace("{excerpts}", sample)
    assert app.summaries(chunks.where("source = 'none'"), Echo()).collect() == []


def test_every_source_is_in_one_leaf(spark):
    class Names:
        def generate(self, prompt, schema=None):
            found = re.findall(r"text of (\d+) ", prompt)
            counts = re.findall(r"--- (\d+) documents ---", prompt)
            return f"{sum(map(int, counts))}" if counts else " ".join(sorted(set(found)))

    assert app.summaries(table(spark, 60), Names(), per_leaf=5, per_node=3, budget=100_000).first().summary == "60"


def test_insights_of_a_store(spark, tmp_path):
    store.build(table(spark, 30), str(tmp_path / "s"))
    out = app.insights(spark, str(tmp_path / "s"), Reader(tmp_path / "log"), answers=str(tmp_path / "answers"))
    assert out["document_count"] == 30 and out["documents"].count() == 30 and out["summary"] == "x" * 3000
    before = (tmp_path / "log").read_text()
    assert app.insights(spark, str(tmp_path / "s"), Reader(tmp_path / "log"), answers=str(tmp_path / "answers"))["summary"] == out["summary"]
    assert (tmp_path / "log").read_text() == before
