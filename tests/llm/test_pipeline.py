import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from paperloom.llm import minhash, toxicity
from paperloom.llm.lines import SQL
from paperloom.llm.words import buffers

from ..oracle import same
from .test_classifiers import brute_score
from .test_decontaminate import brute
from .test_minhash import joined, like


@pytest.fixture(scope="module")
def runs(spark, sf):
    """Each stage's input and output."""
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES:
        out.append((docs, stage(spark, docs, sf).checkpoint()))
        docs = out[-1][1]
    return out


def test_stages_and_run(spark, sf, runs):
    for (name, _), (before, after) in zip(p.STAGES[:-1], runs, strict=False):
        assert after.columns == before.columns and 0 < after.count() <= before.count(), name
    assert p.run(spark, sf).where("piece = 0").count() == runs[-1][0].count()


def test_toxicity_and_lines_against_brute_force(spark, sf, runs):
    before, after = runs[0]
    model = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in before.collect()}
    expected = {i for i, t in texts.items() if not model["lexicon"] or brute_score(t, model) < toxicity.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == expected
    before, after = runs[1]
    assert same(after.select("doc_id", "source", "text"), f"SELECT doc_id, source, text FROM ({SQL})", sf, documents=before.toArrow()) == before.count()
    assert after.where(F.length("text") != F.col("n_chars")).isEmpty()


def test_near_duplicates_and_leaks_against_brute_force(spark, sf, runs):
    before, after = runs[2]
    rows = before.orderBy("doc_id").collect()
    known, idf = minhash.frequent_words(before)
    w = minhash.words_of(*buffers(pa.array([r.text for r in rows])))
    each = [minhash._counted(w, t, minhash.weights(w.hash, known, idf)) for t in range(len(rows))]
    sets = [set(x[0].tolist()) for x in each]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) > 0.5 * min(len(sets[i]), len(sets[j])) and like(each[i], each[j]) >= 0.8]
    label = joined(list(range(len(rows))), near)
    assert sorted(r.doc_id for r in after.collect()) == sorted({rows[k].doc_id for k in label}) and near
    before, after = runs[3]
    leaks = brute([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(x[0] for x in leaks if not x[5]) and any(x[5] for x in leaks)


def test_packing_against_the_tokenizer(runs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = runs[4]
    expected, total = set(), 0
    for r in before.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        first, total = (len(ids) - 1) % 2048 + 1, total + len(ids)
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            own = ids[a : first if k == 0 else a + 2048]
            expected.add((r.doc_id, k, a, len(own), zlib.crc32(own.tobytes())))
    got = after.collect()
    assert len(got) == len(expected) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected
    assert len({r.sequence_id for r in got}) <= math.ceil(total / 2048) + 2


def test_odd_rows_pass_all_stages(spark, odd, none, sf):
    extra = "row int, __row string, node int, label string, key int, keys string, hits int, found int, terms int, n_lines int, piece string, sequence_id int, class_id int, a int, b int"
    more = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in extra.split(", "))]
    for docs in (odd.select("*", *more), none.select("*", *more)):
        out = docs
        for name, stage in p.STAGES:
            out = stage(spark, out, sf).checkpoint()
            assert name == "packing" or out.columns == docs.columns
        assert (out.count() > 0) == (docs.count() > 0)
