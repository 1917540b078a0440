"""The application's plans: index a folder, ask, sum up, and scan for bills."""

from __future__ import annotations

from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import ANSWER_PROMPT, ENTITIES_PROMPT, NO_SUMMARY, NO_TEXT, SETTINGS, SUMMARY_PROMPT
from ..functions.candidates import looks_like_bill
from ..functions.stored import stored
from ..functions.text import basename, fill, strip
from ..operators import bills, chunking, corpus, entities, long_texts, retrieval, stitch
from ..schemas import CHOICE
from ..sources import files, pdf, store
from . import answers as kept
from .providers import Embedder, Generator, embedded, generated

#: Bytes of a text file that is still read as one row.
WHOLE = 64 << 20


def index(spark: SparkSession, folder: str, path: str, embedder: Embedder, reader: pdf.PdfReader | None = None, images: pdf.ImageReader | None = None, tokens: str | None = None, whole: int = WHOLE) -> bool:
    """Builds the chunk store of a folder's text, DOCX and PDF files; whether its first chunks look like bills.

    Files that can't be read are in the store's errors (``store.errors``), and don't stop the others. tokens: a tokenizer file, for texts that
    the recursive splitter can't cut. Text files of more than ``whole`` bytes are cut in windows, into the same chunks as in one."""
    reader = reader or pdf.SimplePdf()
    found_texts = files.folder(spark, folder, files.TEXTS)
    plain = files.texts(found_texts.where(F.col("length") <= whole)).select("source", "text", "file_type", "encoding", "content_format", "likely_delimiter")
    # What is parsed is read twice, for chunks and for errors.
    words = files.docx(files.folder(spark, folder, (".docx",))).persist(StorageLevel.DISK_ONLY)
    found = pdf.parsed(files.folder(spark, folder, (".pdf",)), reader, images).persist(StorageLevel.DISK_ONLY)
    pages = pdf.documents(found, reader.name)
    read = plain.unionByName(words, allowMissingColumns=True).unionByName(pages.withColumn("file_type", F.lit("pdf")), allowMissingColumns=True)
    splitters = [("recursive", chunking.recursive_split)] + ([("token", partial(chunking.token_split, path=tokens))] if tokens else [])
    good, summary = read.where("error is null").drop("error"), F.coalesce(F.col("content_type") == "form_data_summary", F.lit(False))
    forms = good.where(summary).withColumnRenamed("text", "page_content").withColumn("chunk_index", F.lit(0))
    chunks = chunking.cascade(good.where(~summary), splitters).unionByName(forms, allowMissingColumns=True)
    if not found_texts.where(F.col("length") > whole).select("path").isEmpty():
        chunks = chunks.unionByName(long_texts.chunks(spark, folder, over=whole), allowMissingColumns=True)
    store.build(embedded(chunks, embedder), path, errors=read.where("error is not null"))
    words.unpersist()
    found.unpersist()
    return bool(corpus.first_chunks(store.read(spark, path)).select(looks_like_bill(F.col("text")).alias("b")).first()["b"])


def ask(spark: SparkSession, path: str, question: str, embedder: Embedder, model: Generator, k: int | None = None) -> DataFrame:
    """One row: answer, error and sources, the passages in order."""
    chunks = store.read(spark, path).withColumn("key", F.concat_ws("#", "source", "chunk_index"))
    top = retrieval.top_k(chunks, embedder.embed([question])[0].tolist(), k, key="key")
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "source", "page", F.col("page_content").alias("quote"))))
    row = top.agg(best.alias("found"))
    context = F.array_join(F.transform("found", lambda p: p["quote"]), "\n\n")
    asked = row.select("found", fill(ANSWER_PROMPT, context=context, question=F.lit(question)).alias("prompt"))
    return generated(asked, model).select("answer", "error", F.transform("found", lambda p: F.struct(p["source"].alias("source"), p["page"].alias("page"), p["quote"].alias("quote"))).alias("sources"))


#: Sources of one prompt of excerpts, summaries of one prompt that sums them up, and characters of a prompt that name documents.
PER_LEAF, PER_NODE, NAME_CHARS = 100, 8, 2000


def _listed(names: Column, count: Column, most: int = NAME_CHARS) -> Column:
    """Names in a row, as many as fit, and how many more there are."""
    fits = F.aggregate(names, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda s, x: F.when(s["n"] + F.length(x) + 2 <= most, F.struct((s["n"] + F.length(x) + 2).alias("n"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(most).alias("n"), s["k"].alias("k"))), lambda s: s["k"])
    shown = F.array_join(F.slice(names, 1, fits), ", ")
    more = count - fits
    return F.concat(shown, F.when((fits > 0) & (more > 0), F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).when(more > 0, F.concat(count.cast("string"), F.lit(" documents"))).otherwise(""))


def _told(rows: DataFrame, model: Generator, answers: str | None) -> DataFrame:
    return stored(generated(rows, model) if answers is None else kept.answered(rows, model, answers))


def summaries(chunks: DataFrame, model: Generator, *, answers: str | None = None, per_leaf: int = PER_LEAF, per_node: int = PER_NODE, budget: int | None = None) -> DataFrame:
    """One row: summary and error of all sources, or no row without text.

    Up to ``per_leaf`` sources are summed up from a sample of their chunks within the budget. More are dealt to as many such groups as they need, and the groups' summaries
    summed up again, ``per_node`` at a time, until one is left: a tree, whose levels are tables. A prompt has the budget's characters, the names' and
    the question's, however many sources there are."""
    budget = budget or SETTINGS.sample_chars
    names = corpus.sources(chunks)
    groups = max(1, -(-names.count() // per_leaf))
    place = F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int")
    # The first names of a group are all a prompt may show; a group has some per_leaf.
    listed = names.select(place.alias("node"), basename(F.col("source")).alias("name")).groupBy("node").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count("*").alias("documents"))
    several = chunks.withColumn("node", F.coalesce(place, F.lit(0)))
    texts = (corpus.samples(several, "node", budget) if groups > 1 else corpus.sample_text(chunks, budget).withColumn("node", F.lit(0))).where(strip(F.col("excerpts")) != "")
    rows = texts.join(listed, "node", "left").select("node", F.coalesce("documents", F.lit(0)).alias("documents"), F.col("excerpts").alias("text"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    while True:
        asked = rows.select("node", "documents", fill(SUMMARY_PROMPT, document_names=_listed(F.col("names"), F.col("documents")), excerpts=F.col("text")).alias("prompt"))
        told = _told(asked, model, answers)
        if groups <= 1:
            return told.select(F.col("answer").alias("summary"), "error")
        groups = -(-groups // per_node)
        part = F.concat(F.lit("--- "), F.col("documents").cast("string"), F.lit(" documents ---\n"), F.left(F.coalesce("answer", F.lit("")), F.lit(budget // per_node)), F.lit("\n"))
        up = told.groupBy(F.floor(F.col("node") / per_node).cast("int").alias("node"))
        rows = up.agg(F.sum("documents").alias("documents"), F.array_sort(F.collect_list(F.struct("node", part.alias("part")))).alias("parts"))
        rows = rows.select("node", "documents", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"), F.array().cast("array<string>").alias("names"))


def insights(spark: SparkSession, path: str, model: Generator, answers: str | None = None) -> dict:
    """summary, entities, entity_source, documents (a table of names) and document_count of a store. Nothing but the last rows comes to the driver."""
    chunks = store.read(spark, path)
    documents = corpus.sources(chunks).select(basename(F.col("source")).alias("name"))
    out = {"documents": documents, "document_count": documents.count()}
    text = corpus.sample_text(chunks).first()["excerpts"] or ""
    if not text.strip():
        return out | {"summary": NO_TEXT, "entities": [], "entity_source": "heuristic"}
    told = summaries(chunks, model, answers=answers).first()
    if told is not None and told["error"]:
        raise RuntimeError(told["error"])
    row = spark.createDataFrame([(0, text)], "doc_id int, text string")
    asked = _told(row.withColumn("prompt", fill(ENTITIES_PROMPT, excerpts=F.col("text"))), model, answers)
    answer = asked.select("text", "doc_id", "error", entities.parsed(F.col("answer")).alias("e")).first()
    if answer["error"]:
        raise RuntimeError(answer["error"])
    summary = (told and told["summary"]) or NO_SUMMARY
    if answer["e"] is not None:
        return out | {"summary": summary, "entities": [e.asDict() for e in answer["e"]], "entity_source": "llm"}
    found = entities.heuristic(row).orderBy("rank").select("text", "type").collect()
    return out | {"summary": summary, "entities": [e.asDict() for e in found], "entity_source": "heuristic"}


def scan_bills(spark: SparkSession, path: str, model: Generator, pivot: int = 2025, answers: str | None = None) -> DataFrame:
    """The bill records of a store, and error of those whose model failed. The model is asked once for each document.

    answers: a folder that keeps what the model has said. Then a scan that died or failed in part goes on where it was, and
    ``answers.progress`` of the folder says how far it is."""
    documents = stitch.reassemble(store.read(spark, path))
    rows = bills.with_candidates(documents, pivot).where("bill_like")
    asked = rows.withColumn("prompt", bills.prompt(F.col("text"), F.col("amounts"), F.col("dates"))).withColumn("schema", bills.choice_schema(F.col("amounts"), F.col("dates")))
    told = generated(asked, model, schema="schema") if answers is None else kept.answered(asked, model, answers, schema="schema")
    made = told.withColumn("choice", F.from_json("answer", CHOICE))
    records = bills.validated(made.where("choice.is_bill or error is not null"), keep=("error",))
    return records.select("source", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in records.columns if c not in ("source", "error")), "error")
