"""Chunkers. Which pieces a recursive split gives hangs on all that came before in a text, so a text is cut by a Python
function in batches of rows; what is known of a chunk afterwards is worked out by column expressions."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..config import SETTINGS
from ..functions.batches import small_batches
from .structure import content_types, last_headings, with_blocks

SEPARATORS = ("\n\n", "\n", " ", "")


def _parts(text: str, separator: str) -> list[str]:
    """text cut before each separator, which stays with what follows; characters for an empty one."""
    return list(text) if separator == "" else [p for p in re.split(f"(?={re.escape(separator)})", text) if p]


def _merged(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts joined up to a size; each chunk begins with the last parts before it, up to the overlap."""
    out, held, length = [], [], 0
    for part in parts:
        if held and length + len(part) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    return out + (["".join(held)] if held else [])


def recursive_split(text: str, size: int | None = None, overlap: int | None = None, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """A text as chunks of at most so many characters, cut at paragraphs, else lines, words or characters; blank chunks are left out."""
    size, overlap = size or SETTINGS.chunk_size, SETTINGS.chunk_overlap if overlap is None else overlap
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    out: list[str] = []
    small: list[str] = []
    for part in _parts(text, separators[at]):
        if len(part) <= size:
            small.append(part)
            continue
        out += _merged(small, size, overlap)
        small = []
        out += recursive_split(part, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [part]
    return [s for c in out + _merged(small, size, overlap) if (s := c.strip())]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a byte-level tokenizer without a pattern of its own cuts a text by.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _ranked(path: str):
    """(encoding, bytes of each id, added tokens) by ``tiktoken``, which takes a fraction of the time, for a file that is a plain byte-level tokenizer whose
    ids are in the order of its merges; None for all others."""
    try:
        import tiktoken
    except ImportError:
        return None
    import numpy as np

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before, after = (spec.get(k) or {} for k in ("model", "pre_tokenizer", "decoder"))
    odd = [spec.get("normalizer"), spec.get("truncation"), before.get("add_prefix_space"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
    if any(odd) or not before.get("use_regex", True) or [model.get("type"), before.get("type"), after.get("type")] != ["BPE", "ByteLevel", "ByteLevel"]:
        return None
    if any(not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    # Bytes that can't be shown are written by the letters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    words = {w: i for w, i in model["vocab"].items() if w not in added}
    merged = [words.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(c not in byte for w in words for c in w) or not set(byte) <= set(words) or merged != sorted(set(merged) - {-1}) or len(merged) + len(byte) != len(words):
        return None
    ranks = {bytes(byte[c] for c in w): i for w, i in words.items()}
    lengths = np.zeros(max(words.values()) + 1, dtype=np.int64)
    lengths[list(ranks.values())] = [len(w) for w in ranks]
    return tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added), lengths, tuple(added)


def _ends(text: str, path: str, data: bytes):
    """Where each token of a text ends in its bytes; None if the tokenizer itself has to say."""
    if (ranked := _ranked(path)) is None or any(a in text for a in ranked[2]):
        return None
    try:
        ends = ranked[1][ranked[0].encode_to_numpy(text, disallowed_special=())].cumsum()
    except ValueError:  # a run of blanks too long for its pattern
        return None
    return ends if (ends[-1] if len(ends) else 0) == len(data) else None


def token_split(text: str, path: str, size: int | None = None, overlap: int | None = None) -> list[str]:
    """A text as runs of so many tokens, each beginning with the last tokens of the one before. A letter cut by a run's end is a mark for what can't be read."""
    size, overlap = size or SETTINGS.chunk_size, SETTINGS.chunk_overlap if overlap is None else overlap
    data = text.encode()
    if (ends := _ends(text, path, data)) is not None:
        n = len(ends)
        run = lambda i: data[ends[i - 1] if i else 0 : ends[min(i + size, n) - 1] if n else 0].decode("utf-8", "replace")
    else:
        tokenizer = _tokenizer(path)
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        n = len(ids)
        run = lambda i: tokenizer.decode(ids[i : i + size])
    return [c for i in range(0, max(1, n - overlap), size - overlap) if (c := run(i))]


def _annotated(split: DataFrame, method: Column) -> DataFrame:
    """The rows of a table with an array of chunks, a row for each chunk: other columns, chunk_index, page_content, split_method,
    context_headings, content_types_in_chunk."""
    keep = [c for c in split.columns if c not in ("text", "chunks", "__split")]
    return described(split.select(*keep, method.alias("split_method"), F.posexplode("chunks").alias("chunk_index", "page_content")), keep)


def described(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """Chunks with what their text says of them."""
    rows = with_blocks(chunks, "page_content")
    return rows.select(*keep, "chunk_index", "page_content", "split_method", last_headings(F.col("blocks")).alias("context_headings"), content_types(F.col("blocks")).alias("content_types_in_chunk"))


def _cut(documents: DataFrame, split: Callable[[str], list[str]], method: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: split(t) if t and t.strip() else [])

    small_batches(documents.sparkSession)
    # Not deterministic for the plan: it would cut each text once more to see whether there are chunks to be exploded.
    return _annotated(documents.select("*", run.asNondeterministic()("text").alias("chunks")), F.lit(method))


def recursive_chunks(documents: DataFrame, size: int | None = None, overlap: int | None = None) -> DataFrame:
    return _cut(documents, lambda t: recursive_split(t, size, overlap), "recursive")


def token_chunks(documents: DataFrame, path: str, size: int | None = None, overlap: int | None = None) -> DataFrame:
    return _cut(documents, lambda t: token_split(t, path, size, overlap), "token")


def cascade(documents: DataFrame, splitters: list[tuple[str, Callable[[str], list[str]]]]) -> DataFrame:
    """Chunks of the first splitter, by name, that gives some for a text; one that fails, or gives none, makes way for the next. A text that
    none can cut has no chunks."""

    @F.pandas_udf("method string, chunks array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["method", "chunks"])

    def one(text: str | None) -> tuple[str | None, list[str]]:
        for name, split in splitters if text and text.strip() else ():
            try:
                if chunks := split(text):
                    return name, chunks
            except Exception as e:  # noqa: BLE001  the next one is tried
                logging.getLogger(__name__).warning("%s splitter: %s", name, e)
        return None, []

    rows = documents.withColumn("__split", run.asNondeterministic()("text"))
    return _annotated(rows.withColumn("chunks", F.col("__split.chunks")), F.col("__split.method"))


def topics(vectors, most: int = 10, seed: int = 42, steps: int = 50) -> list[int]:
    """A topic for each vector by k-means: at most ten and the root of their number; one is all alike, as many as vectors all different."""
    import numpy as np

    n = len(vectors)
    k = min(most, max(1, int(n**0.5))) if n else 0
    if k in (0, 1):
        return [0] * n
    if k == n:
        return list(range(n))
    x, rng = np.asarray(vectors, dtype=float), np.random.default_rng(seed)
    centres = x[rng.choice(n, 1)]
    while len(centres) < k:
        far = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, x[rng.choice(n, p=far / far.sum())] if far.sum() > 0 else x[len(centres)]])
    label = np.zeros(n, dtype=int)
    for _ in range(steps):
        new = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.stack([x[new == j].mean(0) if (new == j).any() else centres[j] for j in range(k)])
        if (new == label).all():
            break
        label = new
    return label.tolist()


def semantic_chunks(documents: DataFrame, embed, path: str, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """Paragraphs grouped by topic, in order of the topics' first paragraphs, and each group cut by tokens. embed: texts to vectors.

    A text's paragraphs are clustered where the text is: no row waits for another."""

    return _cut(documents, lambda t: semantic_split(t, embed, path, size, overlap), "semantic")


def semantic_split(text: str, embed, path: str, size: int | None = None, overlap: int | None = None) -> list[str]:
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    groups: dict[int, list[str]] = {}
    for topic, p in zip(topics(embed(paragraphs)) if len(paragraphs) > 1 else [0], paragraphs, strict=True):
        groups.setdefault(topic, []).append(p)
    return [c for g in groups.values() for c in token_split("\n\n".join(g), path, size, overlap)]


def pooled(vectors, mask):
    """Mean-pooled embeddings: of texts' token vectors (texts, tokens, size), the mean of those that the mask (texts, tokens) keeps."""
    import numpy as np

    kept = np.asarray(mask, dtype=float)[..., None]
    return (np.asarray(vectors, dtype=float) * kept).sum(1) / np.maximum(kept.sum(1), 1e-9)
