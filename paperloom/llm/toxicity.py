"""Toxicity: misspelt lexicon terms by Levenshtein automata, weighed by their context.

The lexicon is learned from a bounded sample of labelled rows: words, and stems with many endings, that
toxic texts hold and others don't. A word of a text is looked up by running its Levenshtein automaton
over the lexicon's trie; letters and length first rule out words that can't be near a term. Words that
the sample's clean texts hold are never taken for misspellings.

Some terms are only told by company: words that a stem and any ending make, each too rare to be learned, and now and then made by chance in clean texts too.
Such a stem is paired: its words count where a text has two different ones.

Each term found gets a weight from what is around it: less inside a quotation that opens and closes in its line, however
long that is, or near a verb of reporting, more near the second person. A logistic regression on the sums of these
weights, fitted on the same sample, gives the score.

Training is on the driver, from word counts that executors make of at most ``per_class`` rows of each
class. Every document is then scored whole, where it lies, without a shuffle.

Defined cases: a null or empty text has no terms and gets the intercept; without rows of both classes the
lexicon is empty and every score 0; repeated documents are scored alike, and of labelled rows that repeat an id one is learned from; a text of any length is
scored whole; an empty table gives no rows; other columns are kept, but for those named like a result's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .lexicon import Trie, edits, nearest
from .linear import labelled_sample, logistic, remainder, sigmoid
from .sizes import discard, small_batches, stored
from .words import LOWER, WORD, Words, slices, words_of

PER_CLASS = 6000
THRESHOLD = 0.7
#: Of a lexicon entry: its most rows of clean texts for each toxic one, and the chance that so many rows, were they drawn at random, all were toxic.
IMPURE, CHANCE = 0.02, 1e-5
STEM, LONGEST, ENDINGS = 4, 12, 5
#: Of a paired stem: its most clean texts with two of its words for each toxic one.
PAIR_IMPURE = 0.1

# Quotation marks, verbs and nouns of reporting, and words of address, in four languages.
OPENING = "\"'“„«‘‹"
CLOSING = "\"'”“»’›"
REPORTING = frozenset("said says say saying called calls quoted quote quotes wrote writes word words term terms slur reported dit mot terme sagte wort begriff dijo palabra término".split())
ADDRESS = frozenset("you your youre yours u ur are tu toi vous es du dich dir bist sie eres usted".split())
NEAR = 5
QUOTED, REPORTED, ADDRESSED = 0.1, 0.5, 1.5

_BIT = np.zeros(256, dtype=np.uint32)
for _c in [*range(48, 58), *range(97, 123)]:
    _BIT[_c] = 1 << (_c & 31)
_BIT[65:91] = _BIT[97:123]
_ASCII = (WORD & (np.arange(256) < 128)).astype(np.int32)


def learn_lexicon(counts: list[tuple[str, int, int, int]], share: float) -> list[tuple[str, bool]]:
    """counts: word, toxic and clean rows with it, different words before it in toxic rows (copies of one text have one).

    Words and stems of toxic texts; a stem takes in the words that begin with it. share: the sample's share of toxic rows."""
    least = _least(share)
    nodes: dict[str, list[int]] = {}
    for word, toxic, _, places in counts:
        for n in range(STEM, min(len(word), LONGEST) + 1) if toxic else ():
            node = nodes.setdefault(word[:n], [0, 0, 0, 0])
            node[0] += toxic
            node[1] += places
            node[2] += places > 1
            node[3] = max(node[3], places)
    nodes = {p: x for p, x in nodes.items() if x[1] >= least and x[2] >= ENDINGS and x[3] < 0.5 * x[1]}
    free = dict.fromkeys(nodes, 0)
    for word, _, clean, _ in counts:
        for n in range(STEM, min(len(word), LONGEST) + 1) if clean else ():
            if word[:n] in free:
                free[word[:n]] += clean
    stems: list[str] = []
    for p in sorted(nodes, key=lambda p: (len(p), p)):
        if free[p] <= IMPURE * nodes[p][0] and not p.startswith(tuple(stems)):
            stems.append(p)
    words = [w for w, toxic, clean, places in counts if places >= least and clean <= IMPURE * toxic and len(w) >= 3 and not w.startswith(tuple(stems))]
    return [*((s, True) for s in sorted(stems)), *((w, False) for w in sorted(words))]


def pairs_of(words: list[str]) -> set[str]:
    """The stems of which a text has two different longer words."""
    seen: dict[str, int] = {}
    for word in words:
        for n in range(STEM, min(len(word) - 1, LONGEST) + 1):
            seen[word[:n]] = seen.get(word[:n], 0) + 1
    return {p for p, n in seen.items() if n > 1}


def learn_paired(counts: list[tuple[str, int, int]], least: int, lexicon: list[tuple[str, bool]]) -> list[str]:
    """counts: stem, toxic and clean texts with two of its words. The shortest stems that toxic texts have, but for those that begin like a lexicon stem."""
    out = [t for t, stem in lexicon if stem]
    begin = len(out)
    for p, toxic, clean in sorted(counts, key=lambda x: (len(x[0]), x[0])):
        if toxic >= least and clean <= PAIR_IMPURE * toxic and not p.startswith(tuple(out)):
            out.append(p)
    return out[begin:]


def _least(share: float) -> int:
    return max(5, math.ceil(math.log(CHANCE) / math.log(min(max(share, 1e-6), 0.9))))


def _leading(term: str) -> bytes:
    """The ASCII letters that a term begins with."""
    return re.match(r"[\x00-\x7f]*", term)[0].encode()


class Matcher:
    """Finds lexicon terms among words."""

    def __init__(self, lexicon: list[tuple[str, bool]], clean: frozenset[str], paired: tuple[str, ...] = ()):
        self.trie, self.clean, self.known, self.paired = Trie(lexicon), clean, {}, [p.encode() for p in paired]
        of = lambda t: [b for b in t.encode() if _ASCII[b]]
        self.terms = [(np.uint32(np.bitwise_or.reduce(_BIT[of(t)]) if of(t) else 0), len(of(t)), edits(t, stem), stem, _leading(t)) for t, stem in lexicon]

    def lookup(self, word: str) -> tuple[str, int] | None:
        hit = nearest(self.trie, word)
        return None if hit and hit[1] and word in self.clean else hit

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
        """The index of each word near a term, and its edits. Only ASCII letters are counted for the first test:
        an edit changes one of them on each side at most."""
        if not len(start) or not self.terms:
            return []
        a, b = int(start[0]), int(start[-1] + length[-1])
        view, at = data[a:b], start - a
        mask = np.bitwise_or.reduceat(_BIT[view], at)
        size = np.add.reduceat(_ASCII[view], at)
        maybe = np.zeros(len(start), bool)
        for bits, n, e, stem, leading in self.terms:
            if stem and not e:
                near = np.flatnonzero((bits & ~mask == 0) & (size >= n) & (length >= len(leading)))
                for k, byte in enumerate(leading):
                    near = near[LOWER[view[at[near] + k]] == byte]
                maybe[near] = True
            elif stem:
                maybe |= (np.bitwise_count(bits & ~mask) <= e) & (size >= n - e)
            else:
                maybe |= (np.bitwise_count(bits ^ mask) <= 2 * e) & (np.abs(size - n) <= e)
        out = []
        if len(self.known) > 1 << 20:
            self.known.clear()
        which = np.flatnonzero(maybe)
        for i, key in zip(which.tolist(), h[which].tolist(), strict=True):
            if key not in self.known:
                hit = self.lookup(data[start[i] : start[i] + length[i]].tobytes().decode(errors="replace").lower())
                self.known[key] = -1 if hit is None else hit[1]
            if (e := self.known[key]) >= 0:
                out.append((i, e))
        return out


    def pairs(self, data: np.ndarray, w: Words) -> list[int]:
        """The words that are longer than a paired stem and begin with it, in texts that have two different such: of each word of a text the first."""
        out = []
        for stem in self.paired:
            near = np.flatnonzero(w.length > len(stem))
            for k, byte in enumerate(stem):
                near = near[LOWER[data[w.start[near] + k]] == byte]
            text = np.searchsorted(w.first, near, "right") - 1
            _, first = np.unique(np.stack([text.astype(np.uint64), w.hash[near]]), axis=1, return_index=True)
            of = text[first]
            out += near[first][np.bincount(of, minlength=len(w.first))[of] > 1].tolist() if len(of) else []
        return sorted(out)


class Lines:
    """Where a text's lines end and its quotations open and close, so that a place is looked up in whole lines of any length."""

    def __init__(self, text: bytes):
        self.breaks = np.array([m.start() for m in re.finditer(b"\n", text)], dtype=np.int64)
        self.size, self.marks = len(text), []
        for o, c in zip(OPENING, CLOSING, strict=True):
            # An apostrophe inside a word isn't a quotation mark: one opens after a space or a mark, one closes before such.
            before, after = (rb"(?<![^\s(\[-])", rb"(?![A-Za-z0-9\x80-\xff])") if o == "'" else (b"", b"")
            opens, closes = ([m.start() for m in re.finditer(x, text)] for x in (before + re.escape(o.encode()), re.escape(c.encode()) + after))
            self.marks.append((o == c and o != "'", np.array(opens, dtype=np.int64), np.array(closes, dtype=np.int64)))

    def quoted(self, a: int, b: int) -> bool:
        """Whether the bytes a to b stand inside a quotation that opens and closes in their line."""
        i = np.searchsorted(self.breaks, a)
        begin, end = (int(self.breaks[i - 1]) + 1 if i else 0), (int(self.breaks[i]) if i < len(self.breaks) else self.size)
        for even, opens, closes in self.marks:
            o, c = np.searchsorted(opens, [begin, a]), np.searchsorted(closes, [begin, a, b, end])
            inside = (o[1] - o[0]) % 2 == 1 if even else o[1] > o[0] and (c[1] == c[0] or opens[o[1] - 1] > closes[c[1] - 1])
            if inside and c[3] > c[2]:
                return True
        return False


def context(before: str, after: str, quoted: bool) -> float:
    """The weight of a term in quotes, near reporting, or near an address; before and after hold the words around it."""
    near = [w.strip(".,;:!?()'\"’").lower() for w in [*before.split()[-NEAR:], *after.split()[:NEAR]]]
    weight = QUOTED if quoted else 1.0
    if any(w in REPORTING for w in near):
        weight *= REPORTED
    if any(w in ADDRESS for w in near):
        weight *= ADDRESSED
    return weight


#: Bytes on either side in which the words around a term are looked for.
WINDOW = 120


def sums(matcher: Matcher, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the context weights of terms as spelt and misspelt, the terms found, and the context weights of words of paired stems."""
    w = words_of(data, offsets)
    out = np.zeros((len(offsets) - 1, 4))
    now, lines = -1, None
    found = [(i, int(e > 0)) for i, e in matcher.find(data, w.start, w.length, w.hash)]
    for i, column in sorted(found + [(i, 3) for i in matcher.pairs(data, w)]):
        t = int(np.searchsorted(w.first, i, "right")) - 1
        low, high = int(offsets[t]), int(offsets[t + 1])
        if t != now:
            now, lines = t, Lines(data[low:high].tobytes())
        a, b = int(w.start[i]), int(w.start[i] + w.length[i])
        before = data[max(low, a - WINDOW) : a].tobytes().decode(errors="ignore")
        after = data[b : min(high, b + WINDOW)].tobytes().decode(errors="ignore")
        out[t, column] += context(before, after, lines.quoted(a - low, b - low))
        out[t, 2] += 1
    return out


#: What a misspelt term counts for, until the sample shows that clean texts have such words (the last column): less than a
#: term as spelt, so that a single word that may be another one doesn't settle it.
MISSPELT = 0.6


def columns(s: np.ndarray) -> np.ndarray:
    """What the regression sees of the sums: of terms as spelt, of misspelt ones, and of words of paired stems."""
    both = s[:, 0] + MISSPELT * s[:, 1]
    return np.stack([np.minimum(both, 1), np.log1p(both), np.log1p(s[:, 1]), np.log1p(s[:, 2])], axis=1)


@lru_cache(maxsize=4)
def _matcher(lexicon: tuple, clean: frozenset, paired: tuple) -> Matcher:
    """Kept in a worker from task to task, with the words that it has looked up."""
    return Matcher(list(lexicon), clean, paired)


def near_words(lexicon: list[tuple[str, bool]], words: list[str]) -> frozenset[str]:
    """Those of the words that are near a lexicon term."""
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    w = words_of(data, np.array([0, len(data)]))
    found = Matcher(lexicon, frozenset()).find(data, w.start, w.length, w.hash)
    return frozenset(data[w.start[i] : w.start[i] + w.length[i]].tobytes().decode() for i, _ in found)


def train(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", mod: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> dict:
    small_batches(documents.sparkSession)
    sample, stands_for = labelled_sample(labels, label, mod, held_out, per_class)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each part: (word, null, 0, clean rows), and for each word before it in toxic rows (word, before, toxic rows, 0)."""
        counts: dict[tuple[str, int | None], int] = {}
        for part, data, offsets in slices(batches, "text"):
            w = words_of(data, offsets)
            y = part.column(part.schema.get_field_index("y")).to_pylist()
            for t in range(len(offsets) - 1):
                a, b = w.first[t], w.first[t + 1]
                _, first = np.unique(w.hash[a:b], return_index=True)
                for i in (first + a).tolist():
                    word = data[w.start[i] : w.start[i] + w.length[i]].tobytes().decode(errors="replace").lower()
                    key = word, (int(w.hash[i - 1].view(np.int64)) if i > a else 0) if y[t] else None
                    counts[key] = counts.get(key, 0) + 1
        keys = list(counts)
        for i in range(0, len(keys), 10_000):
            some = keys[i : i + 10_000]
            n = [counts[k] for k in some]
            toxic = [x if k[1] is not None else 0 for k, x in zip(some, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some]), pa.array([k[1] for k in some], pa.int64()), pa.array(toxic), pa.array([x - y for x, y in zip(n, toxic, strict=True)])], names=["word", "before", "toxic", "clean"])

    once = texts.dropDuplicates(["doc_id"]).transform(stored)
    words = once.mapInArrow(run, "word string, before bigint, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_distinct("before").alias("places"))
    counts = sorted(zip(*(c.to_pylist() for c in words.where("length(word) >= 3").toArrow().columns), strict=True))
    sizes = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = learn_lexicon(counts, sizes.get(1, 0) / max(1, sum(sizes.values())))
    clean = sorted(w for w, toxic, free, _ in counts if free and free > IMPURE * toxic)
    del counts
    least = _least(sizes.get(1, 0) / max(1, sum(sizes.values())))
    often = {r["stem"]: r["n"] for r in once.where("y = 1").mapInArrow(_pairing(None), "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    other = {r["stem"]: r["n"] for r in once.where("y = 0").mapInArrow(_pairing(frozenset(often)), "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("n")).collect()}
    paired = learn_paired([(p, n, other.get(p, 0)) for p, n in often.items()], least, lexicon)
    model = {"lexicon": lexicon, "clean": near_words(lexicon, clean), "paired": paired}
    rows = once.mapInArrow(_summing(model, ["y"]), "y int, exact double, misspelt double, terms double, paired double").toArrow()
    discard(once)
    y, x = np.array(rows.column(0).to_pylist(), dtype=np.int64), np.array([rows.column(k).to_pylist() for k in (1, 2, 4)], dtype=float).T.reshape(-1, 3)
    if not len(y) or y.min() == y.max() or not (lexicon or paired):
        return {"lexicon": [], "clean": frozenset(), "paired": [], "weights": np.array([0, 0, 0, 0, -40.0])}
    return model | {"weights": logistic(columns(x), y.astype(float), np.where(y == 1, stands_for[1], stands_for[0]), 1e-2)}


def _pairing(wanted: frozenset[str] | None):
    """Counts the texts that have two words of a stem; wanted: of these stems alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for _, data, offsets in slices(batches, "text"):
            w = words_of(data, offsets)
            for t in range(len(offsets) - 1):
                _, first = np.unique(w.hash[w.first[t] : w.first[t + 1]], return_index=True)
                words = [data[w.start[i] : w.start[i] + w.length[i]].tobytes().decode(errors="replace").lower() for i in (first + w.first[t]).tolist()]
                for p in pairs_of(words if wanted is None else [x for x in words if x[:STEM] in heads]) if wanted is None or heads else ():
                    if wanted is None or p in wanted:
                        counts[p] = counts.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["stem", "n"])

    heads = frozenset(p[:STEM] for p in wanted or ())
    return run


def _summing(model: dict, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(tuple(model["lexicon"]), model["clean"], tuple(model["paired"]))
        for part, data, offsets in slices(batches, "text"):
            s = sums(matcher, data, offsets)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), *(pa.array(s[:, k]) for k in range(4))], names=[*keep, "exact", "misspelt", "terms", "paired"])

    return run


def score(documents: DataFrame, model: dict, *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns of each document, score (0 to 1), and terms, the lexicon terms found in it."""
    keep = [c for c in (documents.columns if keep is None else keep) if c not in ("score", "terms")]
    kept = documents.select(*keep)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(tuple(model["lexicon"]), model["clean"], tuple(model["paired"]))
        for part, data, offsets in slices(batches, "__text"):
            s = sums(matcher, data, offsets)
            x = sigmoid(columns(s[:, [0, 1, 3]]) @ model["weights"][:-1] + model["weights"][-1])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(x), pa.array(s[:, 2].astype(np.int64))], names=[*keep, "score", "terms"])

    return documents.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, score double, terms bigint" if schema else "score double, terms bigint")


def reject_toxic(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their columns as they were."""
    inner = documents.select(F.struct("*").alias("row"), "text")
    return score(inner, model, keep=["row"]).where(F.col("score") < threshold).select("row.*")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(documents, train(documents, labels), keep=["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "terms")
