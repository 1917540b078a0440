"""The divergence audit against SQL, and against plain Python where blocks, rounds and products are forced."""

import random
import re
from collections import Counter, defaultdict

import pytest

from paperloom.llm import divergence

from ..oracle import same

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, value int, item string, rank int"


def brute(table, least=divergence.LEAST, top=divergence.TOP):
    """What the contract says, all terms of all groups held against each other."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in table:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        of[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in df.items()}
    whole = {lang: Counter() for lang in kept}
    for (lang, _), c in of.items():
        whole[lang].update(c)
    f = lambda p, q: (p - q) ** 2 // q

    def p(counts, lang):
        n = sum(counts[t] for t in kept[lang])
        return [1 + 10**9 * (counts[t] + 1) // (n + len(kept[lang])) for t in kept[lang]]

    probabilities = {g: p(c, g[0]) for g, c in of.items()}
    out = []
    for (lang, source), mine in probabilities.items():
        pairs = [(sum(map(f, mine, other)), s) for (g, s), other in probabilities.items() if g == lang and s != source]
        terms = [(f(a, b), t) for t, a, b in zip(kept[lang], mine, p(whole[lang], lang), strict=True) if of[lang, source][t] and a > b]
        order = lambda x: (-x[0], x[1].encode())
        out += [(lang, source, "pair", i, v, k + 1) for k, (v, i) in enumerate(sorted(pairs, key=order))]
        out += [(lang, source, "term", i, v, k + 1) for k, (v, i) in enumerate(sorted(terms, key=order)[:top])]
    return sorted(out)


def got(spark, table, **how):
    frame = spark.createDataFrame([(i, *r, "t", 1, 2, "i", 3) for i, r in enumerate(table)], SCHEMA)
    return sorted(map(tuple, divergence.audit(frame, **how).collect()))


def prose(seed, rows, sources=7):
    """Words of very uneven frequency, with capitals, accents and digits between."""
    draw = random.Random(seed)
    words = [w + s for w in "wort Über ñandú WORD x É".split() for s in "abcdefghij"]
    pick = lambda k: " 7.".join(draw.choices(words, [1 / (i + 1 + k) for i in range(len(words))], k=draw.randrange(30)))
    return [(pick(s), draw.choice(["de", "en", None]), f"s{s}" if s else None) for s in (draw.randrange(sources) for _ in range(rows))]


def test_a_larger_table_agrees_with_sql(spark):
    assert same(divergence.op12_divergence(spark, "/root/testdata/sf0.01"), divergence.SQL, "/root/testdata/sf0.01") > 10_000


@pytest.mark.parametrize("top", [1, 4, 200])
def test_buckets_are_left_out_only_below_the_kth(spark, top):
    table = prose(top, 150)
    assert got(spark, table, top=top) == brute(table, top=top)


def test_blocks_of_sources(spark, monkeypatch):
    """A term's sources in several blocks, groups too many for a broadcast, few products at once, and tasks that hand on sums early."""
    for name, value in (("AT_ONCE", 5), ("SALTS", 3), ("HELD", 10)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence, "small", lambda table: False)
    table = prose(9, 200, 12)
    assert got(spark, table, block=3, least=1) == brute(table, least=1)


def test_defined_cases(spark):
    table = [
        (None, None, None), ("", "en", "a"), ("One one ONE two", "en", "a"), ("one Two", "en", "b"), ("one two", "en", "b"), ("one two", "en", "b"), ("only here", "fr", "a"), ("rien", "fr", "b"),
        ("word " * 50_000, "en", "c"), ("x" * 100_000, "en", "c"), ("un deux", "es", "a"), ("un deux", "es", "a"), ("un", "es", "a"), ("...", "es", "z"),
    ]
    found = got(spark, table)
    assert found == brute(table)
    assert ("fr", "a", "pair", "b", 0, 1) in found and not any(r[:3] == ("fr", "a", "term") for r in found)
    assert not any(r[0] == "" for r in found)
    assert got(spark, []) == []


def test_large_counts_are_exact(spark):
    """A count times the unit is beyond 64 bits; the sum of two differences of f in one product is near them."""
    from pyspark.sql import functions as F

    n = 9_000_000_000_000_017
    p = spark.range(1).select(F.expr(divergence._p(f"{n}L", f"{3 * n + 5}L", "7L")).alias("p")).first()["p"]
    assert p == 1 + 10**9 * (n + 1) // (3 * n + 12)
    rows = [("en", "a", "t", 10**9, 5, 1), ("en", "b", "t", 1, 5, 1), ("en", "c", "t", 2, 5, 1)]
    postings = spark.createDataFrame(rows * 50, "lang string, source string, term string, p bigint, q bigint, zero bigint")
    groups = spark.createDataFrame([("en", s, 1, 1, 3) for s in "abc"], "lang string, source string, terms bigint, zero bigint, sources bigint")
    found = {(r.source, r["item"]): r.value for r in divergence._common(postings, groups, 10).groupBy("source", "item").agg(F.sum("value").alias("value")).collect()}
    f = lambda p, q: (p - q) ** 2 // q
    assert found["a", "b"] == 2500 * (f(10**9, 1) - f(10**9, 1) - f(1, 1) + f(1, 1)) and found["a", "c"] == 2500 * (f(10**9, 2) - f(10**9, 1))
