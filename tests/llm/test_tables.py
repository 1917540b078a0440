import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from paperloom.llm import chat, hosts, licences, lines, packing, queries, ranks, sharding

from ..oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    assert same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf) > 0


def test_lines_joined_by_a_shuffle_agree_with_sql(spark, sf):
    pages = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    assert same(lines.drop_lines(pages, counts=True, broadcast=0), lines.SQL, sf) > 0


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from paperloom.llm import sizes

    rows = spark.range(100).select("id", F.lit("x" * 100).alias("s"), F.sequence(F.lit(1), F.lit(50)).alias("a"))
    assert sizes.small(rows, 100) and not sizes.small(rows, 99) and not sizes.small(rows, 100, 9_000) and not sizes.small(rows.select("a"), 100, 5_000) and sizes.small(rows.select("id"), 100, 0)


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))


def packed(rows, length=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_packing_against_the_tokenizer(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op5_packing(spark, sf).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(docs)
    for doc, parts in got.items():
        ids = np.array(t.encode(docs[doc], add_special_tokens=False).ids + [0], dtype="<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(math.ceil(len(ids) / 2048))) and all(r.length == 2048 for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packed(rows) <= 1.01 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_strings_of_added_tokens():
    """As the tokenizer's file has it: one id, wherever the string stands and whatever stands beside it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> ", "<|endoftext|><|endoftext|>\n", "<|endoftext|", "<<|endoftext|>>", "x" * 50 + "<|endoftext|>é", "<|ENDOFTEXT|>", "\n\n <|endoftext|>\t"):
        assert packing.encode(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], text
    assert packing.encode("<|endoftext|>").tolist() == [50256, 0]


def test_plans_place_every_piece():
    rng = random.Random(1)
    for full, n in ((16, 50), (64, 2000), (256, 30_000)):
        h = np.bincount([rng.randint(1, full) for _ in range(n)], minlength=full + 1)
        kinds = packing.plan(h, full)
        placed = Counter()
        for lengths, k in kinds:
            assert sum(lengths) <= full and k > 0
            for x in lengths:
                placed[x] += k
        assert placed == Counter({i: int(c) for i, c in enumerate(h) if c})
        assert sum(k for _, k in kinds) <= 1.03 * math.ceil((h * np.arange(full + 1)).sum() / full) + 2


def test_odd_rows_are_packed(spark, odd, none):
    rows = packing.pack(odd, with_ids=True).collect()
    packed(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in odd.collect())
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert [r.length for r in rows if r.doc_id in (3, 4)] == [1, 1] and packing.pack(none).count() == 0


def test_shards(spark, odd, none):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "é" * rng.randint(0, 9), rng.choice("aaab")) for i in range(5003)], "doc_id bigint, text string, source string")
    rows = sharding.shard(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    mix = Counter((r.shard, r.source) for r in rows)
    assert all(max(mix[s, x] for s in sizes) - min(mix[s, x] for s in sizes) <= 2 for x in "ab")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    got = sharding.shard(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect()) and [r.size for r in got if r.doc_id == 3] == [1]
    assert max(Counter(r.shard for r in got).values()) <= 2 and sharding.shard(none).count() == 0


def test_shards_against_one_sort(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    # A hot source, a null one, many of a row or two, and rows of one source that repeat an id.
    sources = ["hot"] * 900 + [None] * 300 + [f"s{i}" for i in range(400)] + [f"t{i // 2}" for i in range(200)]
    docs = [(i if i % 50 else 0, rng.choice(["", "a", "bb", None]), s) for i, s in enumerate(sources)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    hashes = table.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(sharding.SEED), "doc_id").alias("h"), F.xxhash64(F.lit(sharding.SEED + 1), "source").alias("u")).collect()
    by = defaultdict(list)
    for r in hashes:
        by[r.source].append(r)
    order = []
    for source, rows in by.items():
        rows.sort(key=lambda r: (r.h, r.doc_id, zlib.crc32(r.text.encode()), len(r.text)))
        order += [((k + (r.u % (1 << 30) + 0.5) / (1 << 30)) / len(rows), source is not None, source or "", k, r) for k, r in enumerate(rows)]
    order.sort(key=lambda x: x[:4])
    n = len(order)
    expected = Counter((r.doc_id, r.source, r.text, place * 8 // n) for place, (*_, r) in enumerate(order))
    text = {zlib.crc32(t.encode()): t for t in ("", "a", "bb")}
    rows = sharding.shard(table).collect()
    assert Counter((r.doc_id, r.source, text[r.text_crc32], r.shard) for r in rows) == expected
    first = {}
    for place, (*_, r) in enumerate(order):
        first.setdefault(place * 8 // n, place)
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p * 8 // n, p - first[p * 8 // n]) for p in range(n))
    for s in range(8):
        small = sum(r.shard == s and str(r.source)[0] in "st" for r in rows)
        assert abs(sum(r.shard == s and r.source == "hot" for r in rows) - 900 / 8) <= 10 and abs(small - 600 / 8) < 30


def test_ranks_in_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ranks, "PER_BUCKET", 7)
    monkeypatch.setattr(ranks, "PER_PART", 3)
    rows = spark.createDataFrame([(g, (i * 37 % 100) / 100, i) for g in (None, "x") for i in range(100)], "g string, v double, i int")
    out = ranks.ranked(rows, ["g"], F.col("v"), ["i"], of="n").collect()
    assert len(out) == 200 and all(r.rank == round(r.v * 100) and r.n == 100 for r in out)


def test_lines(spark, odd, none):
    pages = [(i, f"menu\npage {i}\n\n menu \nshared {i // 3}", "h") for i in range(9)] + [(9, "menu\nmenu", "other"), (10, None, "h"), (11, "menu\nmenu", None)] + [(20 + i, "copied", "h") for i in range(9)]
    rows = {r.doc_id: r for r in lines.drop_lines(spark.createDataFrame(pages, "doc_id int, text string, source string"), ratio=0.5, counts=True).collect()}
    assert rows[0].text == "page 0\n\nshared 0" and (rows[0].n_lines, rows[0].n_dropped) == (5, 2)
    assert rows[9].text == "menu\nmenu" and rows[10].text is None and rows[11].text == "menu\nmenu" and rows[20].text == "copied"
    table = spark.createDataFrame(pages, "doc_id int, text string, source string")
    assert same(lines.drop_lines(table, ratio=0.5, counts=True, broadcast=0).select("doc_id", "text", "n_lines", "n_dropped"), "SELECT * FROM documents", "/root/testdata/sf0.001", documents=lines.drop_lines(table, ratio=0.5, counts=True).select("doc_id", "text", "n_lines", "n_dropped").toArrow()) == 21
    assert lines.drop_lines(odd, counts=True, broadcast=0).count() == odd.count()
    left = lines.drop_lines(odd, counts=True)
    assert left.count() == odd.count() and set(odd.columns) - {"n_lines", "n_dropped"} <= set(left.columns) and lines.drop_lines(none).count() == 0


def test_hosts(spark, odd, none):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    docs = [(i, good if i % 10 else bad, "fine") for i in range(60)] + [(100 + i, bad if i % 10 else good, "foul") for i in range(60)] + [(200, good, None)]
    rows = {r.doc_id: r for r in hosts.judge(spark.createDataFrame(docs, "doc_id int, text string, source string")).collect()}
    assert rows[1].kept and not rows[0].kept and rows[100].base_failed is False and not rows[100].kept and rows[200].kept
    table = spark.createDataFrame([(i, t, s or "none") for i, t, s in docs], "doc_id bigint, text string, source string")
    assert same(hosts.query(table), hosts.SQL, "/root/testdata/sf0.001", documents=table.toArrow()) == 121
    out = hosts.judge(odd)
    assert out.count() == odd.count() and hosts.judge(none).count() == 0


def test_measures(spark):
    text = "a b c a b c  x # a,b\nx y\n\nx y\n|"
    row = hosts.measures(spark.createDataFrame([(text,)], "text string")).first()
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 3)}
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(words), sum(map(len, words)), 2, 1, len(covered))


def judged(line):
    """Family, probability and whether a notice confirms it, by the model in Python."""
    families, weights, bias = licences.model()
    own = licences.ngrams_of(line)
    z = bias + sum((weights[g] for g in own if g in weights), np.zeros(len(families)))
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    family, sure = families[int(z.argmax())], round(float(p.max()), 6)
    held = any(x in licences.sentences(line) for x in licences.phrases().get(family, []))
    return family, sure, family != licences.UNKNOWN and sure >= licences.THRESHOLD and held


def scanned(text):
    """Paragraphs, confirmed ones, their families, and unconfirmed ones, without any test for telling words."""
    n, found, unsure, families = 0, 0, 0, set()
    for run in re.split(r"\n[ \t\r\f\v]*(?:\n[ \t\r\f\v]*)+", text or ""):
        lines = [x for x in run.split("\n") if x.strip(" \t\r\f\v")]
        own = run.strip(" \t\r\f\v\n")
        whole = [own.replace("\n", " ")] if "\n" in own else []
        n += len(lines) + len(whole)
        says = lambda units: [(f, c) for f, p, c in map(judged, units) if f != licences.UNKNOWN and p >= licences.THRESHOLD]
        of_lines, of_whole = says(lines), says(whole)
        for family in {f for f, _ in of_lines + of_whole}:
            yes, no = of_lines.count((family, True)), of_lines.count((family, False))
            yes = yes or of_whole.count((family, True))
            found += yes
            unsure += 0 if yes else no or of_whole.count((family, False))
            families |= {family} if yes else set()
    return n, found, ",".join(sorted(families)), unsure


def test_licences_against_the_model(spark):
    texts = [*(t for _, t in licences.notices()[::7]), *licences.OTHERS[::5], "BSD 3-Clause License", "", "x"]
    for r in licences.classify(spark.createDataFrame([(t,) for t in texts], "line string")).collect():
        family, sure, confirmed = judged(r.line)
        assert r.family == family and abs(r.probability - sure) < 2e-6 and r.confirmed == confirmed


def test_licence_query_against_brute_force(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = licences.op9_licences(spark, sf).collect()
    assert len(rows) == len(text) and all((r.n_paragraphs, r.n_found, r.licences, r.n_unconfirmed) == scanned(text[r.doc_id]) for r in rows) and any(r.licences for r in rows)


#: Statements and sentences that no frame of the model has made.
STATED = {
    "MIT": ["foo is distributed under the terms of the MIT license, which you will find below.", "License: MIT"], "Apache-2.0": ["Code in this folder is under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["bar is licensed to you under the GNU General Public License, version 2 or later."], "AGPL": ["The server is released under the GNU Affero General Public License, version 3."], "LGPL": ["This library is licensed under the LGPL-2.1 and nothing else."],
    "BSD": ["Released under the BSD 2-Clause License by the authors."], "MPL-2.0": ["The add-on is available under MPL 2.0."], "CC-BY": ["Text is available under the Creative Commons Attribution License; additional terms may apply."],
    "CC-BY-SA": ["Photos are licensed under CC BY-SA 3.0 by their makers."], "CC-BY-NC": ["Slides are licensed under CC BY-NC 4.0."], "CC0": ["To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work."], "proprietary": ["(c) 2011 ACME. All rights reserved."],
}
PLAIN = ["He lost his driver's license in a bar.", "The copyright of the song is still in dispute.", "Our general manager made the plans public.", "My cousin teaches at MIT.", "The commons is where sheep graze.", "Free software was handed out at the fair.", "The rights of way are marked on the map.", "You may use the back door after six.", "Version 2.0 of the plan was worse.", "The permission of the owner is needed.", "They distribute food to the poor.", "The work is done and the file is closed.", "Apache county lies in Arizona.", "A copy of the key is under the mat."]


def test_statements_that_no_frame_made():
    right = [judged(t)[0] == f and judged(t)[1] >= licences.THRESHOLD and judged(t)[2] for f, texts in STATED.items() for t in texts]
    wrong = [t for t in PLAIN if judged(t)[0] != licences.UNKNOWN and judged(t)[2]]
    assert np.mean(right) >= 0.9 and not wrong
    own = [judged(t)[0] == f and judged(t)[1] >= licences.THRESHOLD for f, t in licences.notices()]
    assert np.mean(own) > 0.995


#: Sentences that hold words of licences and none: marked by hand, in four languages, none of them in the model's own.
NONE = """
Er kam mit seiner Frau. The license was old.
Wir fahren mit einer neuen license.
A professor at MIT lost her driving license.
The MIT team said the license fee was too high.
The library was released in May by ISC and others under license.
MIT students released a film under the terms of a contract.
The MIT press published the work in 1998.
Under the MIT dome there is a library.
The source code of the MIT project was lost.
License plates from MIT parking lots were stolen.
He has a license. MIT hired him anyway.
Distributed systems are taught at MIT by three professors.
The ISC conference was licensed to a hotel.
An ISC license was needed for the diesel engine? Nobody knew.
Software written at MIT is used around the world.
Her licence was granted by the general public office.
Mit freundlichen Grüßen, Ihre Lizenzabteilung.
Sie fährt mit dem Bus, er mit der Bahn.
Die Software wird mit einer Anleitung geliefert.
Mit Lizenz zum Töten ist ein Film.
Unter der Lizenz verstand er etwas anderes.
Das Programm beginnt mit einem Lied.
Alle Rechte und Pflichten gehen auf den Käufer über.
Die Lizenz endet mit dem Jahr 2020.
Er ist mit der Lizenz zufrieden und mit dem Preis nicht.
La licence de conduire n'existe plus.
Le logiciel libre est un sujet de débat.
Tous les droits de l'homme sont universels.
Il a une licence et un master de droit.
Cette œuvre est sous la protection de la ville.
Le public est libre d'entrer sans permission.
Le général parle de la version originale.
La licencia fue otorgada por el general.
Todos los derechos humanos son universales.
El programa es libre para el público general.
La obra está bajo llave en la biblioteca.
El autor renuncia a su cargo en mayo.
Apache warriors used no software.
The Apache helicopter has a version 2.0 of its radar.
A license to fly the Apache is hard to get.
The Mozilla team visited a public garden.
Public libraries lend GNU books.
The gnu herd is protected under the license of the park.
The Free Software Foundation has an office in Boston.
The general public may obtain a copy of the map.
You should have received a letter by now.
See the license for the dog at the town hall.
You may not use this file cabinet.
You may obtain a copy at the desk.
Unless required by law, no tax is paid.
The warranty is without conditions of any kind.
Permission is hereby granted to enter the park.
The above notice shall hang in all rooms.
Redistribution of land was the aim of the reform.
Neither the name of the holder nor the sum was told.
The names of its contributors are on the wall.
This list of conditions is long.
The disclaimer was read aloud.
Some rights reserved for members were lost.
All seats reserved. Rights of way apply.
All the rights are reserved to the crown, he said.
Copyright is a right of authors.
The copyright holder lives in Paris.
Copyright 2020 was the title of the show.
The creative commons of the village was sold.
Creative people share their commons.
Attribution of the painting is not certain.
The attribution to Rubens is licensed guesswork.
Zero is a number, and 1.0 is one too.
CC me on the letter, by 4.0 at the latest.
The CC was sent by mail.
Universal public transport is dedicated to the people.
The author has waived his fee for this work.
This work is dedicated to my mother.
Neighboring rights to water were disputed.
The public domain is a legal idea.
The BSD is a bus station in Delhi.
BSD shares rose by 3 percent.
Two clauses of the license were struck out.
The 3-clause contract was signed.
Proprietary recipes are kept secret.
Confidential files were found on the train.
Unauthorized entry is strictly prohibited.
No part of the house may be reproduced in a film.
Written permission of the owner is required.
The publisher gave prior written notice.
This program was broadcast in 1990.
This program is free for children.
Free of charge, any person may enter.
The software business grew by a tenth.
To deal in the software trade you need money.
Sell copies of the book to the shop.
Without limitation of speed, cars raced by.
He published, distributed and sold the sheet music.
Any later version of the song is worse.
Either version 3 or version 2 of the tale is true.
The terms of the license were read to the guests.
A licensed guide shows you the cave.
The restaurant is fully licensed.
The state licenses doctors and barbers.
"""


def test_lines_without_a_licence():
    lines = NONE.strip().split("\n")
    assert len(lines) == 100 and not set(lines) & set(licences.OTHERS)
    assert sum(judged(t)[2] for t in lines) <= 1
    likely = [t for t in lines if judged(t)[0] != licences.UNKNOWN and judged(t)[1] >= licences.THRESHOLD]
    assert len(likely) <= 10 and not set(likely) & set(lines[:5]), likely


def test_a_notice_counts_once(spark):
    texts = ["some words\nReleased under the MIT License.", "Released under the MIT License.\nAll rights reserved.\nmore", "words\n\nReleased under\nthe MIT License.\n\nReleased under the MIT License.", "x" * 100 + "\nReleased under the MIT License.\n" * 3]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r.n_found, r.licences, r.n_unconfirmed) for r in rows] == [(1, "MIT", 0), (2, "MIT,proprietary", 0), (2, "MIT", 0), (3, "MIT", 0)]


def test_licence_scan(spark, odd, none):
    wrapped = "Some words first.\n\nThis program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License as published by the Free Software\nFoundation, either version 3 of the License, or (at\nyour option) any later version.\n \t\nEnd."
    texts = {1: "text\nAll rights reserved.\nReleased under the MIT License.", 2: "A license to drive.", 3: None, 4: "", 5: wrapped, 6: wrapped.replace("\n", "\r\n"), 7: "word " * 100_000 + "\nLicensed under CC BY 4.0.", 8: "\n\n\n"}
    docs = spark.createDataFrame([(i, t, "l", 1, "f") for i, t in texts.items()], "doc_id bigint, text string, line string, n_found int, family string")
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert rows[1].licences == "MIT,proprietary" and rows[2].licences == "" and rows[3].n_paragraphs == 0 and rows[5].licences == rows[6].licences == "GPL" and rows[7].licences == "CC-BY"
    assert all((r.n_paragraphs, r.n_found, r.licences, r.n_unconfirmed) == scanned(texts[i]) for i, r in rows.items())
    assert licences.scan(odd).count() == odd.count() and licences.scan(none).count() == 0
    assert len(licences.scan(docs.unionByName(docs.limit(1))).where("doc_id = 1 and licences = 'MIT,proprietary'").collect()) == 2


def test_chats(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "<|c"), (3, 0, "user", "a"), (4, 0, "user", "z"), (5, 0, "user", "z"), (6, 1, "assistant", "b"), (6, 0, "user", "x"), (7, None, None, None), (None, 0, "user", "q"), (8, 0, "", "")]
    rows = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(rows) == {2, 4, 6, 7, None} and rows[4].n_copies == 2
    assert rows[2].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\n< |c<|im_end|>\n" and rows[6].text.startswith("<|im_start|>user\nx")
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_chats(empty).count() == 0


def test_chats_with_clashing_columns_and_long_texts(spark):
    columns = "conv_id bigint, turn bigint, role string, text string, n_turns int, n_copies string, n int, p string, h0 int, __id int, line string, turns int"
    rows = [(1, 0, "user", "x" * 2_000_000), (2, 0, "user", "x" * 2_000_000), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "user", ""), (6, None, None, "")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame([(*r, 1, "c", 2, "p", 3, 4, "l", 5) for r in rows], columns)).collect()}
    assert set(got) == {2, 3, 5, 6} and len(got[2].text) > 2_000_000 and (got[3].n_turns, got[3].n_copies) == (2, 1) and got[3].text.count("<|im_start|>user\na<|im_end|>") == 2


def test_logged_snapshots_against_sql(spark, sf):
    from pyspark.sql import functions as F

    whole = spark.read.parquet(f"{sf}/conversations.parquet")
    # Each conversation is logged after every turn, and each third one twice over.
    after = whole.select("conv_id", F.col("turn").alias("k"))
    log = whole.join(after, "conv_id").where("turn <= k").selectExpr("conv_id * 1000 + k AS conv_id", "turn", "role", "text")
    log = log.unionByName(log.where("conv_id % 3 = 0").withColumn("conv_id", F.col("conv_id") + 10**9))
    got = chat.format_chats(log)
    n = got.count()
    assert 0 < n <= whole.select("conv_id").distinct().count() < log.select("conv_id").distinct().count() and got.where("n_copies > 1").count() > 0
    assert same(got, chat.SQL, sf, conversations=log.toArrow()) == n
