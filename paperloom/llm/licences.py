"""Licence scans: a trained paragraph classifier, by DataFrame functions alone.

Paragraphs are lines, and runs of lines between blank ones taken as one line, so that a notice wrapped at any width is
whole in one of them. Each is classified by a sparse multinomial logistic regression over word n-grams into licence
families and an unknown class. The model is fitted on the driver from notices and other sentences below, never from the
corpus, with a lasso penalty that leaves weights to some hundreds of n-grams. A temperature and a shift of the unknown
class are fitted on notices in frames and sentences that the fit hasn't seen, notices inside other text, and fragments of
notices, which are unknown; so a probability below ``THRESHOLD`` can be read as unknown. A prediction is
confirmed if words of the paragraph, one after the other and within sentences as the notice has them, are most of one of the family's notices (``phrases``): with the
family's name whole and a word of the notice beside it, where the notice names it. A name that is a word of other languages too ("MIT") is none by itself: only whole
statements that end with it are.

Every paragraph is classified: one that has none of the model's n-grams has the intercepts' scores, which say unknown, and
the words that every such n-gram must have part of (``evidence``) tell these apart before anything else is worked out. All of
it stays in the paragraph's row, with the weights as a constant of the plan: texts are never shuffled, and a line in a
third of all documents is a row like others. Only counts by document are.

Defined cases: a null or empty text has no paragraphs and no licences; a very long text is cut into its paragraphs in its row; an empty table gives no rows; a family found in a line
and again in the paragraph that the line is part of counts once, as the line; rows that share an id share its licences, and a null id is an id; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .sizes import stored

THRESHOLD, CONFIRM = 0.6, 0.6
#: Words of a notice that names no family, one after the other, that confirm it, or the whole of a shorter one.
LEAST_WORDS = 6
UNKNOWN = "unknown"
SPACE = " \t\r\f\v"
#: What stands between words. (CC BY-NC 4.0 is five of them: n-grams keep them together.)
BETWEEN = "[^a-z0-9]+"

# Names and notices of the licence families.
FRAMES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.",
    "This project is distributed under the terms of the {}.", "This software is licensed under the {}.", "Available under {}.", "License: {}", "SPDX-License-Identifier: {}",
    "You may use this file under the terms of the {}.", "The source code is released under the {} license.", "{}", "This library is free software under the {}.", "Distributed under the {}; see the file for details.",
    "All content on this site is made available under {} unless noted otherwise.",
]
NAMES = {
    "MIT": ["MIT License", "MIT license", "MIT", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License", "GPL-3.0-or-later", "GPL-2.0", "GPLv3", "GNU GPL version 3"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPL-3.0", "LGPL-2.1", "LGPLv3"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL-3.0", "AGPLv3"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "CC0": ["CC0 1.0", "CC0", "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero"],
    "ISC": ["ISC License", "ISC"],
}
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "See the GNU General Public License for more details.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": ["To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-SA": ["To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/"],
    "CC-BY-NC": ["To view a copy of this license, visit https://creativecommons.org/licenses/by-nc/4.0/"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain.", "To view a copy of this license, visit https://creativecommons.org/publicdomain/zero/1.0/"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "proprietary": [
        "All rights reserved.", "Copyright (c) 2020 Example Corporation. All rights reserved.", "Copyright 2019 Example Inc. All Rights Reserved.", "© 2021 Example Ltd. All rights reserved.", "Copyright © Example. All rights reserved worldwide.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
OTHERS = [
    "You need a licence to drive a car.", "Her driving license was suspended last year.", "The company licensed the technology from a rival.", "A licensed electrician must do this work.", "Copyright law protects authors.",
    "The copyright office moved to a new building.", "He asked about the public domain of the function.", "The film has entered the public domain in some countries.", "The warranty covers parts for two years.", "Wealth was redistributed among the people.",
    "The fishing license costs ten dollars.", "Under the new license fee, every household pays.", "The city released the names of all licensed taxis.", "This product comes with a limited warranty.", "Apache is the name of a people.", "The university released a report under pressure.",
    "Send a copy (c) to the office.", "A version of the work was released in May.", "The terms of the contract are under review.", "An international attribution of the painting is disputed.", "General public transport is free of charge.", "The source of the river is not known.",
    "The bar lost its liquor licence.", "Permission to use the hall must be asked for in writing.", "The permit and the license were issued by the county.", "A warrant was issued for his arrest.",
    "She works for a software company in the city.", "The program begins at eight and is free for all.", "Please see the file for more details.", "You can use this room on Mondays.", "The foundation was published in a journal.", "Copies of the book were sold on the street.", "He obtained a copy of the letter.",
    "The new version of the song is longer.", "Visit the museum or view the garden from above.", "The conditions on the road were bad.", "It was provided that the money be paid in May.", "The source of the code was an old book.", "The library is open to the public.", "The general made a public statement.", "Most rights were granted to women after the war.",
    "They reserved a table for two.", "All seats are reserved.", "The rights of the workers were discussed at length.", "Modify the recipe if you have no eggs.", "The attribution of the poem to him is doubtful.", "He was common, creative and kind.", "The commons were open to all cattle.", "Zero degrees is the point at which water freezes.",
    "We drove three miles to the house of my uncle.", "The mean temperature was 2.0 degrees, or 3.0 at the coast.", "Version 3 of the map shows the river.", "Version 4.0 was shipped in spring.", "I can come by at 4.0 or 3.0 hours.", "In 2019 and 2020 the company grew.", "The act of 1998 was an international success.",
    "Wir kommen mit dem Zug und mit dem Rad.", "Er sprach mit ihr über das Wetter.", "Elle a dit que la licence de sa fille est belle.", "El autor publicó un libro sobre la ciudad.", "Mit freundlichen Grüßen an alle.", "A professor at MIT won the prize.", "The Mozilla offices are in California.", "The Apache helicopter landed.", "GNU is an antelope.",
    "He went home with the licence of his boat in hand.", "The institute and the licence office share a building.", "Under the license of 1850 they could fish in the river.", "License fees rose, said the institute.", "Nach der Prüfung bekam er die Lizenz, mit der er fliegen darf.",
    "Sie kommt mit ihrer Schwester und mit dem Hund.", "Mit der neuen Lizenz darf der Verein wieder spielen.", "Die Lizenz wurde mit sofortiger Wirkung entzogen.", "Wer mit dem Auto fährt, braucht einen Führerschein.", "Das Werk wurde unter der Leitung des Meisters gebaut.", "Alle Rechte liegen beim Verlag, sagte sie mit Nachdruck.",
    "Elle a obtenu sa licence de lettres à Lyon.", "La licence du bar a été retirée par la ville.", "Les droits de la femme ont été longtemps niés.", "Le domaine public commence au bout du chemin.", "Il est libre de partir avec le général.", "El general dio licencia a sus soldados.", "La licencia de pesca cuesta diez euros.", "Los derechos de los trabajadores fueron reservados para el final.",
    "Su obra está bajo la dirección de un maestro.", "La versión 2 del mapa es libre de errores.", "The team at the institute said that fees were high.", "They released the fish into the river under a permit.", "The book was made available in May by others.", "A license is a piece of paper, and this one was old.", "The distributed work was done under pressure and without license.",
    "Redistribution of income is a matter of politics.", "The use of force is strictly prohibited.", "This work was difficult, but it was done under the direction of the author.", "This file was found on the desk.", "This project was funded by the state.", "The terms of the agreement were met by both sides.", "All copies of the notice were lost.",
    "Permission was granted by the king.", "No part of the house was dry.", "The publisher gave written permission to the author for a second edition.", "The contract holds without limitation of time.", "Products derived from milk are sold here.", "The binary star was seen in the north.", "Either of them may sell the house.", "To the extent possible, meals are cooked fresh.", "Under law, the owner pays.",
]


#: Names that are words of other languages or of institutions too.
AMBIGUOUS = frozenset({"mit", "isc"})
#: Words that say nothing of a licence: n-grams of these, of ambiguous names and of numbers alone are no features.
PLAIN = frozenset("a an the this that these it is are was be been as of to in on at by for from with without or and and/or not no any all you your if may can has have had do i he she we they its s".split())


def _tells(words: list[str]) -> bool:
    """Whether an n-gram may be a feature: one of the plain words and an ambiguous name has to be three words long."""
    return not all(w in PLAIN or w in AMBIGUOUS or w.isdigit() for w in words) or (len(words) > 2 and not AMBIGUOUS.isdisjoint(words))


def words_in(line: str) -> list[str]:
    return [w for w in re.split(BETWEEN, line.lower()) if w]


def ngrams_of(line: str) -> list[str]:
    """The distinct n-grams of one to three words of a line, in order."""
    words = words_in(line)
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))


def _framed() -> list[tuple[int, str, str]]:
    """(frame, family, statement); an ambiguous name alone states nothing."""
    return [(i, family, frame.format(name)) for family, names in NAMES.items() for name in names for i, frame in enumerate(FRAMES) if frame != "{}" or name.lower() not in AMBIGUOUS]


def notices() -> list[tuple[str, str]]:
    """(family, notice) of all families."""
    framed = [(family, text) for _, family, text in _framed()]
    return framed + [(family, text) for family, texts in NOTICES.items() for text in texts]


def sentences(line: str) -> str:
    """A line's words, each between blanks, with a sign at its beginning and after each sentence."""
    return " ^ " + re.sub("[^a-z0-9|]+", " ", re.sub(r"[.!?;]+(?=\s|$)", " | ", line.lower())).strip() + " | "


def _parts(text: str) -> list[str]:
    words = sentences(text).split()[1:]
    while words and words[-1] == "|":
        words.pop()
    return words


def _holds(run: list[str], name: list[str]) -> bool:
    return any(run[k : k + len(name)] == name for k in range(len(run) - len(name) + 1))


@lru_cache(maxsize=1)
def phrases() -> dict[str, list[str]]:
    """What confirms each family: the runs of most of a notice's words, between blanks, as ``sentences`` writes them."""
    out: dict[str, set[str]] = {family: set() for family in {**NAMES, **NOTICES}}
    shown = lambda words: f" {' '.join(words)} "
    for family, names in NAMES.items():
        for own in (_parts(n) for n in names):
            for frame in FRAMES:
                words = _parts(frame.format(" ".join(own)))
                if len(own) == 1 and own[0] in AMBIGUOUS:
                    # A statement that ends with the name, or a line that is nothing else.
                    if words[-1:] == own and len(words) > 1:
                        out[family].add(shown([*words, "|"] if len(words) > 2 else ["^", *words, "|"]))
                elif words == own:
                    out[family].add(shown(["^", *words, "|"]))
                else:
                    n = max(math.ceil(CONFIRM * len(words)), len(own) + (len(own) < 3))
                    out[family] |= {shown(words[k : k + n]) for k in range(len(words) - n + 1) if _holds(words[k : k + n], own)}
    for family, texts in NOTICES.items():
        own = [_parts(n) for n in NAMES.get(family, ())]
        for words in map(_parts, texts):
            named = [n for n in own if len(n) > 1 and _holds(words, n)]
            n = max(math.ceil(CONFIRM * len(words)), min(len(words), LEAST_WORDS))
            runs = [words[k : k + n] for k in range(len(words) - n + 1)]
            out[family] |= {shown(r) for r in runs if not named or any(_holds(r, x) for x in named)}
    # A phrase that holds another adds nothing.
    return {family: sorted(p for p in own if not any(q != p and q in p for q in own)) for family, own in out.items()}


def _held_out() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Rows to fit weights on, and rows to calibrate them on: other frames, other sentences, notices inside sentences, and fragments."""
    framed = _framed()
    whole = [(family, text) for family, texts in NOTICES.items() for text in texts]
    fit = [*((f, t) for i, f, t in framed if i % 4 != 3), *whole, *((UNKNOWN, t) for i, t in enumerate(OTHERS) if i % 3 != 2)]
    unseen = [t for i, t in enumerate(OTHERS) if i % 3 == 2]
    check = [*((f, t) for i, f, t in framed if i % 4 == 3), *((UNKNOWN, t) for t in unseen)]
    check += [(f, f"{unseen[k % len(unseen)]} {t} {unseen[(k + 7) % len(unseen)]}") for k, (f, t) in enumerate(whole)]
    check += [(UNKNOWN, " ".join(words[k : k + 4])) for _, t in whole for words in [[w for w in words_in(t) if w not in _names()]] for k in range(0, len(words) - 3, 4)]
    return fit, check


@lru_cache(maxsize=1)
def _names() -> frozenset[str]:
    return frozenset(w for names in NAMES.values() for name in names for w in words_in(name))


@lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """Families (unknown first), the weights by family of each n-gram that has some, and the intercepts, the temperature taken in."""
    fit, check = _held_out()
    families = [UNKNOWN, *sorted({f for f, _ in fit} - {UNKNOWN})]
    vocabulary = sorted({g for _, t in fit for g in ngrams_of(t) if _tells(g.split())})
    x, y = _matrix(fit, vocabulary, families)
    weights, bias = _descend(x, y, len(families))
    u, v = _matrix(check, vocabulary, families)
    each = 1 / np.bincount(v, minlength=len(families)).astype(float)[v]
    each[v == 0] *= len(families) - 1
    shift = np.eye(len(families))[0]
    loss = lambda t, k: float(-(each * np.log(_softmax((u @ weights + bias) / t + k * shift)[np.arange(len(v)), v] + 1e-12)).sum())
    temperature, unknown = min(((t, k) for t in np.geomspace(0.1, 4, 33) for k in np.linspace(0, 6, 25)), key=lambda p: loss(*p))
    # Rounded, weights add up to the same in any order.
    weights, bias = np.round(weights / temperature * 4096) / 4096, np.round((bias / temperature + unknown * shift) * 4096) / 4096
    return families, {g: w for g, w in zip(vocabulary, weights, strict=True) if w.any()}, bias


def _matrix(rows: list[tuple[str, str]], vocabulary: list[str], families: list[str]) -> tuple[np.ndarray, np.ndarray]:
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, (_, text) in enumerate(rows):
        x[i, [at[g] for g in ngrams_of(text) if g in at]] = 1
    return x, np.array([families.index(f) for f, _ in rows])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 600, lasso: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by accelerated proximal steps; rows of rare classes weigh more."""
    each = np.sqrt(len(y) / np.bincount(y, minlength=classes))[y]
    each = each / each.sum()
    rate = 2 / float(np.linalg.norm(x * np.sqrt(each)[:, None], 2) ** 2 + 1)
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    ahead, at, momentum = w, b, 1.0
    goal = np.eye(classes)[y]
    for _ in range(steps):
        error = (_softmax(x @ ahead + at) - goal) * each[:, None]
        step = ahead - rate * (x.T @ error)
        new, level = np.sign(step) * np.maximum(np.abs(step) - rate * lasso, 0), at - rate * error.sum(axis=0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, at = new + (momentum - 1) / after * (new - w), level + (momentum - 1) / after * (level - b)
        w, b, momentum = new, level, after
    return w, b


@lru_cache(maxsize=1)
def evidence() -> tuple[list[str], list[list[str]]]:
    """Words of which each n-gram that speaks for a family has one (of its words the one in the fewest of the other sentences), and for
    each the words that stand with it in such n-grams, itself too if it is enough alone.

    A line without any of the first, or with one and none of its second, has no family whose score can pass unknown's."""
    _, weights, bias = model()
    telling = [g for g, w in weights.items() if w[1:].max() > w[0]]
    count = {w: sum(w in words_in(t) for t in OTHERS) for g in telling for w in g.split()}
    beside: dict[str, set[str]] = {}
    for g in telling:
        word = min((w for w in g.split() if w not in PLAIN and not w.isdigit()), key=lambda w: (count[w], w))
        beside.setdefault(word, set()).update(w for w in g.split() if w != word)
    for word, others in beside.items():
        z = bias + weights.get(word, np.zeros(len(bias)))
        if z[1:].max() > z[0]:
            others.add(word)
    return sorted(beside), [sorted(beside[w]) for w in sorted(beside)]


def _constant(value: list, kind: str) -> Column:
    """A value as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), BETWEEN, -1), lambda w: w != "")


def _grams(words: Column) -> Column:
    def run(n: int) -> Column:
        return F.array_compact(F.transform(words, lambda _, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " "))))

    return F.array_distinct(F.concat(words, run(2), run(3)))


def classify(lines: DataFrame) -> DataFrame:
    """lines with family, probability and confirmed of the column line: the likeliest family, how sure the model is, and whether the line
    holds most of a notice of the family. A line without an n-gram of the model is unknown, as the intercepts say."""
    families, weights, bias = model()
    vocabulary = sorted(weights)
    known, values = _constant(vocabulary, "array<string>"), _constant([weights[g].tolist() for g in vocabulary], "array<array<double>>")
    held = _constant([phrases().get(family, []) for family in families], "array<array<string>>")
    step = once(lines, __words=_words(F.col("line")))
    step = once(step, __grams=_grams(F.col("__words")))
    rows = F.transform(F.array_intersect(known, "__grams"), lambda g: F.get(values, (F.array_position(known, g) - 1).cast("int")))
    step = once(step, __z=F.aggregate(rows, _constant(bias.tolist(), "array<double>"), lambda s, x: F.zip_with(s, x, lambda a, b: a + b)))
    step = once(step, __best=F.array_max("__z"))
    place = (F.array_position("__z", F.col("__best")) - 1).cast("int")
    step = once(step, __family=place, probability=F.round(1 / F.aggregate("__z", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("__best"))), 6))
    likely = (F.col("__family") > 0) & (F.col("probability") >= THRESHOLD)
    written = F.regexp_replace(F.regexp_replace(F.lower("line"), r"[.!?;]+(?=\s|$)", " | "), "[^a-z0-9|]+", " ")
    step = once(step, __written=F.when(likely, F.concat(F.lit(" ^ "), F.btrim(written), F.lit(" | "))))
    confirmed = F.coalesce(F.exists(F.get(held, F.col("__family")), lambda p: F.contains(F.col("__written"), p)), F.lit(False))
    return once(step, confirmed=confirmed).select(*lines.columns, F.get(_constant(families, "array<string>"), F.col("__family")).alias("family"), "probability", "confirmed")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once: a generator between keeps later steps from writing them out again."""
    made = F.array(F.struct(*(c.alias(k) for k, c in columns.items())))
    return rows.select("*", F.inline(made))


def paragraphs(text: Column) -> Column:
    """The lines of a text that aren't blank, and each run of several such lines as one: array of (run, whole, line), run by run."""
    runs = F.split(F.coalesce(text, F.lit("")), "\n[ \t\r\f\x0B]*(?:\n[ \t\r\f\x0B]*)+", -1)
    shown = lambda x: F.btrim(x, F.lit(SPACE)) != ""
    item = lambda i, whole, line: F.struct(i.alias("run"), F.lit(whole).alias("whole"), line.alias("line"))

    def each(run: Column, i: Column) -> Column:
        own = F.btrim(run, F.lit(SPACE + "\n"))
        lines = F.transform(F.filter(F.split(run, "\n", -1), shown), lambda x: item(i, False, x))
        return F.concat(lines, F.when(F.contains(own, F.lit("\n")), F.array(item(i, True, F.replace(own, F.lit("\n"), F.lit(" "))))).otherwise(F.slice(lines, 1, 0)))

    return F.flatten(F.transform(runs, each))


def telling(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose text may be of a family, by the words of ``evidence``."""
    signs, beside = evidence()
    known, companions = _constant(signs, "array<string>"), _constant(beside, "array<array<string>>")
    step = once(rows, __words=F.split(F.lower(F.col(column)), BETWEEN, -1))
    step = once(step, __signs=F.array_intersect(known, "__words"))
    alone = F.get(companions, (F.array_position(known, F.get("__signs", F.lit(0))) - 1).cast("int"))
    enough = F.when(F.size("__signs") == 1, F.arrays_overlap("__words", alone)).otherwise(F.size("__signs") > 1)
    return step.where(enough).select(*rows.columns)


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_found, licences, n_unconfirmed): of each document its paragraphs, those with a confirmed licence, their
    families, and the paragraphs of a likely family that no notice confirms.

    A run of lines counts only for a family that none of its lines has."""
    # What holds for all words of a text holds for those of each of its paragraphs.
    texts = telling(documents.select("doc_id", "text"), "text")
    lines = texts.select("doc_id", F.xxhash64("text").alias("__text"), F.inline(paragraphs(F.col("text"))))
    named = classify(telling(lines, "line")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= THRESHOLD))
    group = named.groupBy("doc_id", "__text", "run", "family").agg(F.count_if(F.col("confirmed") & ~F.col("whole")).alias("lines"), F.count_if(~F.col("confirmed") & ~F.col("whole")).alias("open"), F.count_if(F.col("confirmed") & F.col("whole")).alias("wholes"), F.count_if(~F.col("confirmed") & F.col("whole")).alias("open_wholes"))
    found = F.when(F.col("lines") > 0, F.col("lines")).otherwise(F.col("wholes"))
    unsure = F.when(found > 0, F.lit(0)).when(F.col("open") > 0, F.col("open")).otherwise(F.col("open_wholes"))
    each = group.select("doc_id", "family", found.alias("found"), unsure.alias("unsure")).groupBy(F.col("doc_id").alias("__doc"))
    each = each.agg(F.sum("found").alias("n_found"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("found") > 0, F.col("family")))), ",").alias("licences"), F.sum("unsure").alias("n_unconfirmed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    counted = documents.select("doc_id", F.size(paragraphs(F.col("text"))).cast("bigint").alias("n_paragraphs"))
    return counted.join(each, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").select("doc_id", "n_paragraphs", zero("n_found"), F.coalesce("licences", F.lit("")).alias("licences"), zero("n_unconfirmed"))


def op9_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
