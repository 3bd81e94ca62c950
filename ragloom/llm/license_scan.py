"""Licence scans: a trained classifier of paragraphs, in DataFrame functions only.

A multinomial logistic regression with an L1 penalty over word 1- to 3-grams tells licence families and ``unknown`` apart. It is
trained on the driver from notices (the frames below with the names of the licences in them, and sentences of the licences
themselves) and from prose that speaks of licences, rights and software without granting anything; a temperature calibrates it
on notices and prose it wasn't trained on. A prediction counts only if a template of the same family confirms it: by the share
of the template's words and word pairs that the paragraph has, or, for the sentences of a licence, which are often wrapped, by
the share of the paragraph's words that the template has.

Notices are wrapped as often as not, so what is classified are the lines of a text and also the sentences of its paragraphs,
which reach over line ends. Long sentences are read in overlapping windows: a template's words must stand close together. Each
unit yields its likeliest family, none where it denies the licence ("was never released under"); the clauses of a sentence are units too, so a choice of licences yields each of them. Only units
with one of a few words are read: `triggers` derives them from the templates, so that no template without them agrees enough.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

UNKNOWN = "unknown"
#: How notices name a licence, and the names, identifiers, headings and sentences of each family.
FRAMES = ["licensed under {}", "released under {}", "distributed under {}", "available under {}", "licensed under the terms of {}", "under the terms and conditions of {}", "subject to the terms of {}", "governed by {}", "License: {}"]
#: Frames that only label a name.
LABELS = ["License: {}"]
NAMES = {
    "mit": ["the MIT License", "the MIT"],
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license"],
    "bsd": ["the BSD License", "the 3-clause BSD license", "the 2-clause BSD license", "a BSD-style license"],
    "isc": ["the ISC License"],
    "gpl": ["the GNU General Public License, version 3", "the GNU General Public License version 2", "the GNU GPL", "the GPL license", "GPLv3", "GPLv2"],
    "lgpl": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License version 3", "the GNU LGPL", "the LGPL license", "LGPLv3"],
    "agpl": ["the GNU Affero General Public License, version 3", "the GNU AGPL", "the AGPL license", "AGPLv3"],
    "mpl": ["the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "the MPL 2.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons BY-NC license"],
    "cc-by-sa": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons BY-SA license"],
    "cc-by": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons BY license"],
    "public-domain": ["CC0 1.0 Universal", "the Unlicense"],
}
SPDX = {
    "mit": ["MIT"], "apache-2.0": ["Apache-2.0"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "isc": ["ISC"], "gpl": ["GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only"], "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "mpl": ["MPL-2.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by": ["CC-BY-4.0"], "public-domain": ["CC0-1.0", "Unlicense"],
}
HEADINGS = {
    "mit": ["MIT License", "The MIT License (MIT)"], "apache-2.0": ["Apache License Version 2.0, January 2004"], "bsd": ["BSD 3-Clause License", "BSD 2-Clause License"], "isc": ["ISC License"], "gpl": ["GNU General Public License Version 3, 29 June 2007", "GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License"], "agpl": ["GNU Affero General Public License"], "mpl": ["Mozilla Public License Version 2.0"],
}
SENTENCES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "apache-2.0": [
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "dedicated to the public domain by waiving all rights to the work worldwide under copyright law"],
    "proprietary": ["Copyright. All rights reserved.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher", "proprietary and confidential, unauthorized copying of this file is strictly prohibited"],
}
#: Prose with the same words that grants nothing. Every third one is kept for the calibration.
PROSE = """He lost his driving license and the copy of the permission slip.
The license plate was public and the version was new.
A poetic licence is not a licence to lie.
The copyright debate in the general public goes on in version after version.
The apache helicopter was released under fire.
Students at MIT published the work under the terms of the grant.
The software license fee is due; the terms of the license are in the contract.
The council will redistribute the public land and reserve the rights of way.
Please read the license file before you copy.
A fishing license is required in this domain.
Copyright law applies to the work.
The commons are open to the creative public.
The MIT license is shorter than the GPL and older than most of them.
Lawyers compared the BSD license with the Apache license at length.
All rights reserved for members are listed in the contract of the club.
She was granted permission to use the hall, free of charge, by the mayor.
The ship was licensed under a foreign flag and released after three days.
Which license should I choose for my project, and what does each of them allow?
The general public license office opens at nine and closes at noon.
The foundation published free books, and the public came to redistribute them.
Mozilla and Apache are names of foundations that write software.
He wrote a history of the GNU project and of the General Public License.
The creative commons movement started in a small office.
Under the terms of the treaty the island became public domain again.
The new version of the software was distributed under the name of its author.
The band played songs that were available under the counter only.
Redistribution of wealth is the subject of the second chapter.
Neither the name of the holder nor the names of his heirs were known.
The judge ruled that no part of the land may be used without permission.
The company gave a warranty of any kind of part except the engine.
You may not use this door except in case of fire.
Unless required by law, the shops are closed on Sundays.
A copy of the report can be obtained at the desk of the library.
It was governed by a council of elders and subject to the king.
The source of the river and the form of the valley are described in the file.
Conditions are met, provided that the following rules are kept.
The paper discusses open source licenses such as MIT, BSD and GPL.
Our library moved from version 2 to version 3 in one night.
The program is free and starts at eight; you can modify your seat later.
In binary form the number has three digits, with or without the sign.
The notice above the door shall be read by all who enter.
The publisher reserved all rooms and had prior written orders.
This work is about attribution theory and international law.
The driver was charged under the licensing act of 1968.
The licence fee pays for radio and television.
Software patents and copyright are not the same thing.
There is a license server, and its version must match the client's.
The word license is spelt licence in Britain.
The agreement was licensed, signed and distributed to both parties.
The lesser known works of the author are now in print.
The affair was released into the public under great pressure.
He obtained a license to sell beer and a copy of the keys.""".split("\n")
#: Words that any text has.
FREQUENT = "the of and to in a is it for on was by this that with from at as be or an are not your we you he she they his her all any can may must shall should will would have has had been no nor one use used if but so its our my me their there which what when who than then also into out up new work part free public form file kind copy list law person notice source later above following without under either except along this provided required found received".split()
WORD = r"[a-z0-9][a-z0-9.+]*[a-z0-9+]|[a-z0-9]"
#: A paragraph ends at lines without a letter or digit (empty ones, bare comment markers, rules), a sentence at its stop.
PARAGRAPH = r"(?:\r\n|\n|\r(?!\n))(?:[^\p{L}\p{N}\r\n]*(?:\r\n|\n|\r(?!\n)))+"
SENTENCE = r"(?<=[.!?])[\"')\]]*\s+(?!\d)"
#: Words that a list of licences follows, and where a sentence is cut so that each licence named stands with them alone.
_DENIES = r"\b(?:not|never|cannot|no\s+longer|\w+n['’]t|refus\w+|declin\w+|forb[ia]d\w*)\s+(?:[\w'’-]+\s+){0,5}?"
_FRAME = r"\b(?:licen[cs]ed|released|distributed|available|offered)\s+under"
LEAD = rf"(?i){_FRAME}|spdx-license-identifier:"
#: A denied licence up to the next notice, its frame alone, and a named licence, whether a family has that name or not; wrapped lines may start with marks of a comment.
DENIED = rf"(?i){_DENIES}{_FRAME}(?:(?!{_FRAME})[^;])*"
DENIES_ONE = rf"(?i){_DENIES}{_FRAME}"
_GAP = r"[\s*#/]+"
NAMED = rf"(?i)(?<!\w)(?:licen[cs]ed|released|distributed|available|offered){_GAP}under{_GAP}(?:the{_GAP})?(?:terms(?:{_GAP}and{_GAP}conditions)?{_GAP}of{_GAP})?(?:the{_GAP}|an?{_GAP})?(?:[\w.+-]+{_GAP}){{1,5}}?licen[cs]e(?!\w)"
CLAUSE = r"(?i)[\s(]+(?:and/or|and|or)\s+|(?<=[\w.])/(?=(?:mit|apache|[al]?gpl|bsd|mpl|cc)\b)|\s+(?=(?:licen[cs]ed|released|distributed|available|offered)\s+under|spdx-license-identifier:)"
#: Words of a window, more than the longest template's.
WINDOW = 64
#: Least probability of a family, and least agreement with a template of it; least share of a template for the reverse to count,
#: and of how many words a paragraph must be for that; least share of a unit's words that a heading must be.
SURE, AGREES, PARTLY, WORDS, MOSTLY = 0.5, 0.72, 0.25, 8, 0.6
_trained: dict = {}


def words_of(paragraph: str) -> list[str]:
    return re.findall(WORD, paragraph.lower())


def grams_of(words: list[str], upto: int = 3) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, upto + 1) for i in range(len(words) - n + 1)]


def templates() -> list[tuple[str, str, tuple[str, ...]]]:
    """(family, kind, words): notices, headings (which must be most of their line) and sentences. A frame without a verb is a
    heading: prose that compares two licences has all its words too."""
    out = []
    for family, names in NAMES.items():
        out += [(family, "heading" if f in LABELS else "notice", f.format(n)) for f in FRAMES for n in names]
    out += [(family, "notice", f"SPDX-License-Identifier: {x}") for family, ids in SPDX.items() for x in ids]
    out += [(family, "heading", t) for family, ts in HEADINGS.items() for t in ts]
    out += [(family, "sentence", t) for family, ts in SENTENCES.items() for t in ts]
    return [(family, kind, tuple(words_of(t))) for family, kind, t in out]


def triggers() -> list[str]:
    """Words of which a unit has one if it has enough of any template: a template without its triggers agrees too little. The word
    that most templates still need comes first, words that are frequent anywhere last."""
    left = templates()
    chosen: list[str] = []

    def enough(words):
        kept, pairs = set(words) - set(chosen), set(zip(words, words[1:], strict=False))
        return (len(kept) / len(set(words)) + sum(set(p) <= kept for p in pairs) / max(1, len(pairs))) / 2 >= AGREES

    while left := [t for t in left if enough(t[2])]:
        need = Counter(w for _, _, ws in left for w in set(ws) - set(chosen))
        chosen.append(min(need, key=lambda w: (w in FREQUENT or len(w) < 3, -need[w], w)))
    return chosen


def examples(seed: int, per: int, held: bool) -> list[tuple[str, list[str]]]:
    """Templates with words lost and other words around them; prose and templates taken apart are unknown."""
    rng = random.Random(seed)
    out = []

    def some(n):
        return [rng.choice(FREQUENT) if rng.random() < 0.6 else "".join(rng.choices("abcdefghilmnoprstuvw", k=rng.randint(2, 9))) for _ in range(rng.randint(0, n))]

    every = templates()
    for family, kind, words in every:
        w = list(words)
        if not held:
            out.append((family, w))
        for _ in range(per * (4 if kind != "notice" else 1)):
            cut = [x for x in w if len(w) < 6 or rng.random() > 0.06]
            edge = 1 if kind == "heading" else 8
            out.append((family, some(edge) + cut + some(edge)))
            if kind == "sentence" and len(w) > 12:  # a wrapped line of it
                at = rng.randrange(len(w) - 8)
                out.append((family, w[at : at + rng.randint(9, 14)]))
    pool = [w for _, _, ws in every for w in ws]
    frames = [words_of(f.format("")) for f in FRAMES]
    prose = [words_of(p) for i, p in enumerate(PROSE) if (i % 3 == 2) == held]
    for p in prose:
        out += [(UNKNOWN, some(6) + p + some(6)) for _ in range(4)] + [(UNKNOWN, p)] * 2
    for _ in range(len(prose) * 3):
        out.append((UNKNOWN, rng.sample(pool, rng.randint(1, 4)) + some(20)))
        out.append((UNKNOWN, some(30)))
        out.append((UNKNOWN, some(4) + rng.choice(frames) + ["the"] + some(6)))
        a, b = rng.choice(prose), rng.choice(prose)
        out.append((UNKNOWN, a[: len(a) // 2] + b[len(b) // 2 :]))
    return out


def trained(l1: float = 2e-4, steps: int = 250, least: int = 6) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """(classes, intercepts, n-gram -> weights), the temperature already in them; the same on every call."""
    if _trained:
        return _trained["model"]
    classes = [UNKNOWN, *dict.fromkeys(f for f, _, _ in templates())]
    train, held = examples(1, 2, False), examples(2, 1, True)
    seen = Counter(g for _, w in train for g in set(grams_of(w)))
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= least))}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
        x[:, -1] = 1
        for k, (_, w) in enumerate(rows):
            x[k, [vocabulary[g] for g in set(grams_of(w)) if g in vocabulary]] = 1
        return x, np.array([classes.index(c) for c, _ in rows])

    x, y = matrix(train)
    target = np.eye(len(classes), dtype=np.float32)[y]
    top = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest singular value
        top = x.T @ (x @ top)
        top /= np.linalg.norm(top)
    step = np.float32(2 * len(y) / (1.1 * np.linalg.norm(x @ top) ** 2))
    w = v = np.zeros((x.shape[1], len(classes)), np.float32)
    for k in range(steps):
        z = x @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        u = v - step * (x.T @ (p - target)) / len(y)
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * l1, 0)
        v, w = u + np.float32(k / (k + 3)) * (u - w), u
    xh, yh = matrix(held)

    def loss(t):
        z = (xh @ w).astype(float) / t
        z -= z.max(1, keepdims=True)
        return -(z[np.arange(len(yh)), yh] - np.log(np.exp(z).sum(1))).mean()

    heat = min(np.geomspace(0.1, 5, 60), key=loss)
    w = np.round(w.astype(float) / heat, 5)
    _trained["model"] = classes, w[-1], {g: w[i] for g, i in vocabulary.items() if np.abs(w[i]).max() > 0}
    return _trained["model"]


def _sentences(block: Column) -> Column:
    """The sentences of a paragraph, those of more than WINDOW words as windows that overlap by half, and the clauses of each."""

    def windows(sentence):
        words = F.split(sentence, r"\s+")
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW // 2, F.lit(1)), F.lit(WINDOW // 2))
        return F.when(F.size(words) <= WINDOW, F.array(sentence)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i, WINDOW), " ")))

    def clauses(window):
        told = F.regexp_replace(window, DENIED, "")
        lead = F.regexp_extract(told, LEAD, 0)
        parts = F.transform(F.split(told, CLAUSE), lambda c: F.when(c.rlike(LEAD), c).otherwise(F.concat_ws(" ", lead, c)))
        return F.when((F.size(parts) > 1) | (told != window), F.concat(F.array(window), parts)).otherwise(F.array(window))

    found = F.filter(F.flatten(F.transform(F.split(block, SENTENCE), windows)), lambda w: F.lower(w).rlike(_trigger()))
    return F.flatten(F.transform(found, clauses))


def _trigger() -> str:
    if "trigger" not in _trained:
        _trained["trigger"] = r"(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(triggers())) + r")(?![a-z0-9+])"
    return _trained["trigger"]


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para, pos, text and whether it's a line, of the paragraphs' lines, sentences and clauses that have a trigger and
    don't deny a licence."""
    trigger = _trigger()
    blocks = docs.where(F.lower("text").rlike(trigger)).select("doc_id", F.posexplode(F.split("text", PARAGRAPH)).alias("para", "block")).where(F.lower("block").rlike(trigger))
    lines = F.split("block", r"[\r\n]+")
    more = F.array_except(_sentences(F.col("block")), lines)
    units = F.concat(F.transform(lines, lambda u: F.struct(u.alias("par"), F.lit(True).alias("line"))), F.transform(more, lambda u: F.struct(u.alias("par"), F.lit(False).alias("line"))))
    return blocks.select("doc_id", "para", F.posexplode(units).alias("pos", "unit")).select("doc_id", "para", "pos", "unit.*").where(F.lower("par").rlike(trigger) & ~F.col("par").rlike(DENIED))


def _grams(words: Column, upto: int) -> Column:
    def run(n):
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(run(n) for n in range(1, upto + 1))))


def _template_table(spark: SparkSession) -> DataFrame:
    """family, gram, tid, kind, part (of the template's agreement), word (1 for a single word): a few thousand rows."""
    rows = []
    for tid, (family, kind, words) in enumerate(templates()):
        one, two = set(words), {" ".join(p) for p in zip(words, words[1:], strict=False)}
        rows += [(family, w, tid, kind, 0.5 / len(one), 1) for w in sorted(one)] + [(family, p, tid, kind, 0.5 / len(two), 0) for p in sorted(two)]
    return spark.createDataFrame(rows, "family string, gram string, tid int, kind string, part double, word int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, para, pos, par, line, family, probability, template_share, whole, text, confirmed of each line, sentence or clause that
    the model takes for a licence notice; ``whole`` if it has most of a template, not just words of one as part of a wrapped
    sentence, ``text`` if what confirms it isn't a heading only.

    Null and empty texts have no paragraphs; rows with equal ids share their paragraphs. A long text is cut where it lies.
    """
    spark = docs.sparkSession
    classes, bias, weights = trained()
    kinds = ", ".join(f"w{i} double" for i in range(len(classes)))
    model = spark.createDataFrame([(g, *map(float, w)) for g, w in weights.items()], f"gram string, {kinds}")  # a few thousand rows
    words = F.regexp_extract_all(F.lower("par"), F.lit(WORD), F.lit(0))
    unit = ["doc_id", "para", "pos", "pid"]
    pars = paragraphs(docs).withColumn("words", words).withColumn("pid", F.xxhash64("doc_id", "para", "pos", "par")).dropDuplicates(["doc_id", "pid"])
    zs = [F.coalesce(F.sum(f"w{i}"), F.lit(0.0)) + float(bias[i]) for i in range(len(classes))]
    grams = pars.select(*unit, "par", "line", "words", F.explode_outer(_grams(F.col("words"), 3)).alias("gram"))
    scored = grams.join(F.broadcast(model), "gram", "left").groupBy(*unit).agg(F.first("par").alias("par"), F.first("line").alias("line"), F.first("words").alias("words"), F.array(*zs).alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - top))
    family = F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", top).cast("int"))
    scored = scored.select(*unit, "par", "line", "words", family.alias("family"), F.round(F.lit(1.0) / total, 6).alias("probability"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= SURE))
    n = F.size(F.array_distinct("words")).alias("n")
    own = scored.select(*unit, "par", "line", "family", "probability", n, F.explode(_grams(F.col("words"), 2)).alias("gram"))
    own = own.join(F.broadcast(_template_table(spark)), ["family", "gram"], "left").groupBy(*unit, "par", "line", "family", "probability", "n", "tid", "kind").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("part"), F.sum("word").alias("shared"))
    there = F.col("shared") / F.col("n")  # how much of the unit is the template's
    part = F.when((F.col("kind") == "heading") & (there < MOSTLY), 0.0).when((F.col("kind") == "sentence") & (F.col("n") >= WORDS) & (F.col("part") >= PARTLY), F.greatest("part", there)).otherwise(F.col("part"))
    whole = F.when((F.col("kind") == "heading") & (there < MOSTLY), 0.0).otherwise(F.col("part"))
    found = own.groupBy(*unit, "par", "line", "family", "probability").agg(F.round(F.max(part), 6).alias("template_share"), (F.round(F.max(whole), 6) >= AGREES).alias("whole"), (F.round(F.max(F.when(F.col("kind") != "heading", part)), 6) >= AGREES).alias("text"))
    return found.withColumn("confirmed", F.col("template_share") >= AGREES).drop("pid")


def licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, families (sorted distinct array of the confirmed ones), family (of the surest confirmed
    line or sentence, else ``unknown`` if the model saw a notice that no template confirms or the text names another licence in a
    frame of notices, else ``none``), probability,
    template_share, n_paragraphs (the pairs of a paragraph and a family that is confirmed in it; a heading counts only for a family
    that no other paragraph shows).

    Null and empty texts give ``none``. Repeated rows stay repeated; rows with one id and different texts share a result. Ties go
    to the earlier paragraph. Other columns are not read, so their names don't matter; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    found = scan(docs)
    order = F.struct(F.col("confirmed"), F.col("probability"), F.col("template_share"), (-F.col("para")).alias("b"), (-F.col("pos")).alias("p"), F.col("family"))
    found = found.groupBy("doc_id", "para", "family").agg(F.max(order).alias("best"), F.max("whole").alias("whole"), F.max(F.coalesce("text", F.lit(False))).alias("text"))
    # parts of wrapped sentences are alike in several families: next to a whole template, or to a surer part, they count for nothing
    each = F.collect_list(F.when(F.col("best.confirmed"), F.struct("whole", "best", "text")))  # as many as families at most
    found = found.groupBy("doc_id", "para").agg(each.alias("all"), F.max("best").alias("top"))
    surest, some = F.array_max(F.transform("all", lambda x: x["best"])), F.exists("all", lambda x: x["whole"])
    kept = F.filter("all", lambda x: x["whole"] | (~some & (x["best"] == surest)))
    found = found.select("doc_id", "top", F.explode_outer(kept).alias("kept"))
    # a heading belongs to the paragraphs of its family, if there are any
    found = found.groupBy("doc_id", F.col("kept.best.family").alias("family")).agg(F.max(F.coalesce("kept.best", "top")).alias("best"), F.greatest(F.count_if("kept.text"), F.lit(1)).alias("n"))
    best = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("family")).alias("families"), F.max("best").alias("best"), F.sum(F.when(F.col("family").isNotNull(), F.col("n"))).alias("n_paragraphs")).withColumnRenamed("doc_id", "_id")
    named = F.coalesce(F.regexp_replace("text", DENIES_ONE, "").rlike(NAMED), F.lit(False))
    return docs.select("doc_id", named.alias("_named")).join(best, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.when(F.col("_named"), UNKNOWN).otherwise("none")).when(F.col("best.confirmed"), F.col("best.family")).otherwise(UNKNOWN).alias("family"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("best.probability", F.lit(0.0)).alias("probability"),
        F.coalesce("best.template_share", F.lit(0.0)).alias("template_share"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained classifier isn't expressible in SQL; tests compare with the same rules in plain Python."""
    return licenses(documents(spark, sf_dir)).withColumn("families", F.concat_ws(",", "families"))
