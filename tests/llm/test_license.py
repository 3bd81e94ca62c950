"""The licence scan against the same rules in plain Python, and on notices and prose that it has neither as templates nor as prose."""

import math
import random
import re

import pytest
import regex

from ragloom.llm import license_scan as ls

POSITIVE = [
    ("This project is licensed under the MIT License - see the LICENSE.md file for details.", "mit"),
    ("Code released under the MIT licence.", "mit"),
    ("MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\n", "mit"),
    ("Distributed under the BSD 3-Clause License.", "bsd"),
    (" * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n", "bsd"),
    ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n", "bsd"),
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#    http://www.apache.org/licenses/LICENSE-2.0\n", "apache-2.0"),
    (" * Licensed to the Foundation under one or more contributor license agreements.\n * The Foundation licenses this file to You under the Apache License, Version 2.0\n * (the \"License\"); you may not use this file except in compliance with\n * the License.\n", "apache-2.0"),
    ("    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n", "gpl"),
    ("This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
    ("You should have received a copy of the GNU General Public License\nalong with Foo.  If not, see <http://www.gnu.org/licenses/>.", "gpl"),
    (" * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n", "lgpl"),
    ("It is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", "isc"),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "mpl"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", "cc-by-sa"),
    ("Text is available under CC BY-SA 4.0 unless noted.", "cc-by-sa"),
    ("Figures are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("Unless stated otherwise this page is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", "gpl"),
    ("The data was released under CC0 1.0 Universal in 2019.", "public-domain"),
    ("This is free and unencumbered software released into the public domain.\nAnyone is free to copy.", "public-domain"),
    ("ISC License\n\nCopyright 2021 A B", "isc"),
    ("All sources are distributed under the GNU General Public License version 2.", "gpl"),
    ("Copyright 2019 Some Publisher. All rights reserved.", "proprietary"),
    ("Available under the terms of the Mozilla Public License, version 2.0", "mpl"),
]
NEGATIVE = [
    "The MIT licence is older than the BSD license.",
    "All rights reserved are in the contract",
    "My brother studied at MIT and got his pilot license there.",
    "The apache tribes lived under the terms of an old treaty.",
    "General public opinion turned against the license fee.",
    "She released her album under the name of her sister.",
    "The software is distributed on discs, and the manual comes with it.",
    "A license to fish costs ten dollars a year and version two of the form is needed.",
    "Which licence is better for libraries, GPL or MIT, was the question of the evening.",
    "The copyright of the song belongs to the composer.",
    "You may obtain a copy of the map at the station.",
    "The foundation published the results in the public domain of science.",
    "Permission was granted to the person who asked for a copy of the document.",
    "The commons were open, creative people met there under the trees.",
    "He was licensed under the old law and released under the new one.",
    "The use of the source, with or without modification of the river bed, was not permitted.",
    "The conditions are met if the following is true.",
    "Our terms and conditions are subject to change.",
    "Version 2.0 of the public transport plan was released in May.",
    "The GNU project was started in 1983.",
    "No part of the cake may be eaten before noon.",
    "Two books about open source licensing stood on the shelf.",
    "The Mozilla office is in the city, near the public library.",
    "The above notice was shown in all shops.",
    "They wrote to the free software foundation about the program.",
]


def plain(text):
    """(family, probability, share, confirmed) of every unit that the model takes for a notice, with loops over the text."""
    classes, bias, weights = ls.trained()
    trigger = re.compile(ls._trigger())
    out = []
    for para, block in enumerate(regex.split(ls.PARAGRAPH, text) if text and trigger.search(text.lower()) else []):
        if not trigger.search(block.lower()):
            continue
        lines, more = re.split(r"[\r\n]+", block), []
        for sentence in re.split(ls.SENTENCE, block):
            words = re.split(r"\s+", sentence)
            starts = range(0, max(len(words) - ls.WINDOW // 2, 1), ls.WINDOW // 2)
            for w in [sentence] if len(words) <= ls.WINDOW else [" ".join(words[i : i + ls.WINDOW]) for i in starts]:
                if trigger.search(w.lower()):
                    lead = re.search(ls.LEAD, w)
                    parts = re.split(ls.CLAUSE, w)
                    more += [w] + ([c if re.search(ls.LEAD, c) else " ".join([lead[0] if lead else "", c]) for c in parts] if len(parts) > 1 else [])
        for par in [*lines, *dict.fromkeys(x for x in more if x not in lines)]:
            if not trigger.search(par.lower()):
                continue
            words = ls.words_of(par)
            z = [b + sum(weights[g][i] for g in set(ls.grams_of(words)) if g in weights) for i, b in enumerate(bias)]
            k = z.index(max(z))
            probability = 1 / sum(math.exp(x - z[k]) for x in z)
            if classes[k] == ls.UNKNOWN or round(probability, 6) < ls.SURE:
                continue
            one, two, best = set(words), set(zip(words, words[1:], strict=False)), 0.0
            for family, kind, t in ls.templates():
                if family == classes[k]:
                    pairs = set(zip(t, t[1:], strict=False))
                    part = (len(one & set(t)) / len(set(t)) + len(two & pairs) / len(pairs)) / 2 if pairs else len(one & set(t)) / len(set(t)) / 2
                    there = len(one & set(t)) / len(one)
                    if kind == "heading" and there < ls.MOSTLY:
                        part = 0.0
                    if kind == "sentence" and len(one) >= ls.WORDS and part >= ls.PARTLY:
                        part = max(part, there)
                    best = max(best, part)
            out.append((para, classes[k], round(probability, 6), round(best, 6), round(best, 6) >= ls.AGREES))
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)) + "."
    texts = [t for t, _ in POSITIVE] + NEGATIVE
    mixed = [prose(30) + "\n" + rng.choice(POSITIVE)[0] + "\n\n" + prose(50) + " " + rng.choice(NEGATIVE) + " " + rng.choice(POSITIVE)[0] for _ in range(12)]
    return [*texts, *mixed, None, "", prose(3000) + " Released under the MIT License. " + prose(3000), "MIT License\r\n\r\nLicensed under the GPL license or the MIT License"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_scan_equals_plain_python(spark, cases):
    got = {}
    for r in ls.scan(frame(spark, cases)).collect():
        got.setdefault(r.doc_id, []).append((r.para, r.family, r.probability, r.template_share, r.confirmed))
    near = lambda rows: sorted((p, f, round(a, 4), round(s, 4), c) for p, f, a, s, c in rows)
    for i, t in enumerate(cases):
        assert near(got.get(i, [])) == near(set(plain(t))) or near(set(got.get(i, []))) == near(set(plain(t))), t


def test_held_out_notices_and_prose(spark):
    rows = {r.doc_id: r for r in ls.licenses(frame(spark, [t for t, _ in POSITIVE] + NEGATIVE)).collect()}
    found = sum(f in rows[i].families for i, (_, f) in enumerate(POSITIVE))
    wrong = sum(bool(rows[len(POSITIVE) + i].families) for i in range(len(NEGATIVE)))
    print("recall", found / len(POSITIVE), [t for i, (t, f) in enumerate(POSITIVE) if f not in rows[i].families], "false", [t for i, t in enumerate(NEGATIVE) if rows[len(POSITIVE) + i].families])
    assert found >= 0.9 * len(POSITIVE) and wrong == 0


def test_families_of_one_paragraph(spark):
    """Lines that several licences have in common don't add families to a notice that is there as a whole; choices keep both."""
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n"
    texts = [gpl, gpl.replace("General", "Affero General"), "x\n\n" + gpl + "\n" + gpl, "Licensed under either of the Apache License, Version 2.0 or the MIT license."]
    rows = {r.doc_id: r for r in ls.licenses(frame(spark, texts)).collect()}
    assert [rows[i].families for i in range(4)] == [["gpl"], ["agpl"], ["gpl"], ["apache-2.0", "mit"]]
    assert [rows[i].n_paragraphs for i in range(4)] == [1, 1, 2, 2]  # a blank line ends a paragraph


def test_triggers_lose_nothing():
    """No template without its triggers could be confirmed."""
    chosen = set(ls.triggers())
    for _, _, words in ls.templates():
        kept, pairs = set(words) - chosen, set(zip(words, words[1:], strict=False))
        part = (len(kept) / len(set(words)) + sum(set(p) <= kept for p in pairs) / max(1, len(pairs))) / 2
        assert part < ls.AGREES


def test_model_is_sparse():
    _, _, weights = ls.trained()
    assert sum((w != 0).sum() for w in weights.values()) < 0.5 * sum(map(len, weights.values()))


def test_scan_edges(spark):
    empty = frame(spark, [])
    assert ls.licenses(empty).collect() == []
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "x", 0.5), (1, "Released under the MIT License.", "x", 0.5), (None, "Released under the MIT License.", "y", 0.1), (2, None, None, None)], "doc_id long, text string, family string, probability double")
    assert sorted((r.doc_id or 0, r.family) for r in ls.licenses(docs).collect()) == [(0, "mit"), (1, "mit"), (1, "mit"), (2, "none")]
    assert not any(x in ls.licenses(docs)._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))


def test_denied_and_unlisted_licences(spark):
    denied = ["The author refused to have it released under the GPL license.", "This was never licensed under the MIT License.", "It isn't distributed under the MIT License or the GPL license.", "The code can no longer be licensed under the ISC License."]
    unlisted = ["Distributed under the Boost Software License, Version 1.0.", "// released under the zlib\n// license", "This font is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the terms of the Artistic License 2.0"]
    plain = ["The ship was licensed under a foreign flag.", "The songs were available under the counter only.", "It was never released under the Boost Software License.", "under the licence", None]
    both = ["This was never licensed under the MIT License. It is released under the ISC License.", "You may not copy the logo; the code is licensed under the MIT License.", "It was never licensed under the MIT License but is released under the ISC License"]
    rows = {r.doc_id: r for r in ls.licenses(frame(spark, denied + unlisted + plain + both)).collect()}
    got = [(rows[i].family, rows[i].families) for i in range(len(rows))]
    assert got == [("none", [])] * 4 + [("unknown", [])] * 4 + [("none", [])] * 5 + [("isc", ["isc"]), ("mit", ["mit"]), ("isc", ["isc"])]
