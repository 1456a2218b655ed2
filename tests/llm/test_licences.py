from __future__ import annotations

import re
import textwrap

from dossier.llm import licences


def _by_id(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    return [(r["doc_id"], r["sentences"], r["licences"], r["n_unmatched"], r["status"]) for r in licences.licences(docs).collect()]


def brute(text):
    known = licences.known_sentences(licences.SENTENCES)
    ids = [known[p] for p in map(licences.normal, re.split(licences.SENTENCE_END, (text or "").lower())) if p in known]
    left, found = list(ids), set()
    for name, sequence in licences.RULES:
        i = 0
        while i + len(sequence) <= len(left):
            if tuple(left[i : i + len(sequence)]) == sequence:
                left[i : i + len(sequence)] = [None]
                found.add(name)
            i += 1
    rest = sum(x is not None for x in left)
    status = "NONE" if not ids else "UNKNOWN" if not found else "PARTIAL" if rest else "KNOWN"
    return ",".join(ids), ",".join(sorted(found)), rest, status


def test_cases_equal_brute_force(spark):
    all_sentences = list(licences.SENTENCES)
    texts = [
        None, "", "plain prose", "Released under the MIT License.", "RELEASED  under,the MIT license!\nLicensed under CC BY-NC 4.0.",
        "Words before. Licensed under the Apache License, Version 2.0. Words after.", "unlicensed text with copyright in it",
        "\n".join(all_sentences), "\n".join(reversed(all_sentences)), " ".join(all_sentences),
        "\n".join(s for s in all_sentences if "edistribution" in s), all_sentences[3], "word " * 30_000 + "\n" + all_sentences[0],
        (all_sentences[0] + "\n") * 500,
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], None), (3, texts[3], "x")]
    assert sorted(_by_id(spark, rows), key=str) == sorted([(i, *brute(t)) for i, t, _ in rows], key=str)
    assert brute(texts[11])[2:] == (1, "UNKNOWN") and brute(texts[4])[1] == "CC-BY-NC-4.0,MIT"


def test_every_known_sentence_holds_a_marker():
    for piece in licences.known_sentences(licences.SENTENCES):
        assert any(m in piece for m in licences.MARKERS)


def test_empty_table(spark):
    assert _by_id(spark, []) == []


MIT_TEXT = [list(licences.SENTENCES)[2], list(licences.SENTENCES)[3]]
BSD_GRANT, *BSD_ITEMS = list(licences.SENTENCES)[4:8]
GPL3 = list(licences.SENTENCES)[13]
LATER = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
CC0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def _wrapped(paragraphs, width, mark):
    return f"\n{mark}\n".join("\n".join(mark + line for line in textwrap.wrap(p, width)) for p in paragraphs)


def test_wrapped_texts(spark):
    numbered = [f"{i}. {s}" for i, s in enumerate(BSD_ITEMS, 1)]
    texts = [
        (["MIT License", "Copyright (c) 2020 A. Person", *MIT_TEXT, "THE SOFTWARE IS PROVIDED AS IS."], "MIT"),
        (["Copyright 2020 Somebody. All rights reserved.", BSD_GRANT, *numbered], "BSD-3-Clause"),
        ([BSD_GRANT, *numbered[:2]], "BSD-2-Clause"),
        ([GPL3 + " This program is distributed in the hope that it will be useful."], "GPL-3.0-or-later"),
        (["This program is free software; " + LATER.format("General Public License", "2")], "GPL-2.0-or-later"),
        (["This library is free software; " + LATER.format("Lesser General Public License", "2.1")], "LGPL-2.1-or-later"),
        ([GPL3.replace("GNU General", "GNU Affero General")], "AGPL-3.0-or-later"),
        ([list(licences.SENTENCES)[18] + " Anyone is free to copy."], "Unlicense"),
        ([list(licences.SENTENCES)[14]], "MPL-2.0"), ([CC0], "CC0-1.0"), ([ISC], "ISC"),
        (['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
          "http://www.apache.org/licenses/LICENSE-2.0"], "Apache-2.0"),
    ]
    rows, expected = [], []
    for paragraphs, licence in texts:
        for width in (24, 70, 79, 10_000):
            for mark, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", "\r")):
                expected.append((len(rows), licence, 0, "KNOWN"))
                rows.append((len(rows), _wrapped(paragraphs, width, mark).replace("\n", end), None))
    got = sorted((i, found, left, status) for i, _, found, left, status in _by_id(spark, rows))
    assert got == expected
    # a sentence that is a part of a longer line, or that a blank line parts, is none
    rows = [(0, "We say: it is not released under the MIT License at all", None), (1, "Released under\n\nthe MIT License.", None)]
    assert [r[4] for r in _by_id(spark, rows)] == ["NONE", "NONE"]
