"""Licences by the sentences they are stated in.

The method has two steps. Sentences are normalised (lower case, only letters and digits, single spaces) and looked up
in a table of known licence sentences, which gives each a short identifier; other sentences give none. A sentence ends at a
sentence mark or a blank line; inside it, single line breaks, with comment marks after them, are white space. A known sentence also
counts where it fills whole lines of a longer one, so notices need no full stop. The identifiers of
a document, in order, are then matched against an ordered list of rules: a rule names a licence and a sequence of
identifiers that follow each other. Rules are tried from the first to the last, each takes all its sequences out, so a
sentence counts for one licence only. Identifiers that no rule takes make a document ``UNKNOWN``; without any it is ``NONE``.

All is done inside the row by built-in expressions: no shuffle, no Python. Texts without any marker word that the
known sentences share are not cut at all, which changes no result, as each known sentence holds one.
Null and empty texts have no licence. Null or repeated ids and further columns do not matter, one row comes out per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Well-known licence sentences and the identifiers given to them.
SENTENCES = {
    "Released under the MIT License.": "MIT_NAME",
    "Licensed under the MIT License.": "MIT_NAME",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "MIT_GRANT",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "MIT_NOTICE",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD_GRANT",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BSD_SOURCE",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "BSD_BINARY",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD_NAMES",
    "Licensed under the Apache License, Version 2.0.": "APACHE_NAME",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "APACHE_NAME",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.": "APACHE_COPY",
    "This work is licensed under the GNU General Public License, version 2.": "GPL2_NAME",
    "This work is licensed under the GNU General Public License, version 3.": "GPL3_NAME",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL3_LATER",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL2_NAME",
    "Licensed under CC BY 4.0.": "CC_BY",
    "Licensed under CC BY-SA 4.0.": "CC_BY_SA",
    "Licensed under CC BY-NC 4.0.": "CC_BY_NC",
    "This is free and unencumbered software released into the public domain.": "UNLICENSE",
}
#: Sentences of further licences and of the standard texts.
MORE_SENTENCES = {
    "You may obtain a copy of the License at": "APACHE_COPY",
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.": "BSD_NAMES",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;": "GPL_TERMS",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;": "LGPL_TERMS",
    "either version 2 of the License, or (at your option) any later version.": "V2_LATER",
    "either version 2.1 of the License, or (at your option) any later version.": "V2_1_LATER",
    "either version 3 of the License, or (at your option) any later version.": "V3_LATER",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "LGPL3_LATER",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL3_LATER",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC_GRANT",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC_GRANT",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "ZLIB_GRANT",
    "Distributed under the Boost Software License, Version 1.0.": "BSL_NAME",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.": "CC0_GRANT",
}
#: Ordered rules: longer sequences stand before the shorter ones that they contain.
RULES = (
    ("MIT", ("MIT_NAME", "MIT_GRANT", "MIT_NOTICE")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("Apache-2.0", ("APACHE_NAME", "APACHE_COPY")),
    ("GPL-3.0-or-later", ("GPL3_LATER",)),
    ("MIT", ("MIT_NAME",)),
    ("Apache-2.0", ("APACHE_NAME",)),
    ("GPL-2.0", ("GPL2_NAME",)),
    ("GPL-3.0", ("GPL3_NAME",)),
    ("MPL-2.0", ("MPL2_NAME",)),
    ("CC-BY-4.0", ("CC_BY",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC",)),
    ("Unlicense", ("UNLICENSE",)),
)
MORE_RULES = (
    ("GPL-2.0-or-later", ("GPL_TERMS", "V2_LATER")),
    ("GPL-3.0-or-later", ("GPL_TERMS", "V3_LATER")),
    ("LGPL-2.1-or-later", ("LGPL_TERMS", "V2_1_LATER")),
    ("LGPL-3.0-or-later", ("LGPL_TERMS", "V3_LATER")),
    ("LGPL-3.0-or-later", ("LGPL3_LATER",)),
    ("AGPL-3.0-or-later", ("AGPL3_LATER",)),
    ("ISC", ("ISC_GRANT",)),
    ("Zlib", ("ZLIB_GRANT",)),
    ("BSL-1.0", ("BSL_NAME",)),
    ("CC0-1.0", ("CC0_GRANT",)),
)
MARKERS = ("licen", "permission", "copyright", "redistribut", "public domain")
#: A table sentence is cut at a line break, or after a full stop, colon or the like that white space follows.
SENTENCE_END = r"[\n\r]+|[.!?;:][\x20\x09]+"
#: What a line begins with besides its words: marks of comments and quotes, and the number of a list item.
LINE_START = r"(?md)^[^a-z0-9\n(]*(?:\(?(?:[0-9]{1,2}[.)]|[a-z]\))[\x20\x09]+)?"
#: Ends of sentences that may run over lines: a blank line, or a sentence mark that white space follows.
WRAPPED_END = r"\n\n+|[.!?;:](?:[\x20\x09]+|\n)"


def normal(sentence: str) -> str:
    """A sentence of the table as it is looked up."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised pieces and identifiers. A table sentence that the cutting splits is known by its longest piece."""
    known = {}
    for sentence, identifier in sentences.items():
        piece = max((normal(p) for p in re.split(SENTENCE_END, sentence)), key=len)
        if not any(m in piece for m in MARKERS) and "licensed" not in piece:
            raise ValueError(f"No marker word in: {sentence}")
        known[piece] = identifier
    return known


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = known_sentences(sentences)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    markers = "|".join(m.replace(" ", "[^a-z0-9]+") for m in MARKERS)
    # one white space for a line break that goes on, so that a sentence matches however it is wrapped
    longest = sorted(known, key=len, reverse=True)
    runs = r"(?<![^\n])(" + "|".join(s.replace(" ", r"[\x20\n]") for s in longest) + r")(?![^\n])"
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?", "\n"), LINE_START, "")
    held = F.filter(F.split(lines, WRAPPED_END, -1), lambda s: s.rlike(markers))
    spaced = F.transform(held, lambda s: F.regexp_replace(F.regexp_replace(s, "[^a-z0-9\n]+", " "), r"\x20?\n[\x20\n]*", "\n"))
    taken = F.flatten(F.transform(spaced, lambda s: F.regexp_extract_all(F.trim(s), F.lit(runs), 1)))
    found = F.transform(taken, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))
    return F.when(F.lower(text).rlike(markers), found).otherwise(F.array().cast("array<string>"))


def licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES | MORE_SENTENCES, rules=RULES + MORE_RULES) -> DataFrame:
    """(doc_id, sentences, licences, n_unmatched, status): identifiers and licences joined by commas."""
    ids = sentence_ids(F.coalesce("text", F.lit("")), sentences)
    # each identifier stands between its own pair of marks, so that neighbours share none
    df = docs.select("doc_id", ids.alias("_ids")).withColumn("_left", F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    df = df.withColumn("_found", F.array().cast("array<string>"))
    for name, sequence in rules:
        wanted = "".join(f"<{i}>" for i in sequence)
        has = F.contains("_left", F.lit(wanted))
        df = df.withColumns(
            {"_found": F.when(has, F.array_append("_found", F.lit(name))).otherwise(F.col("_found")), "_left": F.replace("_left", F.lit(wanted), F.lit("|"))}
        )
    left = F.length("_left") - F.length(F.replace("_left", F.lit("<"), F.lit("")))
    status = F.when(F.size("_ids") == 0, "NONE").when(F.size("_found") == 0, "UNKNOWN").when(left > 0, "PARTIAL").otherwise("KNOWN")
    return df.select(
        "doc_id", F.array_join("_ids", ",").alias("sentences"), F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("licences"),
        left.cast("long").alias("n_unmatched"), status.alias("status"),
    )
