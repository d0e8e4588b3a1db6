"""Licence recognition by sentences, in DataFrame functions only.

A text is cut into sentences, which are normalised; those equal to a known
licence sentence become its number. Ordered rules then match runs of numbers:
the first rule takes its runs out of the sequence and leaves the licence's
name, the second sees what remains, and so on, so a full licence text comes
before the shorter notices that are part of it. Numbers that no rule takes are
reported as well. Every row is judged by itself: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, numbered from 1.
SENTENCES = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.",
    "Licensed under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is free software;",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "either version 2 of the License, or (at your option) any later version.",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY 4.0.",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "SPDX-License-Identifier: MIT",
    "SPDX-License-Identifier: Apache-2.0",
    "All rights reserved.",
    "This library is free software;",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "either version 2.1 of the License, or (at your option) any later version.",
    "either version 3 of the License, or (at your option) any later version.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "This software is distributed without any warranty.",
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "This software is provided 'as-is', without any express or implied warranty.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under the BSD 3-Clause License.",
    "Licensed under the BSD 2-Clause License.",
    "Licensed under the ISC License.",
    "Licensed under the Mozilla Public License, Version 2.0.",
    "Released under the Apache License, Version 2.0.",
    "Released under the BSD 3-Clause License.",
)
# Identifiers in SPDX lines.
SPDX = ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0")
SENTENCES += tuple(f"SPDX-License-Identifier: {x}" for x in SPDX)

# Fixed values: (licence, run of sentence numbers), tried in this order.
RULES = (
    ("MIT", (1, 2, 3)),
    ("MIT", (1, 2)),
    ("ISC", (4, 3)),
    ("ISC", (4,)),
    ("BSD-3-Clause", (5, 6, 7, 8)),
    ("BSD-2-Clause", (5, 6, 7)),
    ("Apache-2.0", (9, 10, 11, 12)),
    ("Apache-2.0", (9, 10)),
    ("GPL-3.0-or-later", (17,)),
    ("GPL-2.0-or-later", (18, 19, 20)),
    ("Apache-2.0", (13,)),
    ("MIT", (14,)),
    ("MIT", (15,)),
    ("GPL-3.0-only", (16,)),
    ("CC-BY-NC-4.0", (21,)),
    ("CC-BY-4.0", (22,)),
    ("CC-BY-4.0", (23,)),
    ("MPL-2.0", (24,)),
    ("MIT", (25,)),
    ("Apache-2.0", (26,)),
    ("LGPL-2.1-or-later", (28, 29, 30)),
    ("LGPL-3.0-or-later", (28, 29, 31)),
    ("AGPL-3.0-or-later", (32,)),
    ("GPL-2.0-only", (18, 33)),
    ("GPL-2.0-only", (34,)),
    ("LGPL-3.0-only", (35,)),
    ("AGPL-3.0-only", (36,)),
    ("CC0-1.0", (37, 38)),
    ("CC0-1.0", (37,)),
    ("Unlicense", (39, 40)),
    ("Unlicense", (39,)),
    ("Zlib", (41, 42)),
    ("BSL-1.0", (43,)),
    ("BSL-1.0", (44,)),
    ("EPL-2.0", (45,)),
    ("CC-BY-SA-4.0", (46,)),
    ("CC-BY-NC-4.0", (47,)),
    ("CC-BY-SA-4.0", (48,)),
    ("BSD-3-Clause", (49,)),
    ("BSD-2-Clause", (50,)),
    ("ISC", (51,)),
    ("MPL-2.0", (52,)),
    ("Apache-2.0", (53,)),
    ("BSD-3-Clause", (54,)),
)
RULES += tuple((x, (i,)) for i, x in enumerate(SPDX, len(SENTENCES) - len(SPDX) + 1))

# A sentence ends at a line that is blank or holds a comment's mark alone, and at white space after one of these signs.
_SPACE = r"[ \t\n\r\f\x0B]"
SIGN = rf"([.;!?]){_SPACE}+"
BLANK = r"\n[ \t\r\f\x0B]*(?:[#*;%]+|//+|--+)?[ \t\r\f\x0B]*\n"
#: Marks the end of a sentence.
MARK = "\x1e"
#: Every known sentence has one of these; other sentences need no normalising.
ANCHOR = r"(?i)licen[sc]e|permission|software|redistribut|copyright|rights reserved|CC BY|GNU|any later version"


def normal_form(sentence: str) -> str:
    """What ``_normal`` gives, for the known sentences."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


Rules = Sequence[tuple[str, Sequence[int]]]


def scan(docs: DataFrame, sentences: Sequence[str] = SENTENCES, rules: Rules = RULES) -> DataFrame:
    """doc_id, n_known long, sentence_ids, licences, unmatched of every row of ``docs`` (doc_id, text).

    sentence_ids: numbers of the known sentences in order, joined by commas;
    licences: names by the rules' order, one for each rule that matches, each
    name once; unmatched: the numbers that no rule took. No known sentence,
    empty or null text: 0 and empty strings. Repeated rows come out as often
    as they came; extra columns are ignored; an empty table gives no rows.
    Other sentences (each with a word of ``ANCHOR``) and rules may be given; of
    sentences with one normal form the first one's number stands for all, in rules, too.
    """
    first: dict[str, int] = {}
    same = {i: first.setdefault(normal_form(s), i) for i, s in enumerate(sentences, 1)}
    rules = [(name, [same[n] for n in run]) for name, run in rules]
    numbers = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    text = F.coalesce("text", F.lit(""))
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(text, SIGN, f"$1{MARK}"), BLANK, MARK), MARK), lambda s: s.rlike(ANCHOR))
    number = lambda s: F.try_element_at(numbers, _normal(s))
    # a sentence may run over lines; of one that isn't known, each line may be
    known = F.filter(F.flatten(F.transform(parts, lambda s: F.when(number(s).isNotNull(), F.array(number(s))).otherwise(F.transform(F.split(s, "\n"), number)))), lambda n: n.isNotNull())
    # most texts have no anchor at all and aren't cut up
    found = docs.select("doc_id", F.when(text.rlike(ANCHOR), known).otherwise(F.array().cast("array<int>")).alias("known"))
    ids = F.array_join(F.transform("known", lambda n: n.cast("string")), ",")
    tried = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{n}>" for n in run)).alias("run")) for name, run in rules))
    start = F.struct(F.array_join(F.transform("known", lambda n: F.concat(F.lit("<"), n.cast("string"), F.lit(">"))), "").alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["run"])
        # a mark stays where a run was, so that what was apart doesn't become a run
        return F.struct(F.when(hit, F.replace(state["left"], rule["run"], F.lit("|"))).otherwise(state["left"]).alias("left"), F.when(hit, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"))

    judged = found.select("doc_id", F.size("known").cast("long").alias("n_known"), ids.alias("sentence_ids"), F.when(F.size("known") > 0, F.aggregate(tried, start, apply)).otherwise(start).alias("end"))
    rest = F.regexp_replace(F.regexp_replace(F.col("end.left"), r"[|<]", ""), ">", ",")
    return judged.select("doc_id", "n_known", "sentence_ids", F.array_join(F.array_distinct("end.names"), ",").alias("licences"), F.rtrim(rest, F.lit(",")).alias("unmatched"))


def scan_sql() -> str:
    """The same for DuckDB, over a view ``documents``."""
    numbers = " ".join(f"WHEN '{normal_form(s)}' THEN {i}" for i, s in enumerate(SENTENCES, 1))
    anchor = ANCHOR.removeprefix("(?i)")
    steps = ["s0 AS (SELECT doc_id, known, coalesce(array_to_string(list_transform(known, lambda n: '<' || n || '>'), ''), '') AS rest, '' AS names FROM k)"]
    for i, (name, run) in enumerate(RULES):
        text = "".join(f"<{n}>" for n in run)
        add = f"CASE WHEN contains(rest, '{text}') AND NOT contains(names || ',', ',{name},') THEN names || ',{name}' ELSE names END"
        steps.append(f"s{i + 1} AS (SELECT doc_id, known, replace(rest, '{text}', '|') AS rest, {add} AS names FROM s{i})")
    cut = rf"string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{SIGN}', '\1' || chr(30), 'g'), '{BLANK}', chr(30), 'g'), chr(30))"
    number = lambda s: f"CASE trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g')) {numbers} END"
    return (
        f"WITH p AS (SELECT doc_id, unnest({cut}) AS s, generate_subscripts({cut}, 1) AS i FROM documents), "
        f"w AS (SELECT doc_id, i, s, {number('s')} AS n FROM p WHERE regexp_matches(s, '{anchor}', 'i')), "
        "l AS (SELECT doc_id, i, unnest(string_split(s, chr(10))) AS s, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM w WHERE n IS NULL), "
        f"n AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS j, n FROM w UNION ALL SELECT doc_id, i, CAST(j AS BIGINT), {number('s')} FROM l), "
        "g AS (SELECT doc_id, list(n ORDER BY i, j) AS known FROM n WHERE n IS NOT NULL GROUP BY doc_id), "
        "k AS (SELECT d.doc_id, coalesce(g.known, []) AS known FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id), "
        + ", ".join(steps)
        + f" SELECT doc_id, CAST(len(known) AS BIGINT) AS n_known, coalesce(array_to_string(known, ','), '') AS sentence_ids, ltrim(names, ',') AS licences, rtrim(replace(regexp_replace(rest, '[|<]', '', 'g'), '>', ','), ',') AS unmatched FROM s{len(RULES)}"
    )
