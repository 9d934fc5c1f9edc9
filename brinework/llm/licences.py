"""Licence scans by sentence rules: normalised sentences are mapped to identifiers of known licence sentences, and the
sequence of identifiers is matched against ordered licence rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.llm.common import bounded_batches, free_name, pieces

# Sentences of licence notices, as published. "<...>" stands for one to twenty words, as of a name.
SENTENCES = {
    "mit_short": "Released under the MIT License",
    "mit_licensed": "Licensed under the MIT License",
    "mit_title": "The MIT License (MIT)",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "zero_bsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "apache_short": "Licensed under the Apache License, Version 2.0",
    "apache_long": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache_asf": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\")",
    "apache_or_mit": "Licensed under the Apache License, Version 2.0 <...> or the MIT license",
    "apache_use": "you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_title": "Apache License Version 2.0, January 2004",
    "gpl3_short": "This work is licensed under the GNU General Public License, version 3",
    "program_free": "This program is free software",
    "library_free": "This library is free software",
    "gpl_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl_terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "gpl3_terms_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_terms_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3_terms_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "lgpl3_terms_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3_terms_later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "agpl_terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "agpl3_terms_only": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3",
    "agpl3_terms_version": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation",
    "gpl2_title": "GNU General Public License Version 2, June 1991",
    "gpl3_title": "GNU General Public License Version 3, 29 June 2007",
    "version2_later": "either version 2 of the License, or (at your option) any later version",
    "version2_1_later": "either version 2.1 of the License, or (at your option) any later version",
    "version3_later": "either version 3 of the License, or (at your option) any later version",
    "version2_only": "version 2 of the License",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl_implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_names": "Neither the name of <...> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl_form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl_copy_https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl2_made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1_made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "unlicense_free": "This is free and unencumbered software released into the public domain",
    "unlicense_use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc0_waived": "To the extent possible under law, <...> has waived all copyright and related or neighboring rights to this work",
    "cc0_dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc_by_nc_short": "Licensed under CC BY-NC 4.0",
    "cc_by_short": "Licensed under CC BY 4.0",
    "cc_by_work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc_by_sa_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc_by_nc_work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc_by_3_work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    "cc_by_sa_3_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "boost_short": "Distributed under the Boost Software License, Version 1.0",
    "wtfpl_terms": "You just DO WHAT THE FUCK YOU WANT TO",
    "artistic_intro": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package",
    "rights_reserved": "All rights reserved",
}

# Identifiers of licences in a line of their own.
SPDX = """MIT Apache-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC
0BSD MPL-2.0 EPL-1.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Zlib BSL-1.0 WTFPL Artistic-1.0
Artistic-2.0""".split()
SPDX_LINE = "SPDX-License-Identifier"
SENTENCES |= {f"spdx_{x}": f"{SPDX_LINE} {x}" for x in SPDX} | {"spdx_mit_apache": f"{SPDX_LINE} MIT OR Apache-2.0", "spdx_apache_mit": f"{SPDX_LINE} Apache-2.0 OR MIT"}

# What each run of sentences means. Tried in this order; what a rule matches, later rules no longer see.
RULES = [
    ("MIT", ["mit_title", "mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_title"]),
    ("MIT", ["mit_short"]),
    ("MIT", ["mit_licensed"]),
    ("Apache-2.0 OR MIT", ["apache_or_mit"]),
    ("BSL-1.0", ["boost_grant"]),
    ("BSL-1.0", ["boost_short"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["zero_bsd_grant"]),
    ("Apache-2.0", ["apache_long", "apache_use", "apache_copy"]),
    ("Apache-2.0", ["apache_long", "apache_use"]),
    ("Apache-2.0", ["apache_long"]),
    ("Apache-2.0", ["apache_short"]),
    ("Apache-2.0", ["apache_asf", "apache_use", "apache_copy"]),
    ("Apache-2.0", ["apache_asf"]),
    ("Apache-2.0", ["apache_title"]),
    ("AGPL-3.0-or-later", ["program_free", "agpl3_terms_later", "gpl_warranty", "gpl_implied"]),
    ("AGPL-3.0-or-later", ["program_free", "agpl3_terms_later"]),
    ("AGPL-3.0-or-later", ["agpl3_terms_later"]),
    ("AGPL-3.0-or-later", ["agpl_terms", "version3_later"]),
    ("AGPL-3.0-only", ["agpl3_terms_only"]),
    ("AGPL-3.0-only", ["agpl3_terms_version"]),
    ("LGPL-2.0-or-later", ["lgpl2_terms", "version2_later"]),
    ("LGPL-3.0-or-later", ["library_free", "lgpl3_terms_later"]),
    ("LGPL-3.0-or-later", ["program_free", "lgpl3_terms_later"]),
    ("LGPL-3.0-or-later", ["lgpl3_terms_later"]),
    ("LGPL-2.1-or-later", ["library_free", "lgpl_terms", "version2_1_later"]),
    ("LGPL-2.1-or-later", ["lgpl_terms", "version2_1_later"]),
    ("LGPL-3.0-or-later", ["lgpl_terms", "version3_later"]),
    ("GPL-2.0-only", ["program_free", "gpl2_terms_only", "gpl_warranty", "gpl_implied"]),
    ("GPL-2.0-only", ["gpl2_terms_only"]),
    ("GPL-2.0-only", ["gpl_terms", "version2_only"]),
    ("GPL-2.0-or-later", ["program_free", "gpl_terms", "version2_later", "gpl_warranty", "gpl_implied"]),
    ("GPL-2.0-or-later", ["program_free", "gpl_terms", "version2_later"]),
    ("GPL-2.0-or-later", ["gpl_terms", "version2_later"]),
    ("GPL-3.0-or-later", ["program_free", "gpl3_terms_later", "gpl_warranty", "gpl_implied"]),
    ("GPL-3.0-or-later", ["program_free", "gpl3_terms_later"]),
    ("GPL-3.0-or-later", ["gpl3_terms_later"]),
    ("GPL-3.0-or-later", ["gpl_terms", "version3_later"]),
    ("GPL-3.0-only", ["gpl3_terms_only"]),
    ("GPL-3.0", ["gpl3_short"]),
    ("GPL-3.0", ["gpl3_title"]),
    ("GPL-2.0", ["gpl2_title"]),
    ("BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_names"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD", ["bsd_grant"]),
    ("MPL-2.0", ["mpl_form", "mpl_copy"]),
    ("MPL-2.0", ["mpl_form", "mpl_copy_https"]),
    ("MPL-2.0", ["mpl_form"]),
    ("EPL-2.0", ["epl2_made"]),
    ("EPL-1.0", ["rights_reserved", "epl1_made"]),
    ("EPL-1.0", ["epl1_made"]),
    ("Unlicense", ["unlicense_free", "unlicense_use"]),
    ("Unlicense", ["unlicense_free"]),
    ("CC0-1.0", ["cc0_waived"]),
    ("CC0-1.0", ["cc0_dedicated"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_short"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_work"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_work"]),
    ("CC-BY-4.0", ["cc_by_short"]),
    ("CC-BY-4.0", ["cc_by_work"]),
    ("CC-BY-3.0", ["cc_by_3_work"]),
    ("CC-BY-SA-3.0", ["cc_by_sa_3_work"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("WTFPL", ["wtfpl_terms"]),
    ("Artistic-1.0", ["artistic_intro"]),
    *((x, [f"spdx_{x}"]) for x in SPDX),
    ("Apache-2.0 OR MIT", ["spdx_mit_apache"]),
    ("Apache-2.0 OR MIT", ["spdx_apache_mit"]),
    ("proprietary", ["rights_reserved"]),
]

#: What counts only where no other licence is found: notices of all licences begin with such a line.
ALONE = "proprietary"

SLOT = "<...>"
#: Words that a slot holds, at most.
SLOT_WORDS = 20
#: Words from which on a known sentence counts anywhere in a sentence.
LONG = 11
#: A sentence ends at one of these marks before white space; a line end may end it, too.
_MARK = re.compile(r"(?<![.!?:;])[.!?:;]++[ \t\r\n]+")
#: Such marks before a line, which set it apart as a comment.
_AHEAD = re.compile(r"(^|\n)[ \t]*[.!?:;]+[ \t]+")
#: The colon of such a line is no end of a sentence, and a plus means later versions, too.
_SPDX_PLUS = re.compile(r"(spdx-license-identifier[ \t]*:[ \t]*[a-z0-9.-]+)\+")
_SPDX_COLON = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*")
# Comment marks that are words; all others fall away as a sentence is normalised.
_MARKS = ("dnl ", "rem ", "c ")
_OTHER = re.compile(r"[^a-z0-9]+")
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line(part: str) -> str:
    """A line of a sentence, normalised, without a comment mark before it."""
    out = _OTHER.sub(" ", part.translate(_ASCII_LOWER)).strip(" ")
    return next((out[len(m) :] for m in _MARKS if out.startswith(m)), out)


def known_sentence(text: str) -> tuple[str, str | None]:
    """What a known sentence begins with, and what it ends with behind its slot, if it has one."""
    if SLOT not in text:
        return line(text), None
    before, after = text.split(SLOT)
    return line(before), line(after)


class Recogniser:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES):
        #: (start, end behind a slot or nothing, words without those of a slot, identifier) of each known sentence.
        self.known = [(f" {a} ", f" {b} " if b else "", len(f"{a} {b}".split()) if b else len(a.split()), name) for name, s in sentences.items() for a, b in [known_sentence(s)]]
        self.rules = [(licence, "".join(f"|{i}|" for i in ids)) for licence, ids in rules]
        self.names = list(dict.fromkeys(x for x, _ in rules))
        #: Each known sentence has one of these words, so a text without them has none.
        self.hints = sorted({max((a + b).split(), key=len) for a, b, _, _ in self.known})

    def _in_block(self, lines: list[str]) -> list[str]:
        """Identifiers of the known sentences in lines that are one sentence or more without a stop."""
        words = " ".join(lines).split(" ")
        text = f" {' '.join(words)} "
        spaces = [i for i, c in enumerate(text) if c == " "]
        ends = list(accumulate(len(x.split()) for x in lines))
        starts, ends = {0, *ends}, set(ends)
        found = []
        for head, tail, n, name in self.known:
            at, size, after = text.find(head), head.count(" ") - 1, tail.count(" ") - 1
            while at >= 0:
                first, gap = bisect_left(spaces, at), 0
                if tail:  # within so many words, or not at all
                    rest = f" {' '.join(words[first + size : first + size + SLOT_WORDS + after])} "
                    gap = rest.find(tail)
                    gap = rest.count(" ", 0, gap) if gap >= 0 else -1
                last = first + n + gap
                if (not tail or 1 <= gap <= SLOT_WORDS) and (n >= LONG or first in starts and last in ends):
                    found.append((first, last, name))
                at = text.find(head, at + 1)
        # what starts no later and ends no sooner comes first; equal ones stand beside each other
        kept, reach, own = [], -1, None
        for a, b, name in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
            if b > reach or (a, b) == own:
                kept.append((a, b, name))
                reach, own = b, (a, b)
        return [name for _, _, name in kept]

    def sentences(self, text: str) -> list[str]:
        """Identifiers of the known sentences, in order. A sentence ends at a stop before white space, and at a blank
        line; single line ends and comment marks within it are no matter. One of ``LONG`` words or more counts wherever
        it stands in a sentence, as a heading may run into it; a shorter one only as whole lines or a whole sentence.
        One within another doesn't count."""
        low = text.translate(_ASCII_LOWER) if not text.isascii() else text.lower()
        if not any(h in low for h in self.hints):
            return []
        if SPDX_LINE.lower() in low:
            low = _SPDX_COLON.sub("spdx-license-identifier ", _SPDX_PLUS.sub(r"\1-or-later", low))
        out = []
        for sentence in _MARK.split(_AHEAD.sub(r"\1", low)):
            if any(h in sentence for h in self.hints):
                block: list[str] = []
                for x in [*map(line, sentence.split("\n")), ""]:
                    if x:
                        block.append(x)
                    elif block:
                        out += self._in_block(block)
                        block = []
        return out

    def licences(self, ids: list[str]) -> list[str]:
        left, out = "".join(f"|{i}|" for i in ids), set()
        for licence, run in self.rules:
            if run in left and (licence != ALONE or not out):
                left = left.replace(run, "|*|")
                out.add(licence)
        return [x for x in self.names if x in out]


def scan(docs: DataFrame, text_col: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None, sentences_as: str = "licence_sentences", licences_as: str = "licences") -> DataFrame:
    """``docs`` with ``licence_sentences`` (identifiers in order) and ``licences`` (in the order of the rules) of each
    whole text; empty arrays where there is none, and for null and empty texts. Columns of ``docs`` with these names
    are replaced; name others in ``sentences_as`` and ``licences_as`` to keep them. Repeated rows stay."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(sentences_as, licences_as)
    own = Recogniser(sentences or SENTENCES, rules or RULES)
    names = T.ArrayType(T.StringType())
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField(sentences_as, names), T.StructField(licences_as, names)])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                ids = [own.sentences(t or "") for t in batch.column(text_col).to_pylist()]
                out = batch.append_column(sentences_as, pa.array(ids, pa.list_(pa.string())))
                yield out.append_column(licences_as, pa.array([own.licences(x) for x in ids], pa.list_(pa.string())))

    return docs.mapInArrow(run, schema)


def drop_licences(docs: DataFrame, banned: list[str], **options) -> DataFrame:
    """``docs`` less the rows with one of the ``banned`` licences; columns stay, whatever their names."""
    a, b = free_name(docs, "_sentences"), free_name(docs, "_licences")
    found = scan(docs, sentences_as=a, licences_as=b, **options)
    return found.where(~F.arrays_overlap(b, F.array(*map(F.lit, banned)))).select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL of the scan over ``documents``: every word of a sentence is tried as the first of each known one."""
    quote = lambda s: s.replace("'", "''")
    parts = {name: known_sentence(s) for name, s in SENTENCES.items()}
    known = ", ".join(f"('{quote(a)}', {'NULL' if b is None else repr(b)}, '{name}', '{a.split()[0]}', {len(a.split())}, {len(b.split()) if b else 0})" for name, (a, b) in parts.items())
    hints = "|".join(Recogniser().hints)
    seqs, flags = ["left0"], []
    for i, (licence, ids) in enumerate(RULES):
        run = "".join(f"|{x}|" for x in ids)
        flags.append((licence, f"contains(left{i}, '{run}')"))
        seqs.append(f"replace(left{i}, '{run}', '|*|') AS left{i + 1}")
    steps, names = [], list(dict.fromkeys(x for x, _ in RULES))
    for i in range(len(RULES)):
        steps.append(f"s{i + 1} AS (SELECT *, {seqs[i + 1]} FROM s{i})")
    any_of = lambda xs: " OR ".join(f for x, f in flags if x in xs)
    found = ", ".join(f"CASE WHEN {any_of([name])} THEN '{name}' END" for name in names if name != ALONE)
    alone = f"CASE WHEN ({any_of([ALONE])}) AND concat_ws('', {found}) = '' THEN '{ALONE}' END"
    return rf"""
WITH k(head, tail, id, word, n, m) AS (VALUES {known}),
c AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS ci FROM (
    SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '(spdx-license-identifier[ \t]*:[ \t]*[a-z0-9.-]+)\+', '\1-or-later', 'g'), 'spdx-license-identifier[ \t]*:[ \t]*', 'spdx-license-identifier ', 'g'), '(^|\n)[ \t]*[.!?:;]+[ \t]+', '\1', 'g'), '[.!?:;]+[ \t\r\n]+') AS parts FROM documents WHERE text IS NOT NULL)),
u AS (
  SELECT doc_id, ci, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM (SELECT doc_id, ci, string_split(part, chr(10)) AS lines FROM c WHERE regexp_matches(part, '{hints}'))),
n AS (SELECT doc_id, ci, i, regexp_replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), '^(dnl|rem|c) ', '') AS x FROM u),
b AS (SELECT *, sum(CASE WHEN x = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ci ORDER BY i) AS block, len(string_split(x, ' ')) AS w FROM n),
l AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, ci, block ORDER BY i) AS till FROM b WHERE x <> ''),
g AS (SELECT doc_id, ci, block, string_split(string_agg(x, ' ' ORDER BY i), ' ') AS ws, list(till) AS ends, list(till - w + 1) AS starts FROM l GROUP BY ALL),
p AS (SELECT *, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS s FROM g),
h AS (SELECT p.*, k.* EXCLUDE (word), CASE WHEN tail IS NULL THEN [0] ELSE range(1, {SLOT_WORDS} + 1) END AS slots FROM p JOIN k ON k.word = p.word WHERE array_to_string(ws[s:s + n - 1], ' ') = head),
e AS (SELECT *, unnest(slots) AS gap FROM h),
f AS (
  SELECT DISTINCT doc_id, ci, block, s AS a, s + n + gap + m - 1 AS b, id FROM e
  WHERE (tail IS NULL OR array_to_string(ws[s + n + gap:s + n + gap + m - 1], ' ') = tail) AND (n + m >= {LONG} OR list_contains(starts, s) AND list_contains(ends, s + n + gap + m - 1))),
m AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY ci, block, a) AS ids, string_agg('|' || id || '|', '' ORDER BY ci, block, a) AS left0 FROM f
  WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.ci = f.ci AND g.block = f.block AND g.a <= f.a AND f.b <= g.b AND (g.a <> f.a OR g.b <> f.b)) GROUP BY doc_id),
s0 AS (SELECT d.doc_id, ids, coalesce(left0, '') AS left0 FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id),
{", ".join(steps)}
SELECT doc_id, coalesce(ids, '') AS sentences, concat_ws(',', {found}, {alone}) AS licences FROM s{len(RULES)}
"""
