import textwrap
import time

import duckdb
import pytest

from brinework.llm import licences

# Notices as published: blank lines between paragraphs.
MIT = """MIT License

Copyright (c) 2021 A. Body and others

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Copyright 2020 The Authors.

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
GPL = """This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{semi} either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {kind} for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
NAMES = """
3. Neither the name of the {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
PUBLISHED = {
    "MIT": MIT,
    "Apache-2.0": APACHE,
    "GPL-2.0-or-later": GPL.format(colon=";", kind="General Public License", semi=";", version="2"),
    "GPL-3.0-or-later": GPL.format(colon=":", kind="General Public License", semi=",", version="3"),
    "LGPL-2.1-or-later": GPL.format(colon=";", kind="Lesser General Public License", semi=";", version="2.1").replace("This program", "This library"),
    "LGPL-3.0-or-later": GPL.format(colon=":", kind="Lesser General Public License", semi=",", version="3"),
    "AGPL-3.0-or-later": GPL.format(colon=":", kind="Affero General Public License", semi=",", version="3"),
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "BSD-2-Clause": BSD.format(third=""),
    "BSD-3-Clause": BSD.format(third=NAMES.format(holder="copyright holder")),
    "BSD-4-Clause": BSD.format(third="\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software of the Body.\n" + NAMES.format(holder="University of Somewhere and its many friends")),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html\n\nContributors: A. Body",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, Jo Author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Apache-2.0 OR MIT": "Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0> or the MIT license <LICENSE-MIT or http://opensource.org/licenses/MIT>, at your option. This file may not be copied, modified, or distributed except according to those terms.",
    "LGPL-2.0-or-later": GPL.format(colon=";", kind="Library General Public License", semi=";", version="2").replace("This program", "This library"),
    "AGPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n\n(See accompanying file LICENSE_1_0.txt)",
}
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0"""
HEADED = {x: "Copyright (c) 2015, The Regents. All rights reserved.\n\n" + t for x, t in PUBLISHED.items()} | {"Apache-2.0 ": ASF}
MARKS = ["", " * ", "# ", "// ", "-- ", "dnl ", "REM ", "C     ", "; "]


def wrapped(text: str, mark: str = "", width: int = 72, end: str = "\n") -> str:
    lines = [mark + x for block in text.split("\n\n") for x in [*textwrap.wrap(block, width, break_long_words=False, break_on_hyphens=False), ""]]
    return end.join(["/*" if mark == " * " else "", *lines, " */" if mark == " * " else "", "int main;"])


def test_sequences():
    own = licences.Recogniser()
    text = "Some code.\n" + licences.SENTENCES["mit_grant"] + ":\n\n" + licences.SENTENCES["mit_notice"] + ".\nAll rights reserved. LICENSED under the Apache   License, version 2.0!\n"
    ids = own.sentences(text)
    assert ids == ["mit_grant", "mit_notice", "rights_reserved", "apache_short"]
    assert own.licences(ids) == ["MIT", "Apache-2.0"]  # rights reserved beside a licence are no licence
    assert own.licences(["rights_reserved"]) == ["proprietary"]
    assert own.sentences("the license of this is unknown. released under") == []
    assert own.licences([]) == []


def test_order_of_rules_and_sequences():
    own = licences.Recogniser({"a": "first thing", "b": "second thing"}, [("both", ["a", "b"]), ("one", ["a"]), ("two", ["b", "b"])])
    assert own.licences(own.sentences("First thing. Second thing.\nfirst thing")) == ["both", "one"]
    assert own.licences(own.sentences("Second thing. First thing")) == ["one"]
    assert own.licences(own.sentences("second thing\nsecond-thing")) == ["two"]
    # a notice that stands twice is no other licence
    assert own.licences(own.sentences("First thing. Second thing. First thing. Second thing")) == ["both"]


@pytest.mark.parametrize("mark", MARKS)
@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("licence", sorted(PUBLISHED))
def test_published_notices_wrapped_and_commented(licence, mark, end):
    own = licences.Recogniser()
    for width in (40, 72, 100):
        assert own.licences(own.sentences(wrapped(PUBLISHED[licence], mark, width, end))) == [licence]


@pytest.mark.parametrize("licence", sorted(PUBLISHED))
def test_published_notices_as_one_line(licence):
    own = licences.Recogniser()
    flat = " ".join(PUBLISHED[licence].split())
    assert own.licences(own.sentences(flat)) == [licence]


@pytest.mark.parametrize("mark", MARKS)
@pytest.mark.parametrize("licence", sorted(HEADED))
def test_notices_with_copyright_lines(licence, mark):
    own = licences.Recogniser()
    for width in (40, 80):
        assert own.licences(own.sentences(wrapped(HEADED[licence], mark, width))) == [licence.strip()]


def test_identifiers_in_a_line():
    own = licences.Recogniser()
    for x in licences.SPDX:
        for form in ("// SPDX-License-Identifier: {}", "/* SPDX-License-Identifier:{} */", "# spdx-license-identifier : {}\nimport re"):
            assert own.licences(own.sentences("#!/bin/sh\n" + form.format(x))) == [x]
    assert own.licences(own.sentences("SPDX-License-Identifier: GPL-2.0+")) == ["GPL-2.0-or-later"]
    assert own.licences(own.sentences("SPDX-License-Identifier: MIT OR Apache-2.0\n")) == ["Apache-2.0 OR MIT"]
    assert own.licences(own.sentences("SPDX-License-Identifier: Something-1.0\n")) == []
    assert own.licences(own.sentences("// SPDX-License-Identifier: MIT\n\n" + APACHE)) == ["MIT", "Apache-2.0"]
    assert own.licences(own.sentences("Licensed under the MIT license.")) == ["MIT"]


def test_very_long_texts_take_linear_time():
    own = licences.Recogniser()
    begin = "Neither the name of x "
    for text, count in (("All rights reserved\n" * 100_000, 100_000), (begin * 30_000, 0), ("." * 300_000 + " mit license", 0), ("released under the mit license " * 30_000, 0), ("Licensed under the Apache License, Version 2.0\n" * 30_000, 30_000)):
        start = time.monotonic()
        assert len(own.sentences(text)) == count
        assert time.monotonic() - start < 4


def test_wrapped_sentences_end_at_blank_lines_and_stops():
    own = licences.Recogniser()
    assert own.sentences("Released under\nthe MIT License") == ["mit_short"]
    assert own.sentences("Released under\n\nthe MIT License") == []
    assert own.sentences(" * Released under\n *\n * the MIT License") == []
    assert own.sentences("Released under.\nthe MIT License") == []
    assert own.sentences("Licensed under the Apache License, Version 2.0\nLicensed under CC BY 4.0") == ["apache_short", "cc_by_short"]
    assert own.sentences("Licensed under the Apache License, Version 2.0\n(the \"License\");\nLicensed under CC BY 4.0") == ["apache_long", "cc_by_short"]
    assert own.sentences("The text is\nAll rights reserved\nby us") == ["rights_reserved"]
    assert own.sentences("Not all rights reserved") == []


def test_slots():
    own = licences.Recogniser()
    begin, end = "Neither the name of ", " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert own.sentences(begin + "x" + end) == ["bsd_names"]
    assert own.sentences(begin + "x " * 20 + end) == ["bsd_names"]
    assert own.sentences(begin + "x " * 21 + end) == []
    assert own.sentences(begin + end) == []


def test_frames(spark):
    rows = [(1, "x\nReleased under the MIT License.", "a"), (1, "x\nReleased under the MIT License.", "a"), (None, None, None), (2, "", "b"), (3, "w " * 200_000 + "\nLicensed under CC BY-NC 4.0.", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = [(r.doc_id, list(r.licences)) for r in licences.scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, ["MIT"]), (1, ["MIT"]), (None, []), (2, []), (3, ["CC-BY-NC-4.0"])], key=str)
    left = licences.drop_licences(docs.selectExpr("*", "1 as _licences", "2 as _SENTENCES"), ["MIT"])
    assert left.columns == ["doc_id", "text", "licences", "_licences", "_SENTENCES"]
    assert {(r.doc_id, r.licences, r._licences, r._SENTENCES) for r in left.collect()} == {(None, None, 1, 2), (2, "b", 1, 2), (3, "c", 1, 2)}
    assert licences.scan(docs.limit(0)).count() == 0


def test_sql_knows_wrapped_notices_too():
    own = licences.Recogniser()
    texts = [wrapped(t, m, w) for t in PUBLISHED.values() for m in MARKS for w in (50, 72)] + list(PUBLISHED.values()) + [" ".join(t.split()) for t in PUBLISHED.values()] + [wrapped(t, m) for t in HEADED.values() for m in MARKS[:4]] + [f"// SPDX-License-Identifier: {x}\nx" for x in [*licences.SPDX, "GPL-3.0+", "X"]] + [None, "", "\n\n", "Released under.\nthe MIT License", "The text is\nAll rights reserved\nby us"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {r[0]: r[1:] for r in con.execute(licences.oracle()).fetchall()}
    for i, text in enumerate(texts):
        ids = own.sentences(text or "")
        assert got[i] == (",".join(ids), ",".join(own.licences(ids)))
