"""Fingerprints, mixing and licence scans against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from listenlab.llm import fingerprints, licenses, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_fingerprints(spark, docs):
    some = docs.where("doc_id IS NOT NULL AND doc_id <> 7").select("doc_id", "text", F.lit("x").alias("fingerprint"))
    got = {r.doc_id: r for r in fingerprints.fingerprinted(some).collect()}
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(got) == sorted(ids)
    for i, k in enumerate(ids):
        t, nxt = texts[k], texts[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[k].n_chars == len(t)
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got[k].near_edited), (nxt, got[k].near_next)):
            a, b = _shingles(t), _shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert near == pytest.approx(true, abs=0 if len(a | b) <= fingerprints.K else 0.15)
    assert got[1].fingerprint == got[2].fingerprint != ""
    assert got[4].fingerprint == ""


def test_fingerprints_of_nothing_and_of_repeated_ids(docs, none):
    assert fingerprints.fingerprinted(none).count() == 0
    assert fingerprints.fingerprinted(docs).count() == docs.count()
    one = fingerprints.fingerprinted(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_sketches_merge(spark):
    a, b = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(450, 1400))
    one = spark.createDataFrame([(a, b)], "a string, b string")
    k = 256
    sa, sb = fingerprints.sketch(F.col("a"), k), fingerprints.sketch(F.col("b"), k)
    r = one.select(fingerprints.merge(sa, sb, k).alias("m"), fingerprints.distinct_shingles(sa, k).alias("n"), fingerprints.resemblance(sa, sb, k).alias("j"), fingerprints.containment(sa, sb, k).alias("c")).first()
    assert r.m == sorted(r.m) and len(r.m) == k
    x, y = _shingles(a), _shingles(b)
    assert r.n == pytest.approx(len(x), rel=0.25)
    assert r.j == pytest.approx(len(x & y) / len(x | y), abs=0.12)
    assert r.c == pytest.approx(len(x & y) / len(x), abs=0.2)
    merged = fingerprints.merged(spark.createDataFrame([(1, a), (1, b)], "g int, text string"), ["g"], k).first()
    assert merged.sketch == r.m


def _brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in cut]
        level = (total - sum(3 * sizes[s] for s in cut)) / sum(w[s] for s in rest) if rest else 0
        more = {s for s in rest if level * w[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in cut else level * w[s] for s in order}
        cut |= more


def test_mixing(spark, docs):
    rows = [(i, " ".join(["w"] * (i % 50)), f"s{i % 7}" if i % 11 else None) for i in range(3000)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), docs):
        got = mixing.mixed(df).collect()
        assert len(got) == df.count()
        src = {}
        for r in df.collect():
            src.setdefault(r.source, []).append((r.doc_id, len(WORD.findall(r.text or ""))))
        want = _brute_targets({s: sum(n for _, n in v) for s, v in src.items()})
        by_id = {r.doc_id: r for r in got}
        for s, v in src.items():
            for i, n in v:
                assert by_id[i].size == n and by_id[i].target == pytest.approx(want[s])
                assert by_id[i].taken <= 3 * n and (n == 0 or by_id[i].taken % n == 0)
            taken = sum(by_id[i].taken for i, _ in set(v))
            if len(v) > 50:
                assert taken == pytest.approx(want[s], abs=50)
        assert sorted(got, key=str) == sorted(mixing.mixed(df).collect(), key=str)


def test_mixing_nothing(none):
    assert mixing.mixed(none).count() == 0


def test_licences(docs, none, spark):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[11].licenses == "Apache-2.0,MIT" and got[11].sentence_ids == "MITref,Apache2ref,MITtitle"
    assert got[4].licenses == got[1].licenses == ""
    assert licenses.scan(none).count() == 0
    full = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    one = licenses.scan(spark.createDataFrame([(1, full)], "doc_id long, text string")).first()
    assert one.sentence_ids == "MITtitle,MITgrant,MITnotice" and one.licenses == "MIT"


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_wrapped_licences(spark):
    want = {
        MIT: ("MITtitle,MITgrant,MITnotice", "MIT"), GPL: ("GPL3plus,GPLwarranty,GPLsee", "GPL-3.0-or-later"),
        BSD: ("AllRights,BSDgrant,BSDsource,BSDbinary,BSDendorse", "BSD-3-Clause"),
        APACHE: ("Apache2ref,Apache2use,Apache2copy,Apache2warranty,Apache2see", "Apache-2.0"),
    }
    marks = ("", " * ", "# ", "// ")
    rows = [(i, "x = 1\n\n" + "".join(f"{m}{line}".rstrip() + end for line in text.splitlines())) for i, (text, m, end) in enumerate((t, m, e) for t in want for m in marks for e in ("\n", "\r\n"))]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [w for w in want.values() for _ in range(8)]
    # a line end need not be passed over, a blank line or a full stop is never
    some = [(1, "some words\nMIT License\nmore words"), (2, "released under the\n\nMIT License"), (3, "licensed under the. MIT License"), (4, "known as the MIT License")]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == {1: "MITtitle", 2: "MITtitle", 3: "MITtitle", 4: ""}


def test_more_licences(spark):
    isc = """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
    lgpl = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
    warranty = MIT + """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
    rows = [isc, lgpl, mpl, warranty, "// SPDX-License-Identifier: Apache-2.0\nint x;", "# SPDX-License-Identifier: GPL-2.0-only", "This is free and unencumbered software released into the public domain."]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == ["ISC", "LGPL-2.1-or-later", "MPL-2.0", "MIT", "Apache-2.0", "GPL-2.0-only", "Unlicense"]


BSD_REST = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD2 = BSD[: BSD.index("3. Neither")]


def _holder(name):
    return BSD.replace("the copyright holder nor the names of its\n   contributors may be used to", f"{name} nor the names of its\n   contributors may be used to")


def test_slots_free_wordings_and_expressions(spark):
    cases = {
        _holder("Google Inc.") + BSD_REST: "BSD-3-Clause",
        _holder("the University of California, Berkeley") + BSD_REST.replace("THE COPYRIGHT HOLDERS", "THE REGENTS"): "BSD-3-Clause",
        BSD2 + BSD_REST: "BSD-2-Clause",
        _holder("one two three four five six seven eight nine"): "BSD-2-Clause",
        "Copyright 2020 Some One. All rights reserved.": "LicenseRef-proprietary",
        "All rights reserved.\n\n" + MIT + "\nAll rights reserved.": "MIT",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
        "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause */": "BSD-3-Clause,GPL-2.0-only",
        "// SPDX-License-Identifier: GPL-2.0+\nint x;": "GPL-2.0-or-later",
        "# SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1-only",
        "# SPDX-License-Identifier: MIT-0": "",
        "It is free. It is licensed under the terms of the MIT license. ": "",
        "The parser library is licensed under the terms of the MIT licence.": "MIT",
        "Released under the MIT licence.": "MIT",
        "This package is\ndistributed under the Boost Software License,\nVersion 1.0.": "BSL-1.0",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-Non Commercial-No Derivatives 3.0 Unported License.": "CC-BY-NC-ND-3.0",
        "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
        "Licensed under the Apache License v2.0.": "Apache-2.0",
        "nothing of the kind, in software version 2": "",
    }
    for mark in ("", "# ", " * "):
        rows = [(i, "x = 1\n\n" + "".join(mark + line + "\n" for line in text.splitlines())) for i, text in enumerate(cases)]
        got = [r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
        assert got == list(cases.values())


def test_no_known_sentence_is_without_an_anchor():
    assert all(re.search(licenses.ANCHOR, s) for s in licenses.KNOWN)


def _longest(ids):
    found, i = set(), 0
    while i < len(ids):
        fit = [(len(seq), name) for seq, name in licenses.RULES if tuple(ids[i : i + len(seq)]) == seq]
        if fit:
            found.add(max(fit)[1])
        i += max(fit)[0] if fit else 1
    return [n for n in licenses._NAMES if n in found]


def test_longest_rule_at_a_place(spark):
    names = sorted({x for seq, _ in licenses.RULES for x in seq} | {"MPL2copy"})
    rng = random.Random(5)
    rows = [([*rng.choice(licenses.RULES)[0], *rng.choices(names, k=rng.randint(0, 3)), *rng.choice(licenses.RULES)[0]],) for _ in range(200)] + [([],)]
    got = spark.createDataFrame(rows, "ids array<string>").select("ids", licenses.recognise(F.col("ids")).alias("r")).collect()
    assert all(r.r == _longest(r.ids) for r in got)


def test_long_lines(spark):
    text = "word " * 200_000 + ". MIT License. " + "x" * 300_000
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == ""
