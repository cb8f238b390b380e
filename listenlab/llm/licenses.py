"""Licence scans by sentence-rule recognition.

Texts are normalised, the ends of sentences marked, and the sentences looked up in a table of known
licence sentences; a sentence can go on over line ends. Known sentences can have slots ("{}", one to
eight words: a holder's name) and free wordings (FREE: licence or license, with or without "the terms of", ...).
The identifiers found, in order of the text, are matched against ordered rules: from each place on, the
longest rule that matches there wins and its identifiers are used up. "All rights reserved" stands in
many open licences: it names a licence of its own only where no other identifier is found. Licences are
named in the order of the rules; a tag with an expression (AND, OR, WITH, +) names each of its licences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Known licence sentences in normal form (lower case, only letters, digits and single spaces) and their identifiers.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "the mit license": "MITtitle",
    "mit license": "MITtitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "licensed under the apache license version 2 0": "Apache2ref",
    "licensed under the apache license version 2 0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "Apache2use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache2copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2warranty",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2see",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "licensed under the gnu general public license version 3": "GPL3ref",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "see the gnu general public license for more details": "GPLsee",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "the name of {} may not be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "the names of {} may not be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "all rights reserved": "AllRights",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliability",
    "this software is provided by {} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDwarranty",
    "in no event shall {} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSDliability",
    "licensed under the bsd 2 clause license": "BSD2ref",
    "licensed under the bsd 3 clause license": "BSD3ref",
    "bsd 2 clause license": "BSD2title",
    "bsd 3 clause license": "BSD3title",
    "isc license": "ISCtitle",
    "licensed under the isc license": "ISCref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCwarranty",
    "licensed under the gnu general public license version 2": "GPL2ref",
    "this work is licensed under the gnu lesser general public license version 3": "LGPL3ref",
    "licensed under the gnu lesser general public license version 3": "LGPL3ref",
    "licensed under the gnu affero general public license version 3": "AGPL3ref",
    "gnu general public license": "GPLtitle",
    "gnu lesser general public license": "LGPLtitle",
    "gnu affero general public license": "AGPLtitle",
    "version 2 june 1991": "GPL2date",
    "version 3 29 june 2007": "GPL3date",
    "version 3 19 november 2007": "AGPL3date",
    "version 2 1 february 1999": "LGPL21date",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3plus",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "see the gnu lesser general public license for more details": "LGPLsee",
    "see the gnu affero general public license for more details": "AGPLsee",
    "apache license": "ApacheTitle",
    "version 2 0 january 2004": "Apache2date",
    "apache license version 2 0 january 2004": "Apache2title",
    "mozilla public license version 2 0": "MPL2title",
    "licensed under the mozilla public license version 2 0": "MPL2ref",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2grant",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2grant",
    "eclipse public license v 2 0": "EPL2title",
    "this is free and unencumbered software released into the public domain": "Unlicensegrant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "Unlicenseuse",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0grant",
    "cc0 1 0 universal": "CC0title",
    "boost software license version 1 0 august 17th 2003": "BSL1title",
    "distributed under the boost software license version 1 0": "BSL1ref",
    "this software is provided as is without any express or implied warranty": "Zlibwarranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Zlibgrant",
    "licensed under the apache 2 0 license": "Apache2ref",
    "licensed under the apache license 2 0": "Apache2ref",
    "licensed under the apache license v2 0": "Apache2ref",
    "licensed under either of apache license version 2 0 or mit license": "Apache2ref MITref",
    "licensed under either of apache license version 2 0 or mit license at your option": "Apache2ref MITref",
    "licensed under either the mit license or the apache license version 2 0": "MITref Apache2ref",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "Apache2warranty",
    "licensed under the gnu gpl version 2": "GPL2ref",
    "licensed under the gnu gpl version 3": "GPL3ref",
    "licensed under the gnu gpl v2": "GPL2ref",
    "licensed under the gnu gpl v3": "GPL3ref",
    "licensed under the gnu general public license v2 0": "GPL2ref",
    "licensed under the gnu general public license v3 0": "GPL3ref",
}

#: Rules in order of precedence; a rule is a sequence of identifiers and the licence it names.
RULES = (
    (("Apache2ref", "Apache2use", "Apache2copy", "Apache2warranty", "Apache2see"), "Apache-2.0"),
    (("MITtitle", "MITgrant", "MITnotice"), "MIT"),
    (("BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"), "BSD-3-Clause"),
    (("GPL3plus", "GPLwarranty", "GPLsee"), "GPL-3.0-or-later"),
    (("GPL2plus", "GPLwarranty", "GPLsee"), "GPL-2.0-or-later"),
    (("BSDgrant", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("MITgrant", "MITnotice"), "MIT"),
    (("Apache2ref", "Apache2use"), "Apache-2.0"),
    (("Apache2ref",), "Apache-2.0"),
    (("MITref",), "MIT"),
    (("GPL3plus",), "GPL-3.0-or-later"),
    (("GPL2plus",), "GPL-2.0-or-later"),
    (("GPL3ref",), "GPL-3.0-only"),
    (("GPL2ref",), "GPL-2.0-only"),
    (("LGPL21plus", "GPLwarranty", "LGPLsee"), "LGPL-2.1-or-later"),
    (("LGPL3plus", "GPLwarranty", "LGPLsee"), "LGPL-3.0-or-later"),
    (("AGPL3plus", "GPLwarranty", "AGPLsee"), "AGPL-3.0-or-later"),
    (("LGPL21plus",), "LGPL-2.1-or-later"),
    (("LGPL3plus",), "LGPL-3.0-or-later"),
    (("AGPL3plus",), "AGPL-3.0-or-later"),
    (("LGPL3ref",), "LGPL-3.0-only"),
    (("AGPL3ref",), "AGPL-3.0-only"),
    (("GPLtitle", "GPL3date"), "GPL-3.0-only"),
    (("GPLtitle", "GPL2date"), "GPL-2.0-only"),
    (("LGPLtitle", "LGPL21date"), "LGPL-2.1-only"),
    (("LGPLtitle", "GPL3date"), "LGPL-3.0-only"),
    (("AGPLtitle", "AGPL3date"), "AGPL-3.0-only"),
    (("ApacheTitle", "Apache2date"), "Apache-2.0"),
    (("Apache2title",), "Apache-2.0"),
    (("MITtitle", "MITgrant", "MITnotice", "MITwarranty", "MITliability"), "MIT"),
    (("MITgrant", "MITnotice", "MITwarranty", "MITliability"), "MIT"),
    (("BSDgrant", "BSDsource", "BSDbinary", "BSDendorse", "BSDwarranty", "BSDliability"), "BSD-3-Clause"),
    (("BSDgrant", "BSDsource", "BSDbinary", "BSDwarranty", "BSDliability"), "BSD-2-Clause"),
    (("BSD3title", "BSDgrant", "BSDsource", "BSDbinary", "BSDendorse", "BSDwarranty", "BSDliability"), "BSD-3-Clause"),
    (("BSD2title", "BSDgrant", "BSDsource", "BSDbinary", "BSDwarranty", "BSDliability"), "BSD-2-Clause"),
    (("BSD3ref",), "BSD-3-Clause"),
    (("BSD2ref",), "BSD-2-Clause"),
    (("ISCtitle", "ISCgrant", "ISCwarranty"), "ISC"),
    (("ISCgrant", "ISCwarranty"), "ISC"),
    (("ISCgrant",), "ISC"),
    (("ISCref",), "ISC"),
    (("MPL2grant", "MPL2copy"), "MPL-2.0"),
    (("MPL2grant",), "MPL-2.0"),
    (("MPL2title",), "MPL-2.0"),
    (("MPL2ref",), "MPL-2.0"),
    (("EPL2grant",), "EPL-2.0"),
    (("EPL2title",), "EPL-2.0"),
    (("Unlicensegrant", "Unlicenseuse"), "Unlicense"),
    (("Unlicensegrant",), "Unlicense"),
    (("CC0grant",), "CC0-1.0"),
    (("CC0title",), "CC0-1.0"),
    (("BSL1title",), "BSL-1.0"),
    (("BSL1ref",), "BSL-1.0"),
    (("Zlibwarranty", "Zlibgrant"), "Zlib"),
    (("Zlibgrant",), "Zlib"),
)

#: Creative Commons, by a rule: every kind in every version, by its short and its long name.
_KINDS = {"by": "attribution", "by nc": "attribution noncommercial", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
for _v, _place in (("4 0", "international"), ("3 0", "unported"), ("2 5", "generic"), ("2 0", "generic"), ("1 0", "generic")):
    for _short, _long in _KINDS.items():
        _id, _name = f"CC{_short.upper().replace(' ', '')}{_v.replace(' 0', '').replace(' ', '')}ref", f"CC-{_short.upper().replace(' ', '-')}-{_v.replace(' ', '.')}"
        SENTENCES |= {f"licensed under cc {_short} {_v}": _id} | {f"licensed under a creative commons {_long} {_v}{end}": _id for end in ("", " license", f" {_place} license", f" {_place} public license")}
        RULES = (*RULES, ((_id,), _name))

#: What a document with no identifier but "all rights reserved" is called.
PROPRIETARY = "LicenseRef-proprietary"

#: Licences by how a tag names them, in normal form with "+" for "or later"; the short names of the GNU licences without an ending mean "only".
TAG = "spdx license identifier "
TAGS = {re.sub("[^a-z0-9]+", " ", name.lower()).replace(" or later", "+"): name for _, name in RULES}
TAGS |= {key[:-5]: name for key, name in TAGS.items() if key.endswith(" only")}
RULES = (*RULES, *(((f"spdx:{name}",), name) for name in dict.fromkeys(TAGS.values())))

#: Further known sentences, as they stand in full licence texts.
LONGER = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
}

#: Where sentences end ("|"), and where they can end or go on ("~"): at a line's end or at ; or :. Comment marks and indents are white space.
#: Runs are read from their start only, so the time is linear in a text's length.
BREAKS = (
    (r"(?<=[a-z0-9])([^a-z0-9\n]*+)\n[^a-z0-9]*+(?=http)", "$1~"),
    (r"\n[^a-z0-9\n]*+\n[^a-z0-9]*+|(?<=[.!?])[ \t\r]++\n?|(?<=[.!?])\n", "|"),
    (r"\n|(?<=[;:])[ \t\r]++", "~"),
    (r"[^a-z0-9|~]++", " "),
    (r"\|[ ~|]*+", "|"),
    (r"(?<![ ~])[ ~]++\|", "|"),
    (r" ?~[ ~]*+", "~"),
)


#: Wordings that count as one, on single sentences in normal form: each pattern and what stands for it.
FREE = (
    (r"\blicence", "license"),
    (r"\bnon (infringement|commercial)", r"non\1"),
    (r"\bshare alike\b", "sharealike"),
    (r"\bno derivatives\b", "noderivatives"),
    (r"\bunder (?:(?:a|the) )?(?:terms of (?:a|the) )?", "under "),
    (r"^(?:(?:this|the) (?:[a-z0-9]+ ){1,6}?(?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|made available) under ", "licensed under "),
    (r"^neither the names? of (?:[a-z0-9]+ ){1,8}?nor the names of (?:its |any |other )?contributors may ", "neither the name of {} nor the names of its contributors may "),
    (r"^the (names?) of (?:[a-z0-9]+ ){1,8}?may not be used to endorse ", r"the \1 of {} may not be used to endorse "),
    (r"^this software is provided by (?:[a-z0-9]+ ){1,8}?as is and any ", "this software is provided by {} as is and any "),
    (r"^in no event shall (?:[a-z0-9]+ ){1,8}?be liable for any direct ", "in no event shall {} be liable for any direct "),
)

#: The same wordings in the search for sentences: words, and the patterns that stand for them.
WORDS = {
    "{}": "[a-z0-9]++(?:[ ~|][a-z0-9]++){0,7}?", "license": "licen[cs]e", "noninfringement": "non[ ~]?infringement", "noncommercial": "non[ ~]?commercial",
    "sharealike": "share[ ~]?alike", "noderivatives": "no[ ~]?derivatives", "under": "under(?:[ ~](?:a|the))?(?:[ ~]terms[ ~]of[ ~](?:a|the))?",
}
_LEAD = "(?:(?:this|the)[ ~](?:[a-z0-9]++[ ~]){1,6}?(?:is|are)[ ~])?(?:dual[ ~])?(?:licensed|released|distributed|(?:made[ ~])?available)"

#: Every known sentence has one of these, so a text without any has no known sentence.
ANCHOR = "(?i)licen[cs]e|software|redistribution|warrant|reserved|mpl|cc0|version[^a-z0-9]+[23]"


def plain(sentence: str) -> str:
    """A sentence of the table with its free wordings as one."""
    for pattern, to in FREE:
        sentence = re.sub(pattern, to, sentence)
    return sentence


#: Identifiers, several of them with spaces between, by sentences.
KNOWN = {plain(s): i for s, i in (SENTENCES | LONGER).items()}


def marked(text: Column) -> Column:
    """A text in lower case, runs of all but ASCII letters and digits as one space or one mark of BREAKS; a "+" behind a version is "or later"."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), "|~", "__")
    for digit in "01":
        out = F.replace(out, F.lit(f"{digit}+"), F.lit(f"{digit} or later"))
    for pattern, to in BREAKS:
        out = F.regexp_replace(out, pattern, to)
    return F.btrim(out)


def _tree(sentences: list[list[str]]) -> str:
    """A pattern for any of some sentences, as a tree of words: the longest that matches, slots after words."""
    heads: dict[str, list[list[str]]] = {}
    for words in sentences:
        if words:
            heads.setdefault(words[0], []).append(words[1:])
    kinds = []
    for head, tails in sorted(heads.items(), key=lambda h: h[0] == "{}"):
        more = _tree(tails)
        gap = "[ ~|]" if head == "{}" else "[ ~]"  # "Some Inc. nor": a stop in a name
        kinds.append(WORDS.get(head, head) + (f"(?:{gap}{more})" if more else "") + ("?" if more and [] in tails else ""))
    return "(?:" + "|".join(kinds) + ")" if len(kinds) > 1 else "".join(kinds)


def _search() -> str:
    lead = [s.split(" ")[1:] for s in KNOWN if s.startswith("licensed under ")]
    rest = [s.split(" ") for s in KNOWN if not s.startswith("licensed under ")]
    return f"(?<![^|~])(?:{TAG.strip().replace(' ', '[ ~]')}[ ~][^|~]++|{_LEAD}[ ~]{_tree(lead)}|{_tree(rest)})(?![^|~])"


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences in a text, in order, with repeats; of those that start at one place the longest counts."""
    table = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])

    def of(s: Column) -> Column:
        s = F.translate(s, "~|", "  ")
        one = s
        for pattern, to in FREE:
            one = F.regexp_replace(one, pattern, to.replace("\\1", "$1"))
        names = F.split(F.replace(F.substring(s, len(TAG) + 1, 1 << 30), F.lit(" or later"), F.lit("+")), " (?:and|or|with) ")
        named = F.transform(F.filter(names, lambda n: F.element_at(tags, n).isNotNull()), lambda n: F.concat(F.lit("spdx:"), F.element_at(tags, n)))
        return F.when(F.startswith(s, F.lit(TAG)), named).otherwise(F.split(F.element_at(table, one), " "))

    found = F.regexp_extract_all(marked(text), F.lit(_search()), F.lit(0))
    ids = F.filter(F.flatten(F.transform(found, lambda s: F.coalesce(of(s), F.array().cast("array<string>")))), lambda i: i != "")
    return F.when(F.coalesce(text, F.lit("")).rlike(ANCHOR), ids).otherwise(F.array().cast("array<string>"))


def _sequence(ids: tuple[str, ...]) -> str:
    """Every identifier stands between bars of its own ("|A||B|"), so sequences match whole identifiers."""
    return "".join(f"|{x}|" for x in ids)


#: Rules by their number of identifiers, so that the longest that matches at a place is the first that does.
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0]))
_PATTERN = "|".join(_sequence(seq).replace("|", "[|]").replace(".", "[.]") for seq, _ in _BY_LENGTH)
_NAMES = list(dict.fromkeys(name for _, name in RULES))


def recognise(ids: Column) -> Column:
    """Licences of an identifier sequence, in order of the rules, each once."""
    table = F.create_map(*[F.lit(x) for seq, name in dict(RULES).items() for x in (_sequence(seq), name)])
    line = F.array_join(F.transform(F.filter(ids, lambda x: x != "AllRights"), lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "")
    found = F.transform(F.regexp_extract_all(line, F.lit(_PATTERN), F.lit(0)), lambda x: F.element_at(table, x))
    named = let(found, lambda f: F.filter(F.array(*[F.lit(n) for n in _NAMES]), lambda n: F.array_contains(f, n)))
    return F.when((F.size(ids) > 0) & (line == ""), F.array(F.lit(PROPRIETARY))).otherwise(named)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) of every document, in one pass without a shuffle; n_sentences counts identifiers.

    Lists are joined by commas, and empty if nothing is known; a null or empty text gives empty lists.
    Repeated rows are kept; other columns are ignored.
    """
    ids = docs.select("doc_id", identifiers(F.col("text")).alias("_ids"))
    return ids.select(
        "doc_id",
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.when(F.size("_ids") > 0, F.array_join(recognise(F.col("_ids")), ",")).otherwise("").alias("licenses"),
    )


def _oracle() -> str:
    """SQL for notices of one line; sentences over line ends are tested on licence texts."""
    table = ", ".join(f"('{s}', '{i}')" for s, i in KNOWN.items())
    tags = ", ".join(f"('{s}', 'spdx:{name}')" for s, name in TAGS.items())
    rules = ", ".join(f"('{_sequence(seq)}', '{name}', {_NAMES.index(name)})" for seq, name in RULES)
    one = "s"
    for pattern, to in FREE:
        one = f"regexp_replace({one}, '{pattern}', '{to}', 'g')"
    return f"""
WITH k(s, ids) AS (VALUES {table}),
t(s, id) AS (VALUES {tags}),
u(seq, name, place) AS (VALUES {rules}),
d AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
p AS (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
      FROM (SELECT rid, string_split_regex(regexp_replace(replace(replace(coalesce(text, ''), '0+', '0 or later'), '1+', '1 or later'), '([.!?;:])[ \t\r]+', '\1' || chr(10), 'g'), '\n+') AS parts FROM d)),
n AS (SELECT rid, pos, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS s FROM p),
e AS (SELECT rid, pos, unnest(x) AS s, generate_subscripts(x, 1) AS sub
      FROM (SELECT rid, pos, string_split_regex(replace(substr(s, {len(TAG) + 1}), ' or later', '+'), ' (?:and|or|with) ') AS x FROM n WHERE starts_with(s, '{TAG}'))),
m AS (SELECT rid, pos, unnest(x) AS id, generate_subscripts(x, 1) AS sub FROM (SELECT rid, pos, string_split(k.ids, ' ') AS x FROM n JOIN k ON k.s = {one.replace("(s,", "(n.s,")})
      UNION ALL SELECT rid, pos, id, sub FROM e JOIN t USING (s)),
l AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY pos, sub) AS ids, coalesce(string_agg('|' || id || '|', '' ORDER BY pos, sub) FILTER (id <> 'AllRights'), '') AS line FROM m GROUP BY rid),
h AS (SELECT DISTINCT rid, name, place FROM (SELECT rid, unnest(regexp_extract_all(line, '{_PATTERN}')) AS seq FROM l) JOIN u USING (seq)),
f AS (SELECT rid, string_agg(name, ',' ORDER BY place) AS licenses FROM h GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, CASE WHEN line = '' THEN '{PROPRIETARY}' ELSE coalesce(licenses, '') END AS licenses
FROM d LEFT JOIN l USING (rid) LEFT JOIN f USING (rid)
"""


ORACLE = _oracle()
