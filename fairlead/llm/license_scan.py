"""Licence recognition by sentence rules.

Texts are cut into sentences at line ends and after ``.``, ``!``, ``?``, ``;`` or
``:`` before white space. A normalised sentence (lower case, only letters and
digits, single spaces) is looked up among known licence sentences, and the
identifiers found, in order, are matched against rules: a rule holds if its
sentence identifiers occur in this order with at most ``gap`` other sentences
between neighbours. Of rules that share sentences, the longer wins.

Three sorts of sentences are known: those of licence texts and notices
(``SENTENCES``), some of them with a part that may be any words, such as the name of
a holder (``*``); naming sentences made by rule from ``NAMES`` and ``NAMING``
("Licensed under the ..."); and lines ``SPDX-License-Identifier: ...`` with the
identifiers of ``NAMES``, alone or joined by AND, OR and WITH. A sentence may be
wrapped over lines, and numbers or letters of a list before it do not count.

Covered are the licences that are keys of ``NAMES`` and those of ``RULES``.

Defined results: a null or empty text has no licences; repeated rows give
repeated results; of rules with the same number of sentences the first by name
takes them; a null id is carried through; an empty table gives an empty one; other
columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import arrow_map, keyed, spread

# Sentences of well-known licence texts and notices, by identifier. ``*`` stands for any words.
SENTENCES = {
    "all-rights": ["All rights reserved."],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "apache-under": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-may": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by *."],
    "bsd-endorse": [
        "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of * may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-zero": ["This work is dedicated to the public domain.", "Licensed under CC0 1.0."],
    "epl-title": ["Eclipse Public License - v 2.0"],
    "epl-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "gpl-free-2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-only-2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-title-2": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-title-3": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-free-21": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-free-3": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "lgpl-title-21": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl-title-3": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl-under": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-origin": ["The origin of this software must not be misrepresented;"],
}

# Licences by identifier, with the names that they go by.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL v3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 license", "Apache-2.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause license", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause license", "BSD-3-Clause"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC-BY-SA-3.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0-1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3", "GFDL-1.3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL, Version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL, Version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "ISC": ["ISC License", "ISC license", "ISC"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT license (MIT)", "MIT"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "Zlib"],
}
# Sentences that name a licence.
NAMING = [f"{head}{the}" for head in ("", "This work is ", "This project is ", "This program is ", "This software is ", "This file is ", "This code is ", "This content is ", "It is ", "The code is ", "The software is ") for the in ("licensed under the {}", "licensed under {}", "licensed under a {}", "released under the {}", "distributed under the {}", "available under the {}", "licensed under the terms of the {}", "released under the terms of the {}")] + ["License: {}", "Licence: {}"]
#: Endings of identifiers in SPDX lines that say "this version" or "any later one".
SPDX_ENDS = ("", "-only", "-or-later", "+")

# Rules as (licence, sentence identifiers in order).
RULES = [
    ("AGPL-3.0", ("agpl-title",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("All-Rights-Reserved", ("all-rights",)),
    ("Apache-2.0", ("apache-under",)),
    ("Apache-2.0", ("apache-title",)),
    ("Apache-2.0", ("apache-under", "apache-may", "apache-copy", "apache-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSL-1.0", ("boost-title",)),
    ("CC0-1.0", ("cc-zero",)),
    ("EPL-2.0", ("epl-title",)),
    ("EPL-2.0", ("epl-terms",)),
    ("GPL-2.0", ("gpl-title-2",)),
    ("GPL-2.0-only", ("gpl-only-2",)),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope")),
    ("GPL-3.0", ("gpl-title-3",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("ISC", ("isc-grant",)),
    ("LGPL-2.1", ("lgpl-title-21",)),
    ("LGPL-2.1-or-later", ("lgpl-free-21",)),
    ("LGPL-2.1-or-later", ("lgpl-free-21", "lgpl-hope")),
    ("LGPL-3.0", ("lgpl-title-3",)),
    ("LGPL-3.0-or-later", ("lgpl-free-3",)),
    ("LGPL-3.0-or-later", ("lgpl-free-3", "lgpl-hope")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MPL-2.0", ("mpl-under",)),
    ("MPL-2.0", ("mpl-title",)),
    ("Unlicense", ("unlicense-free",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("WTFPL", ("wtfpl-title",)),
    ("Zlib", ("zlib-grant", "zlib-origin")),
] + [(name, (f"named-{name}",)) for name in NAMES]

_end = re.compile(r"(?<=[.!?;:])\s+|\s*\n\s*")
_other = re.compile(r"[^a-z0-9]+")
_list_mark = re.compile(r"(?:[0-9]{1,2}|[a-z]) ")


def normalised(sentence: str) -> str:
    return _other.sub(" ", sentence.lower()).strip()


def known_sentences() -> tuple[dict[str, str], dict[str, list[tuple[str, str, str]]]]:
    """Whole normalised sentences by identifier, and, by their first word, sentences with a free part as (before, after, identifier)."""
    whole = {normalised(t.format(n)): f"named-{name}" for name, names in NAMES.items() for n in names for t in NAMING}
    whole |= {normalised(f"SPDX-License-Identifier: {name}{end}"): f"named-{name}" for name in NAMES for end in SPDX_ENDS}
    free: dict[str, list[tuple[str, str, str]]] = {}
    for name, texts in SENTENCES.items():
        for text in texts:
            if "*" in text:
                before, after = (normalised(x) for x in (text.partition("*")[0], text.rpartition("*")[2]))
                free.setdefault(before.split(" ")[0], []).append((before + " ", " " + after if after else "", name))
            else:
                whole[normalised(text)] = name
    return whole, free


KNOWN, FREE = known_sentences()
#: Words that a free part may have.
FREE_WORDS = 40
LONGEST = max(len(k) for k in KNOWN)
FIRST_WORDS = {k.split(" ")[0] for k in KNOWN} | FREE.keys()
_spdx = re.compile(r"spdx license identifier ")
_joined = re.compile(r" (?:and|or|with) ")


def identified(joined: str) -> list[str]:
    """The identifiers of one normalised sentence; none if it is unknown. Only an SPDX line may have several."""
    if joined in KNOWN:
        return [KNOWN[joined]]
    for before, after, name in FREE.get(joined.split(" ", 1)[0], ()):
        if joined.startswith(before) and joined.endswith(after) and 0 < len(joined[len(before) : len(joined) - len(after)].split()) <= FREE_WORDS:
            return [name]
    if _spdx.match(joined):
        parts = [KNOWN.get("spdx license identifier " + x) for x in _joined.split(joined[24:])]
        return [p for p in parts if p]
    return []


def sentence_ids(text: str) -> list[tuple[int, int, str]]:
    """(first place, place after, identifier) of the known sentences, places counting all sentences with letters or digits."""
    pieces = [p for p in (normalised(x) for x in _end.split(text)) if p]
    out, k = [], 0
    while k < len(pieces):
        step, piece = 1, pieces[k]
        if piece.split(" ", 1)[0] not in FIRST_WORDS and (mark := _list_mark.match(piece)):
            piece = piece[mark.end() :]
        if (first := piece.split(" ", 1)[0]) in FIRST_WORDS:
            joined, limit = piece, 2 * LONGEST if first in FREE else LONGEST
            for size in range(1, len(pieces) - k + 1):  # a sentence may be wrapped over lines
                if size > 1:
                    joined += " " + pieces[k + size - 1]
                if len(joined) > limit:
                    break
                if names := identified(joined):
                    out += [(k, k + size, name) for name in names]
                    step = size
                    break
        k += step
    return out


def licences(found: list[tuple[int, int, str]], gap: int = 6) -> list[str]:
    """Licences whose rules match, longer rules first taking their sentences."""
    used: set[int] = set()
    out: set[str] = set()
    present = {name for *_, name in found}
    for name, wanted in sorted(RULES, key=lambda r: (-len(r[1]), r)):
        if not present.issuperset(wanted):
            continue
        for start in range(len(found)):
            if start in used or found[start][2] != wanted[0]:
                continue
            taken, at = [start], start
            for want in wanted[1:]:
                after = next((k for k in range(at + 1, len(found)) if found[k][2] == want and k not in used), None)
                if after is None or found[after][0] - found[at][1] > gap:
                    break
                taken.append(after)
                at = after
            if len(taken) == len(wanted):
                out.add(name)
                used.update(taken)
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_known_sentences, sentence_ids, licences): what is recognised in each text."""
    chosen = spread(keyed(docs, id_col, text_col))
    text = T.StringType()
    schema = T.StructType([chosen.schema[id_col], T.StructField("n_known_sentences", T.LongType()), T.StructField("sentence_ids", text), T.StructField("licences", text)])

    def rows(batch: pa.RecordBatch):
        found = [sentence_ids(t) if t else [] for t in batch.column(1).to_pylist()]
        yield [batch.column(0), [len(x) for x in found], [",".join(i for *_, i in x) for x in found], [",".join(licences(x)) for x in found]]

    return arrow_map(chosen, schema, rows)
