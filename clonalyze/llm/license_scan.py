"""Licence recognition by sentences and ordered rules.

A text is cut into sentences, sentences are normalised (lower case, letters and digits
only, single spaces) and looked up among known licence sentences; the sequence of their
identifiers is then matched against ordered rules. The first rules are the longest, and a
rule uses up the identifiers it matches, so a whole MIT text is not also reported as the
fragments that other rules consist of. Known sentences that no rule uses are reported as
fragments.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from clonalyze.llm.common import passed_through

# ---- fixed values: public licence texts and names -------------------------------

#: Names that follow "licensed under the ..." and the licence they stand for.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}

#: Beginnings of a sentence that names a licence.
REFERENCES = [
    "Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under",
    "This file is licensed under", "This software is licensed under", "This software is released under",
    "This project is licensed under", "This program is licensed under", "Published under",
]

#: Sentences of licence texts and notices.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
                 'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
                 'rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit '
                 'persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is-mit": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
                 'WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "no-liability-mit": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
                        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
                        "OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                 "provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission",
    "apache-notice": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
                    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                 "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "public-domain": "This work is in the public domain",
    "all-rights": "All rights reserved",
}

#: Ordered rules: (licence, sentence identifiers that follow one another).
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is-mit", "no-liability-mit"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-mit"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-notice", "apache-obtain", "apache-as-is"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-notice", "apache-obtain"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-grant"]),
    ("Unlicense", ["unlicense-free"]),
    ("public-domain", ["public-domain"]),
    ("all-rights-reserved", ["all-rights"]),
]
# ---- end of fixed values ----------------------------------------------------------

_SENTENCE_END = re.compile(r"(?<=[.!?:;])(?<!\bv\.)\s+|\n[ \t\r]*\n\s*")
_LINE_END = re.compile(r"(?<=[.!?])(?<!\bv\.)[ \t]+|[\r\n]+")
#: A licence expression: identifiers joined by AND, OR and WITH, in any brackets.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t(]*[A-Za-z0-9.+:-]+(?:[ \t()]+(?i:AND|OR|WITH)[ \t(]+[A-Za-z0-9.+:-]+)*")
_SPDX_TOKEN = re.compile(r"[A-Za-z0-9.+:-]+")
_FIRST_WORD = re.compile(r"[\W_]*([^\W_]+)")
_NOT_WORD = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def normalise(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier; references are made from beginnings and names by rule."""
    out = {normalise(s): i for i, s in SENTENCES.items()}
    for spdx, names in NAMES.items():
        for n in names:
            for r in REFERENCES:
                for the in ("", "the ", "a "):
                    out[normalise(f"{r} {the}{n}")] = f"name:{spdx}"
    # the Apache notice goes on after a comma in its usual form
    out[normalise('Licensed under the Apache License, Version 2.0 (the "License")')] = "name:Apache-2.0"
    return out


def ordered_rules() -> list[tuple[str, list[str]]]:
    return RULES + [(spdx, [f"name:{spdx}"]) for spdx in NAMES]


def expression_licences(text: str, start: int, end: int) -> list[tuple[int, str]]:
    """(position, identifier) of every licence in an SPDX expression; exceptions after WITH aren't licences."""
    out, exception = [], False
    for m in _SPDX_TOKEN.finditer(text, start, end):
        if m.group().upper() in ("AND", "OR", "WITH"):
            exception = m.group().upper() == "WITH"
        elif not exception:
            out.append((m.start(), m.group()))
    return out


class Recogniser:
    def __init__(self, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None):
        self.known = known_sentences() if known is None else known
        self.rules = ordered_rules() if rules is None else rules
        words = [k.split() for k in self.known]
        self.starts = {w[0] for w in words if w}
        self.longest = max((len(k) for k in self.known), default=0)

    def sentence_ids(self, text: str) -> list[str]:
        """Identifiers of the known sentences in order of their start.

        Sentences are read both line by line and across line breaks, since notices are
        wrapped at will; one that both readings give counts once.
        """
        found: dict[int, str] = {}
        for cut in (_LINE_END, _SENTENCE_END):
            at = 0
            for m in [*cut.finditer(text), None]:
                end = m.start() if m else len(text)
                start = at
                while start < end:
                    word = _FIRST_WORD.match(text, start, end)
                    if word and word.group(1).lower() in self.starts:
                        got = self.known.get(self.normalised(text, start, end))
                        if got is not None:
                            found.setdefault(word.start(1), got)
                            break
                    # the sentence may begin on one of the next lines
                    start = text.find("\n", start, end) + 1 or end
                at = m.end() if m else end
        for m in _SPDX.finditer(text):
            for at, licence in expression_licences(text, m.start() + len("SPDX-License-Identifier:"), m.end()):
                found.setdefault(at, f"spdx:{licence}")
        return [found[i] for i in sorted(found)]

    def normalised(self, text: str, start: int, end: int) -> str | None:
        """``normalise`` of a piece of ``text``; None once its words are longer than any known sentence."""
        words, n = [], -1
        for m in _WORD.finditer(text, start, end):
            words.append(m.group())
            n += 1 + m.end() - m.start()
            if n > 2 * self.longest:        # lower case may be shorter
                return None
        return normalise(" ".join(words))

    def licences(self, ids: list[str]) -> tuple[list[str], list[str]]:
        """(licences in order of their first sentence, identifiers that no rule used)."""
        left: list[str | None] = list(ids)
        found: list[tuple[int, str]] = []
        for licence, need in self.rules:
            n, i = len(need), 0
            while i + n <= len(left):
                if left[i:i + n] == need:
                    found.append((i, licence))
                    left[i:i + n] = [None] * n
                i += 1
        for i, s in enumerate(left):
            if s is not None and s.startswith("spdx:"):
                found.append((i, s.removeprefix("spdx:")))
                left[i] = None
        names = dict.fromkeys(x for _, x in sorted(found))
        return list(names), [s for s in left if s is not None]


def scan(df: DataFrame, text_col: str = "text", recogniser: Recogniser | None = None) -> DataFrame:
    """``df`` plus ``licenses``, ``sentence_ids`` and ``fragments`` (arrays of string).

    Null and empty texts have none. Rows are judged one by one, so ties and repeated rows
    have no effect; an empty table gives an empty result. Columns of these names are
    replaced, all others pass through.
    """
    r = recogniser or Recogniser()

    def compute(texts: pa.Array) -> list[pa.Array]:
        ids = [r.sentence_ids(t or "") for t in texts.to_pylist()]
        got = [r.licences(i) for i in ids]
        kind = pa.list_(pa.string())
        return [pa.array([g[0] for g in got], kind), pa.array(ids, kind), pa.array([g[1] for g in got], kind)]

    return passed_through(df, [text_col], compute, [("licenses", "array<string>"), ("sentence_ids", "array<string>"), ("fragments", "array<string>")])
