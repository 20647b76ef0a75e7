"""Licence scans by sentence rules.

1. Known licence sentences have identifiers.  A text is cut into words; at every place where a
   sentence can begin (start of the text or a line, after a sentence mark, after comment marks) a
   trie of the known sentences' words is followed, and the longest known sentence that also ends
   where a sentence can end gives its identifier.  Line breaks inside a sentence do not matter.
2. A licence rule is an ordered sequence of sentence identifiers.  Rules are matched against the
   text's identifier sequence: their sentences must come in order, with at most ``max_gap`` words
   between two of them.  Of overlapping matches the one with more sentences wins, then the earlier.

Words are runs of letters and digits, lower-cased; dots inside version numbers are kept apart as
words of their own digits, so ``2.0`` is two words.  Where a known sentence names a holder or a
product it has a placeholder ``*`` for one to PLACEHOLDER words.  Null and empty texts have no match.  Rows without an id are scanned too.  Repeated rows give repeated matches.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Sentences of public licence texts and of the usual notices.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-use": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache2-means": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
    "apache2-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2-short": "Licensed under the Apache License 2.0",
    "apache2-is": "This * is licensed under the Apache License, Version 2.0",
    "apache2-is-short": "This * is licensed under the Apache License 2.0",
    "mit-terms": "Distributed under the terms of the MIT License",
    "mit-is-terms": "This * is distributed under the terms of the MIT License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-project": "This project is licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-title-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl2-licensed": "Licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl2-only-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "gnu-freedom": "The licenses for most software are designed to take away your freedom to share and change it",
    "gpl3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "agpl3-copyleft": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl3-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "lgpl3-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-author": "The name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-names": "Neither the names of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY * "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd3-licensed": "Licensed under the BSD 3-Clause License",
    "bsd2-licensed": "Licensed under the BSD 2-Clause License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND * DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "bsl1-distributed": "Distributed under the Boost Software License, Version 1.0",
    "bsl1-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl1-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "cc0-title": "CC0 1.0 Universal",
    "cc0-waived": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl2-terms": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT")',
    "epl2-acceptance": "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "artistic2-title": "The Artistic License 2.0",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl2-contributor": '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software',
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "reserved": "All rights reserved",
}
#: Rules: (licence, rule, sentences in order).  Long forms come with their short notices as rules of their own.
RULES = [
    ("Apache-2.0", "notice", ["apache2-notice"]),
    ("Apache-2.0", "header", ["apache2-the", "apache2-use", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("Apache-2.0", "text", ["apache2-title", "apache2-terms", "apache2-means"]),
    ("Apache-2.0", "named", ["apache2-the"]),
    ("Apache-2.0", "short", ["apache2-short"]),
    ("Apache-2.0", "product", ["apache2-is"]),
    ("Apache-2.0", "product-short", ["apache2-is-short"]),
    ("MIT", "terms", ["mit-terms"]),
    ("MIT", "product-terms", ["mit-is-terms"]),
    ("MIT", "released", ["mit-released"]),
    ("MIT", "licensed", ["mit-licensed"]),
    ("MIT", "project", ["mit-project"]),
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", "titled-text", ["mit-title", "mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", "short-titled-text", ["mit-title-short", "mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", "title", ["mit-title"]),
    ("MIT", "short-title", ["mit-title-short"]),
    ("GPL-3.0-only", "work", ["gpl3-work"]),
    ("GPL-3.0-only", "licensed", ["gpl3-licensed"]),
    ("GPL-2.0-only", "licensed", ["gpl2-licensed"]),
    ("GPL-3.0-or-later", "free", ["gpl-free"]),
    ("GPL-3.0-or-later", "notice", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", "free", ["gpl2-free"]),
    ("GPL-2.0-or-later", "notice", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-only", "free", ["gpl2-only-free"]),
    ("GPL-2.0-only", "notice", ["gpl2-only-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0", "text", ["gpl3-title", "gnu-verbatim", "gpl3-copyleft"]),
    ("GPL-2.0", "text", ["gpl2-title", "gnu-verbatim", "gnu-freedom"]),
    ("LGPL-3.0", "text", ["lgpl3-title", "gnu-verbatim", "lgpl3-incorporates"]),
    ("LGPL-2.1", "text", ["lgpl21-title", "gnu-verbatim", "gnu-freedom"]),
    ("AGPL-3.0", "text", ["agpl3-title", "gnu-verbatim", "agpl3-copyleft"]),
    ("LGPL-3.0-or-later", "free", ["lgpl3-free"]),
    ("LGPL-3.0-or-later", "notice", ["lgpl3-free", "lgpl-hope", "lgpl-details"]),
    ("LGPL-2.1-or-later", "free", ["lgpl21-free"]),
    ("LGPL-2.1-or-later", "notice", ["lgpl21-free", "lgpl-hope", "lgpl-details"]),
    ("AGPL-3.0-or-later", "free", ["agpl3-free"]),
    ("AGPL-3.0-or-later", "notice", ["agpl3-free", "gpl-hope", "agpl-details"]),
    ("BSD-2-Clause", "text", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-asis"]),
    ("BSD-3-Clause", "text", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis"]),
    ("BSD-3-Clause", "author-text", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-author", "bsd-asis"]),
    ("BSD-3-Clause", "names-text", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-names", "bsd-asis"]),
    ("BSD-4-Clause", "text", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", "licensed", ["bsd3-licensed"]),
    ("BSD-2-Clause", "licensed", ["bsd2-licensed"]),
    ("ISC", "grant", ["isc-grant"]),
    ("ISC", "text", ["isc-grant", "isc-asis"]),
    ("0BSD", "grant", ["0bsd-grant"]),
    ("Zlib", "text", ["zlib-asis", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("BSL-1.0", "distributed", ["bsl1-distributed"]),
    ("BSL-1.0", "text", ["bsl1-title", "bsl1-grant"]),
    ("CC0-1.0", "title", ["cc0-title"]),
    ("CC0-1.0", "waived", ["cc0-waived"]),
    ("EPL-2.0", "text", ["epl2-title", "epl2-terms", "epl2-acceptance"]),
    ("EPL-2.0", "available", ["epl2-available"]),
    ("Artistic-2.0", "text", ["artistic2-title", "gnu-verbatim"]),
    ("MPL-2.0", "text", ["mpl2-title", "mpl2-contributor"]),
    ("MPL-2.0", "notice", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", "subject", ["mpl2-subject"]),
    ("CC-BY-4.0", "licensed", ["cc-by-4"]),
    ("CC-BY-4.0", "work", ["cc-by-4-long"]),
    ("CC-BY-SA-4.0", "licensed", ["cc-by-sa-4"]),
    ("CC-BY-SA-4.0", "work", ["cc-by-sa-4-long"]),
    ("CC-BY-NC-4.0", "licensed", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", "work", ["cc-by-nc-4-long"]),
    ("CC-BY-ND-4.0", "licensed", ["cc-by-nd-4"]),
    ("CC-BY-NC-SA-4.0", "licensed", ["cc-by-nc-sa-4"]),
    ("CC-BY-NC-ND-4.0", "licensed", ["cc-by-nc-nd-4"]),
    ("Unlicense", "free", ["unlicense-free"]),
    ("Unlicense", "text", ["unlicense-free", "unlicense-anyone"]),
    ("all-rights-reserved", "notice", ["reserved"]),
]
# Names of licences in file headers; each gives a sentence and a rule of its own.
NAMED = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib"]
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in NAMED}
RULES += [(name, "identifier", [f"spdx-{name}"]) for name in NAMED]
_WORD = re.compile(r"[^\W_]+")
#: Words that a placeholder stands for at most.
PLACEHOLDER = 16


def words_of(sentence: str) -> list[str]:
    """The words of a known sentence; ``*`` is a placeholder."""
    return re.findall(r"[^\W_]+|\*", sentence.lower())


@dataclass
class SentenceTrie:
    """Known sentences by their words; `first` are the words with which any of them begins."""

    root: dict = field(default_factory=dict)

    @classmethod
    def of(cls, sentences: dict[str, str]) -> SentenceTrie:
        trie = cls()
        for name, text in sentences.items():
            node = trie.root
            for word in words_of(text):
                node = node.setdefault(word, {})
            node[""] = name
        trie.start = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(map(re.escape, trie.root), key=len, reverse=True))})(?![^\W_])", re.I)
        return trie

    def sentences_in(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of the known sentences in a text, in order and without overlap; places in code points."""
        out, free = [], 0
        for begin in self.start.finditer(text):
            if begin.start() < free or not _can_begin(text, begin.start()):
                continue
            # places in the trie, each with the words that its placeholder may still take
            states, found = [(self.root, 0)], None
            for word in _WORD.finditer(text, begin.start()):
                own, ahead = word[0].lower(), []
                for node, left in states:
                    if own in node:
                        ahead.append((node[own], 0))
                    if "*" in node:
                        ahead.append((node["*"], PLACEHOLDER - 1))
                    if left:
                        ahead.append((node, left - 1))
                if not ahead:
                    break
                states = ahead
                names = [node[""] for node, _ in states if "" in node]
                if names and _can_end(text, word.end()):
                    found = (min(names), begin.start(), word.end())
            if found:
                out.append(found)
                free = found[2]
        return out


def _can_begin(text: str, at: int) -> bool:
    """A sentence begins at the start, after a line break or a sentence mark; marks and spaces between are skipped."""
    while at and not text[at - 1].isalnum():
        if text[at - 1] in "\n.!?;:":
            return True
        at -= 1
    return at == 0


def _can_end(text: str, at: int) -> bool:
    while at < len(text) and not text[at].isalnum():
        if text[at] in "\n.!?;:,(":
            return True
        at += 1
    return at == len(text)


class RuleSet:
    def __init__(self, sentences: dict[str, str] | None = None, rules: list | None = None, max_gap: int = 80):
        self.trie = SentenceTrie.of(SENTENCES if sentences is None else sentences)
        self.rules: dict[str, list[tuple[str, str, list[str]]]] = {}
        for licence, rule, ids in RULES if rules is None else rules:
            self.rules.setdefault(ids[0], []).append((licence, rule, ids))
        self.max_gap = max_gap

    def scan(self, text: str | None) -> list[tuple[str, str, int, int, int]]:
        """(licence, rule, start, end, sentences) of the matches, in order of their places."""
        found = self.trie.sentences_in(text) if text else []
        matches = []
        for i, (name, start, _) in enumerate(found):
            for licence, rule, ids in self.rules.get(name, ()):
                at = self._follow(found, i, ids, text)
                if at is not None:
                    matches.append((-len(ids), start, licence, rule, found[at[-1]][2], at))
        used: set[int] = set()
        out = []
        for n, start, licence, rule, end, at in sorted(matches):
            if not used & set(at):
                used |= set(at)
                out.append((licence, rule, start, end, -n))
        return sorted(out, key=lambda m: (m[2], m[3], m[0], m[1]))

    def _follow(self, found: list, i: int, ids: list[str], text: str) -> list[int] | None:
        at = [i]
        for want in ids[1:]:
            for j in range(at[-1] + 1, len(found)):
                between = _WORD.finditer(text, found[at[-1]][2], found[j][1])
                if next(islice(between, self.max_gap, None), None):
                    return None
                if found[j][0] == want:
                    at.append(j)
                    break
            else:
                return None
        return at


SCHEMA = "doc_id long, licence string, rule string, start long, end long, n_sentences int"


def scan(docs: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """One row per licence match of each document (doc_id, text): doc_id, licence, rule, start, end, n_sentences."""
    rules = rules or RuleSet()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *match) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for match in rules.scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
