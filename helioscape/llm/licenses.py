"""Licence scan: sentences of a text are mapped to known licence sentences, and their sequence to licence rules.

Sentences are compared as words without case and punctuation, also where a line break or a comment mark cuts through
them. A rule is an ordered list of sentences; rules are tried in their order at every known sentence, and the sentences
of a match are used up.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Known licence sentences by identifier, as words.
SENTENCES = {
    "apache2-line": "licensed under the apache license version 2 0",
    "apache2-line-the": "licensed under the apache license version 2 0 the license",
    "apache2-limits": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                     "basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-line": "released under the mit license",
    "mit-line-licensed": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
                 "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
                 "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
                 "to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                 "merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
                     "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                 "conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
                  "the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                 "this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
                 "the above copyright notice and this permission notice appear in all copies",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl2-line": "this work is licensed under the gnu general public license version 2",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                        "published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                         "published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                "merchantability or fitness for a particular purpose",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccbync-line": "licensed under cc by nc 4 0",
    "ccby-line": "licensed under cc by 4 0",
    "ccbysa-line": "licensed under cc by sa 4 0",
    "ccby-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache2": "spdx license identifier apache 2 0",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
}
#: Licence rules in the order in which they are tried; sentences in the order in which they must stand.
RULES = [
    ("Apache-2.0", ["apache2-line-the", "apache2-limits", "apache2-copy", "apache2-basis", "apache2-see"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache2-line-the"]),
    ("Apache-2.0", ["apache2-line"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-line-licensed"]),
    ("GPL-3.0-only", ["gpl3-line"]),
    ("GPL-2.0-only", ["gpl2-line"]),
    ("MPL-2.0", ["mpl2"]),
    ("CC-BY-NC-4.0", ["ccbync-line"]),
    ("CC-BY-SA-4.0", ["ccbysa-line"]),
    ("CC-BY-4.0", ["ccby-line"]),
    ("CC-BY-NC-4.0", ["ccbync-work"]),
    ("CC-BY-SA-4.0", ["ccbysa-work"]),
    ("CC-BY-4.0", ["ccby-work"]),
    ("Unlicense", ["unlicense"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("GPL-3.0-or-later", ["spdx-gpl3"]),
]
#: Characters that may stand between two sentences of a rule: comment marks, numbering, a short remark.
GAP = 200
#: Every known sentence holds one of these; a text without any has no licence. Words, held against words.
ANCHORS = ("license", "permission", "redistribut", "warranty", "licensed", "copyright", "public domain", "liable")

#: A sentence ends at a mark before white space, or at a line end; what follows may still continue it.
_END = re.compile(r"[.!?;:]+(?=\s|\Z)|\n|,(?=\s)|\Z")
_WORD = re.compile(r"[a-z0-9]+")


def _trie(sentences: dict[str, str]) -> dict:
    root: dict = {}
    for name, words in sentences.items():
        node = root
        for word in words.split():
            node = node.setdefault(word, {})
        node[""] = name
    return root


class Matcher:
    """Known sentences as a trie of words, and rules by their first sentence.

    With `anywhere`, sentences are also known inside longer ones; otherwise only where the text pauses before and after.
    """

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, anywhere: bool = False):
        loose = [n for n, words in sentences.items() if not any(a in words for a in ANCHORS)]
        if loose:
            raise ValueError(f"sentences without an anchor word: {loose}")
        self.trie, self.rules = _trie(sentences), {}
        self.anywhere = anywhere
        self.anchors = [(a.split()[0], re.compile("[^a-z0-9]+".join(a.split()))) for a in ANCHORS]
        for rank, (licence, steps) in enumerate(rules):
            self.rules.setdefault(steps[0], []).append((rank, licence, steps))

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of known sentences, the leftmost first and the longest at each place, without overlaps."""
        lowered = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
        words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lowered)]
        if self.anywhere:
            places = (i for i, w in enumerate(words) if w[0] in self.trie)
        else:
            starts = [w[1] for w in words]
            places = (bisect_right(starts, at - 1) for at in sorted({m.end() for m in _END.finditer(lowered)} | {0}))
        out, free = [], 0
        for first in places:
            if first < free or first >= len(words):
                continue
            node, here, found = self.trie, first, None
            while here < len(words) and words[here][0] in node:
                node = node[words[here][0]]
                here += 1
                if "" in node and (self.anywhere or here == len(words) or _END.search(lowered, words[here - 1][2], words[here][1])):
                    found = node[""], here
            if found:
                free = found[1]
                out.append((found[0], words[first][1], words[found[1] - 1][2]))
        return out

    def licences(self, text: str | None) -> list[tuple[str, int, int]]:
        """(licence, start, end) of the rules that the known sentences follow, in text order."""
        if not text:
            return []
        lowered = text.lower()
        if not any(word in lowered and anchor.search(lowered) for word, anchor in self.anchors):
            return []
        known, out, at = self.sentences(text), [], 0
        while at < len(known):
            for _, licence, steps in sorted(self.rules.get(known[at][0], [])):
                end = self._follows(known, at, steps)
                if end:
                    out.append((licence, known[at][1], known[end - 1][2]))
                    at = end
                    break
            else:
                at += 1
        return out

    @staticmethod
    def _follows(known, at: int, steps: list[str]) -> int:
        """End of the run of known sentences from `at` that the steps describe; 0 if they do not."""
        for i, step in enumerate(steps):
            if at + i >= len(known) or known[at + i][0] != step:
                return 0
            if i and known[at + i][1] - known[at + i - 1][2] > GAP:
                return 0
        return at + len(steps)


def find_licences(docs: DataFrame, id_col: str, text_col: str, sentences: dict[str, str] = SENTENCES,
                  rules: list[tuple[str, list[str]]] = RULES, anywhere: bool = False) -> DataFrame:
    """(id, found array<struct<license, start, end>>): licences of whole texts in text order, code points, ends exclusive.

    Null and empty texts have none; a licence stated twice is found twice. With `anywhere`, sentences inside longer ones
    count; otherwise the text must pause before and after. Repeated rows are repeated; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(sentences, rules, anywhere)
        for batch in batches:
            found = [[{"license": n, "start": a, "end": b} for n, a, b in matcher.licences(t)] for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "found": found})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInPandas(run, f"id {kind}, found array<struct<license:string,start:int,end:int>>")
