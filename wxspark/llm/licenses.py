"""Licence scan by sentence rules.

A text is read as a stream of normalised words (letters and digits, lower case), so line breaks, comment marks and list numbers don't
matter. Where a sentence may start, the words that follow are looked up among known licence sentences; the sequence of
sentence identifiers is then matched against ordered licence rules. A rule is a sequence of identifiers that must follow each other in the text,
with at most ``gap`` unknown sentences between the end of one and the start of the next. Longer rules win over the shorter ones they hold.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: licence sentences by identifier; ``*`` stands for up to MOST_FREE words, such as the name of a holder.
SENTENCES = {
    "mit-name": "Released under the MIT License",
    "mit-name-2": "Licensed under the MIT License",
    "mit-name-3": "This project is licensed under the MIT License",
    "mit-head": "The MIT License (MIT)",
    "mit-head-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "isc-head": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd2-name": "Licensed under the BSD 2-Clause License",
    "bsd3-name": "Licensed under the BSD 3-Clause License",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "apache-name": "Licensed under the Apache License, Version 2.0",
    "apache-name-2": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-name-3": "This project is licensed under the Apache License 2.0",
    "apache-head": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "mpl-head": "Mozilla Public License Version 2.0",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-head": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-head": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl3-head": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-head": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "agpl3-head": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl2-head": "Eclipse Public License - v 2.0",
    "epl1-head": "Eclipse Public License - v 1.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "boost-head": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-name": "Distributed under the Boost Software License, Version 1.0",
    "wtfpl-head": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc0-head": "CC0 1.0 Universal",
    "cc0-waive": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "ccbync4-name": "Licensed under CC BY-NC 4.0",
    "ccby4-name": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbysa4-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ccbync4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "ccbyncsa4-name": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "ccbynd4-name": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "ccbyncnd4-name": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
}
#: Fixed value: ordered rules, licence and sentence identifiers.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-head",)),
    ("MIT", ("mit-head-2",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-name-2",)),
    ("MIT", ("mit-name-3",)),
    ("MIT-0", ("mit0-grant", "mit-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-head",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD", ("bsd-grant", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd2-name",)),
    ("BSD-3-Clause", ("bsd3-name",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Apache-2.0", ("apache-name-2", "apache-comply", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-name", "apache-comply", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-head", "apache-terms")),
    ("Apache-2.0", ("apache-name-2",)),
    ("Apache-2.0", ("apache-name",)),
    ("Apache-2.0", ("apache-name-3",)),
    ("Apache-2.0", ("apache-head",)),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("MPL-2.0", ("mpl-subject",)),
    ("MPL-2.0", ("mpl-head",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-3.0", ("gpl3-name",)),
    ("GPL-3.0", ("gpl3-head",)),
    ("GPL-2.0", ("gpl2-head",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-2.1", ("lgpl21-head",)),
    ("LGPL-3.0", ("lgpl3-head",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("AGPL-3.0", ("agpl3-head",)),
    ("EPL-2.0", ("epl2-made",)),
    ("EPL-2.0", ("epl2-head",)),
    ("EPL-1.0", ("epl1-head",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-head",)),
    ("BSL-1.0", ("boost-name",)),
    ("WTFPL", ("wtfpl-head",)),
    ("CC0-1.0", ("cc0-head",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("CC-BY-NC-4.0", ("ccbync4-name",)),
    ("CC-BY-NC-4.0", ("ccbync4-long",)),
    ("CC-BY-4.0", ("ccby4-name",)),
    ("CC-BY-SA-4.0", ("ccbysa4-name",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-name",)),
    ("CC-BY-ND-4.0", ("ccbynd4-name",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd4-name",)),
)
#: Unknown sentences that may stand between two sentences of a rule, and words that ``*`` stands for.
GAP, MOST_FREE = 2, 12
#: A known sentence starts and ends at a line's edge, at a mark other than a hyphen, or before an address; unknown sentences are told apart by these ends.
EDGE = re.compile(r"[^ \-]|  ")
SENTENCE_END = re.compile(r"[.!?](?=\s|$)|\n[^\S\n]*\n")
ADDRESS = ("http", "https", "www")
WORDS = re.compile(r"[A-Za-z0-9]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


def with_tags(sentences: dict[str, str], rules: tuple) -> tuple[dict[str, str], tuple]:
    """The tables with an SPDX tag for every licence of the rules."""
    names = sorted({licence for licence, _ in rules})
    tags = {f"spdx-{n}": f"SPDX-License-Identifier: {n}" for n in names}
    return {**sentences, **tags}, (*rules, *((n, (f"spdx-{n}",)) for n in names))


class Recogniser:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, gap: int = GAP):
        self.gap = gap
        self.by_first = defaultdict(list)
        for licence, ids in sorted(rules, key=lambda r: -len(r[1])):
            self.by_first[ids[0]].append((licence, ids))
        # Sentences by their first word, longest first; each is a list of parts between free places.
        self.by_word: dict[str, list[tuple[list[list[str]], str]]] = defaultdict(list)
        known = {name: [words_of(p) for p in text.split("*")] for name, text in sentences.items()}
        for name, parts in sorted(known.items(), key=lambda x: -sum(map(len, x[1]))):
            if parts[0]:
                self.by_word[parts[0][0]].append((parts, name))
        # A text without any of these words holds no known sentence.
        left, self.anchors = [set(sum(parts, [])) for parts in known.values() if parts[0]], []
        while left:
            # Long words are rarer in other texts; of those, one that many sentences share.
            rare = max(left, key=lambda s: max(map(len, s)))
            best = max(sorted(w for w in rare if len(w) >= min(7, max(map(len, rare)))), key=lambda w: sum(w in s for s in left))
            self.anchors.append(best)
            left = [s for s in left if best not in s]

    def _ends(self, words: list[str], at: int, parts: list[list[str]]) -> int | None:
        """Word after a sentence that starts at word ``at``, or None."""
        for nth, part in enumerate(parts):
            starts = range(at, at + 1) if nth == 0 else range(at + 1, at + MOST_FREE + 1)
            at = next((s + len(part) for s in starts if words[s : s + len(part)] == part), None)
            if at is None:
                return None
        return at

    def sentences(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(first word, word after the last, start, end, identifier) of the known sentences of a text, in order."""
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return []
        spans = [m.span() for m in WORDS.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]

        def edge(i: int) -> bool:
            """Whether a sentence may end before word i and another start there."""
            if i == 0 or i == len(spans) or words[i] in ADDRESS:
                return True
            return EDGE.search(text, spans[i - 1][1], spans[i][0]) is not None

        out, i = [], 0
        while i < len(words):
            found = None
            if words[i] in self.by_word and edge(i):
                for parts, name in self.by_word[words[i]]:
                    end = self._ends(words, i, parts)
                    if end is not None and edge(end):
                        found = (i, end, spans[i][0], spans[end - 1][1], name)
                        break
            if found:
                out.append(found)
                i = found[1]
            else:
                i += 1
        return out

    def near(self, text: str, a: tuple, b: tuple) -> bool:
        """Whether at most ``gap`` unknown sentences stand between two known ones."""
        between = SENTENCE_END.split(text[a[3] : b[2]])
        return sum(WORDS.search(s) is not None for s in between) <= self.gap

    def licences(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(licence, start, end, sentences) of every rule found, leftmost and longest first, without overlaps."""
        text = text or ""
        known = self.sentences(text)
        out, i = [], 0
        while i < len(known):
            for licence, ids in self.by_first[known[i][4]]:
                run = known[i : i + len(ids)]
                if tuple(k[4] for k in run) == ids and all(self.near(text, x, y) for x, y in zip(run, run[1:])):
                    out.append((licence, run[0][2], run[-1][3], len(ids)))
                    i += len(ids)
                    break
            else:
                i += 1
        return out


ALL_SENTENCES, ALL_RULES = with_tags(SENTENCES, RULES)


def scan(docs: DataFrame, sentences: dict[str, str] = ALL_SENTENCES, rules: tuple = ALL_RULES, gap: int = GAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found array<struct<licence, start, end, sentences>>) of every row; places count code points.

    Null and empty texts hold nothing. Rows are independent, so repeated and null ids are kept. No shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Recogniser(sentences, rules, gap)
        names = ("licence", "start", "end", "sentences")
        for frame in frames:
            found = [[dict(zip(names, x)) for x in r.licences(t)] for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "found": found})

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInPandas(run, "doc_id string, found array<struct<licence:string,start:int,end:int,sentences:int>>")
    return out.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "found")


def report(documents: DataFrame) -> DataFrame:
    """Per document: number of licence statements, the distinct licences, and all spans as licence:start:end."""
    spans = F.transform("found", lambda x: F.concat_ws(":", x["licence"], x["start"], x["end"]))
    return scan(documents).select(
        "doc_id", F.size("found").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.licence"))), ",").alias("licences"), F.array_join(spans, ",").alias("spans"),
    )
