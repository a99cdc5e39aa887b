"""Whole licence texts, wrapped and commented, and a plain matcher made of regular expressions."""

import random
import re
import textwrap

import pytest

from wxspark.llm import licenses
from wxspark.llm.licenses import ALL_RULES, ALL_SENTENCES, GAP, MOST_FREE, RULES, SENTENCES

S = SENTENCES
HOLDER = "Copyright (c) 2020 Jane Doe and Others. All rights reserved."
TEXTS = {
    "MIT": f"MIT License\n\n{HOLDER}\n\n{S['mit-grant']}:\n\n{S['mit-notice']}.\n\n{S['mit-warranty']}. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.",
    "MIT-0": f"{HOLDER}\n\n{S['mit0-grant']}.\n\n{S['mit-warranty']}.",
    "ISC": f"{HOLDER}\n\n{S['isc-grant']}.\n\n{S['isc-warranty']}. IN NO EVENT SHALL THE AUTHOR BE LIABLE.",
    "0BSD": f"{HOLDER}\n\n{S['0bsd-grant']}.\n\n{S['isc-warranty']}.",
    "BSD-2-Clause": f"{HOLDER}\n\n{S['bsd-grant']}:\n\n1. {S['bsd-source']}.\n\n2. {S['bsd-binary']}.\n\n{S['bsd-warranty']}. IN NO EVENT.",
    "BSD-3-Clause": f"{HOLDER}\n\n{S['bsd-grant']}:\n\n* {S['bsd-source']}.\n\n* {S['bsd-binary']}.\n\n* {S['bsd-names'].replace('*', 'Jane Doe, Inc.')}.\n\n{S['bsd-warranty']}.",
    "Apache-2.0": f"{HOLDER}\n\n{S['apache-name-2']};\n{S['apache-comply']}.\n{S['apache-copy']}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{S['apache-basis']}. See the License.",
    "MPL-2.0": f"{S['mpl-subject']}. {S['mpl-copy']} https://mozilla.org/MPL/2.0/.",
    "GPL-3.0-or-later": f"{HOLDER}\n\n{S['gpl3-free']}.\n\n{S['gpl-hope']}.  See the GNU General Public License for more details.\n\n{S['gpl-copy']}.  If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-or-later": f"{S['gpl2-free']}.\n\n{S['gpl-hope']}. See it.\n\n{S['gpl-copy']}; if not, write to them.",
    "LGPL-2.1-or-later": f"{S['lgpl21-free']}.\n\n{S['lgpl-hope']}.",
    "LGPL-3.0-or-later": f"{S['lgpl3-free']}.\n\n{S['lgpl-hope']}.",
    "AGPL-3.0-or-later": f"{S['agpl3-free']}.\n\n{S['gpl-hope']}.",
    "EPL-2.0": f"{S['epl2-made']} https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": f"{S['unlicense-free']}.\n\n{S['unlicense-anyone']}.",
    "Zlib": f"{HOLDER}\n\n{S['zlib-warranty']}. In no event will the authors be held liable.\n\n{S['zlib-grant']}:",
}
R = licenses.Recogniser(ALL_SENTENCES, ALL_RULES)


def plain(text, sentences=ALL_SENTENCES, rules=ALL_RULES, gap=GAP):
    """Every sentence as a regular expression; leftmost and longest first, then rules the same way."""
    apart, word = r"[^A-Za-z0-9]+", r"[A-Za-z0-9]+"
    hits = []
    for name, said in sentences.items():
        parts = [apart.join(re.findall(word, p)) for p in said.split("*")]
        free = f"{apart}(?:{word}{apart}){{1,{MOST_FREE}}}?"
        for m in re.finditer(rf"(?i)(?<![A-Za-z0-9])(?={free.join(parts)}(?![A-Za-z0-9]))", text):
            end = re.compile(f"(?i){free.join(parts)}(?![A-Za-z0-9])").match(text, m.start()).end()
            before = re.search(r"[^A-Za-z0-9]*$", text[: m.start()]).group()
            after = re.match(r"[^A-Za-z0-9]*", text[end:]).group()
            address = lambda t: re.match(r"(?i)[^a-z0-9]*(https?|www)(?![a-z0-9])", t)
            at_edge = lambda t, free_side: free_side or "  " in t or re.search(r"[^ \-]", t)
            if at_edge(before, not re.search(word, text[: m.start()]) or address(text[m.start() :])) and at_edge(after, not re.search(word, text[end:]) or address(text[end:])):
                hits.append((m.start(), -len(re.findall(word, said)), end, name))
    known, at = [], 0
    for start, _, end, name in sorted(hits):
        if start >= at:
            known.append((start, end, name))
            at = end
    out, i = [], 0
    while i < len(known):
        for licence, ids in sorted(rules, key=lambda r: -len(r[1])):
            run = known[i : i + len(ids)]
            unknown = [sum(bool(re.search(word, s)) for s in re.split(r"[.!?](?=\s|$)|\n[^\S\n]*\n", text[x[1] : y[0]])) for x, y in zip(run, run[1:])]
            if tuple(k[2] for k in run) == ids and all(u <= gap for u in unknown):
                out.append((licence, run[0][0], run[-1][1], len(ids)))
                i += len(ids)
                break
        else:
            i += 1
    return out


def shapes(text):
    yield text
    flat = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    for width in (40, 72):
        wrapped = "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in flat.split("\n\n"))
        yield wrapped
        for mark in ("# ", " * ", "// ", ";; "):
            yield "\n".join((mark + line).rstrip() for line in wrapped.split("\n"))
    yield "before this. " + text + "\nand after."


@pytest.mark.parametrize("name", list(TEXTS))
def test_whole_texts_are_recognised(name):
    for text in shapes(TEXTS[name]):
        got = R.licences(text)
        assert name in {g[0] for g in got} and {g[0] for g in got} <= {name, "MIT"}, (text, got)
        assert got == plain(text)


def test_every_licence_has_a_tag_and_a_rule():
    names = {licence for licence, _ in RULES}
    assert len(names) >= 25
    for n in names:
        assert [g[0] for g in R.licences(f"// SPDX-License-Identifier: {n}\ncode()")] == [n]
    assert all(i in ALL_SENTENCES for _, ids in ALL_RULES for i in ids)


def test_edges_of_sentences():
    assert R.licences("Released under the" + " " * 3000 + "MIT License.")[0][0] == "MIT"
    assert R.licences("It is not released under the MIT License but another") == [] == R.licences("SPDX-License-Identifier: MIT-Modified")
    assert R.licences("THE MIT LICENSE (MIT)")[0] == ("MIT", 0, 20, 1)
    assert R.licences("Neither the name of nor the names of its contributors may be used") == []


def test_random_mixtures_match_the_plain_matcher():
    rnd = random.Random(3)
    pieces = [*SENTENCES.values(), "Some other sentence", "license", "MIT", HOLDER, "no words of note", "1", ""]
    for _ in range(150):
        text = ""
        for _ in range(rnd.randrange(1, 9)):
            p = rnd.choice(pieces).replace("*", " ".join(["x"] * rnd.randrange(0, 15)))
            text += (p.upper() if rnd.random() < 0.2 else p.replace(" ", "\n", 3) if rnd.random() < 0.3 else p) + rnd.choice([". ", "\n", " ", "; ", "\n\n", " - ", ".\n"])
        assert R.licences(text) == plain(text), text


def test_scan_covers_whole_texts(spark):
    far = "word " * 50_000 + "\n" + TEXTS["BSD-3-Clause"] + "\n" + "word " * 50_000
    df = spark.createDataFrame([(1, far), (2, None), (3, ""), (None, TEXTS["MIT"])], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.report(df).collect()}
    assert got == {1: "BSD-3-Clause", 2: "", 3: "", None: "MIT"}
