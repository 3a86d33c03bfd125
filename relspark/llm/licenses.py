"""Licence scans: matching statistics against a suffix automaton of licence templates.

All templates, as sequences of words, share one generalised suffix automaton. The words
of a text stream through it; at each word the state tells the longest match that ends
there. Matches that cannot be extended are chained, per template, in the order of both
text and template; a chain that covers enough of its template gives the label.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from relspark.llm.common import passes, text_buffer
from relspark.llm.words import STEP, Words, grams, hash_words, words

#: Phrases whose every place is reported, with their labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Texts of public licences. Where a label has several, the longest is its whole text (or its
#: notice, for licences of many pages); the others are openings and names that are used alone.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc", "licensed under CC BY"),
    ("cc", "licensed under a Creative Commons"),
]
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 16, 0.5


class Automaton(NamedTuple):
    next: list[dict[int, int]]
    link: list[int]
    size: list[int]  # words of the longest string of a state
    ends: list[dict[int, set[int]]]  # state -> {template: indices of last words there}
    phrases: list[tuple[int, ...]]  # phrases that end the longest string of a state
    lengths: list[int]  # words of each template
    labels: list[str]
    n_phrases: int  # the first templates are phrases
    vocabulary: np.ndarray  # sorted word hashes; a word's id is its place
    calls: np.ndarray  # for each word id: last word of a phrase, or of a template shorter than a match
    grams: np.ndarray  # sorted hashes of the shortest matches of templates


def build(phrases: list[tuple[str, str]], templates: list[tuple[str, str]], min_match: int = MIN_MATCH) -> Automaton:
    texts = [hash_words(text) for _, text in [*phrases, *templates]]
    vocabulary = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
    ids = [np.searchsorted(vocabulary, t).tolist() for t in texts]
    step: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    ends: list[dict[int, set[int]]] = [{}]
    for t, template in enumerate(ids):
        at = 0
        for place, word in enumerate(template):
            if word in step[at] and size[step[at][word]] == size[at] + 1:
                at = step[at][word]  # a later template walks what is there already
                ends[at].setdefault(t, set()).add(place)
                continue
            split = word in step[at]
            new = -1 if split else len(step)
            if not split:
                step.append({}), link.append(0), size.append(size[at] + 1), ends.append({t: {place}})
            p = at
            while p >= 0 and word not in step[p]:
                step[p][word] = new
                p = link[p]
            if p >= 0:
                q = step[p][word]
                if size[q] > size[p] + 1:
                    clone = len(step)
                    step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1), ends.append({})
                    link[q] = clone
                    while p >= 0 and step[p].get(word) == q:
                        step[p][word] = clone
                        p = link[p]
                    q = clone
                if split:
                    new = q
                    ends[new].setdefault(t, set()).add(place)
                else:
                    link[new] = q
            at = new
    for v in sorted(range(1, len(step)), key=lambda v: -size[v]):  # an end of a string ends its suffixes
        for t, places in ends[v].items() if link[v] else ():
            ends[link[v]].setdefault(t, set()).update(places)
    closing: list[tuple[int, ...]] = []
    for v in range(len(step)):
        t, place = next((t, min(places)) for t, places in ends[v].items()) if v else (0, -1)
        closing.append(tuple(p for p in range(len(phrases)) if v and 0 < len(ids[p]) <= size[v] and ids[t][place - len(ids[p]) + 1 : place + 1] == ids[p]))
    calls = np.zeros(len(vocabulary), bool)
    calls[[i[-1] for p, i in enumerate(ids) if i and (p < len(phrases) or len(i) < min_match)]] = True
    return Automaton(step, link, size, ends, closing, [len(i) for i in ids], [x for x, _ in [*phrases, *templates]], len(phrases), vocabulary, calls, np.unique(np.concatenate([np.zeros(0, np.uint64), *(grams(Words(x, np.array([0, len(x)])), min_match)[0] for x in texts)])))


class Match(NamedTuple):
    start: int  # in the text
    at: int  # in the template
    n: int


def stream(a: Automaton, codes: list[int], first: int, places: list[tuple[int, int]], matches: dict[int, list[Match]], min_match: int) -> None:
    """One run of template words, the first of them word `first` of its text. Adds the phrases'
    places and, for each template, the matches that neither side extends."""
    state, n = 0, 0
    for i, word in enumerate([*codes, -1]):
        before, held = n, state
        while state and word not in a.next[state]:
            state = a.link[state]
            n = a.size[state]
        if word in a.next[state]:
            state, n = a.next[state][word], n + 1
        else:
            state, n = 0, 0
        if n <= before and before >= 1:
            for t, ends in a.ends[held].items():
                if before >= min(min_match, a.lengths[t]):
                    matches.setdefault(t, []).extend(Match(first + i - before, end - before + 1, before) for end in ends)
        for p in a.phrases[state]:
            if n >= a.lengths[p]:
                places.append((p, first + i - a.lengths[p] + 1))


def chain(matches: list[Match], max_gap: int) -> tuple[int, int, int]:
    """The chain of matches, in order of text and template and with gaps of at most max_gap
    words, that covers most template words: (covered, first word, end) in the text."""
    best = (0, 0, 0)
    ordered = sorted(set(matches))
    cover, begin = [m.n for m in ordered], [m.start for m in ordered]
    starts = [m.start for m in ordered]
    longest = max(m.n for m in ordered)
    for i, m in enumerate(ordered):
        for j in range(bisect_left(starts, m.start - max_gap - longest), i):
            b = ordered[j]
            gap, step = m.start - b.start - b.n, m.at - b.at - b.n
            over = max(0, -gap, -step)  # words in both
            if m.at > b.at and m.start > b.start and max(gap, step) <= max_gap and over < m.n and cover[j] + m.n - over > cover[i]:
                cover[i], begin[i] = cover[j] + m.n - over, begin[j]
        best = max(best, (cover[i], -begin[i], m.start + m.n))
    return best[0], -best[1], best[2]


def scan(
    docs: DataFrame, phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None,
    min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base (places of all phrases), first_word and
    last_word (their smallest and largest start, from 0; null without one), base_labels, labels
    (sorted, distinct, comma-joined), score (largest covered share of a label's longest template, 0 to 1),
    spans (array of label, first word, end word, share: for each label of the method the chain that covers most).

    Null texts count as empty. Null and repeated ids are kept. Other columns are not read.
    An empty table gives an empty result.
    """
    a = build(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, min_match)
    held = docs.sparkSession.sparkContext.broadcast(a)

    whole = {label: max(n for n, x in zip(a.lengths, a.labels) if x == label) for label in a.labels}

    def judge(places: list[tuple[int, int]], matches: dict[int, list[Match]]) -> tuple:
        a = held.value
        spans: dict[str, tuple] = {}  # of each label the one that covers most
        score = 0.0
        for t, found in matches.items():
            covered, start, end = chain(found, max_gap)
            label, share = a.labels[t], min(1.0, covered / a.lengths[t])
            score = max(score, min(1.0, covered / whole[label]))
            if share >= (1.0 if a.lengths[t] <= min_match else min_cover):
                spans[label] = max(spans.get(label, (0,)), (covered, -start, end, min(1.0, covered / whole[label])))
        base = sorted({a.labels[p] for p, _ in places})
        starts = [s for _, s in places]
        return (
            len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *spans})), score,
            [{"label": label, "first_word": -s[1], "end_word": s[2], "share": s[3]} for label, s in sorted(spans.items())],
        )

    def lookup(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids, and whether they are words of templates."""
        ids, known = np.zeros(len(code), np.int32), np.zeros(len(code), bool)
        vocabulary = held.value.vocabulary
        for lo in range(0, len(code) if len(vocabulary) else 0, STEP):
            part = slice(lo, lo + STEP)
            ids[part] = np.minimum(np.searchsorted(vocabulary, code[part]), len(vocabulary) - 1)
            known[part] = vocabulary[ids[part]] == code[part]
        return ids, known

    def matching(found: Words, known: np.ndarray) -> np.ndarray:
        """Places where a shortest match begins: all words are of templates, and in this order."""
        n = len(known) - min_match + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        every = known[:n].copy()
        for k in range(1, min_match):
            every &= known[k : n + k]
        place = np.flatnonzero(every)
        place = place[found.doc[place] == found.doc[place + min_match - 1]]
        rows = found.hash[place[:, None] + np.arange(min_match)]
        own = grams(Words(rows.ravel(), np.arange(len(place) + 1) * min_match), min_match)[0]
        return place[np.isin(own, held.value.grams)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        for batch in batches:
            for some in passes(batch, "_text"):
                found = words(*text_buffer(some.column("_text")))
                out: list[tuple] = [(0, None, None, "", "", 0.0, [])] * some.num_rows
                code, known = lookup(found.hash)
                # Runs of template words in one text that hold a match or a phrase's last word.
                new = np.zeros(len(code), bool)
                new[1:] = known[1:] != known[:-1]
                new[found.first[:-1][found.first[:-1] < len(code)]] = True
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(code)))
                wanted = known & a.calls[code] if len(a.calls) else known
                wanted[matching(found, known)] = True
                runs = np.unique(np.searchsorted(first, np.flatnonzero(wanted), side="right") - 1)
                seen: dict[int, tuple[list, dict]] = {}
                for r in runs.tolist():
                    lo, d = int(first[r]), int(found.doc[first[r]])
                    places, matches = seen.setdefault(d, ([], {}))
                    stream(a, code[lo : lo + int(size[r])].tolist(), lo - int(found.first[d]), places, matches, min_match)
                for d, (places, matches) in seen.items():
                    if places or matches:
                        out[d] = judge(places, matches)
                columns = list(zip(*out)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [some.column("_id"), pa.array(np.diff(found.first)), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans_type)))],
                    [f.name for f in schema.fields],
                )

    spans_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,share:double>>"
    schema = T.StructType([chosen.schema["_id"], *T._parse_datatype_string(fields).fields])
    return chosen.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
