"""License scan by patience alignment of texts with license templates.

Words that occur once in a template and once in a stretch of text are anchors; the longest increasing
subsequence of anchors is aligned, and the gaps between them are aligned in the same way, recursively.
The coverage of a template is the share of its words that are aligned.

Where a document may hold a template is found by votes: each place of a telling template word (one that
isn't a function word) votes for the place where the template would begin, and stretches with enough
votes for the wanted coverage are aligned. So several notices in one document are found each. Templates whose words foreign
ones part are found too: a text with enough different telling words is aligned from the first to the last of them, and copies
after each other are told apart where a telling word comes once more than in the template. Templates under ``LONG`` words, which
the words of any long text may make up by chance, may be parted by ``SPREAD`` foreign words for each of theirs. One pass over whole
texts, without a shuffle; the templates are constants of the job.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._spark import load, text_of
from ._text import WORDS, Words, batches, utf8

COVERAGE = 0.8
#: Any number of foreign words may part templates of ``LONG`` words; ``SPREAD`` for each word those of shorter ones.
LONG, SPREAD = 20, 8

# License notices and texts as their publishers give them (placeholders left out).
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}
# Function words, which alone tell nothing of a license.
FUNCTION_WORDS = "a all an and any as at be but by can do for from if in is it its may must no not of on one or out so that the they this to use was will with you your".split()


@dataclass(frozen=True)
class Template:
    name: str
    words: np.ndarray  # hashes, in order
    telling: np.ndarray  # by word: whether it may vote


def templates_of(texts: dict[str, str]) -> list[Template]:
    """Templates as hashed words; where every word is a function word, all of them vote."""
    common = Words(*utf8(pa.array([" ".join(FUNCTION_WORDS)])), WORDS).hash
    out = []
    for name, text in sorted(texts.items()):
        h = Words(*utf8(pa.array([text])), WORDS).hash
        telling = ~np.isin(h, common)
        out.append(Template(name, h, telling if telling.any() else np.ones(len(h), bool)))
    return [t for t in out if len(t.words)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, that rises in the second (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [b], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text word, template word) pairs, rising in both, by patience alignment.

    Equal words at both ends of a stretch are aligned first; a stretch without anchors ends there.
    """
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict[int, list[int]] = {}
        for j in range(c, d):
            once.setdefault(template[j], [0, j, 0, -1])[0] += 1
        for i in range(a, b):
            if (x := once.get(text[i])) is not None:
                x[2] += 1
                x[3] = i
        anchors = increasing(sorted((x[3], x[1]) for x in once.values() if x[0] == x[2] == 1))
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def spread(template: Template) -> float:
    """How many foreign words may part those of a template: any number, and ``SPREAD`` for each word of a short one."""
    n = len(template.words)
    return np.inf if n >= LONG else SPREAD * n


def stretches(at: np.ndarray, word: np.ndarray, template: Template, need: int) -> list[tuple[int, int]]:
    """Stretches of a text (first and end word) that may hold a template whose words foreign ones part.

    ``at`` has the places of telling words, ``word`` the number of the word there. A stretch has ``need`` different ones.
    """
    n = len(template.words)
    if len(np.unique(word)) < need:
        return []
    if np.isinf(spread(template)):
        return [(max(0, int(at[0]) - n), int(at[-1]) + n)]
    count, different, j, out = np.zeros(int(word.max()) + 1, np.int64), 0, 0, []
    for i in range(len(at)):
        while j < len(at) and at[j] < at[i] + n + spread(template):
            different += count[word[j]] == 0
            count[word[j]] += 1
            j += 1
        if different >= need:
            # All that a template whose first telling word stands here may take.
            a, b = int(max(0, at[i] - n)), int(at[i] + 2 * n + spread(template))
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        count[word[i]] -= 1
        different -= count[word[i]] == 0
    return out


def single_copies(at: np.ndarray, word: np.ndarray, template: Template, need: int, aligned: Callable[[int, int], object]) -> None:
    """Align stretches that hold no telling word more often than the template does, so that copies after each other are
    looked at one by one: a word too many begins a new stretch where the one before it was found, and else moves its begin. Function
    words count up to the template's length before and after the telling ones."""
    _, most = np.unique(template.words[template.telling], return_counts=True)
    n, count, different, i = len(template.words), np.zeros(len(most), np.int64), 0, 0
    for j in range(len(at) + 1):
        w = word[j] if j < len(at) else -1
        if w < 0 or count[w] == most[w]:
            end = int(at[j]) if w >= 0 else int(at[-1]) + n
            if different >= need and at[j - 1] - at[i] < n + spread(template) and aligned(max(0, int(at[i]) - n, int(at[i - 1]) + 1 if i else 0), min(end, int(at[j - 1]) + n)):
                i, different = j, 0
                count[:] = 0
            while w >= 0 and count[w] == most[w]:
                count[word[i]] -= 1
                different -= count[word[i]] == 0
                i += 1
        if w >= 0:
            different += count[w] == 0
            count[w] += 1


def find(text: np.ndarray, template: Template, coverage: float = COVERAGE) -> list[tuple[float, int, int]]:
    """(coverage, first word, end word) of every place of a template in a document's words; places don't overlap."""
    n, words = len(template.words), template.words
    order = np.argsort(words, kind="stable")
    lo, hi = np.searchsorted(words[order], text, "left"), np.searchsorted(words[order], text, "right")
    many = hi - lo
    at = np.repeat(np.arange(len(text)), many)
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    place = order[np.repeat(lo, many) + inner]
    votes = template.telling[place]
    begin = (at - place)[votes]
    if not len(begin):
        return []
    # Missing words (1 - coverage) may be telling ones; a begin is blurred by what is left out or put in.
    slack = max(2, int(n * (1 - coverage)) + 2)
    need = max(1, int(np.ceil(template.telling.sum() - n * (1 - coverage))))
    cell = np.floor_divide(begin, slack)
    cells, number = np.unique(cell, return_counts=True)
    neighbour = dict(zip(cells.tolist(), number.tolist(), strict=True))
    likely = [c for c in cells.tolist() if sum(neighbour.get(c + k, 0) for k in (-1, 0, 1)) >= need]
    out: list[tuple[float, int, int]] = []

    def aligned(a: int, b: int) -> tuple[int, int] | None:
        pairs = align(text[a:b].tolist(), words.tolist())
        if not pairs or len(pairs) < coverage * n - 1e-9:
            return None
        out.append((len(pairs) / n, a + pairs[0][0], a + pairs[-1][0] + 1))
        return out[-1][1:]

    for c in likely:
        aligned(max(0, (c - 1) * slack), min(len(text), (c + 2) * slack + n + slack))
    # Stretches that hold enough different telling words, however they are spread; what lies beside a find is searched again.
    names = np.unique(words[template.telling])
    spots, which = np.unique(at[votes], return_index=True)
    numbers = np.searchsorted(names, words[place[votes]][which])
    different = max(1, int(np.ceil(len(names) - n * (1 - coverage))))
    todo = stretches(spots, numbers, template, different)
    if todo:
        single_copies(spots, numbers, template, different, aligned)
    alone = set(out)
    while todo:
        a, b = todo.pop()
        if found := aligned(a, min(b, len(text))):
            todo += [(x, y) for x, y in ((a, found[0]), (found[1], b)) if y - x >= coverage * n]
    # What was found alone goes first: a whole stretch may mix the words of several copies.
    best: list[tuple[float, int, int]] = []
    for x in sorted(set(out), key=lambda x: (x not in alone, -x[0], x[2] - x[1], x[1])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in best):
            best.append(x)
    return sorted(best, key=lambda x: x[1])


def license_scan(docs: DataFrame, texts: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_found, best_license, best_coverage, found (array of license,
    coverage, first and end word), sorted by place and name.

    Defined cases: null, empty and unmatched texts have nothing found, best_license null and coverage 0; very long texts
    are scanned whole; ties go to the first license by name; repeated rows are scanned each; other columns aren't looked at;
    an empty table gives no rows.
    """
    known = templates_of(TEMPLATES if texts is None else texts)
    telling = np.unique(np.concatenate([t.words[t.telling] for t in known])) if known else np.zeros(0, np.uint64)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            w = Words(*utf8(b.column("text")), WORDS)
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            if len(telling):
                place = np.minimum(np.searchsorted(telling, w.hash), len(telling) - 1)
                for d in np.unique(w.doc[telling[place] == w.hash]).tolist():
                    mine = w.hash[w.first[d] : w.first[d + 1]]
                    found[d] = [{"license": t.name, "coverage": round(c, 6), "first_word": a, "end_word": z} for t in known for c, a, z in find(mine, t, coverage)]
                    found[d].sort(key=lambda x: (x["first_word"], x["license"]))
            best = [max(x, key=lambda y: (y["coverage"], y["end_word"] - y["first_word"])) if x else None for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array([x and x["license"] for x in best], pa.string()), pa.array([x["coverage"] if x else 0.0 for x in best], pa.float64()), pa.array(found, kind)],
                ["doc_id", "n_found", "best_license", "best_coverage", "found"],
            )

    df = text_of(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_found long, best_license string, best_coverage double, found array<struct<license:string,coverage:double,first_word:long,end_word:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))
