"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are cut in shingles of ``SHINGLE`` words; of every ``WINDOW`` neighbouring shingle hashes the smallest is kept, and
an inverted index maps it to the templates and places that have it. A document looks up all its shingles. Hits of one
template on nearby diagonals are one candidate, whose words are aligned with the template's inside a band around those
diagonals.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from featforge.llm import text as X

SHINGLE = 3
WINDOW = 4
#: Templates of fewer words keep every shingle, so that a changed word does not hide them. All but one of their words must
#: match, and what tells the license from others must stand unbroken.
SHORT = 16
#: Smallest share of a template's words that a report must match.
COVERAGE = 0.6

#: Public license texts and the notices that stand for them.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED.""",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
        OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT.""",
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
}

#: Licenses whose texts are near to those above.
RELATIVES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
        You should have received a copy of the GNU Affero General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software
        Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free
        Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
        You should have received a copy of the GNU Lesser General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
}
LIBRARY = TEMPLATES | RELATIVES

#: Runs of words that tell a short template's license from others; of a short template that is not listed, all words do.
IDENTIFYING = {
    "Apache-2.0-notice": ("Apache",),
    "CC-BY-4.0-notice": ("Creative Commons Attribution 4.0",),
    "CC-BY-NC-4.0-notice": ("CC BY-NC 4.0",),
    "GPL-3.0-notice": ("GNU General Public License", "3"),
    "MIT-notice": ("MIT",),
}

#: Runs of words that no text of a license holds, but those of its relatives do.
FOREIGN = {
    "BSD-2-Clause": ("Neither the name",),
    "GPL-2.0": ("Lesser General Public", "Library General Public", "Affero General Public"),
    "GPL-3.0": ("Lesser General Public", "Library General Public", "Affero General Public"),
    "LGPL-2.1": ("Affero General Public",),
    "LGPL-3.0": ("Affero General Public",),
    "AGPL-3.0": ("Lesser General Public",),
}
#: The version of a license, which is the number after one of ``VERSION_WORDS``.
VERSIONS = {"AGPL-3.0": (3,), "Apache-2.0": (2,), "GPL-2.0": (2,), "GPL-3.0": (3,), "LGPL-2.1": (2, 1), "LGPL-3.0": (3,), "MPL-2.0": (2,)}
VERSION_WORDS = ("version", "v")


def _hashes(run: str) -> np.ndarray:
    return next(X.chunks(pa.array([run]), X.PLAIN_LOWER)).word_hashes()


def _contains(words: np.ndarray, run: np.ndarray) -> bool:
    return len(run) <= len(words) and bool((np.lib.stride_tricks.sliding_window_view(words, len(run)) == run).all(axis=1).any())


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest of every ``window`` neighbouring hashes, the last of equal ones; of fewer hashes, all."""
    if len(hashes) < window:
        return np.arange(len(hashes))
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(runs)) + window - 1 - runs.argmin(axis=1))


def _numbers(t: X.Texts, begin: int, end: int) -> list[bytes]:
    """The words [begin, end) that are digits only."""
    found = [t.data[a:b].tobytes() for a, b in zip(t.start[begin:end].tolist(), t.end[begin:end].tolist())]
    return [w for w in found if w.isdigit()]


class Index:
    """Fingerprints of templates; bounded by the templates, which are given by the program and not by the data."""

    def __init__(self, templates: Mapping[str, str], shingle: int = SHINGLE, window: int = WINDOW,
                 identifying: Mapping[str, tuple[str, ...]] = IDENTIFYING):
        self.names, self.shingle = list(templates), shingle
        self.foreign = {k: [_hashes(run) for run in FOREIGN.get(name, ())] for k, name in enumerate(self.names)}
        self.versions = {k: VERSIONS[name] for k, name in enumerate(self.names) if name in VERSIONS}
        self.version_words = np.concatenate([_hashes(w) for w in VERSION_WORDS])
        self.words: list[np.ndarray] = []
        #: Of each short template the hashes of its identifying runs, and the numbers in it.
        self.runs: dict[int, list[np.ndarray]] = {}
        self.numbers: dict[int, set[bytes]] = {}
        keys, of, place = [], [], []
        for k, body in enumerate(templates.values()):
            (t,) = X.chunks(pa.array([body]), X.PLAIN_LOWER, 1 << 30)
            words = t.word_hashes()
            if len(words) < shingle:
                raise ValueError(f"template {self.names[k]!r} has fewer than {shingle} words")
            grams, _ = X.ngrams(words, t.doc, shingle)
            at = winnow(grams, window if len(words) >= SHORT else 1)
            self.words.append(words)
            if len(words) < SHORT:
                runs = [next(X.chunks(pa.array([x]), X.PLAIN_LOWER)).word_hashes() for x in identifying.get(self.names[k], ())]
                self.runs[k] = runs if runs and all(_contains(words, r) for r in runs) else [words]
                self.numbers[k] = set(_numbers(t, 0, len(words)))
            keys.append(grams[at])
            of.append(np.full(len(at), k))
            place.append(at)
        keys, of, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, of, place))
        order = np.argsort(keys, kind="stable")
        self.keys, self.of, self.place = keys[order], of[order], place[order]

    def names_license(self, of: int, t: X.Texts, words: np.ndarray, matches: int, begin: int, end: int) -> bool:
        """Whether words [begin, end), aligned with a template, name its license.

        They hold no run of words that only its relatives have, and no version but its own. Of a short template all words but one must match, its identifying runs must stand there, and no number that it has not:
        neither in the span nor right after one that stops before the template's last word.
        """
        if any(_contains(words[begin:end], run) for run in self.foreign[of]) or not self._own_version(of, t, words, begin, end):
            return False
        if of not in self.runs:
            return True
        template = self.words[of]
        if matches < len(template) - 1 or not all(_contains(words[begin:end], r) for r in self.runs[of]):
            return False
        after = words[end - 1] != template[-1] and end < len(words) and t.doc[end] == t.doc[begin]
        return self.numbers[of].issuperset(_numbers(t, begin, end + after))

    def _own_version(self, of: int, t: X.Texts, words: np.ndarray, begin: int, end: int) -> bool:
        """Numbers after a word for versions are those of the license, zeros at the end aside; without numbers nothing is asked."""
        if of not in self.versions:
            return True
        for at in (begin + np.flatnonzero(np.isin(words[begin:end], self.version_words))).tolist():
            found, k = [], at + 1
            while k < len(words) and t.doc[k] == t.doc[at] and (w := t.data[t.start[k]:t.end[k]].tobytes()).isdigit() and len(w) < 3 and len(found) < 3:
                found.append(int(w))
                k += 1
            while found and found[-1] == 0:
                found.pop()
            if found and tuple(found) != self.versions[of]:
                return False
        return True

    def hits(self, t: X.Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, template, place in it) of every shingle of the texts that the index has."""
        grams, at = X.ngrams(words, t.doc, self.shingle)
        low, high = np.searchsorted(self.keys, grams), np.searchsorted(self.keys, grams, "right")
        some = np.flatnonzero(high > low)
        n = (high - low)[some]
        slot = np.repeat(low[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at[some], n), self.of[slot], self.place[slot]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int, added: int = 1) -> tuple[int, int, int]:
    """Best local alignment with place in text less place in template in [low, high]: matches, and the word span.

    A match counts 2, a changed or left out word -1, an added one -``added``. Of equal scores the first end is taken.
    """
    width = high - low + 1
    score, back = np.zeros((len(template) + 1, width + 2), np.int64), np.zeros((len(template) + 1, width + 2), np.int8)
    best, where = 0, None
    for i in range(1, len(template) + 1):
        row, above, step, same = score[i], score[i - 1], back[i], template[i - 1]
        for b in range(1, width + 1):
            j = i - 1 + low + b - 1  # word of the text on this diagonal
            if not 0 <= j < len(words):
                continue
            value, way = above[b] + (2 if words[j] == same else -1), 1
            if above[b + 1] - 1 > value:
                value, way = above[b + 1] - 1, 2  # a word of the template left out
            if row[b - 1] - added > value:
                value, way = row[b - 1] - added, 3  # a word of the text added
            if value > 0:
                row[b], step[b] = value, way
                if value > best:
                    best, where = int(value), (i, b)
    if where is None:
        return 0, 0, 0
    i, b = where
    end, matches, first = i + low + b - 1, 0, None
    while score[i, b] > 0:
        j = i - 1 + low + b - 1
        first = j
        if back[i, b] == 1:
            matches += int(words[j] == template[i - 1])
            i -= 1
        elif back[i, b] == 2:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return matches, first, end


def _band(n: int) -> int:
    """A short notice has room for some added words ('under the terms of the'), which cost nothing there."""
    return 4 if n < SHORT else max(2, n // 8)


def _candidates(index: Index, t: X.Texts, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, template, first and last diagonal, hits): hits sorted by diagonal, cut where it jumps by more than the band."""
    at, of, place = index.hits(t, words)
    doc = t.doc[at]
    diagonal = at - t.bounds[doc] - place
    order = np.lexsort((diagonal, of, doc))
    doc, of, diagonal = doc[order], of[order], diagonal[order]
    bands = np.array([_band(len(w)) for w in index.words])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]) | (diagonal[1:] - diagonal[:-1] > bands[of[1:]])
    edges = np.append(np.flatnonzero(new), len(doc)).tolist()
    return [(int(doc[a]), int(of[a]), int(diagonal[a]), int(diagonal[b - 1]), b - a) for a, b in zip(edges, edges[1:])]


def scan(index: Index, t: X.Texts, coverage: float) -> list[tuple[int, str, float, int, int, int]]:
    """(text, template, coverage, matched words, start, end): code points, end exclusive; by text and start.

    Of reports that overlap in a text, the one with most matched words stays (then the larger coverage, then the first).
    """
    words, points, found = t.word_hashes(), t.points(), []
    for doc, of, low, high, _ in _candidates(index, t, words):
        template, first = index.words[of], int(t.bounds[doc])
        band = _band(len(template))
        begin = max(0, low - band)
        stop = min(int(t.bounds[doc + 1]) - first, high + len(template) + band)
        step = 4 * len(template) + 2 * band  # a long run of diagonals is aligned in parts, which overlap
        for part in range(low, high + 1, step):
            to = min(high, part + step - 1)
            at = max(begin, part - band)
            matches, a, b = align(template, words[first + at:first + min(stop, to + len(template) + band)], part - band - at, to + band - at,
                                  added=int(len(template) >= SHORT))
            if matches and matches >= coverage * len(template) and index.names_license(
                    of, t, words, matches, first + at + a, first + at + b):
                found.append((doc, of, matches, matches / len(template), at + a, at + b))
    found.sort(key=lambda r: (r[0], -r[2], -r[3], r[4], r[1]))
    kept: list[tuple] = []
    doc, starts, ends = -1, [], []
    for r in found:
        if r[0] != doc:
            doc, starts, ends = r[0], [], []
        # Kept spans of a text are apart from each other, so only the neighbours can overlap.
        i = bisect_right(starts, r[4])
        if (i == 0 or ends[i - 1] <= r[4]) and (i == len(starts) or starts[i] >= r[5]):
            starts.insert(i, r[4])
            ends.insert(i, r[5])
            kept.append(r)
    base = points[t.edges[:-1]]
    out = [(d, index.names[of], share, n, int(points[t.start[t.bounds[d] + a]] - base[d]), int(points[t.end[t.bounds[d] + b - 1]] - base[d]))
           for d, of, n, share, a, b in kept]
    return sorted(out, key=lambda r: (r[0], r[4], r[1]))


def licenses(docs: DataFrame, templates: Mapping[str, str] = LIBRARY, coverage: float = COVERAGE, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """A row for each license found in a text: key, license, coverage, n_matched, start, end.

    Words are runs of digits, letters and all beyond ASCII, in lower case for A-Z. ``coverage`` is the share of the
    template's words that the alignment matches; templates of under ``SHORT`` words must match in all but one and with the
    words that identify the license (``Index.names_license``); ``start`` and ``end`` are code points of the whole text. Null and empty
    texts have none; repeated rows give their rows each; the key may be null; other columns are not read. Templates need
    ``SHINGLE`` words or more.
    """
    index = Index(templates)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in X.chunks(batch.column(1), X.PLAIN_LOWER):
                rows = scan(index, t, coverage)
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([t.first + d for d in columns[0]], pa.int64())), pa.array(columns[1], pa.string()),
                     pa.array(columns[2], pa.float64()), *[pa.array(c, pa.int64()) for c in columns[3:]]],
                    [key, "license", "coverage", "n_matched", "start", "end"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, license string, coverage double, n_matched bigint, start bigint, `end` bigint")
