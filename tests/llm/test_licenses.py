import random
import re

import numpy as np
import pyarrow as pa

from featforge.llm import licenses as L
from featforge.llm import text as X
from featforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def whole_alignment(template, doc):
    """Matches of the best local alignment without a band."""
    score = np.zeros((len(template) + 1, len(doc) + 1, 2), int)
    best = (0, 0)
    for i, a in enumerate(template, 1):
        for j, b in enumerate(doc, 1):
            options = [(score[i - 1, j - 1, 0] + (2 if a == b else -1), score[i - 1, j - 1, 1] + (a == b)),
                       (score[i - 1, j, 0] - 1, score[i - 1, j, 1]), (score[i, j - 1, 0] - 1, score[i, j - 1, 1])]
            s, m = max(options, key=lambda o: o[0])
            if s > 0:
                score[i, j] = s, m
                best = max(best, (s, m))
    return best[1]


def test_winnowing_keeps_one_in_every_window():
    hashes = np.random.default_rng(3).integers(0, 50, 300)
    kept = L.winnow(hashes, 4)
    for i in range(len(hashes) - 3):
        assert any(i <= k < i + 4 and hashes[k] == hashes[i:i + 4].min() for k in kept)
    assert L.winnow(hashes[:2], 4).tolist() == [0, 1]


def test_reports_equal_unbanded_alignment(spark):
    rng = random.Random(4)
    texts, truth = [], []
    for k in range(40):
        name = rng.choice(list(L.TEMPLATES))
        body = [w for w, *_ in words(L.TEMPLATES[name])]
        for _ in range(rng.randint(0, max(1, len(body) // 12))):
            i = rng.randrange(len(body))
            body[i:i + 1] = rng.choice([[], ["changed"], [body[i], "added"]])
        filler = lambda: [f"f{rng.randrange(999)}" for _ in range(rng.randint(0, 60))]
        texts.append(" ".join([*filler(), *body, *filler()]))
        truth.append(name)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {}
    for r in L.licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (text, name) in enumerate(zip(texts, truth)):
        template, doc = [w for w, *_ in words(L.TEMPLATES[name])], [w for w, *_ in words(text)]
        matches = whole_alignment(template, doc)
        reports = [r for r in got.get(i, []) if r.license == name]
        run = L.SHINGLE + (L.WINDOW - 1 if len(template) >= L.SHORT else 0)  # a shared run of so many words is always seen
        shared = any(template[k:k + run] == doc[j:j + run] for k in range(len(template) - run + 1) for j in range(len(doc)))
        if matches >= 0.8 * len(template) and shared:
            assert reports and reports[0].n_matched >= matches - 1, (i, name)
            assert abs(reports[0].coverage - reports[0].n_matched / len(template)) < 1e-9


def test_odd_rows(spark):
    notice, full = L.TEMPLATES["MIT-notice"], L.TEMPLATES["MIT"]
    docs = [(1, None), (2, ""), (3, f"ééé {notice}"), (None, notice.upper()), (4, f"{notice} {notice}\n\n{notice}"), (5, full), (5, full),
            (6, full.replace("Software", "Program")), (7, "under the terms of the license"), (8, "x " * 20_000 + full + " y" * 20_000),
            (9, L.TEMPLATES["Apache-2.0"]), (10, "released under the license of mit")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id bigint, text string, start int, license string").repartition(3)
    got = {}
    for r in L.licenses(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 2), r.start, r.end))
    assert 1 not in got and 2 not in got and 7 not in got
    assert got[3] == [("MIT-notice", 1.0, 4, 4 + len(notice) - 1)] and got[None] == [("MIT-notice", 1.0, 0, len(notice) - 1)]
    assert [r[0] for r in sorted(got[4], key=lambda r: r[2])] == ["MIT-notice"] * 3
    assert len(got[5]) == 2 and all(r[0] == "MIT" and r[1] == 1.0 for r in got[5])
    assert got[6][0][0] == "MIT" and got[6][0][1] > 0.9 and got[8][0][0] == "MIT" and got[8][0][1] == 1.0
    assert [r[0] for r in got[9]] == ["Apache-2.0"]
    assert L.licenses(df.limit(0)).count() == 0


def test_query_finds_the_notices(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op10_license_scan"](spark, SF).collect()
    for name, body in L.TEMPLATES.items():
        has = {i for i, t in docs.items() if body.rstrip(".").lower() in (t or "").lower()}
        assert has <= {r.doc_id for r in got if r.license == name}
    for r in got:
        assert 0.6 <= r.coverage <= 1 and 0 <= r.start < r.end <= len(docs[r.doc_id])


def test_overlapping_reports_of_many_headers():
    header, full = L.TEMPLATES["Apache-2.0"], L.TEMPLATES["MIT"]
    (t,) = X.chunks(pa.array(["\n\n".join([header] * 100), f"{full}\n" * 90]), X.PLAIN_LOWER)
    rows = L.scan(L.Index(L.TEMPLATES), t, L.COVERAGE)
    assert [r[:2] for r in rows] == [(0, "Apache-2.0")] * 100 + [(1, "MIT")] * 90
    for a, b in zip(rows, rows[1:]):
        assert a[0] != b[0] or a[5] <= b[4]


def test_short_notices_need_the_words_that_identify_them():
    texts = {
        "The film was released under the title of its book": [], "a BSD program, released under the BSD License": [],
        "Released under the Apache License": [], "Released under the MIT-0 License": [], "Licensed under CC BY 4.0": [],
        "Licensed under CC BY-NC-SA 4.0.": [], "Licensed under CC BY-NC 3.0.": [],
        "This work is licensed under the GNU General Public License, version 2.": [],
        "This work is licensed under the GNU Lesser General Public License, version 3.": [],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": [],
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": [],
        "Licensed under the Apache License, Version 1.1": [], "Licensed under the Apache License, Version 1.0": [],
        "Distributed under the MIT license": ["MIT-notice"], "Released under the terms of the MIT License 2024": ["MIT-notice"],
        "Licensed under the terms of the MIT License": ["MIT-notice"],
        "Available under the Apache License, Version 2.0 2024": ["Apache-2.0-notice"],
        "This program is licensed under the GNU General Public License, version 3.": ["GPL-3.0-notice"],
        "Released under CC BY-NC 4.0": ["CC-BY-NC-4.0-notice"], "my own notice of five words": ["own"], "my own notice of six words": [],
    }
    templates = L.TEMPLATES | {"own": "own notice of five words"}
    t, = X.chunks(pa.array(list(texts)), X.PLAIN_LOWER)
    got = [[] for _ in texts]
    for r in L.scan(L.Index(templates), t, L.COVERAGE):
        got[r[0]].append(r[1])
    assert dict(zip(texts, got)) == texts


def test_relatives_and_other_versions_are_told_apart():
    gpl, apache, mpl, bsd = (L.LIBRARY[k] for k in ("GPL-3.0", "Apache-2.0", "MPL-2.0", "BSD-3-Clause"))
    texts = {
        gpl: ["GPL-3.0"], gpl.replace("version 3", "version 2"): ["GPL-2.0"], L.LIBRARY["GPL-2.0"]: ["GPL-2.0"],
        gpl.replace("General Public", "Lesser General Public"): ["LGPL-3.0"], gpl.replace("General Public", "Affero General Public"): ["AGPL-3.0"],
        gpl.replace("General Public", "Library General Public").replace("version 3", "version 2"): [],
        gpl.replace("General Public", "Lesser General Public").replace("version 3", "version 2.1"): ["LGPL-2.1"], L.LIBRARY["LGPL-2.1"]: ["LGPL-2.1"],
        apache: ["Apache-2.0"], apache.replace("Version 2.0", "Version 1.1").replace("LICENSE-2.0", "LICENSE-1.1"): [],
        apache.replace("Version 2.0", "Version 2"): ["Apache-2.0"], apache.replace(", Version 2.0", ""): ["Apache-2.0"],
        mpl: ["MPL-2.0"], mpl.replace("v. 2.0", "v. 1.1").replace("MPL/2.0", "MPL/1.1"): [], mpl.replace("v. 2.0", "Version 1.1"): [],
        bsd: ["BSD-3-Clause"], L.LIBRARY["BSD-2-Clause"]: ["BSD-2-Clause"], L.LIBRARY["0BSD"]: ["0BSD"], L.LIBRARY["ISC"]: ["ISC"],
        f"{gpl} See version 2 of the manual": ["GPL-3.0"],
    }
    t, = X.chunks(pa.array(list(texts)), X.PLAIN_LOWER)
    got = [[] for _ in texts]
    for r in L.scan(L.Index(L.LIBRARY), t, L.COVERAGE):
        got[r[0]].append(r[1])
    assert got == list(texts.values())
