import math
import re
from collections import Counter

import pytest

from lexdrift.llm import licenses, queries

FILES = "key long, path string, text string, dir string, own int, above string"
LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "# Released under the MIT license": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def plain(texts, templates=licenses.TEMPLATES):
    """Cosines over whole dictionaries."""
    vocabulary = {w for _, t in templates for w in licenses.words(t)}
    n = len(texts)
    df = {w: sum(w in set(licenses.words(t)) for t in texts) for w in vocabulary}
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1

    def vector(text):
        return {w: n * idf(w) for w, n in Counter(licenses.words(text)).items()}

    def cosine(a, b):
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    def fits(name, template, candidate, before):
        has, wants = Counter(licenses.words(candidate)), Counter(licenses.words(template))
        names = licenses.NAMED.get(name) or licenses.NAMED.get(name.split("-")[0], set())
        if any(w[0].isdigit() and not has[w] for w in wants) or any(has[w] < n for w, n in wants.items() if w in names):
            return False
        if any(has[w] and not wants[w] for w in licenses.OTHER):
            return False
        short = sum(wants.values()) <= licenses.SHORT and not licenses.DENIED & set(wants)
        return not (short and licenses.DENIED & {*has, *before})

    rows = [(name, t, vector(t)) for name, t in templates]
    out = []
    for text in texts:
        scores = {}
        lines = text.split("\n")
        said = [(line, licenses.words(lines[i - 1])[-2:] if i else []) for i, line in enumerate(lines)]
        for c, before in [*said, *((x, []) for x in re.split(r"\n(?:[^a-z0-9\n]*\n)+", text, flags=re.I)), (text, [])]:
            if v := vector(c):
                for i, (name, t, row) in enumerate(rows):
                    if fits(name, t, c, before):
                        scores[i] = max(scores.get(i, 0), cosine(v, row))
        top = max(scores.values(), default=0)
        best = next((rows[i][0] for i in sorted(scores) if scores[i] > top - 1e-12), None)
        more = max((c for i, c in scores.items() if rows[i][0] == licenses.EXTENDED.get(best)), default=0)
        if more >= licenses.THRESHOLD:
            best, top = licenses.EXTENDED[best], more
        out.append((best, top) if top >= licenses.THRESHOLD else (None, None))
    return out


BSD2 = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause" and len(t) > 500)
BSD3 = BSD2.replace("THIS SOFTWARE IS", "3. " + next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and len(t) > 100) + "\n\nTHIS SOFTWARE IS", 1).replace("2. Redis", "\n\n2. Redis")
GPL = "This program is free software{0} you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation{1} either version {2} of the License, or\n# (at your option) any later version."
NOTICES = [
    ("MIT", "Released under the MIT License. " * 4 + " ".join(f"word{i}" for i in range(21))),
    ("MIT", "Copyright (c) 2020 A. Author\n\n" + next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 800)),
    ("GPL-2.0", "#!/bin/sh\n#\n# " + GPL.format(";", ";", 2) + "\n#\n# more words follow here"),
    ("GPL-3.0", "# " + GPL.format(":", ",", 3)),
    (None, "# " + GPL.format(":", ",", 1)),
    ("BSD-2-Clause", "Copyright 2019 Somebody\n\n" + BSD2),
    ("BSD-3-Clause", "Copyright 2019 Somebody\n\n" + BSD3),
    ("ISC", "Copyright x\n\n" + next(t for n, t in licenses.TEMPLATES if n == "ISC" and len(t) > 100)),
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n text"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"),
    (None, "We spoke of version 2 of the software and its license, free of charge."),
    ("MIT", "prose without end " * 10_000 + "\nReleased under the MIT License.\n" + "more prose " * 10_000),
]

# Titles, identifiers, denials, and licences that others are made of.
STATED = [
    ("MIT", "MIT License\n\nCopyright (c) 2021 A. Author"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later"),
    (None, "// SPDX-License-Identifier: LicenseRef-Ours"),
    ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    (None, "Not released under the MIT License."),
    (None, "This file is not\nreleased under the MIT License."),
    (None, "The code is no longer licensed under the Apache License, Version 2.0."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-2.0", GPL.format(";", ";", 2).replace("This program", "This library")),
    (None, "GNU LESSER GENERAL PUBLIC LICENSE Version 2"),
    (None, "Licensed under the House License, Version 2.0."),
    (None, "License\n"),
    ("Apache-2.0", "Licensed under the Apache License, v2.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("Zlib", "Copyright 1999 X\n\n" + max((t for n, t in licenses.TEMPLATES if n == "Zlib"), key=len)),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + max((t for n, t in licenses.TEMPLATES if n == "BSL-1.0"), key=len)),
]


@pytest.mark.parametrize("notices", [NOTICES, STATED])
def test_notices_and_texts(spark, notices):
    """Repeated words, comments, versions, clauses, and a very long text; ties go to the first template."""
    texts = [t for _, t in notices]
    got = {r.key: r for r in licenses.scan(spark.createDataFrame([(i, f"{i}.txt", t) for i, t in enumerate(texts)], "key long, path string, text string")).collect()}
    for i, ((name, _), (want, score)) in enumerate(zip(notices, plain(texts), strict=True)):
        assert got[i].own == want == name, (i, got[i], want, score)
        assert got[i].score == pytest.approx(score or 0, abs=1e-5)
    twin = [("B", "alpha beta gamma"), ("A", "alpha beta gamma")]
    assert licenses.scan(spark.createDataFrame([(1, "f", "alpha beta gamma")], "key long, path string, text string"), twin).first().own == "B"


@pytest.fixture(scope="module")
def files():
    prose = "The quick brown fox spoke of a licence and of software.\nIt went on.\n\nNothing else was free of charge."
    rows = [(f"a/b/c/f{i}.txt", prose + (f"\n{line}\nmore" if i % 2 else "")) for i, line in enumerate([*LINES] * 2)]
    rows += [("a/LICENSE", [*LINES][0]), ("a/b/COPYING.md", [*LINES][1]), ("a/b/LICENSE", "no licence here at all"), ("x/LICENSE", [*LINES][3])]
    rows += [("a/g.txt", prose), ("x/y/z.txt", prose), ("q/r.txt", prose), ("top.txt", prose), ("a/empty", None), (None, [*LINES][2])]
    return [(i, p, t) for i, (p, t) in enumerate(rows)]


def test_scan_against_plain_cosines_and_paths(spark, files):
    got = {r.key: r for r in licenses.scan(spark.createDataFrame([(*f, "d", 1, "x") for f in files], FILES).repartition(3)).collect()}
    want = plain([t or "" for _, _, t in files])
    for (key, path, _), (name, score) in zip(files, want, strict=True):
        assert got[key].own == name and (score is None or got[key].score == pytest.approx(score, abs=1e-5))
        source, licence = None, None
        parts = (path or "").split("/")[:-1]
        while path and source is None:
            there = sorted((p, w[0]) for (_, p, _), w in zip(files, want, strict=True) if p and w[0] and re.search(licenses.LICENCE_NAME, p) and p.split("/")[:-1] == parts)
            if there:
                source, licence = there[0]
            if not parts:
                break
            parts = parts[:-1]
        assert (got[key].licence, got[key].source) == ((name, "own") if name else (licence, source)), path


def test_planted_lines_are_found_and_prose_is_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {line.replace("# ", "").replace("license", "License") if name == "MIT" else line: name for line, name in LINES.items()}
    got = {r.key: r for r in licenses.scan(licenses.layout(docs)).collect()}
    for r in docs.collect():
        lines = [name for line, name in planted.items() if line in r.text]
        assert (got[r.doc_id].own is not None) == bool(lines), r.doc_id
        assert not lines or got[r.doc_id].own in lines


def test_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], FILES)).count() == 0
    got = licenses.scan(spark.createDataFrame([(1, "f", None), (1, "f", None)], "key long, path string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "f", None, 0.0, None, None)] * 2


def test_registered_query_inherits_as_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    planted = {line.replace("# ", "").replace("license", "License") if name == "MIT" else line: name for line, name in LINES.items()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op5_licenses(spark, sf).collect()}
    assert set(got) == set(docs)
    path, speak = {}, {}
    for i, d in docs.items():
        parts = [d.source, d.lang, str(i // 1000)]
        licensed = any(line in d.text for line in planted)
        path[i] = "/".join([*parts[: i % 3 + 1], f"LICENSE-{i}"] if licensed and i % 2 == 0 else [*parts, f"{i}.txt"])
        if licensed and i % 2 == 0:
            where = path[i].rsplit("/", 1)[0]
            speak[where] = min(speak.get(where, (path[i], i)), (path[i], i))
    inherited = 0
    for i, r in got.items():
        own = {name for line, name in planted.items() if line in docs[i].text}
        assert r.path == path[i] and (r.own in own if own else r.own is None)
        if own:
            assert (r.licence, r.source) == (r.own, "own")
            continue
        above = path[i].split("/")[:-1]
        first = next((speak[d] for d in ("/".join(above[:n]) for n in range(len(above), 0, -1)) if d in speak), None)
        assert (r.licence, r.source) == ((got[first[1]].own, first[0]) if first else (None, None))
        inherited += first is not None
    assert inherited > 100 and any(r.own and r.doc_id % 2 for r in got.values())


def test_no_directory_is_too_deep(spark):
    deep = "/".join(["d"] * 200)
    rows = [(1, "d/LICENSE", [*LINES][0]), (2, f"{deep}/f.txt", "plain prose")]
    got = {r.key: r for r in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    assert (got[2].own, got[2].licence, got[2].source) == (None, "CC-BY-NC-4.0", "d/LICENSE")
