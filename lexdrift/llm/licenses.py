"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line, every paragraph and the whole of a text are candidates. Their words and those of the templates are
weighted by term frequency times inverse document frequency over all texts; a word of no template
weighs as much as a word of no document, so prose that merely mentions a licence stays far from all templates.
A template's numbers (its version) and the words that name its licence must be among the candidate's words, and a candidate
with a word that makes another licence of it (lesser, noncommercial, ...) isn't that template's. A short notice is denied by a
negation it doesn't have, in the candidate or just before. Long licences (Apache, GPL, MPL, EPL, Creative Commons) are
known by their titles, notices and identifiers, short ones by their whole texts as well.

A file whose name is that of a licence file speaks for its directory. A file without a licence of its own
inherits that of the nearest directory above it which has one: directories are resolved once,
by an equi-join of their ancestors' paths, and files then find their directory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import slices

# Texts, notices and titles of public licences, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License 1.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "Licensed under the GNU GPL v2"),
    ("GPL-3.0", "Licensed under the GNU GPL v3"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("Unlicense", "The Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "zlib License"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
# Creative Commons 4.0, by rule: the parts of a licence's name in short and in full.
_CC = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
for _parts in (["BY"], ["BY", "NC"], ["BY", "NC", "ND"], ["BY", "NC", "SA"], ["BY", "ND"], ["BY", "SA"]):
    _short = "-".join(_parts)
    TEMPLATES.append((f"CC-{_short}-4.0", f"Licensed under CC {_short} 4.0."))
    TEMPLATES.append((f"CC-{_short}-4.0", f"This work is licensed under a Creative Commons {'-'.join(_CC[x] for x in _parts)} 4.0 International License."))
# Identifiers, by rule; what follows one (-only, -or-later, WITH ...) is a few words more.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES})]
# Words that name a licence; where a template has one, its candidates have it as often.
NAMED: dict[str, set[str]] = {
    "AGPL": {"affero", "agpl"}, "Apache": {"apache"}, "BSD": {"bsd"}, "BSL": {"boost", "bsl"}, "CC": {"cc", "creative", "by", "attribution"}, "CC0": {"cc0"},
    "EPL": {"eclipse", "epl"}, "GPL": {"general", "gpl"}, "ISC": {"isc"}, "LGPL": {"lesser", "lgpl"}, "MIT": {"mit"}, "MPL": {"mozilla", "mpl"},
    "Unlicense": {"unlicense"}, "Zlib": {"zlib"}, "LGPL-2.0": {"library", "lgpl"},
}
# Words that make another licence of one, and words that deny a notice.
OTHER = {"affero", "lesser", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike"}
DENIED = {"aren", "cannot", "doesn", "don", "isn", "longer", "neither", "never", "nor", "not", "wasn", "weren"}
#: Words of a notice that a negation denies, at most; longer texts have negations of their own around them.
SHORT = 20
#: Licences whose text is another's with a clause more: where both match it is the second.
EXTENDED = {"BSD-2-Clause": "BSD-3-Clause"}
#: Least cosine of a match.
THRESHOLD = 0.7
#: Names of files that speak for their directory.
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
# The v of a version (v2.0) isn't part of it.
_WORD = re.compile(r"(?:\bv(?=[0-9]))?([a-z0-9]+(?:\.[0-9]+)*)", re.A)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms(templates: list[tuple[str, str]]) -> list[str]:
    """All words of the templates, and those that make another licence of one, in order."""
    return sorted({w for _, t in templates for w in words(t)} | OTHER | DENIED)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of lines (first, after last) of a text: each line, each paragraph (between lines without words), and all."""
    lines = text.split("\n")
    begin = 0
    for i, line in enumerate([*lines, ""]):
        if i < len(lines):
            yield i, i + 1
        if not _WORD.search(line.lower()):
            if i - begin > 1:
                yield begin, i
            begin = i + 1
    if len(lines) > 1:
        yield 0, len(lines)


class Matcher:
    """Cosines to all templates with one table of document frequencies."""

    def __init__(self, documents: int, frequency: dict[str, int], templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        vocabulary = terms(templates)
        self.at = {w: i for i, w in enumerate(vocabulary)}
        idf = lambda n: np.log((1 + documents) / (1 + n)) + 1
        self.idf = np.array([idf(frequency.get(w, 0)) for w in vocabulary])
        self.weight = dict(zip(vocabulary, self.idf.tolist(), strict=True))
        self.rare = float(idf(0))
        tf = np.array([self.counts(words(t))[0] for _, t in templates])
        numbers = np.array([w[0].isdigit() for w in vocabulary])
        named = np.array([[w in NAMED.get(name, NAMED.get(name.split("-")[0], ())) for w in vocabulary] for name in self.names])
        self.needed = np.where(named, tf, (tf > 0) & numbers)
        self.barred = (tf == 0) & np.array([w in OTHER for w in vocabulary])
        denied = np.array([w in DENIED for w in vocabulary])
        self.deniable = (tf.sum(1) <= SHORT) & ~(tf[:, denied] > 0).any(1)
        rows = tf * self.idf
        self.rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def counts(self, found: Sequence[str]) -> tuple[np.ndarray, int]:
        """Counts of the templates' words, and the sum of the squares of the others'."""
        tf, other = np.zeros(len(self.at)), {}
        for w in found:
            if (i := self.at.get(w)) is not None:
                tf[i] += 1
            else:
                other[w] = other.get(w, 0) + 1
        return tf, sum(n * n for n in other.values())

    def cosines(self, found: Sequence[str], denied: bool = False) -> np.ndarray:
        """To all templates; 0 where a template's number or name is missing, or a word makes another licence of it or denies it."""
        tf, other = self.counts(found)
        v = tf * self.idf
        length = float(np.sqrt(v @ v + self.rare**2 * other))
        if not length:
            return np.zeros(len(self.names))
        out = (self.needed > tf).any(1) | (self.barred & (tf > 0)).any(1)
        if denied or not DENIED.isdisjoint(found):
            out |= self.deniable
        return np.where(out, 0.0, self.rows @ v / length)

    def best(self, text: str) -> tuple[str | None, float]:
        """The best template's name over all candidates, if any reaches the threshold; the first of equals. Else the score is 0."""
        lines = [words(line) for line in text.split("\n")]
        known = [[self.weight.get(w) for w in line] for line in lines]
        weights = [sum(w for w in line if w is not None) for line in known]
        foreign = [line.count(None) for line in known]
        # The templates' words weigh their sum at most, the others' square is their number at least: where that
        # bounds the cosine under the threshold it isn't computed.
        ratio = THRESHOLD**2 / (1 - THRESHOLD**2) * self.rare**2
        scores = np.zeros(len(self.names))
        seen: set[tuple[bool, tuple[str, ...]]] = set()
        for a, b in candidates(text):
            weight = weights[a] if b == a + 1 else sum(weights[a:b])
            if weight == 0 or weight * weight * (1 + 1e-9) < ratio * (foreign[a] if b == a + 1 else sum(foreign[a:b])):
                continue
            found = tuple(w for line in lines[a:b] for w in line)
            denied = a > 0 and not DENIED.isdisjoint(lines[a - 1][-2:])
            if (denied, found) not in seen:
                seen.add((denied, found))
                scores = np.maximum(scores, self.cosines(found, denied))
        at = int(scores.argmax())
        if scores[at] < THRESHOLD:
            return None, 0.0
        name = self.names[at]
        more = [c for n, c in zip(self.names, scores.tolist(), strict=True) if n == EXTENDED.get(name) and c >= THRESHOLD]
        return (EXTENDED[name], max(more)) if more else (name, float(scores[at]))


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each word of the templates: at most a row a word from each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        known = pa.array(vocabulary, pa.string())
        for whole in batches:
            for batch in slices(whole):
                text = pc.fill_null(batch.column("text"), "")
                # the same words as words(): neither ends of sentences nor a v are parts of numbers
                clean = pc.replace_substring_regex(pc.ascii_lower(text), r"\bv([0-9])", r"\1")
                clean = pc.replace_substring_regex(clean, r"\.([^0-9]|$)", r" \1")
                lists = pc.split_pattern_regex(clean, r"[^a-z0-9.]+")
                at = pc.index_in(lists.flatten(), value_set=known)
                rows = pc.list_parent_indices(lists).to_numpy()
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                pairs = np.unique(rows[hit].astype(np.int64) * len(vocabulary) + at.filter(at.is_valid()).to_numpy())
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                n += len(text)
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(vocabulary)), -1]), pa.array([*total.tolist(), n])], ["word", "n"])

    got = {r.word: r.n for r in files.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), {w: got.get(i, 0) for i, w in enumerate(vocabulary)}


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, licence_path: str | None = None) -> DataFrame:
    """A row for each row of ``files`` (key, path, text): key, path, own (licence or null), score, licence, source.

    source is ``own``, or the path of the file whose licence was inherited, or null with a null licence. Of several
    licence files in a directory the one with the first path counts; one without a known licence doesn't.
    score is the best cosine, 0 without a licence. Null text is empty, a null path has no directory, equal rows stay, no files give no rows; other
    columns are ignored. ``licence_path`` names a column with the path of a file in whose text, wherever it stands,
    a licence is found; without a licence, or with a null there, ``path`` holds.
    """
    spark, templates = files.sparkSession, templates or TEMPLATES
    named = F.col(licence_path) if licence_path else F.lit(None).cast("string")
    files = files.select("key", "path", named.alias("named"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = terms(templates)
    matcher = spark.sparkContext.broadcast(Matcher(*frequencies(files, vocabulary), templates))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for batch in batches:
            best: list[Any] = [m.best(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("path"), batch.column("named"), pa.array([b[0] for b in best], pa.string()), pa.array([round(b[1], 6) for b in best], pa.float64())],
                ["key", "path", "named", "own", "score"],
            )

    kind = dict(files.dtypes)["key"]
    scored = files.mapInArrow(work, f"key {kind}, path string, named string, own string, score double")
    path = F.when(F.col("own").isNotNull(), F.coalesce("named", "path")).otherwise(F.col("path"))
    found = staged(scored.select("key", path.alias("path"), "own", "score"))
    parent = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).when(c != "", F.lit(""))
    found = found.withColumn("dir", parent(F.col("path")))
    speak = (
        found.where(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_NAME))
        .groupBy("dir")
        .agg(F.min(F.struct("path", "own")).alias("first"))
        .select(F.col("dir").alias("above"), F.col("first.own").alias("inherited"), F.col("first.path").alias("from"))
    )
    # Every directory once, with its ancestors; the deepest that speaks counts.
    steps = F.filter(F.split("dir", "/"), lambda x: x != "")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), F.size(steps) - i), "/"))
    dirs = found.select("dir").where("dir is not null").distinct()
    resolved = (
        dirs.select("dir", F.explode(ancestors).alias("above"))
        .join(speak.withColumn("above", F.array_join(F.filter(F.split("above", "/"), lambda x: x != ""), "/")), "above")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("above").alias("depth"), "inherited", "from")).alias("best"))
        .select("dir", "best.inherited", "best.from")
    )
    # Directories grow with the input and aren't broadcast. Written tables: both sides of the join are plain shuffles, so
    # Spark can split a hot directory.
    out = found.join(staged(resolved).hint("merge"), "dir", "left")
    return out.select(
        "key", "path", "own", "score",
        F.coalesce("own", "inherited").alias("licence"),
        F.when(F.col("own").isNotNull(), F.lit("own")).otherwise(F.col("from")).alias("source"),
    )


def layout(docs: DataFrame) -> DataFrame:
    """Files (key, path, text, licence_path) from a table of documents, which has no paths: source/lang/thousand/id.

    Documents of even ids have a ``licence_path``: if their text holds a licence they are the licence file of their
    directory or, by the id, of one of the two above it. The others keep a licence to themselves.
    """
    top, mid = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    low = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    at = F.pmod(F.col("doc_id"), F.lit(3))
    as_licence = F.when(at == 0, F.concat_ws("/", top, F.concat(F.lit("LICENSE-"), name))).when(at == 1, F.concat_ws("/", top, mid, F.concat(F.lit("LICENSE-"), name)))
    as_licence = as_licence.otherwise(F.concat_ws("/", top, mid, low, F.concat(F.lit("LICENSE-"), name)))
    return docs.select(
        F.col("doc_id").alias("key"),
        F.concat_ws("/", top, mid, low, F.concat(name, F.lit(".txt"))).alias("path"),
        "text",
        F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, as_licence).alias("licence_path"),
    )
