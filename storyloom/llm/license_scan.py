"""Licence scan: a trained classifier of paragraphs, confirmed by comparison with templates.

A paragraph is a run of lines that are no blank ones. Notices stand alone, within prose, or wrapped over several lines, so
both its lines and the paragraph as a whole are classified. Features are hashed words and word pairs (lower case), shared
out over all n-grams. A multinomial logistic regression has a class for each licence family and one for other text; it is
trained on the templates, their sentences, and random parts of both, against a bounded sample of the corpus's own lines. A
temperature, fitted on whole templates that were held out, calibrates its probabilities; then those are learned too.

A line (or else a paragraph) is a licence text if other text is less likely than not. Its neighbours within the paragraph
join it as long as most of their word pairs occur in the templates of its family; the lines joined are classified again as
one text. Its family counts if it reaches ``sure`` and enough of its word pairs occur in a template of that family, or the
other way round; else it is ``unknown``. A family is out of the question where the text has a word that decides for another
licence (affero, say), or names another version. A text of which no word pair occurs in any template is none.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams

# Texts of well-known licences, sentence by sentence, and notices that name them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License, Version 2.0, January 2004, http://www.apache.org/licenses/",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is distributed under the terms of the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "agpl-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "Licensed under the GNU General Public License, version 2 only.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "This work has been dedicated to the public domain under CC0.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "No part of this work may be reproduced, distributed, or transmitted in any form or by any means without prior written permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
# Words that make another licence of a text that is otherwise like one of these.
DECIDING = "affero lesser sharealike noncommercial noderivatives noderivs sa nc nd isc mit apache mozilla eclipse boost artistic zlib".split()
FAMILIES = sorted(TEMPLATES)
BITS, SCALE = 15, 12.0
#: The share of a line's word pairs that must occur in a family's templates for the line to join its neighbour's notice.
JOIN = 0.5
#: Documents whose paragraphs stand for other text, and paragraphs of them.
DOCUMENTS, OTHERS = 400, 4000

_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Model:
    weights: np.ndarray  # (buckets, families + 1); the last column is other text
    bias: np.ndarray
    temperature: float


def _features(data: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return grams.word_ngrams(_LOWER[data], part, BITS)


def _matrix(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        _, b = _features(data, np.zeros(len(data), np.int64))
        at, n = np.unique(b, return_counts=True)
        out.append((at, n * (SCALE / max(1, len(b)))))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _parts(rng: random.Random, text: str) -> str:
    """A random part of a sentence: a run of its words, a few of them left out."""
    words = text.split()
    if len(words) < 7:
        return text if rng.random() < 0.7 else text.rstrip(".")
    n = rng.randint(max(6, len(words) * 2 // 3), len(words))
    at = rng.randint(0, len(words) - n)
    return " ".join(w for w in words[at : at + n] if rng.random() > 0.05)


def _sentences(rng: random.Random) -> list[tuple[str, int, bool]]:
    """(text, family, held out) of the templates: sentences, runs of neighbouring ones, and parts of both.

    A template is held out with all its parts: every fourth one of a family."""
    out = []
    for i, family in enumerate(FAMILIES):
        known = TEMPLATES[family]
        for j, t in enumerate(known):
            out += [(t if k == 0 else _parts(rng, t), i, j % 4 == 3) for k in range(24)]
        for _ in range(24):
            a, n = rng.randrange(len(known)), rng.randint(2, 4)
            out.append((_parts(rng, " ".join(known[a : a + n])), i, any(j % 4 == 3 for j in range(a, min(a + n, len(known))))))
    return out


def fit(docs: DataFrame, seed: int = 1, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the templates against lines of at most DOCUMENTS documents, picked by a hash of their text.

    A corpus holds licence texts itself. A sampled line of which over half of the word pairs occur in the templates teaches
    nothing, lest it stand for other text.
    """
    texts = docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    picked = [r["h"] for r in texts.groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(DOCUMENTS).collect()]  # hashes alone: the driver gets few bytes of a task
    some = texts.filter(F.col("h").isin(picked)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect() if picked else []
    known = set().union(*_family_pairs().values())
    lines = sorted({line for r in some for line in r["text"].split("\n") if line.strip()})
    others = [line for line in lines if len(p := _pairs(line)) and len(p & known) <= JOIN * len(p)]
    rng = random.Random(seed)
    rng.shuffle(others)
    others = others[:OTHERS] or ["other text"]
    texts = _sentences(rng) + [(t, len(FAMILIES), k % 4 == 3) for k, t in enumerate(others)]
    rng.shuffle(texts)
    rows = _matrix([t for t, _, _ in texts])

    def trained(keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
        w, bias, g2 = np.zeros((1 << BITS, len(FAMILIES) + 1)), np.zeros(len(FAMILIES) + 1), np.full((1 << BITS, 1), 1e-3)
        for _ in range(rounds):
            for k in keep:
                at, v = rows[k]
                d = _softmax(v @ w[at] + bias)
                d[texts[k][1]] -= 1
                grad = v[:, None] * d
                g2[at] += (grad * grad).sum(axis=1, keepdims=True)
                w[at] -= 0.5 * grad / np.sqrt(g2[at])
                bias -= 0.02 * d
        return w, bias

    # the temperature comes from templates that the model has not seen; then all of them are learned
    held = [k for k, x in enumerate(texts) if x[2]]
    w, bias = trained([k for k, x in enumerate(texts) if not x[2]])
    z = np.array([rows[k][1] @ w[rows[k][0]] + bias for k in held]).reshape(-1, len(FAMILIES) + 1)
    y = np.array([texts[k][1] for k in held], np.int64)
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    w, bias = trained(list(range(len(texts))))
    return Model(w.astype(np.float32), bias.astype(np.float32), min(loss, key=loss.get))


def _pairs(text: str) -> set[tuple[str, str]]:
    words = re.findall(r"[^\W_]+", text.lower())
    return set(zip(words, words[1:], strict=False)) or {(w, "") for w in words}


def _family_pairs() -> dict[str, set[tuple[str, str]]]:
    return {f: set().union(*map(_pairs, ts)) for f, ts in TEMPLATES.items()}


def similarity(text: str, family: str) -> float:
    """The greatest share of common word pairs, in the text or in a template, with the templates of a family.

    A template counts as contained in a longer paragraph, and a paragraph of three words or more as part of a template.
    """
    mine = _pairs(text)
    best = len(mine & _family_pairs()[family]) / len(mine) if len(mine) >= 2 else 0.0
    for t in TEMPLATES[family]:
        other = _pairs(t)
        best = max(best, len(mine & other) / len(other))
    return best


_VERSION = re.compile(r"(?:version|\bv\.?|license[,)]?|gpl|mpl)[\s-]*(\d+(?:\.\d+)*)", re.IGNORECASE)


def _versions(text: str) -> set[str]:
    return {v.removesuffix(".0") for v in _VERSION.findall(text)}


def contradicted(text: str, family: str) -> bool:
    """Whether a text cannot be of a family however alike it is: it has a deciding word that no template of the family has,
    or names versions of which none is the family's."""
    words = set(re.findall(r"[^\W_]+", text.lower()))
    known = {w for t in TEMPLATES[family] for w in re.findall(r"[^\W_]+", t.lower())}
    own = re.search(r"-(\d+(?:\.\d+)*)$", family)
    told = _versions(text)
    return any(w in words and w not in known for w in DECIDING) or bool(own and told and own[1].removesuffix(".0") not in told)


HITS = "doc_id long, paragraph int, lines int, text string, family string, probability double, similarity double"


def classify(texts: list[str], model: Model) -> np.ndarray:
    """The probabilities of the families and of other text (last) of each text."""
    z = np.array([v @ model.weights[at] + model.bias for at, v in _matrix(texts)]).reshape(-1, len(FAMILIES) + 1)
    return _softmax(z / model.temperature)


def _probabilities(data: np.ndarray, part: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the parts that have a word, and their probabilities."""
    at, bucket = _features(data, part)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, len(FAMILIES) + 1))
    order = np.argsort(at, kind="stable")
    at, bucket = at[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[starts, len(at)])
    z = (np.add.reduceat(model.weights[bucket], starts, axis=0) * (SCALE / n)[:, None] + model.bias) / model.temperature
    return at[starts], _softmax(z)


def scan(docs: DataFrame, model: Model, sure: float = 0.3, alike: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, paragraph, lines, text, family, probability, similarity`` of the licence texts.

    ``paragraph`` is the number of its first line, from 0, and ``lines`` how many it has; ``family`` is ``unknown`` where no
    family is sure and confirmed. Of families that are equally likely the first by name counts. Null and empty texts have no
    paragraphs. Equal rows give equal rows, a null doc_id stays null, an empty table gives no rows, other columns are not
    read. Texts of any length are scanned whole.
    """
    last = len(FAMILIES)
    pairs = _family_pairs()
    anywhere = set().union(*pairs.values())

    def joins(line: str, family: str) -> bool:
        mine = _pairs(line)
        return bool(mine) and len(mine & pairs[family]) > JOIN * len(mine)

    def grown(lines: list[str], k: int, family: str, taken: set[int]) -> tuple[int, int]:
        lo, hi = k, k + 1
        while lo > 0 and lo - 1 not in taken and joins(lines[lo - 1], family):
            lo -= 1
        while hi < len(lines) and hi not in taken and joins(lines[hi], family):
            hi += 1
        return lo, hi

    def notices(lines: list[str], seeds: list[tuple[int, np.ndarray]], whole: np.ndarray | None) -> Iterator[tuple]:
        """(first line, number of lines, text, family, probability, similarity) within one paragraph."""
        if not seeds and whole is not None:
            family = FAMILIES[int(whole[:last].argmax())]
            seeds = [(k, whole) for k, x in enumerate(lines) if joins(x, family)]
        taken: set[int] = set()
        for k, p in seeds:
            if k in taken:
                continue
            lo, hi = grown(lines, k, FAMILIES[int(p[:last].argmax())], taken)
            taken |= set(range(lo, hi))
            text = "\n".join(lines[lo:hi])
            if hi - lo > 1 or whole is p:
                p = classify([text], model)[0]
                if p[last] >= 0.5:
                    continue
            may = np.array([not contradicted(text, f) for f in FAMILIES])
            family = int(np.where(may, p[:last], -1.0).argmax()) if may.any() else int(p[:last].argmax())
            like = similarity(text, FAMILIES[family]) if may[family] else 0.0
            if not _pairs(text) & anywhere:
                continue  # no two words of it are those of any template
            yield lo, hi - lo, text, FAMILIES[family] if p[family] >= sure and like >= alike else "unknown", float(p[family]), like

    def hits(data: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
        if not len(data):
            return
        new_doc = doc[1:] != doc[:-1]
        line = np.cumsum(np.r_[False, (data[:-1] == 10) | new_doc])
        begins = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        ends = np.r_[begins[1:], len(line)]
        blank = np.add.reduceat((data > 32).astype(np.int64), begins) == 0
        owner = doc[begins]
        block = np.cumsum(np.r_[False, blank[1:] | blank[:-1] | (owner[1:] != owner[:-1])])
        at, p = _probabilities(data, line, model)
        of_block, q = _probabilities(data, block[line], model)
        seeds: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k in np.flatnonzero(p[:, last] < 0.5):
            seeds.setdefault(int(block[at[k]]), []).append((int(at[k]), p[k]))
        whole = {int(of_block[k]): q[k] for k in np.flatnonzero(q[:, last] < 0.5)}
        first = np.searchsorted(block, np.arange(block[-1] + 2))
        for b in sorted(seeds.keys() | whole.keys()):
            lo, hi = first[b], first[b + 1]
            lines = [data[x:y].tobytes().decode("utf-8", "replace").rstrip("\n") for x, y in zip(begins[lo:hi], ends[lo:hi], strict=True)]
            own = owner[lo]
            start = int(lo - np.searchsorted(owner, own))
            for k, n, *rest in notices(lines, [(k - lo, p) for k, p in seeds.get(b, [])], whole.get(b)):
                yield own, start + k, n, *rest

    names = [x.split()[0] for x in HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ids = b.column(0).to_pylist()
            for lo, _, data, doc in grams.chunks(b.column(1)):
                rows += [(ids[lo + own], *rest) for own, *rest in hits(data, doc)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary")).mapInArrow(run, HITS)


def describe(model: Model) -> str:
    """What a trained model is, for logs."""
    return json.dumps({"families": FAMILIES, "buckets": 1 << BITS, "used": int((model.weights != 0).any(axis=1).sum()), "temperature": model.temperature})
