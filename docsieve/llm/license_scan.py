"""Licence scans: a trained paragraph classifier with template comparison.

A paragraph is what stands between blank lines. It is looked at line by line, since notices are often one line of a text, and, if no
line is a notice, as a whole, since notices are often wrapped. What is looked at is described by its word n-grams up to three
words. A multinomial logistic regression with a lasso penalty gives the probability of each licence family and of `unknown`. It is
trained here on licence texts, on the usual sentences about the names and SPDX identifiers of licences, on the same sentences about
licences that aren't listed (which are unknown), on sentences that deny a licence (unknown too), and on other paragraphs. Probabilities
are calibrated by a temperature, fitted where whole names, listed and unlisted, were left out of training with all their sentences. What
the classifier predicts is confirmed by comparison with the templates of the family: the whole of one of its names must be there, or
most word pairs of one of its texts, and no template of another family may be nearer. The names of a confirmed family are then replaced by a mark, and the rest is judged again, so that
a line tells of all its licences, as `Apache-2.0 OR MIT` does.

Defined results: null and empty texts have no paragraphs; lines and paragraphs without words don't count; texts of any length are
scanned whole; each row is scanned by itself, null and repeated ids included; a family is reported once a paragraph, and families of
one line in the order in which they are judged, likelier first; other columns are left out; an empty table gives an empty result, and the model is then trained on the built-in paragraphs alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, table

UNKNOWN = "unknown"
#: Stands where a confirmed name stood; no word of a text has this character.
MARK = "~"
_MARK = MARK.encode()
#: Names and SPDX identifiers by family. One of them, whole, confirms a prediction.
NAMES = {
    "MIT": ("MIT License", "MIT Licence", "MIT-licensed", "Expat License", "under MIT", "License: MIT", "SPDX-License-Identifier: MIT",
            "~ or MIT", "~ and MIT", "MIT or ~", "MIT and ~", "~/MIT", "MIT/~"),
    "ISC": ("ISC License", "ISC Licence", "under ISC", "License: ISC", "SPDX-License-Identifier: ISC", "~ or ISC", "~ and ISC", "ISC or ~", "ISC and ~"),
    "BSD": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "BSD Licence",
            "BSD 3-Clause", "BSD 2-Clause", "0BSD", "License: BSD"),
    "Apache": ("Apache License, Version 2.0", "Apache License", "Apache Licence 2.0", "Apache-2.0", "Apache 2.0"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License", "GNU GPL", "GPL", "GPLv2", "GPLv3",
            "GPL-2.0-only", "GPL-3.0-or-later", "GPL, version 2 or later"),
    "LGPL": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPLv2", "LGPLv3",
             "LGPL-2.1-only", "LGPL-3.0-or-later"),
    "AGPL": ("GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0-only"),
    "MPL": ("Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPL 1.1", "MPL-1.1"),
    "CC-BY": ("CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International",
              "Creative Commons Attribution 3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0", "CC BY-SA",
                 "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License",
                 "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC", "CC BY-NC-SA", "CC BY-NC-ND", "Creative Commons Attribution-NonCommercial",
                 "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-ND": ("CC BY-ND 4.0", "CC BY-ND 3.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND",
                 "Creative Commons Attribution-NoDerivatives", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    "public-domain": ("CC0", "CC0 1.0 Universal", "CC0-1.0", "The Unlicense", "Unlicense", "Creative Commons Zero", "Creative Commons Zero v1.0 Universal", "dedicated to the public domain", "released into the public domain"),
    "all-rights-reserved": ("All rights reserved",),
}
#: Texts by family, as they are commonly written. Most word pairs of one of them confirm a prediction.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see the address of the foundation.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "CC-BY-ND": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "all-rights-reserved": (
        "Copyright by the authors. All rights reserved. No part of this publication may be reproduced, stored in a retrieval system, or "
        "transmitted in any form or by any means without the prior written permission of the publisher.",
    ),
}
#: Sentences about a licence.
SENTENCES = (
    "{}", "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "Distributed under the terms of the {}.", "This project is licensed under the {}. See the LICENSE file for details.",
    "This work is licensed under a {}.", "This software is available under the {}.", "Code in this repository is covered by the {}", "License: {}", "{}, see COPYING",
    "This file may be used under the terms of {}.", "Published under {} by its authors.", "SPDX-License-Identifier: {}",
    "license = {}", "{} OR ~", "~ OR {}", "~ and the {}", "the ~ or the {}, at your option", "Licensed under the ~ and {}.", "Dual-licensed under ~ and {}",
)
#: Sentences that deny it; whatever the licence, they are unknown.
DENIALS = (
    "This is not released under the {}.", "It is not licensed under the {}.", "not {}", "This software is not available under {}.", "no longer under the {}",
    "It is no longer licensed under the {}.", "This project is not covered by the {}", "never released under {}", "This isn't distributed under the {}.", "It isn't licensed under the {}.", "They aren't released under {}.", "~, not {}",
)
#: Licences that no family stands for; what is said about them is unknown.
UNLISTED = (
    "Eclipse Public License 2.0", "EPL-2.0", "zlib License", "Boost Software License 1.0", "BSL-1.0", "Artistic License 2.0", "European Union Public Licence", "EUPL-1.2",
    "Microsoft Public License", "MS-PL", "SIL Open Font License", "OFL-1.1", "Common Development and Distribution License", "CDDL-1.0", "Elastic License 2.0",
    "Server Side Public License", "Business Source License 1.1", "Open Database License", "ODbL-1.0", "PostgreSQL License", "Python Software Foundation License",
    "Ruby License", "PHP License 3.01", "Academic Free License", "Common Public License 1.0", "OpenSSL License", "Netscape Public License", "Sun Public License",
    "Foo License", "Acme Commercial License", "Example Public License", "Company License Agreement", "site license", "driving licence", "Proprietary", "Custom",
)
#: Paragraphs that use the words of notices, but aren't any.
OTHERS = (
    "He renewed the license of his car at the public office in version two of the form.",
    "The work of the free press was released to the general public on Monday.",
    "All seats were reserved by the authors of the program.",
    "All rights of way are reserved for walkers on the public path.",
    "A license to fish is sold at the harbour; the terms are posted at the gate.",
    "The software was distributed to the students without any conditions.",
    "She studied at MIT and worked under general conditions of stress.",
    "The team at MIT released a copy of the software to the public.",
    "The Apache helicopter was seen over the source of the river.",
    "The Apache people were granted rights to the land under the terms of a treaty.",
    "The creative commons of the village was licensed for a market in May.",
    "The BSD meeting was released from its schedule.",
    "Copy the file, modify the second line, and save it.",
    "The rights of all members are listed in the second version of the charter.",
    "The public domain of the king was mapped in four sheets.",
    "This project was done under the direction of the foundation.",
    "GNU goats and other animals may be seen in the public garden.",
    "Permission to enter is granted free of charge to any person over sixty.",
    "You may not use this file without the permission of your teacher.",
)
#: Function words: what is made of them alone is no notice.
_PLAIN = frozenset(b"a an and any as at be but by for from if in into is it its no nor not of on or other see such that the their this to was were with without you your".split())
_BLANK = re.compile(r"\n[^\S\n]*\n")


def words_of(paragraph: str) -> list[bytes]:
    return paragraph.encode().translate(ALNUM).split()


def _template(text: str) -> list[bytes]:
    """Words of a sentence that may have marks."""
    return [w for i, part in enumerate(text.split(MARK)) for w in ([_MARK] if i else []) + words_of(part)]


def grams_of(w: list[bytes]) -> set[bytes]:
    out = set(w)
    out.update(a + b" " + b for a, b in zip(w, w[1:]))
    out.update(a + b" " + b + b" " + c for a, b, c in zip(w, w[1:], w[2:]))
    return out


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]
    vocabulary: dict[bytes, int]
    weights: np.ndarray  # one row a gram, one column a family; the last family is unknown
    bias: np.ndarray
    names: dict[str, tuple[bytes, ...]]  # words joined by spaces, with one at either end
    texts: dict[str, tuple[frozenset, ...]]  # word pairs
    telling: frozenset  # words of names and texts; without any, nothing can be confirmed

    def probabilities(self, w: list[bytes]) -> np.ndarray:
        rows = [self.vocabulary[g] for g in grams_of(w) if g in self.vocabulary]
        z = self.bias + self.weights[rows].sum(axis=0)
        p = np.exp(z - z.max())
        return p / p.sum()

    def named(self, family: str, w: list[bytes]) -> list[bytes]:
        """The words with each name of the family, longest first, replaced by a mark."""
        line = b" " + b" ".join(w) + b" "
        for n in sorted(self.names[family], key=lambda n: (-len(n), n)):
            while n in line:
                line = line.replace(n, b" " + _MARK + b" ")
                if _MARK in n:  # such a name holds the mark that it becomes
                    break
        return line.split()

    def match(self, family: str, w: list[bytes]) -> float:
        """1 where a whole name of the family is there; else the largest share of a text's word pairs that the paragraph has."""
        line = b" " + b" ".join(w) + b" "
        if any(n in line for n in self.names[family]):
            return 1.0
        pairs = set(zip(w, w[1:]))
        return max((len(pairs & t) / len(t) for t in self.texts[family]), default=0.0)

    def judge(self, w: list[bytes], least: float, least_match: float) -> list[tuple[str, float, float]]:
        """(family, probability, match) of the notices: each round confirms one and marks its names, until nothing new is confirmed.
        Texts of families are much alike, so that after the first only whole names confirm."""
        out: list[tuple[str, float, float]] = []
        while not self.telling.isdisjoint(w):
            p = self.probabilities(w)
            k, second = np.argsort(-p, kind="stable")[:2]
            unknown = len(p) - 1
            if p[k] < least and unknown not in (k, second):
                # two families share what is said; one is judged with the other marked
                p = self.probabilities(self.named(self.families[second], w))
                k = p.argmax()
            family = self.families[k]
            if k == unknown or p[k] < least or family in (f for f, *_ in out) or (m := self.match(family, w)) < (1 if out else least_match):
                break
            if m < 1 and any(self.match(f, w) > m for f in self.families[:unknown] if f != family):
                break  # another family's templates are nearer
            out.append((family, float(p[k]), m))
            rest = self.named(family, w)
            if rest == w:
                break
            w = rest
        return out

    def scan(self, text: str | None, least: float = 0.5, least_match: float = 0.6) -> tuple[int, list[tuple[int, str, float, float]]]:
        """Number of paragraphs, and (paragraph, family, probability, match) of the notices in them."""
        n, out = -1, []
        for block in _BLANK.split(text or ""):
            lines = [w for w in map(words_of, block.split("\n")) if w]
            if not lines:
                continue
            n += 1
            found: dict[str, tuple] = {}
            for w in lines:
                for hit in self.judge(w, least, least_match):
                    found.setdefault(hit[0], hit)
            if not found and len(lines) > 1:
                found = {hit[0]: hit for hit in self.judge([x for w in lines for x in w], least, least_match)}
            out += [(n, *hit) for hit in found.values()]
        return n + 1, out


def _excerpts(rng: np.random.Generator, w: list[bytes], n: int) -> list[list[bytes]]:
    """The words, and longer parts of them in which some words are left out."""
    out = [w]
    for _ in range(n - 1):
        size = len(w) if len(w) < 9 else int(rng.integers(max(8, len(w) * 3 // 5), len(w) + 1))
        at = int(rng.integers(0, len(w) - size + 1))
        out.append([x for x in w[at:at + size] if rng.random() > 0.06] or w)
    return out


def _examples(rng: np.random.Generator, negatives: list[str]) -> list[tuple[set[bytes], int, bool]]:
    """(grams, family, left out of the fit that calibrates): a quarter of the names, with all that is said about them, and of other lines."""
    unknown = len(NAMES)
    held = lambda: bool(rng.random() < 0.25)
    out = []

    def say(name: str, k: int, sentences: tuple, left_out: bool) -> None:
        out.extend((grams_of(_template(s.format(name))), k, left_out) for s in sentences)

    for k, family in enumerate(NAMES):
        for i, name in enumerate(NAMES[family]):
            left_out = i > 0 and held()
            if name.startswith(("under ", "License:", "SPDX")) or MARK in name:
                say(name, k, ("{}",) * 4 + ("Released {}.", "This is {}"), left_out)
            else:
                say(name, k, SENTENCES, left_out)
            say(name, unknown, DENIALS, left_out)
        for text in TEXTS[family]:
            out += [(grams_of(e), k, False) for e in _excerpts(rng, words_of(text), 12)]
    for name in UNLISTED:
        say(name, unknown, SENTENCES, held())
    say(MARK, unknown, SENTENCES, False)
    for text in OTHERS:
        out += [(grams_of(e), unknown, False) for e in _excerpts(rng, words_of(text), 8)]
    return out + [(grams_of(w), unknown, held()) for w in map(words_of, negatives) if w]


def _regression(grams: list[tuple], y: np.ndarray, n: np.ndarray, names: int, classes: int, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial regression with a lasso penalty, by accelerated proximal steps over sparse rows; row i counts
    n[i] times. The bias is the weight of a gram that all rows have, free of the penalty."""
    size = np.array([len(g) + 1 for g in grams])
    column = np.array([c for g in grams for c in (*g, names)])
    row = np.repeat(np.arange(len(grams)), size)
    starts = np.cumsum(size) - size
    order = np.argsort(column, kind="stable")
    by_column, (used, firsts) = row[order], np.unique(column[order], return_index=True)
    target = np.eye(classes, dtype=np.float32)[y]
    # families have unlike numbers of examples; each counts as much as its square root
    share = (n / np.sqrt(np.maximum(1, np.bincount(y, n, classes)))[y]).astype(np.float32)[:, None]
    share /= share.sum()
    w = np.zeros((names + 1, classes), np.float32)
    w[-1, -1] = 1.0
    rate = 2.0 / max(1.0, float(size.mean() - 1) / 2)
    least = np.full((names + 1, 1), rate * penalty, np.float32)
    least[-1] = 0
    ahead, t = w, 1.0
    for _ in range(rounds):
        z = np.add.reduceat(ahead[column], starts, axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - target) * share
        new = ahead.copy()
        new[used] -= rate * np.add.reduceat(e[by_column], firsts, axis=0)
        new = np.sign(new) * np.maximum(np.abs(new) - least, 0)
        if float(((ahead - new) * (new - w)).sum()) > 0:
            t = 1.0  # the step went too far: speed is given up
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / later) * (new - w)
        w, t = new, later
    return w[:-1], w[-1]


def fit(negatives: list[str], seed: int = 3, rounds: int = 400, penalty: float = 2e-5) -> LicenseModel:
    """The model: fitted once without the names that are left out, for the temperature, and once with all."""
    families = (*NAMES, UNKNOWN)
    joined = {f: tuple(b" " + b" ".join(_template(n)) + b" " for n in ns) for f, ns in NAMES.items()}
    pairs = {f: tuple(frozenset(zip(v, v[1:])) for v in map(words_of, ts)) for f, ts in TEXTS.items()}
    telling = frozenset(v for ts in (*NAMES.values(), *TEXTS.values()) for t in ts for v in words_of(t)) - _PLAIN
    plain = LicenseModel(families, {}, np.zeros((0, len(families)), np.float32), np.zeros(len(families), np.float32), joined, pairs, telling)
    # a line that a template confirms may be a notice, so it is no example of what isn't
    negatives = [t for t in negatives if all(plain.match(f, words_of(t)) < 0.6 for f in NAMES)]
    data = _examples(np.random.default_rng(seed), negatives)
    # grams of notices only; what else a paragraph holds says nothing
    count: dict[bytes, int] = {}
    for g, k, _ in data:
        if k < len(families) - 1:
            for x in g:
                count[x] = count.get(x, 0) + 1
    for s in DENIALS:
        for g in grams_of(_template(s.format(""))):
            count[g] = count.get(g, 0) + 3
    names = sorted(x for x, n in count.items() if n >= 3)
    number = {x: i for i, x in enumerate(names)}
    rows: dict[tuple, int] = {}
    for g, k, left_out in data:
        key = (tuple(sorted(number[x] for x in g if x in number)), k, left_out)
        rows[key] = rows.get(key, 0) + 1
    grams, n = [g for g, *_ in rows], np.array(list(rows.values()), float)
    y, test = np.array([k for _, k, _ in rows]), np.array([o for *_, o in rows])
    w, b = _regression([g for g, o in zip(grams, test) if not o], y[~test], n[~test], len(names), len(families), rounds, penalty)
    z = np.array([w[list(g)].sum(axis=0) + b for g, o in zip(grams, test) if o])

    def loss(t: float) -> float:
        s = z * t
        s = s - s.max(axis=1, keepdims=True)
        return float(-((s[np.arange(len(s)), y[test]] - np.log(np.exp(s).sum(axis=1))) * n[test]).sum())

    scale = min(np.linspace(0.5, 6, 56), key=loss)
    w, b = _regression(grams, y, n, len(names), len(families), rounds, penalty)
    keep = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    return LicenseModel(families, {names[i]: k for k, i in enumerate(keep)}, w[keep] * scale, b * scale, joined, pairs, telling)


def negatives(docs: DataFrame, id_col: str, text_col: str, documents: int = 200, paragraphs: int = 2000, longest: int = 2000) -> list[str]:
    """Lines, of `longest` characters at most, of a bounded sample of documents. `fit` leaves out those that a template confirms; nobody
    has labelled them."""
    ids = docs.select(id_col).distinct().orderBy(F.xxhash64(id_col)).limit(documents)
    lines = (docs.join(F.broadcast(ids), id_col, "left_semi").select(F.explode(F.split(text_col, "\n")).alias("line"))
             .where(F.length("line").between(1, longest)).orderBy(F.xxhash64("line")).limit(paragraphs))
    return [r["line"] for r in lines.collect()]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """One row a document: id, n_paragraphs, notices (paragraph, family, probability, match)."""
    model = model or fit(negatives(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.families, model.vocabulary, model.weights, model.bias, model.names, model.texts, model.telling))
    kind = docs.schema[id_col].dataType.simpleString()
    notice = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("match", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LicenseModel(*shared.value)
        for b in batches:
            found = [own.scan(t.as_py()) for t in b.column(1)]
            rows = [[dict(zip(("paragraph", "family", "probability", "match"), x)) for x in f] for _, f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(rows, notice)],
                                             ["id", "n_paragraphs", "notices"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_paragraphs long, notices array<struct<paragraph:int,family:string,probability:double,match:double>>")
    return out.withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))), ",").alias("families"),
                        F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["paragraph"], x["family"])), ",").alias("notices"))
