"""Licence scans with a positional rare-token index.

A licence template is a sequence of words with a mandatory key phrase inside it: a sentence, a file header or a whole
text. The index holds, for each template, the offsets of its rarest words by inverse document frequency over all
documents, and of the rarest word of its key phrase. A file's occurrences of those words vote for the place where the
template would start (position minus offset). A start with half of the rare words, or with the key phrase's own, is
looked at: it holds if the key phrase stands whole and the share of the template's words that the text has in order
reaches the template's minimum. So whatever has the key phrase whole is looked at, however its other words changed, and
words that were put in or left out elsewhere shift nothing. The base phrases are templates that must stand whole, found
through their single rarest word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.storage import bound_batches, lean, pieces

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rare words indexed for each template, and the least share of a template's words that must agree.
RARE, SHARE = 3, 0.75
#: Base phrases by label.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: Label, words of a public licence notice, its mandatory key phrase.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person obtaining a copy of this"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
]
#: Label, file header or text of a public licence without names and dates, its mandatory key phrase.
TEXTS = [
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        "you may not use this file except in compliance with the license",
    ),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        "gnu general public license as published by the free software foundation either version 2 of the license",
    ),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
        "gnu general public license as published by the free software foundation either version 3 of the license",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
        License for more details.""",
        "gnu lesser general public license as published",
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
        for more details.""",
        "gnu affero general public license as published",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "subject to the terms of the mozilla public license",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "to deal in the software without restriction",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        "with or without fee is hereby granted provided that",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED.""",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
        "may be used to endorse or promote products derived from this software",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software.""",
        "the origin of this software must not be misrepresented",
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so""",
        "any person or organization obtaining a copy of the software and accompanying documentation",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        "free and unencumbered software released into the public domain",
    ),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: tuple[bytes, ...]
    base: bool = False
    share: float = SHARE

    @cached_property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)

    def agreement(self, words: list[bytes], start: int) -> int:
        """How many of the template's words the text has in order, where its key phrase stands as if it began at ``start``.

        Words are compared place by place; if too few agree, the words before and after the key phrase are aligned by
        longest common blocks with as many words again as a tenth of the template.
        """
        size = len(self.words)
        agree = sum(1 for i in range(max(0, -start), min(size, len(words) - start)) if words[start + i] == self.words[i])
        if agree >= self.share * size:
            return agree
        more, key, after = size // 10, start + self.key_at, self.key_at + len(self.key)
        sides = (self.words[: self.key_at], words[max(0, start - more) : key]), (self.words[after:], words[start + after : start + size + more])
        return len(self.key) + sum(b.size for a, w in sides for b in SequenceMatcher(None, a, w, autojunk=False).get_matching_blocks())


def templates() -> list[Template]:
    cut = lambda text: tuple(words_of(text))
    return [Template(k, cut(v), cut(v), True, 1.0) for k, v in BASE.items()] + [Template(k, cut(v), cut(key)) for k, v, key in NOTICES + TEXTS]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """(documents that have each word of the templates, documents), over all rows. The result is bounded by the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in pieces(batches):
            found[b""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                found.update(vocabulary.intersection(words_of(text)))
        yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts, counts.pop(b"", 0)


class Index:
    """Postings of the rare words: word -> (template, offset), by descending inverse document frequency."""

    def __init__(self, found: list[Template], counts: dict[bytes, int], n: int):
        self.templates = found
        #: word -> (template, offset, does it lie in the key phrase as its rarest word)
        self.postings: dict[bytes, list[tuple[int, int, bool]]] = {}
        self.votes = []
        idf = lambda w: math.log((n + 1) / (counts.get(w, 0) + 1))
        for t, template in enumerate(found):
            once = [i for i, w in enumerate(template.words) if template.words.index(w) == i]
            first, after = template.key_at, template.key_at + len(template.key)
            key = min(range(first, after), key=lambda i: (-idf(template.words[i]), i))
            rare = sorted(once, key=lambda i: (-idf(template.words[i]), i))[: 1 if template.base else RARE]
            self.votes.append((len(rare) + 1) // 2)
            for word in {template.words[i] for i in [key, *rare]}:
                for at in (at for at, w in enumerate(template.words) if w == word):
                    self.postings.setdefault(word, []).append((t, at, at == key))
        self.look = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, bool, float]]:
        """(label, start, end, is it a base phrase, share of words that agree) of every hold."""
        if self.look.isdisjoint(words):
            return []
        votes: Counter = Counter()
        for at, word in enumerate(words):
            if word in self.look:
                for t, offset, in_key in self.postings[word]:
                    votes[t, at - offset] += len(self.templates[t].words) if in_key else 1
        out = []
        for (t, start), n in votes.items():
            template = self.templates[t]
            if n < self.votes[t]:
                continue
            key = start + template.key_at
            if key < 0 or tuple(words[key : key + len(template.key)]) != template.key:
                continue
            size = len(template.words)
            agree = size if template.base else template.agreement(words, start)
            if agree >= template.share * size:
                out.append((template.label, max(start, 0), min(start + size, len(words)), template.base, agree / size))
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame) -> DataFrame:
    """Licence holds of every row of ``docs(doc_id, text)``.

    n_words; n_base, first_word, last_word: number of places where a base phrase stands and the smallest and largest
    of their starts in words from 0 (null where there is none); base_labels and labels (all templates'): distinct,
    sorted, comma-joined; score: the best share of a template's words that agree, 0 where nothing holds; holds: all
    of them in order of place. A null text is empty, a text of any length is scanned whole, and an empty table gives an
    empty result. Every row gives a row, repeated or not; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = templates()
    counts, n = document_frequencies(rows, frozenset(w for t in found for w in t.words))
    index = Index(found, counts, n)
    hold = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                holds = index.scan(words)
                base = [h for h in holds if h[3]]
                out.append(
                    (
                        len(words),
                        len(base),
                        base[0][1] if base else None,
                        base[-1][1] if base else None,
                        ",".join(sorted({h[0] for h in base})),
                        ",".join(sorted({h[0] for h in holds})),
                        max((h[4] for h in holds), default=0.0),
                        [dict(zip(("label", "start", "end", "base", "share"), h)) for h in holds],
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), hold]
            columns = list(zip(*out)) or [()] * 8
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "holds"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lean(run),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "holds array<struct<label:string,start:bigint,end:bigint,base:boolean,share:double>>",
    )
