"""Licence scan by a positional index of rare words.

Each template is a run of words with its label and the key phrases that it must
hold.  The words of all templates get their inverse document frequency from the
whole corpus, and postings: in which template's anchor phrase, and where there.
A file's licence words are looked up from the highest IDF on.  The postings of
one template are intersected by relative position, that is, by where its anchor
phrase would begin; each place that all of the looked-up words agree on is a
candidate.  It is verified: key phrases word by word, the rest by the weight of
the words that stand around it in the template's order.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Longer notices, each with the key phrases it must hold word by word.
NOTICES = (
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission", ("all rights reserved",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    ("bsl-1", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("boost software license",)),
    ("wtfpl", "do what the fuck you want to public license", ("what the fuck you want to public license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("the above copyright notice and this permission notice shall be included",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain the above copyright notice",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("governing permissions and limitations under the license",)),
    ("gpl-2-or-later", "either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("version 2 of the license or at your option any later version",)),
    ("gpl-3-or-later", "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("version 3 of the license or at your option any later version",)),
)

_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool


def templates() -> list[Template]:
    made = [Template(label, tuple(words_of(text)), (tuple(words_of(text)),), True) for label, text in BASE.items()]
    return made + [Template(label, tuple(words_of(text)), tuple(tuple(words_of(key)) for key in keys), False) for label, text, keys in NOTICES]


def _places(words: list[bytes], phrase: tuple[bytes, ...], low: int, high: int) -> bool:
    """Whether the phrase stands somewhere within words[low:high]."""
    n = len(phrase)
    return any(tuple(words[at : at + n]) == phrase for at in range(max(0, low), min(high, len(words)) - n + 1))


def weight_in_order(template: tuple[bytes, ...], words: list[bytes], idf: dict[bytes, float]) -> float:
    """The greatest weight of template words that stand in these words in the template's order."""
    found = np.array(words, object)
    best = np.zeros(len(words) + 1)
    for word in template:
        best[1:] = np.maximum(best[1:], best[:-1] + idf[word] * (found == word))
        best = np.maximum.accumulate(best)
    return float(best[-1])


class PositionalIndex:
    """Postings of the words of each template's anchor phrase, and the look-up of a file in them.

    The anchor is the key phrase of the greatest IDF.  A template's words stand
    in a file with up to ``slack`` words more or fewer on either side.
    """

    def __init__(self, idf: dict[bytes, float], rare_words: int = 3, least: float = 0.7, slack: int = 6):
        self.templates, self.idf, self.rare_words, self.least, self.slack = templates(), idf, rare_words, least, slack
        self.anchor = [max(template.keys, key=lambda key: (sum(map(idf.__getitem__, key)), key)) for template in self.templates]
        self.offset = [next(at for at in range(len(x.words)) if x.words[at : at + len(key)] == key) for x, key in zip(self.templates, self.anchor, strict=True)]
        self.needed = [frozenset(w for key in template.keys for w in key) for template in self.templates]
        self.weight = [sum(map(idf.__getitem__, template.words)) for template in self.templates]
        self.postings: dict[bytes, dict[int, list[int]]] = {word: {} for word in idf}
        for t, key in enumerate(self.anchor):
            for position, word in enumerate(key):
                self.postings[word].setdefault(t, []).append(position)
        # Highest IDF first; words of one IDF in their own order.
        self.ranked = sorted(idf, key=lambda w: (-idf[w], w))
        self.place_of = {word: k for k, word in enumerate(self.ranked)}
        self.vocabulary = frozenset(idf)

    def candidates(self, t: int, rarest_first: list[bytes], positions: dict[bytes, list[int]]) -> list[int]:
        """Where the anchor of template t may begin: what the postings of the file's rarest words agree on."""
        agreed: set[int] | None = None
        looked_up = [w for w in rarest_first if t in self.postings[w]][: self.rare_words]
        for word in looked_up:
            starts = {at - relative for at in positions[word] for relative in self.postings[word][t]}
            agreed = starts if agreed is None else agreed & starts
            if not agreed:
                break
        return sorted(agreed or ())

    def share(self, t: int, words: list[bytes], at: int) -> float:
        """How much of template t, by weight, stands around its anchor at ``at``; 0 if a key phrase lacks."""
        template = self.templates[t]
        start = at - self.offset[t]
        low, high = max(0, start - self.slack), start + len(template.words) + self.slack
        if not all(_places(words, key, low, high) for key in template.keys):
            return 0.0
        return min(1.0, weight_in_order(template.words, words[low:high], self.idf) / self.weight[t])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """Base places (start, label), labels of all kinds, and the best share of a template's weight."""
        held = self.vocabulary.intersection(words)
        possible = [t for t, needed in enumerate(self.needed) if needed <= held]
        if not possible:
            return [], set(), 0.0
        rarest_first = sorted(held, key=self.place_of.__getitem__)
        wanted = {w for t in possible for w in self.anchor[t]}
        positions: dict[bytes, list[int]] = defaultdict(list)
        for position, word in enumerate(words):
            if word in wanted:
                positions[word].append(position)
        places, labels, best = set(), set(), 0.0
        for t in possible:
            template, anchor = self.templates[t], self.anchor[t]
            for at in self.candidates(t, rarest_first, positions):
                if at < 0 or tuple(words[at : at + len(anchor)]) != anchor:
                    continue
                if template.base:
                    places.add((at, template.label))
                    labels.add(template.label)
                    best = 1.0
                elif template.label not in labels or best < 1.0:
                    share = self.share(t, words, at)
                    if share >= self.least:
                        labels.add(template.label)
                        best = max(best, share)
        return sorted(places), labels, best


def word_idf(docs: DataFrame, *, text_col: str = "text") -> dict[bytes, float]:
    """IDF of the templates' words over all documents; as many rows as the templates have words."""
    vocabulary = frozenset(w for template in templates() for w in template.words)
    source = docs.select(F.col(text_col).alias("text"))

    def run(batches):
        counts, rows = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    for word in vocabulary.intersection(words_of(text)):
                        counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*counts, b""], pa.binary()), pa.array([*counts.values(), rows], pa.int64())], names=["word", "docs"])

    counted = {bytes(word): n for word, n in source.mapInArrow(run, "word binary, docs bigint").groupBy("word").agg(F.sum("docs")).collect()}
    rows = counted.get(b"", 0)
    return {word: math.log((1 + rows) / (1 + counted.get(word, 0))) + 1e-3 for word in vocabulary}


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rare_words: int = 3, least: float = 0.7, slack: int = 6) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row's whole text.

    n_base counts all places of base phrases; first_word and last_word are their
    smallest and largest start (null without any).  A null or empty text has no
    words, no labels (empty strings) and score 0.  Repeated rows are scanned
    each, and so is a row without doc_id; an empty table gives no rows; other
    columns are not read.

    rare_words: of how many of a file's highest-IDF words the postings of a
    template are intersected.  least: share of a notice's weight that must stand
    around its key phrases, in order, with up to ``slack`` words more on a side.
    score is the greatest such share, 1 for a base phrase.
    """
    index = PositionalIndex(word_idf(docs, text_col=text_col), rare_words, least, slack)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text) if text else []
                places, labels, score = index.scan(words)
                base = sorted({label for _, label in places})
                rows.append((len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted(labels)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True))], names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
