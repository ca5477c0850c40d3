"""Licence scan with a positional rare-token index.

The texts are read once. That pass splits a text into words, finds the places of the base phrases, the licence words (a fixed vocabulary:
all words of the templates) that the file holds, and the templates whose mandatory key phrase stands in it; only for files with such
a phrase it keeps the sequence of licence words. Summing the first over all files gives each licence word's document frequency and
thereby its IDF.

A file's licence words are then ranked by IDF and looked up from the highest down in an index from word to (template, position). A
template of n words may differ from a file by d = floor((1 - coverage) * n) word edits, so that at least one of its d + 1 rarest
places is found unchanged; the lookup ends when that holds for every template that can still occur. Of the P places of a template that
have been looked up then, at least P - d must agree about where the template begins, up to d words: the postings are
intersected by relative position. Where they do, the template is aligned with the stretch around that place; the best alignments
of at most d edits, with a key phrase inside, give the label, and 1 - edits / n the score. No step but the last verification
rejects a place that the full alignment of all templates would accept.

Cases: null is the empty text (no words, null places, empty labels, score 0); ties between words of one IDF go by the word;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.common import text_or_empty, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
    "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or "
    "the use or other dealings in the software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions "
    "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution"
)
BSD_WARRANTY = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
    "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
    "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
FREE = "this program is free software you can redistribute it and or modify it under the terms of the"
FSF = "as published by the free software foundation either version"
USEFUL = (
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
    "fitness for a particular purpose see the"
)

#: Label, words, mandatory key phrases (any one of them). Public licence texts where they are short, else the notice
#: that the licence asks to be put into files.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
     "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
     "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
     "conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
     + WARRANTY, ["obtaining a copy of this software and associated documentation files"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
     "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
     "sublicense and or sell copies of the software", ["obtaining a copy of this software and associated documentation files"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
     "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
     "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
     "license for the specific language governing permissions and limitations under the license", ["apache license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", f"{FREE} gnu general public license {FSF} 2 of the license or at your option any later version {USEFUL} gnu general public license for "
     "more details", ["gnu general public license"]),
    ("gpl", f"{FREE} gnu general public license {FSF}", ["gnu general public license"]),
    ("lgpl", f"{FREE.replace('program', 'library')} gnu lesser general public license {FSF} 2 1 of the license or at your option any later version",
     ["gnu lesser general public license"]),
    ("agpl", f"{FREE} gnu affero general public license {FSF} 3 of the license or at your option any later version",
     ["gnu affero general public license"]),
    ("bsd-2-clause", f"{BSD} {BSD_WARRANTY}", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", f"{BSD} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     f"derived from this software without specific prior written permission {BSD_WARRANTY}", ["endorse or promote products derived from"]),
    ("bsd", BSD, ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
     "above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
     "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and "
     "to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must "
     "not claim that you wrote the original software", ["the origin of this software must not be misrepresented"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
     "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
     ["free and unencumbered software"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare "
     "derivative works of the software", ["use reproduce display distribute execute and transmit"]),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as "
     "the name is changed", ["changing it is allowed as long as the name is changed"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
     "you can obtain one at http mozilla org mpl 2 0", ["mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0",
     ["eclipse public license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
     ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4", "commons attribution international"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ["commons attribution sharealike", "commons attribution share alike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ["commons attribution noncommercial", "commons attribution non commercial"]),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written "
     "agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
     ["without a written agreement is hereby granted"]),
]

FACTS = "n_words long, n_base long, first_word long, last_word long, base_labels string, held array<short>, possible array<short>, codes array<short>"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def starts(words: list[str], phrase: list[str], ends: dict[str, list[int]]) -> list[int]:
    """Where the phrase's words stand consecutively; ``ends`` has the positions of every last word."""
    n = len(phrase)
    return [i - n + 1 for i in ends.get(phrase[-1], ()) if i - n + 1 >= 0 and words[i - n + 1 : i + 1] == phrase]


class Templates:
    """The templates as codes of the licence words, which are numbered by the alphabet."""

    def __init__(self, templates, coverage: float):
        self.labels = [label for label, _, _ in templates]
        self.vocabulary = sorted({w for _, t, keys in templates for w in f"{t} {' '.join(keys)}".split()})
        self.code = {w: i for i, w in enumerate(self.vocabulary)}
        self.words = [np.array([self.code[w] for w in t.split()]) for _, t, _ in templates]
        self.key_texts = [[f" {k} " for k in keys] for _, _, keys in templates]
        self.keys = [[np.array([self.code[w] for w in k.split()]) for k in keys] for _, _, keys in templates]
        self.edits = [int((1 - coverage) * len(t) + 1e-9) for t in self.words]


def edits_by_end(template: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """For every word of the stretch the edits between the template and the best part that ends there (its start is free)."""
    col = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)
    for i, w in enumerate(template):
        new = np.r_[i + 1, np.minimum(row[1:] + 1, row[:-1] + (stretch != w))]
        row = np.minimum.accumulate(new - col) + col
    return row[1:]


def places_of(phrase: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    n = len(stretch) - len(phrase) + 1
    return np.flatnonzero(np.all([stretch[j : j + n] == w for j, w in enumerate(phrase)], axis=0)) if n > 0 else np.empty(0, int)


def accepted(t: Templates, k: int, stretch: np.ndarray) -> int | None:
    """The least edits (at most d) of template k in a stretch with a key phrase among the n + d words up to the end, else None."""
    n, d = len(t.words[k]), t.edits[k]
    edits = edits_by_end(t.words[k], stretch)
    has = np.zeros(len(stretch), bool)
    for key in t.keys[k]:
        for at in places_of(key, stretch):
            has[at + len(key) - 1 : at + n + d] = True
    found = edits[has & (edits <= d)]
    return int(found.min()) if len(found) else None


class RareTokenIndex:
    """Postings of every licence word, ranked by IDF (most telling first). Its size is that of the templates."""

    def __init__(self, t: Templates, df: dict[int, int]):
        order = sorted(range(len(t.vocabulary)), key=lambda c: (df.get(c, 0), t.vocabulary[c]))
        self.t, self.rank = t, np.empty(len(order), int)
        self.rank[order] = np.arange(len(order))
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(t.words):
            for at, c in enumerate(words.tolist()):
                self.postings[c].append((k, at))
        #: by template, the ranks of its places, rarest first
        self.ranks = [np.sort(self.rank[w]) for w in t.words]

    def matches(self, codes: np.ndarray, possible: list[int]) -> dict[int, float]:
        """The score of every template (of the possible ones) that occurs in a file of these licence words (-1: any other)."""
        t, out = self.t, {}
        last = max(self.ranks[k][t.edits[k]] for k in possible)  # the d + 1st rarest place of each
        held = np.unique(codes[codes >= 0])
        looked_up = held[self.rank[held] <= last]
        shifts: dict[int, list[np.ndarray]] = {k: [] for k in possible}
        for c in looked_up[np.argsort(self.rank[looked_up])]:
            at_file = np.flatnonzero(codes == c)
            for k, at in self.postings[int(c)]:
                if k in shifts:
                    shifts[k].append(at_file - at)
        for k in possible:
            if not shifts[k]:
                continue
            n, d = len(t.words[k]), t.edits[k]
            s = np.sort(np.concatenate(shifts[k]))
            votes = np.searchsorted(s, s + 2 * d, side="right") - np.arange(len(s))  # of places that agree up to d words
            begins = s[votes >= np.searchsorted(self.ranks[k], last, side="right") - d]
            if not len(begins):
                continue
            # places close together are aligned in one stretch, which holds every alignment that they can mean and the key before its end
            gap = np.flatnonzero(np.diff(begins) > 2 * n)
            for lo, hi in zip(np.r_[begins[0], begins[gap + 1]], np.r_[begins[gap], begins[-1]]):
                edits = accepted(t, k, codes[max(0, int(lo) - 3 * d) : int(hi) + n + 2 * d])
                if edits is not None:
                    out[k] = max(out.get(k, 0.0), 1 - edits / n)
        return out


def licence_facts(docs: DataFrame, t: Templates, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with the columns of FACTS: base places and labels, the licence words held, the templates with a key phrase, and for
    files that have one the code of each word."""
    split = [(p.split(), label) for p, label in phrases.items()]
    lasts = {p[-1] for p, _ in split}

    @F.pandas_udf(FACTS)
    def facts(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = words_of(text)
            held = t.code.keys() & set(words)
            places, base = [], set()
            if not lasts.isdisjoint(held):
                ends: dict[str, list[int]] = defaultdict(list)
                for i, w in enumerate(words):
                    if w in lasts:
                        ends[w].append(i)
                for p, label in split:
                    if at := starts(words, p, ends):
                        places += at
                        base.add(label)
            joined = f" {' '.join(words)} "
            possible = [k for k, keys in enumerate(t.key_texts) if any(key in joined for key in keys)]
            codes = [t.code.get(w, -1) for w in words] if possible else None
            out.append((
                len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                [t.code[w] for w in held], possible, codes,
            ))
        made = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "held", "possible", "codes"])
        return made.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(id_col), facts(text_or_empty(text_col)).alias("r")).select(id_col, "r.*")


def document_frequency(facts: DataFrame) -> dict[int, int]:
    """Files that hold each licence word; the driver gets one number a word of the fixed vocabulary."""
    return {r.code: r.n for r in facts.select(F.explode("held").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, coverage: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's id, n_words, n_base, first_word, last_word, base_labels, labels and score (of the best template); ``coverage``: least score
    of a label."""
    t = Templates(templates, coverage)
    facts = written(licence_facts(docs, t, phrases, id_col, text_col), "licence")
    index = RareTokenIndex(t, document_frequency(facts))

    @F.pandas_udf("labels string, score double")
    def scan(base: pd.Series, possible: pd.Series, codes: pd.Series) -> pd.DataFrame:
        out = []
        for b, p, c in zip(base, possible, codes):
            found = index.matches(np.asarray(c), [int(k) for k in p]) if len(p) else {}
            labels = {x for x in b.split(",") if x} | {t.labels[k] for k in found}
            out.append((",".join(sorted(labels)), max(found.values(), default=0.0)))
        return pd.DataFrame(out, columns=["labels", "score"])

    done = facts.withColumn("s", scan("base_labels", "possible", "codes"))
    return done.select(id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "s.labels", "s.score")
