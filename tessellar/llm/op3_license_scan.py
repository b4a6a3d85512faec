"""License scans: base phrases by position and license notices by an exact set-similarity join.

A text block matches a template when it contains at least `threshold` of the template's distinct
words. Blocks are the paragraphs between blank lines for whole notices, and the lines for one-line
statements. As published notices go over several paragraphs and statements are wrapped, the words
around each blank line or line break are a block too: as many before and after it as the template
has, over further breaks. Such a block has the number of the paragraph or line before the break, and
is left out where one of those two has as good a match itself. Statements of fewer than WRAPPED_WORDS
words are looked for within a line only. The words of all templates are put in one global
order, rarest first, by their document frequency over the whole corpus, counted in a first pass.
Then, for a template of n words of which r = ceil(threshold * n) are needed:

- prefix filter: a matching block holds one of the template's n - r + 1 rarest words;
- length filter: it has at least r distinct words;
- positional filter: while the template's words are looked up in order, the search ends as soon as
  hits so far plus words still to come fall below r.

A text whose words as a whole don't match a template has no matching block. All are exact, so every matching block is found. The index of templates is a parameter, not
data: it doesn't grow with the corpus. Two map-only passes; the only exchange sums frequencies of
template words (a few hundred rows).

Defined cases: null text is empty (no words, no labels, score 0); a very long text is scanned whole; of
blocks with equal scores all are reported, in order of place; a label found more than once stands once;
repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import slices, table, texts_of

THRESHOLD = 0.8
#: Phrase -> label; fixed values of the query.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license notices; label -> text.
NOTICES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-notice": "This work is licensed under a Creative Commons Attribution International License. To view a copy of this license, visit creativecommons org licenses",
    "warranty-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
}

#: Public one-line license statements; label -> text.
LINES = {
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "mit-line": "Released under the MIT License",
    "reserved-line": "All rights reserved",
}

#: Words of a statement from which it is looked for over line breaks too; words as near as those of a shorter one may be chance.
WRAPPED_WORDS = 4

#: Bytes of words stay, A-Z in lower case; the rest become spaces. Non-ASCII characters are words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANK_LINE = re.compile(rb"\n[ \t\r\f\v]*\n")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split(None)


def base_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start, label) of every phrase, in order of phrases."""
    found = []
    for phrase, label in phrases:
        at = -1
        last, n = phrase[-1], len(phrase)
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            if at >= n - 1 and words[at - n + 1 : at + 1] == phrase:
                found.append((at - n + 1, label))
    return found


class TemplateIndex:
    """Templates with their words in global order, and the prefixes' inverted index."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.templates, self.prefixes, self.lengths = [], {}, {}
        for label, text in sorted(templates.items()):
            every = words_of(text.encode())
            words = sorted(set(every), key=lambda w: (frequency.get(w, 0), w))
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            for w in words[: len(words) - need + 1]:
                self.prefixes.setdefault(w, []).append(len(self.templates))
            self.templates.append((label, words, need))
            self.lengths[label] = len(every)

    def matches(self, block: set[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block meets."""
        out = []
        for k in sorted({k for w in block & self.prefixes.keys() for k in self.prefixes[w]}):
            label, words, need = self.templates[k]
            if len(block) < need:
                continue
            hits, ahead = 0, len(words)
            for w in words:
                ahead -= 1
                hits += w in block
                if hits + ahead < need:
                    break
            else:
                out.append((label, hits / len(words)))
        return out


def blocks_found(index: TemplateIndex, blocks: list[bytes], least: int = 1) -> list[dict]:
    """Matches of the blocks, and of the words around the breaks between them for templates of `least` words or more."""
    split = [words_of(block) for block in blocks]
    words = list(chain.from_iterable(split))
    possible = [label for label, _ in index.matches(set(words))]
    if not possible:
        return []
    own = [dict(index.matches(set(block))) for block in split]
    found = [{"label": label, "block": k, "containment": c} for k, of in enumerate(own) for label, c in of.items()]
    filled = [k for k, block in enumerate(split) if block]
    at = 0
    for k, after in zip(filled, filled[1:], strict=False):
        at += len(split[k])
        for label in possible:
            n = index.lengths[label]
            if n < least:
                continue
            for other, c in index.matches(set(words[max(at - n, 0) : at + n])):
                if other == label and c > max(own[k].get(label, 0.0), own[after].get(label, 0.0)):
                    found.append({"label": label, "block": k, "containment": c})
    return found


def word_frequencies(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each word of the bounded vocabulary."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in texts_of(part, 0):
                    total.update(vocabulary.intersection(words_of(text.encode())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}  # at most one row for each template word


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, lines: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, n_words, places (array of start, label) and blocks (array of label, number of the block, containment)."""
    templates, lines = NOTICES if templates is None else templates, LINES if lines is None else lines
    split = [(words_of(p.encode()), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    vocabulary = {w for t in [*templates.values(), *lines.values()] for w in words_of(t.encode())}
    frequency = word_frequencies(docs, text_col, vocabulary)
    indexes = [(TemplateIndex(templates, frequency, threshold), _BLANK_LINE.split, 1), (TemplateIndex(lines, frequency, threshold), bytes.splitlines, WRAPPED_WORDS)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                n_words, places, blocks = [], [], []
                for text in texts_of(part, 1):
                    raw = text.encode()
                    words = words_of(raw)
                    n_words.append(len(words))
                    places.append([{"start": at, "label": label} for at, label in base_places(words, split)])
                    found = []
                    for index, split_blocks, least in indexes:
                        if not index.prefixes.keys().isdisjoint(words):
                            found += blocks_found(index, split_blocks(raw), least)
                    blocks.append(found)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(pa.struct({"start": pa.int64(), "label": pa.string()}))), pa.array(blocks, pa.list_(pa.struct({"label": pa.string(), "block": pa.int64(), "containment": pa.float64()})))], ["id", "n_words", "places", "blocks"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_words long, places array<struct<start:long,label:string>>, blocks array<struct<label:string,block:long,containment:double>>").withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One flat row a document; score 1 for a base phrase, else the best containment, else 0."""
    joined = lambda labels: F.concat_ws(",", F.sort_array(F.array_distinct(labels)))
    base, own = F.col("places.label"), F.col("blocks.label")
    return scanned.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(license_scan(table(spark, sf_dir, "documents")))
