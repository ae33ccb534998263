"""Licence notices in whole texts: a positional index of the rarest licence words.

Templates are short public notices.  Their words are counted over all documents (how many hold each), which gives every
licence word its inverse document frequency and every place of a template a weight.  A notice is confirmed where places
of at least ``SHARE`` of its template's weight hold their words, up to ``SHIFT`` words off, and its mandatory phrases
stand word for word within.  So of the rarest places that weigh more than the rest of the share together, one must
be there, and two of those that weigh more than that and the heaviest place.  The index has postings (template, position)
of these places alone; a text looks up its words among them, each place of a posting votes for a beginning of its
template, and beginnings with enough votes within ``SHIFT`` words are compared whole.  Nothing that comparing everything
would confirm is lost.  Three phrases that are looked for everywhere (``BASE``) come first.

Work on texts is one narrow map; only the count of licence words is shuffled (one row of bounded length a task),
and only the index is sent out (some hundred postings, whatever the corpus holds).  Nothing is capped: every place of an
indexed word is looked at, in slices.

Defined results: words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; a null or empty text
has no words, no labels and score 0; the score is 1 with a place of ``BASE``, else the best share of a confirmed notice, else 0;
repeated rows give repeated results; with no document that holds a licence word every frequency is 0 and nothing is found;
an empty table gives no rows; further columns pass through, the new ones replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import wordhash
from canvass.llm.storage import documents

SHIFT, SHARE = 3, 0.75
#: Beginnings whose template words are compared at once.
SLICE = 2048

#: Phrases that are reported wherever they stand, and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Label, notice, phrases that must stand within it.
NOTICES = (
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by", "This work is licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "This work is licensed under CC BY SA 4.0", ("cc by sa",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("related or neighboring rights",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("lgpl", "you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
)

#: What parts words once A-Z are lower-cased.
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[:128] = [not chr(c).isalnum() for c in range(128)]


def hashed(phrases: list[str]) -> list[np.ndarray]:
    return [w.copy() for w in wordhash.hashed_texts(pa.array([p.encode() for p in phrases], type=pa.binary()), True, _BREAKS)]


def consecutive(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after the other."""
    at = np.flatnonzero(words[: max(len(words) - len(phrase) + 1, 0)] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[words[at + j] == phrase[j]]
    return at


@dataclass
class Index:
    """Templates as word hashes with the weight of each word, and postings of rare words sorted by word."""

    labels: list[str]
    templates: list[np.ndarray]
    weights: list[np.ndarray]
    phrases: list[list[np.ndarray]]
    needed: np.ndarray  # votes that a beginning of each template needs
    rare: np.ndarray  # indexed words, sorted
    begin: np.ndarray  # of their postings
    template: np.ndarray
    position: np.ndarray


def vocabulary(notices=NOTICES) -> np.ndarray:
    """All words of the notices, sorted."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *hashed([n[1] for n in notices])]))


def build_index(frequencies: np.ndarray, n_docs: int, notices=NOTICES) -> Index:
    """frequencies: how many documents hold each word of the vocabulary."""
    vocab, templates = vocabulary(notices), hashed([n[1] for n in notices])
    idf = np.log((n_docs + 1) / (frequencies + 0.5)) + 1e-9  # never 0, as a document holds a word once
    weights = [idf[np.searchsorted(vocab, t)] for t in templates]
    found, needed = [], []
    for i, (t, w) in enumerate(zip(templates, weights, strict=True)):
        order = np.argsort(-w, kind="stable")
        total, rest = np.cumsum(w[order]), (1 - SHARE) * w.sum() * (1 + 1e-9)
        two = np.flatnonzero(total > rest + w.max())
        upto = int(two[0] if len(two) else np.flatnonzero(total > rest)[0]) + 1
        needed.append(2 if len(two) else 1)
        found += [(int(t[j]), i, int(j)) for j in order[:upto]]
    found.sort()
    words = np.array([f[0] for f in found], dtype=np.uint64)
    rare, begin = np.unique(words, return_index=True)
    return Index(
        [n[0] for n in notices], templates, weights, [hashed(list(n[2])) for n in notices], np.array(needed),
        rare, np.append(begin, len(words)), np.array([f[1] for f in found], dtype=np.int64), np.array([f[2] for f in found], dtype=np.int64),
    )


def beginnings(words: np.ndarray, index: Index) -> Iterator[tuple[int, np.ndarray]]:
    """By template: where it may begin, in order."""
    if not len(index.rare) or not len(words):
        return
    to = np.minimum(np.searchsorted(index.rare, words), len(index.rare) - 1)
    at = np.flatnonzero(index.rare[to] == words)
    if not len(at):
        return
    sizes = index.begin[to[at] + 1] - index.begin[to[at]]
    posting = np.repeat(index.begin[to[at]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    template, start = index.template[posting], np.repeat(at, sizes) - index.position[posting]
    for t in np.unique(template).tolist():
        value, votes = np.unique(start[template == t], return_counts=True)
        some = np.unique(value[:, None] + np.arange(-SHIFT, SHIFT + 1)) if index.needed[t] == 1 or votes.sum() > 1 else value[:0]
        total = np.concatenate(([0], np.cumsum(votes)))
        near = total[np.searchsorted(value, some + SHIFT, side="right")] - total[np.searchsorted(value, some - SHIFT)]
        yield t, some[near >= index.needed[t]]


def notices_in(words: np.ndarray, index: Index) -> list[tuple[int, int, int, float]]:
    """Confirmed notices: template, first word, end, share; of beginnings within a template's length the best, the first of equals."""
    out = []
    for t, starts in beginnings(words, index):
        template, weight = index.templates[t], index.weights[t]
        padded = np.concatenate([np.zeros(len(template) + SHIFT, dtype=np.uint64), words, np.zeros(len(template) + SHIFT, dtype=np.uint64)])
        found: list[tuple[float, int]] = []
        for a in range(0, len(starts), SLICE):
            some = starts[a : a + SLICE]
            place = some[:, None] + np.arange(len(template))[None] + len(template) + SHIFT
            hit = np.zeros(place.shape, dtype=bool)
            for s in range(-SHIFT, SHIFT + 1):
                hit |= padded[np.clip(place + s, 0, len(padded) - 1)] == template
            share = hit @ weight / weight.sum()
            found += [(-float(s), int(b)) for s, b in zip(share, some, strict=True) if s >= SHARE]
        taken: dict[int, int] = {}  # by b // length: one there at most
        for share, b in sorted(found):
            first, end, q = max(b - SHIFT, 0), min(b + len(template) + SHIFT, len(words)), b // len(template)
            if any(abs(b - taken[i]) < len(template) for i in (q - 1, q, q + 1) if i in taken):
                continue
            if all(len(consecutive(words[first:end], p)) for p in index.phrases[t]):
                taken[q] = b
                out.append((t, max(b, 0), min(b + len(template), len(words)), min(-share, 1.0)))
    return sorted(out, key=lambda n: (n[1], n[0]))


def frequencies(docs: DataFrame, text: str, notices=NOTICES) -> tuple[np.ndarray, int]:
    """How many documents hold each word of the vocabulary, and how many there are."""
    vocab = vocabulary(notices)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocab) + 1, dtype=np.int64)
        for batch in batches:
            for words in wordhash.hashed_texts(batch.column("text"), True, _BREAKS):
                to = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
                counts[np.unique(to[vocab[to] == words])] += 1
            counts[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["word", "n"])

    texts = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    out = np.zeros(len(vocab) + 1, dtype=np.int64)
    for r in texts.mapInArrow(count, "word long, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out[:-1], int(out[-1])


_FOUND = (
    "n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double, "
    "notices: array<struct<label: string, start: int, end: int, share: double>>"
)


_NEW = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")


def scanned(words: np.ndarray, index: Index, base: list[np.ndarray]) -> tuple:
    """The fields of _FOUND for one text."""
    places = [consecutive(words, p) for p in base]
    every = np.concatenate(places)
    own = {label for (_, label), at in zip(BASE, places, strict=True) if len(at)}
    notices = notices_in(words, index)
    score = 1.0 if own else max((n[3] for n in notices), default=0.0)
    ends = (int(every.min()), int(every.max())) if len(every) else (None, None)
    both = own | {index.labels[n[0]] for n in notices}
    return len(words), len(every), *ends, ",".join(sorted(own)), ",".join(sorted(both)), score, [{"label": index.labels[t], "start": a, "end": b, "share": s} for t, a, b, s in notices]


def license_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and notices (label, start, end, share)."""
    counts, n_docs = frequencies(df, text)
    index, base = build_index(counts, n_docs), hashed([p for p, _ in BASE])

    @F.arrow_udf(f"struct<{_FOUND}>")
    def scan(texts: pa.Array) -> pa.Array:
        found = [scanned(words, index, base) for words in wordhash.hashed_texts(texts, True, _BREAKS)]
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], type=k) for i, k in enumerate(kinds)], names=_NEW)

    rest = [F.col(f"`{c}`") for c in df.columns if c not in _NEW]
    return df.select(*rest, scan(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__found")).select(*rest, "__found.*")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "notices")
