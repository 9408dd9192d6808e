"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Every line, every paragraph (lines up to a blank one) and the whole of a text is a unit. A unit is
compared with a template only if its number of bigrams allows the coefficient at all: with a and b
bigrams it is at most 2 min(a, b) / (a + b). Units without a bigram of any template are passed over,
as their coefficient is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices of common licences, our choice.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BLANK = regex.compile(r"\n[^\S\n]*\n")


def bigrams(text: str) -> Counter:
    """Word bigrams of a text in lower case without marks; a single word is a bigram with nothing."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False)) if len(words) != 1 else Counter({(words[0], ""): 1})


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.known = sorted((c.total(), name, c) for name, texts in templates.items() for c in map(bigrams, texts) if c)
        self.sizes = np.array([k[0] for k in self.known])
        self.seen = {gram for _, _, c in self.known for gram in c}
        # A unit that is like a template has least / (2 - least) of its bigrams or more. Of so many of
        # each template that one must be among those, the unit has the longer word.
        words = set()
        for n, _, c in self.known:
            spare = n * (1 - least / (2 - least)) + 1e-9
            for gram, times in sorted(c.items(), key=lambda x: -max(map(len, x[0]))):
                words.add(max(gram, key=len))
                spare -= times
                if spare < 0:
                    break
        self.words = sorted(w for w in words if not any(v in w for v in words if v != w))

    def likely(self, lowered: str) -> bool:
        return any(w in lowered for w in self.words)

    def best(self, unit: str) -> list[tuple[str, float]]:
        """Each licence with its best template at or above the least coefficient."""
        grams = bigrams(unit)
        n = grams.total()
        if not n or self.seen.isdisjoint(grams):
            return []
        # 2 min(n, b) / (n + b) >= least
        low, high = self.least * n / (2 - self.least), (2 - self.least) * n / self.least
        found: dict[str, float] = {}
        for i in range(np.searchsorted(self.sizes, low - 1e-9), np.searchsorted(self.sizes, high + 1e-9, "right")):
            _, name, template = self.known[i]
            value = dice(grams, template)
            if value >= self.least:
                found[name] = max(found.get(name, 0.0), value)
        return sorted(found.items())


def units(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, number from 0, text) of every line, paragraph and the whole."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        yield "line", i, line
    if len(lines) > 1:
        paragraphs = _BLANK.split(text)
        if len(paragraphs) > 1:
            for i, part in enumerate(paragraphs):
                yield "paragraph", i, part
        yield "text", 0, text


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    least: float = 0.8,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document, licence and matching unit: doc_id, license, unit, number, dice.

    Documents without a match return no row; null, empty and blank texts match nothing. Repeated rows
    return their matches each. Rows without doc_id return matches without one. Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in batches:
            at, out = [], []
            for i, value in enumerate(batch.column("text")):
                body = value.as_py()
                if not body or not known.likely(body.lower()):
                    continue
                for unit, number, part in units(body):
                    if not known.likely(part.lower()):
                        continue
                    for name, score in known.best(part):
                        at.append(i)
                        out.append((name, unit, number, score))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "license", "unit", "number", "dice"],
            )

    return rows.where(F.length("text") > 0).mapInArrow(scan, f"doc_id {kind}, license string, unit string, number bigint, dice double")
