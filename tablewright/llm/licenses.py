"""License scan: MinHash bands over overlapping windows of words retrieve templates, exact shingle containment verifies them.

Templates of similar length form a class. Windows of a class are one and a half of its longest template wide and move by half of
it, so every occurrence lies in one window. At the least containment looked for, the Jaccard similarity of window and template is
at least `floor`; the number of bands is chosen so that such a pair misses all of them with probability `miss` at most.
A window without any shingle of a template shares no minimum with it, so only windows that hold one get signatures.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.arrays import byte_values, inside_table, mix, parts, texts, valid_starts, window_hashes, word_bounds, word_hashes
from tablewright.session import ship_package

# Widely used license notices, passages of license texts, and the short wordings and SPDX lines that name a license.
# The terms of bsd-2-clause are also part of the 3-clause text. A short wording names what tells licenses apart, so it has no room for
# a changed word; other verbs and phrases around it do not matter.
TEMPLATES = {
    "agpl": "GNU Affero General Public License",
    "agpl-3.0-spdx": "SPDX-License-Identifier: AGPL-3.0",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-named": "the Apache License, Version 2.0",
    "apache-2.0-short": "Apache License 2.0",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause-named": "BSD 2-Clause License",
    "bsd-2-clause-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-3-clause-named": "BSD 3-Clause License",
    "bsd-3-clause-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "bsd-named": "the BSD License",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-named": "Attribution-NonCommercial 4.0 International",
    "cc-by-nc-4.0-short": "CC BY-NC 4.0",
    "cc-by-sa-4.0-named": "Attribution-ShareAlike 4.0 International",
    "cc-by-sa-4.0-short": "CC BY-SA 4.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1.0-named": "CC0 1.0 Universal",
    "epl": "Eclipse Public License",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl-2.0-spdx": "SPDX-License-Identifier: EPL-2.0",
    "gpl": "GNU General Public License",
    "gpl-2.0": "General Public License, version 2",
    "gpl-2.0-spdx": "SPDX-License-Identifier: GPL-2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-spdx": "SPDX-License-Identifier: GPL-3.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-named": "the ISC License",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "lgpl": "GNU Lesser General Public License",
    "lgpl-2.0": "GNU Library General Public License",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "lgpl-2.1-spdx": "SPDX-License-Identifier: LGPL-2.1",
    "lgpl-3.0-spdx": "SPDX-License-Identifier: LGPL-3.0",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-heading": "MIT License Copyright",
    "mit-named": "the MIT License",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-spdx": "SPDX-License-Identifier: MPL-2.0",
    "mpl-named": "Mozilla Public License",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-spdx": "SPDX-License-Identifier: Unlicense",
}
INSIDE = inside_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
VALUES = byte_values(5, lower=True)
SLICE_BYTES = 4 << 20


class Class:
    """Templates of similar length with their window, and the signatures' bands."""

    def __init__(self, names: list[str], shingles: list[np.ndarray], words: int, size: int, containment: float, rows: int, miss: float) -> None:
        self.names, self.shingles = names, shingles
        self.window, self.step = -(-3 * words // 2), max(1, words // 2)
        per_window = self.window - size + 1
        floor = min(containment * len(s) / (per_window + (1 - containment) * len(s)) for s in shingles)
        self.rows, self.bands = rows, math.ceil(math.log(miss) / math.log(1 - floor**rows))
        self.seeds = mix(np.arange(1, self.rows * self.bands + 1, dtype=np.uint64))
        self.known = np.unique(np.concatenate(shingles))
        self.keys = [self.signature(s) for s in shingles]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """One key for each band: the minima of its rows, mixed."""
        low = mix(shingles[:, None] ^ self.seeds[None, :]).min(0).reshape(self.bands, self.rows)
        key = low[:, 0]
        for r in range(1, self.rows):
            key = mix(key ^ low[:, r])
        return key


def classes(templates: dict[str, str], size: int, containment: float, rows: int, miss: float) -> list[Class]:
    names = sorted(templates)
    data, offsets = texts(pa.array([templates[n] for n in names], pa.string()))
    starts, ends, first = word_bounds(data, offsets, INSIDE)
    hashes = word_hashes(data, starts, ends, VALUES, 5)
    groups: dict[int, list[int]] = {}
    for i, n in enumerate(np.diff(first)):
        if n >= size:
            groups.setdefault(int(n - 1).bit_length(), []).append(i)
    made = []
    for members in groups.values():
        own = [np.unique(window_hashes(hashes[first[i] : first[i + 1]], size, 5)) for i in members]
        made.append(Class([names[i] for i in members], own, int(max(np.diff(first)[members])), size, containment, rows, miss))
    return made


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    size: int = 3,
    containment: float = 0.8,
    rows: int = 2,
    miss: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Templates in every whole text.

    Words are runs of digits, letters and characters beyond ASCII; A-Z count as a-z. Returns one row for each input row: the id,
    n_words, licenses (names found, sorted), matches (license, start and length in words of every window that holds it, overlapping
    windows of one license as one, contained: the largest share of the template's distinct `size`-word shingles in one of these windows,
    at least `containment`), by license, then by start.

    NULL and empty texts have no words and no match; repeated rows each have their row; NULL ids are kept; an empty table gives
    no rows; templates of fewer than `size` words are refused. Templates are a caller's short list, not a table. Other columns
    are not read.
    """
    ship_package(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    kinds = classes(templates, size, containment, rows, miss)
    if sum(len(k.names) for k in kinds) < len(templates):
        raise ValueError(f"a template has fewer than {size} words")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in parts(offsets, SLICE_BYTES):
                own = data[offsets[lo] : offsets[hi]]
                starts, ends, first = word_bounds(own, offsets[lo : hi + 1] - offsets[lo], INSIDE)
                found = _search(word_hashes(own, starts, ends, VALUES, 5), first, kinds, size, containment)
                matches = [[{"license": n, "start": a, "length": b - a, "contained": c} for n, spans in sorted(own.items()) for a, b, c in spans] for own in found]
                kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("contained", pa.float64())]))
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array([sorted(own) for own in found], pa.list_(pa.string())), pa.array(matches, kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "licenses", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, licenses array<string>, matches array<struct<license:string,start:bigint,length:bigint,contained:double>>"
    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def _search(hashes: np.ndarray, first: np.ndarray, kinds: list[Class], size: int, containment: float) -> list[dict[str, list[tuple[int, int, float]]]]:
    """Of every row, by template: (start, end, largest share) of verified windows, overlapping ones merged."""
    found: list[dict[str, list[tuple[int, int, float]]]] = [{} for _ in first[1:]]
    at = valid_starts(first, size)
    shingles = window_hashes(hashes, size, 5)[at]
    for kind in kinds:
        near = np.searchsorted(kind.known, shingles)
        hits = at[kind.known[np.minimum(near, len(kind.known) - 1)] == shingles]
        row = np.searchsorted(first, hits, "right") - 1
        inside = hits - first[row]
        # every window of the grid that holds the hit
        windows = {(int(r), w) for r, p in zip(row, inside, strict=True) for w in range(max(0, -(-(p + size - kind.window) // kind.step)), p // kind.step + 1)}
        for r, w in sorted(windows):
            start = int(first[r]) + w * kind.step
            end = min(start + kind.window, int(first[r + 1]))
            own = np.unique(window_hashes(hashes[start:end], size, 5))
            keys = kind.signature(own)
            for name, template, wanted in zip(kind.names, kind.shingles, kind.keys, strict=True):
                if (keys == wanted).any():
                    share = len(np.intersect1d(own, template, assume_unique=True)) / len(template)
                    if share >= containment:
                        spans, (a, b) = found[r].setdefault(name, []), (w * kind.step, end - int(first[r]))
                        if spans and a < spans[-1][1]:
                            a, _, before = spans.pop()
                            share = max(share, before)
                        spans.append((a, b, share))
    return found
