"""License scans by conditional compression, confirmed by exact wording differences.

A text that states a template has to hold most of its words, so of any few more of its words than may be missing it holds one. Each template's rarest words of that number are its anchors: a
document's candidate blocks are windows around anchors and runs of words that reach as far around one as the longest template, and no text that states a template is without one. Each block is compressed alone and, for each template, with that template as a raw Zstandard
dictionary; the share of bytes that a template saves ranks the templates. All that save enough are confirmed by a word-level difference with the
template: enough of its words have to occur, in order, and the report lists the words that were changed.

Templates are a parameter, name to text; the ones below are common notices. Blocks of a long document are scanned one after another; a block of
more than BLOCK_WORDS words is scanned in overlapping windows, which hold the longest template wherever it starts.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS, OVERLAP_WORDS, NARROW_WORDS = 400, 200, 60
#: Compression levels of long and of narrow blocks.
LEVELS = (3, 19)
#: Share of a template's words that have to be found in order.
LEAST_COVERED = 0.85
#: Share of a block's compressed bytes that a template has to save before its wording is compared.
LEAST_SAVED = 0.15

#: Wording of public notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "all rights reserved": "All rights reserved.",
}

_WORD = re.compile(r"[0-9a-z]+(?:[.-][0-9a-z]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def anchors(templates: dict[str, list[str]]) -> frozenset[str]:
    """Of each template so many words that a text which has LEAST_COVERED of the template's words has one of them; those that few templates share and long ones first, as they are rare."""
    shared = Counter(w for words in templates.values() for w in set(words))
    out = set()
    for words in templates.values():
        left, counts = len(words) - math.ceil(LEAST_COVERED * len(words) - 1e-9) + 1, Counter(words)
        for w in sorted(counts, key=lambda w: (shared[w] > 2, -len(w), w)):
            if left <= 0:
                break
            out.add(w)
            left -= counts[w]
    return frozenset(out)


def candidate_blocks(text: str, longest: int, anchors: frozenset[str]) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
    """(words of the text, line of each, blocks as first and end word): a window of NARROW_WORDS around the anchors, and each run of words that are within reach of one.

    The reach is `longest`, the words of the longest template, and a quarter more. A run of more than BLOCK_WORDS, or four times the longest template, gives overlapping windows of that size.
    """
    low = text.lower()
    found = [(m.group(), m.start()) for m in _WORD.finditer(low)]
    words, starts = [w for w, _ in found], np.array([i for _, i in found], dtype=np.int64)
    breaks = np.array([i for i, c in enumerate(low) if c == "\n"], dtype=np.int64)
    line = np.searchsorted(breaks, starts)
    at = np.array([i for i, w in enumerate(words) if w in anchors], dtype=np.int64)
    out, last = [], -1
    for w in at.tolist():
        if w > last:
            last = w + NARROW_WORDS // 4
            out.append((max(0, w - NARROW_WORDS // 2), min(len(words), w + NARROW_WORDS // 2)))
    reach, most = longest + longest // 4 + 1, max(BLOCK_WORDS, 4 * longest)
    step = most - max(OVERLAP_WORDS, 2 * longest)
    runs: list[list[int]] = []
    for w in at.tolist():
        a, b = max(0, w - reach), min(len(words), w + reach + 1)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [(k, min(b, k + most)) for k in range(a, max(a + 1, b - most + step), step)]
    return words, line, out


class Scanner:
    """Templates with their raw dictionaries and words."""

    def __init__(self, templates: dict[str, str] | None = None):
        self.templates = {k: words_of(v) for k, v in (templates or TEMPLATES).items()}
        self.templates = {k: words for k, words in self.templates.items() if words}
        self.longest = max(map(len, self.templates.values()), default=0)
        self.anchors = anchors(self.templates)
        self.held = ahocorasick.Automaton()
        for w in self.anchors:
            self.held.add_word(w, w)
        self.held.make_automaton()
        # a few words in a small block save bytes only where the compressor looks for the best parse
        self.by_level = {}
        for level in LEVELS:
            given = {}
            for k, words in self.templates.items():
                raw = zstandard.ZstdCompressionDict(" ".join(words).encode() + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=level)
                given[k] = zstandard.ZstdCompressor(level=level, dict_data=raw)
            alone = zstandard.ZstdCompressor(level=level)
            own = {k: max(8, len(alone.compress(" ".join(words).encode())) - 8) for k, words in self.templates.items()}
            self.by_level[level] = alone, given, own

    def may_state(self, text: str) -> bool:
        """Whether some anchor occurs; texts without one have no candidate blocks."""
        return bool(self.anchors) and next(self.held.iter(text.lower()), None) is not None

    def ranked(self, words: list[str]) -> list[tuple[float, str]]:
        """(bytes saved over bytes that the template's own words take, name), best first.

        A short template can save little of a long block, so what it saves is measured against what it could: its own compressed size.
        """
        raw = " ".join(words).encode()
        alone, given, own = self.by_level[LEVELS[len(words) <= NARROW_WORDS]]
        base = len(alone.compress(raw))
        out = [((base - len(one.compress(raw))) / own[k], k) for k, one in given.items()]
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def confirm(self, name: str, words: list[str]) -> tuple[float, list[str], int]:
        """(share of the template's words found in order, the differences, first word found) in the best place of the block."""
        want = self.templates[name]
        matcher = difflib.SequenceMatcher(None, words, want, autojunk=False)
        blocks = [b for b in matcher.get_matching_blocks() if b.size]
        if not blocks:
            return 0.0, [], 0
        core = max(blocks, key=lambda b: b.size)
        first = max(0, core.a - core.b - len(want) // 4)
        last = min(len(words), core.a + (len(want) - core.b) + len(want) // 4)
        part = words[first:last]
        codes = difflib.SequenceMatcher(None, part, want, autojunk=False).get_opcodes()
        found = sum(j2 - j1 for op, _, _, j1, j2 in codes if op == "equal")
        inner = [c for c in codes if not (c[0] == "delete" and (c[3] == 0 or c[4] == len(want)))]
        changes = [f"{op}: {' '.join(part[i1:i2])} -> {' '.join(want[j1:j2])}" for op, i1, i2, j1, j2 in inner if op != "equal"]
        return found / len(want), changes, first + next((i1 for op, i1, _, _, _ in codes if op == "equal"), 0)

    def scan(self, text: str) -> list[dict]:
        """Confirmed licenses of a text, each once with its first and best place."""
        found: dict[str, dict] = {}
        every, line, blocks = candidate_blocks(text, self.longest, self.anchors)
        for a, b in blocks:
            words = every[a:b]
            if not words:
                continue
            for saved, name in self.ranked(words):
                if saved < LEAST_SAVED:
                    break
                covered, changes, at = self.confirm(name, words)
                if covered >= LEAST_COVERED and (name not in found or covered > found[name]["covered"]):
                    found[name] = {"license": name, "line": int(line[a + at]), "saved": round(saved, 6), "covered": round(covered, 6), "changes": changes}
        return [found[k] for k in sorted(found)]


_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("line", pa.int64()), ("saved", pa.float64()), ("covered", pa.float64()), ("changes", pa.list_(pa.string()))]))
_MATCHES_DDL = "array<struct<license:string,line:bigint,saved:double,covered:double,changes:array<string>>>"


def _scan(templates: dict[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                out.append(scanner.scan(text) if scanner.may_state(text) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _MATCHES)], names=["doc_id", "licenses"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, licenses), a row for each row; null and empty texts have none.

    licenses: for each confirmed template its name, line of its first word found, bytes saved over its own size, share of its words found, and wording differences.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scan(templates), f"doc_id long, licenses {_MATCHES_DDL}")
