"""3. License scans by conditional compression.

Candidate blocks are the stretches of a text around words that license notices use (`CUE`): the line of the cue and up to
`AROUND` neighbouring lines on each side that hold letters, cut at blank lines.  Each template has windows of the block's
words around its cues, as wide as the template on both sides and bounded in length.  Every window is compressed alone and
with the template as a raw zstandard dictionary; the bytes saved, as a share of what the template saves of itself, rank the
templates, and one that saves none is out.  All others are then compared word by word, in the order of their rank.  The
stretch of the window that matches, compressed alone and with the template again (level 9), must save a share of at least
`SAVING`, which does not depend on the length of the line, and at most a tenth of the template's words may be missing from
their order (so none of a template of fewer than ten words).  Differences in wording decide only between templates that
match the same stretch: fewest missing words, then most shared words, then the share saved, then the rank; they are
returned, word by word.

For the ranking literals are stored as they are (`squeeze`): the codes for literals of a small window vary by more than a
short notice saves, so that the words around a notice would decide.  Matches of four bytes count, so that a notice with
other words between all of its words still saves some.

Templates are a parameter: short notices by SPDX id.  Their number and size are checked (`MOST_BYTES`), since every
executor holds them.

Defined cases: a null text is an empty one without blocks; a very long text is scanned line by line, so that memory is
bound by its length; repeated rows and null ids are rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, schema_of, table, with_columns_of

#: Notices in the words that their licenses recommend or that are in common use.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
CUE = re.compile(r"licen[sc]|public domain|redistribut|permission (?:is hereby|to use)|free software", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9.+-]*[a-z0-9]")
AROUND, SAVING = 12, 0.1
MOST_BYTES = 1 << 20


def words(t: str) -> list[str]:
    return WORD.findall(t.lower())


def windows(cues: list[int], reach: int, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that hold those within reach of a cue; long ones are cut so that 2 * reach words stay together."""
    joined: list[list[int]] = []
    for c in cues:
        a, b = max(0, c - reach), min(n, c + reach + 1)
        if joined and a <= joined[-1][1]:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    for a, b in joined:
        while b - a > 4 * reach:
            yield a, a + 4 * reach
            a += 2 * reach
        yield a, b


def wording(want: list[str], have: list[str]) -> str:
    """How the words differ: those of the template that are missing as -word, those that stand in their place as +word."""
    out: list[str] = []
    for tag, a, b, x, y in difflib.SequenceMatcher(None, want, have, autojunk=False).get_opcodes():
        if tag != "equal":
            out += [f"-{w}" for w in want[a:b]] + [f"+{w}" for w in have[x:y]]
    return " ".join(out)


def squeeze(raw: bytes = b"") -> zstandard.ZstdCompressor:
    """zstandard without codes for literals (level -1), with a raw dictionary if there is one."""
    params = zstandard.ZstdCompressionParameters.from_level(-1, min_match=4, window_log=24, hash_log=17, write_content_size=False, write_dict_id=False)
    # no match starts in the last 8 bytes of a dictionary
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(raw + b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if raw else None)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.rows = [(name, t, words(t)) for name, ts in templates.items() for t in ts]
        self.counts = [Counter(w) for _, _, w in self.rows]
        if sum(len(t) for _, t, _ in self.rows) > MOST_BYTES:
            raise ValueError(f"templates of more than {MOST_BYTES} bytes")
        texts = [t.lower().encode() for _, t, _ in self.rows]
        self.alone, self.given = squeeze(), [squeeze(t) for t in texts]
        self.own = [max(1, len(self.alone.compress(t)) - len(g.compress(t))) for t, g in zip(texts, self.given)]
        self.plain = zstandard.ZstdCompressor(level=9)
        self.with_dict = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in texts]
        self.seen: dict[str, list[tuple[str, float, int, str]]] = {}

    def blocks(self, t: str) -> Iterator[tuple[int, str]]:
        """Start and text of each block; blocks do not overlap."""
        done = 0
        for m in CUE.finditer(t):
            if m.start() < done:
                continue
            a = t.rfind("\n", done, m.start()) + 1 or done
            b = t.find("\n", m.end())
            b = len(t) if b < 0 else b
            for _ in range(AROUND):
                p = t.rfind("\n", done, a - 1) + 1 if a - 1 > done else done
                if a <= done or not t[p : a - 1].strip() or not CUE.search(t, p, a - 1):
                    break
                a = p
            for _ in range(AROUND):
                if b >= len(t):
                    break
                e = t.find("\n", b + 1)
                e = len(t) if e < 0 else e
                if not t[b + 1 : e].strip():
                    break
                b = e
            done = b
            yield a, t[a:b]

    def ranked(self, low: str, found: list[tuple[str, int, int]]) -> list[tuple[float, int, int, int, int]]:
        """(-share, -saved bytes, template, first and end word) of the windows of which a template saves any, the best first."""
        ends = [x[2] for x in found]
        cues = [bisect.bisect_right(ends, m.start()) for m in CUE.finditer(low)]
        size: dict[tuple[int, int], int] = {}
        out: list[tuple[float, int, int, int, int]] = []
        for k, (_, _, want) in enumerate(self.rows):
            for a, b in windows(cues, len(want) + max(4, len(want) // 4), len(found)):
                raw = low[found[a][1] : found[b - 1][2]].encode()
                if (a, b) not in size:
                    size[a, b] = len(self.alone.compress(raw))
                saved = size[a, b] - len(self.given[k].compress(raw))
                if saved > 0:
                    out.append((-saved / self.own[k], -saved, k, a, b))
        return sorted(out)

    def matches(self, block: str) -> Iterator[tuple[int, int, float, int, str, int, int, str]]:
        """(missing words, -shared words, -saving, rank, license, first and end word, wording) of the ranked templates that the wording confirms."""
        low = block.lower()
        found = [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
        of = [x[0] for x in found]
        for rank, (_, _, k, a, b) in enumerate(self.ranked(low, found)):
            name, _, want = self.rows[k]
            most, have = len(want) // 10, Counter(of[a:b])
            if sum(min(n, have[w]) for w, n in self.counts[k].items()) < len(want) - most:
                continue
            same = [m for m in difflib.SequenceMatcher(None, want, of[a:b], autojunk=False).get_matching_blocks() if m.size]
            shared = sum(m.size for m in same)
            if not same or len(want) - shared > most:
                continue
            first, end = a + same[0].b, a + same[-1].b + same[-1].size
            raw = low[found[first][1] : found[end - 1][2]].encode()
            gain = 1 - len(self.with_dict[k].compress(raw)) / len(self.plain.compress(raw))
            if gain >= SAVING:
                yield len(want) - shared, -shared, -gain, rank, name, first, end, wording(want, of[first:end])

    def judge(self, block: str) -> list[tuple[str, float, int, str]]:
        """(license, saving, differing words, wording) of the templates that the block's wording confirms, the best first."""
        if block in self.seen:
            return self.seen[block]
        taken: list[tuple[int, int]] = []
        best: dict[str, tuple[str, float, int, str]] = {}
        for missing, _, gain, _, name, a, b, how in sorted(self.matches(block)):
            # a template that mostly matches words of a better one is a weaker reading of them
            if all(2 * (min(b, y) - max(a, x)) <= min(b - a, y - x) for x, y in taken):
                taken.append((a, b))
                best.setdefault(name, (name, -gain, missing, how))
        if len(self.seen) < 10_000:
            self.seen[block] = list(best.values())
        return list(best.values())

    def spans(self, t: str) -> list[tuple[int, int, str, float, int, str]]:
        """(start, end, license, saving, number of differing words, wording) in the order of the text."""
        return [(a, a + len(b), *x) for a, b in self.blocks(t) for x in self.judge(b)]

    def scan(self, t: str) -> list[tuple[int, int, str, float, int]]:
        """spans() without the wording."""
        return [x[:5] for x in self.spans(t)]


COLUMNS = "n_blocks long, licenses array<string>, spans array<struct<start:int,end:int,license:string,saving:double,differing:int,wording:string>>"


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """The kept columns of docs and COLUMNS for each row."""
    Scanner(templates)  # checks the size
    schema = schema_of(docs, keep, COLUMNS)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("saving", pa.float64()), ("differing", pa.int32()), ("wording", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            n, names, spans = [], [], []
            for v in b.column("text"):
                found = scanner.spans(v.as_py() or "")
                n.append(len({x[0] for x in found}))
                names.append(sorted({x[2] for x in found}))
                spans.append([dict(zip(("start", "end", "license", "saving", "differing", "wording"), x)) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(span))], names=schema.names)

    return arrow_map(docs, run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = scan(with_columns_of(table(spark, sf_dir, "documents"), ("doc_id", "long"), ("text", "string")))
    first = F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string")))
    return out.select("doc_id", "n_blocks", F.array_join("licenses", ",").alias("licenses"), F.array_join(first, ",").alias("spans"))
