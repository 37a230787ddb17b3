"""License scans by conditional compression.

Each template's wording is looked for in windows of words a little longer than it, over the whole text,
whatever its lines and sentences are. A window with too few of the template's words is passed over;
the others are held against it by the exact differences in wording: the template's words must be there
in order, with few words missing or put in between, and no differing number (another version is another
license). What is found is compressed alone and once with the template as a raw zstandard dictionary,
and must be explained by it, that is, a large share of its own size must be saved. Of wordings that
overlap the longest is kept, then the one with the fewest differences, then the largest share.

Documents without a license word are left out in the scan itself.

Cases: null and empty texts give no rows. Rows of documents that repeat are each scanned. Texts of any
length are scanned whole. Ties in rank fall to the template named first. An empty table gives no rows.
Extra columns are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns

# License wordings (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
CUE = r"(?i)licen[cs]|copyright|permission|redistribut|public\W+domain|free\W+software"

FOUND = ("doc_id long, license string, start long, end long, reduction double, n_differences long, differences string")
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_CUE = re.compile(CUE[4:], re.I)
_LINE_START = re.compile(r"\s*\n\W*|\s+")


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]


class Template:
    def __init__(self, license_id: str, text: str):
        self.license, self.text, self.words = license_id, text, [w for w, _, _ in _words(text)]
        book = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=9, dict_data=book, write_content_size=False, write_dict_id=False)


_PLAIN = zstandard.ZstdCompressor(level=9, write_content_size=False)


def reduction(found: str, template: Template) -> float:
    """Share of the compressed size of a found wording, without marks at line starts, that its template saves."""
    data = _LINE_START.sub(" ", found).encode("utf-8", "surrogatepass")
    return 1 - len(template.packer.compress(data)) / len(_PLAIN.compress(data))


def wording(words: list[str], template: Template) -> tuple[int, int, list[str]] | None:
    """(first, end, differences) of the template's wording among the words, or nothing if a number differs."""
    matcher = SequenceMatcher(None, template.words, words, autojunk=False)
    same = [m for m in matcher.get_matching_blocks() if m.size]
    if not same:
        return None
    first, last = same[0].b, same[-1].b + same[-1].size
    out = []
    for op, a, b, c, d in matcher.get_opcodes():
        if op == "equal":
            continue
        gone, new = template.words[a:b], words[max(c, first):min(d, last)]
        if any(x.isdigit() or x.replace(".", "").isdigit() for x in gone):
            return None
        out += [f"-{w}" for w in gone] + [f"+{w}" for w in new]
    return first, last, out


def _wordings(words: list[str], template: Template, differing: float) -> Iterator[tuple[int, int, list[str]]]:
    """Every place of the template's wording, in order: a window starts at every few words and holds any wording that begins there."""
    own, most = set(template.words), differing * len(template.words)
    step = max(1, int(0.4 * len(template.words)))
    width = step + int(len(template.words) + most) + 1
    shared = [0, *accumulate(w in own for w in words)]
    at = 0
    while at < len(words):
        end = min(at + width, len(words))
        told = wording(words[at:end], template) if shared[end] - shared[at] >= len(template.words) - most else None
        if not told or len(told[2]) > most:
            at += step
            continue
        start = at + told[0]
        again = wording(words[start:start + width], template)  # the window may have ended inside the wording
        if again and len(again[2]) <= len(told[2]):
            told, at = again, start
        yield at + told[0], at + told[1], told[2]
        at += told[1]


def scan(text: str | None, templates: list[Template], least: float, differing: float) -> list[tuple]:
    """(license, start, end, reduction, differences) of every confirmed wording, in order, none inside another."""
    found = []
    if not text or not _CUE.search(text):
        return found
    placed = _words(text)
    words = [w for w, _, _ in placed]
    for template in templates:
        for first, last, differences in _wordings(words, template, differing):
            start, end = placed[first][1], placed[last - 1][2]
            share = reduction(text[start:end], template)
            if share >= least:
                found.append((template.license, start, end, share, differences))
    found.sort(key=lambda f: (-(f[2] - f[1]), len(f[4]), f[1], -f[3]))  # the longest wording explains what lies within it
    kept: list[tuple] = []
    for f in found:
        if not any(f[1] < k[2] and k[1] < f[2] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[1])


def _scanner(templates: dict[str, tuple[str, ...]], least: float, differing: float):
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                        ("reduction", pa.float64()), ("n_differences", pa.int64()), ("differences", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Template(k, t) for k, texts in templates.items() for t in texts]
        for batch in batches:
            rows = [{"doc_id": d, "license": lic, "start": s, "end": e, "reduction": round(share, 6), "n_differences": len(diff),
                     "differences": " ".join(diff)}
                    for d, text in zip(*(c.to_pylist() for c in batch.columns)) for lic, s, e, share, diff in scan(text, ready, least, differing)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.4, differing: float = 0.1) -> DataFrame:
    """One row per license wording found, with its place, the share it saves and its differences."""
    rows = kept_columns(docs, "doc_id", "text").where(F.col("text").rlike(CUE))
    return rows.mapInArrow(_scanner(templates, least, differing), FOUND)
