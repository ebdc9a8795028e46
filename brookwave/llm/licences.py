"""Licence scans: known sentences, then ordered rules over their identifiers.

A text is cut into sentences (at line ends, and at . ! ? ; : before white space) and each is normalised:
A-Z lowered, everything but letters, digits and + becomes one blank (comment marks too), version numbers keep
their dots. Sentences that together make a known licence sentence become its identifier, so one that is wrapped at a
column or holds inner stops is known as a whole (an exact look-up after the normalisation, the longest first;
sentences with a variable part, like a copyright line or an SPDX tag, by their fixed beginning). A rule is a
sequence of identifiers that must follow each other in this order with at most ``GAP`` other sentences
between neighbours; enumerators, bare comment marks and continued lines are not counted. Of the rules that start
at a sentence the longest wins, and matches of one text do not overlap. One pass over whole texts, no shuffle.

Defined results: null and empty texts have no sentence and no licence; a text may hold several; rows
with an equal doc_id are scanned row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import read

GAP = 2
SCHEMA = "doc_id long, n_sentences long, n_known long, licences array<string>, starts array<int>, ends array<int>, sentence_ids array<string>"
#: Known sentences, as they stand in the licences and notices.
SENTENCES = {
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0/may-not-use": "you may not use this file except in compliance with the License",
    "apache-2.0/obtain": "You may obtain a copy of the License at",
    "apache-2.0/as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-3.0/work": "This work is licensed under the GNU General Public License, version 3",
    "gpl/redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl/redistribute-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl/no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mit/notice": "Released under the MIT License",
    "mit/title": "The MIT License (MIT)",
    "mit/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit/include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "isc/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd/source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd/binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd/no-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd/as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0/notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0/notice": "Licensed under CC BY-SA 4.0",
    "cc0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "reserved/notice": "All rights reserved",
}
#: Other wordings of known sentences.
WORDINGS = {"apache-2.0/notice": ("Licensed under the Apache License, Version 2.0 (the \"License\")",)}
#: Sentences with a variable part: their fixed beginning. An SPDX tag's own value is its licence.
BEGINNINGS = {"copyright/line": ("copyright c ", "copyright 1", "copyright 2"), "spdx/tag": ("spdx license identifier ",)}
#: Licences as ordered rules over sentence identifiers.
RULES = (
    ("Apache-2.0", ("apache-2.0/notice",)), ("Apache-2.0", ("apache-2.0/notice", "apache-2.0/may-not-use", "apache-2.0/obtain", "apache-2.0/as-is")), ("Apache-2.0", ("apache-2.0/notice", "apache-2.0/may-not-use")),
    ("GPL-3.0-only", ("gpl-3.0/work",)), ("GPL-3.0-or-later", ("gpl/redistribute-3",)), ("GPL-3.0-or-later", ("gpl/redistribute-3", "gpl/no-warranty")),
    ("GPL-2.0-or-later", ("gpl/redistribute-2",)), ("GPL-2.0-or-later", ("gpl/redistribute-2", "gpl/no-warranty")),
    ("MIT", ("mit/notice",)), ("MIT", ("mit/title",)), ("MIT", ("mit/grant", "mit/include")), ("MIT", ("mit/title", "copyright/line", "mit/grant", "mit/include")),
    ("ISC", ("isc/grant",)), ("BSD-2-Clause", ("bsd/grant", "bsd/as-is")), ("BSD-3-Clause", ("bsd/grant", "bsd/no-endorse", "bsd/as-is")),
    ("BSD-2-Clause", ("bsd/grant", "bsd/source", "bsd/binary", "bsd/as-is")), ("BSD-3-Clause", ("bsd/grant", "bsd/source", "bsd/binary", "bsd/no-endorse", "bsd/as-is")),
    ("MPL-2.0", ("mpl-2.0/notice",)), ("CC-BY-NC-4.0", ("cc-by-nc-4.0/notice",)), ("CC-BY-4.0", ("cc-by-4.0/notice",)), ("CC-BY-SA-4.0", ("cc-by-sa-4.0/notice",)), ("CC0-1.0", ("cc0-1.0/notice",)),
    ("All-Rights-Reserved", ("copyright/line", "reserved/notice")), ("All-Rights-Reserved", ("reserved/notice",)), ("SPDX", ("spdx/tag",)),
)
CUT = re.compile(r"\n+|(?<=[.!?;])\s+|(?<=:)(?<!Identifier:)\s+")
DROP = re.compile(r"(?:[^a-z0-9+.\u0080-\U0010ffff]+|\.(?![0-9]))+")
ENUMERATOR = re.compile(r"(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})?")
MARK = re.compile(r"\s*(?:dnl|@?rem)\s", re.I)
FIRST = re.compile(r"[^A-Za-z0-9+\u0080-\U0010ffff]*([A-Za-z0-9+\u0080-\U0010ffff]*)")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def normalised(sentence: str) -> str:
    if m := MARK.match(sentence):
        sentence = sentence[m.end() :]
    return DROP.sub(" ", sentence.translate(LOWER)).strip()


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of a text's sentences."""
    text, out, at = text or "", [], 0
    for m in CUT.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


KNOWN = {normalised(w): name for name, text in SENTENCES.items() for w in (text, *WORDINGS.get(name, ()))}
#: What a known sentence can begin with, up to its last word but one.
PREFIXES = {" ".join(words[:k]) for words in map(str.split, KNOWN) for k in range(1, len(words))}
#: First words of all that can be known, and the line marks before them.
FIRSTS = {x.split()[0] for x in (*KNOWN, *(y for starts in BEGINNINGS.values() for y in starts))} | {"dnl", "rem"}
STARTS: dict[str, list] = {}
for _rule in sorted(RULES, key=lambda r: (-len(r[1]), r[0])):
    STARTS.setdefault(_rule[1][0], []).append(_rule)


def _known(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(first span, last span, identifier) of the known sentences."""
    out, at = [], 0
    while at < len(spans):
        a, b = spans[at]
        end = at
        if FIRST.match(text, a, b)[1].translate(LOWER) in FIRSTS:
            words, last, found = normalised(text[a:b]), at, None
            while True:
                if words in KNOWN:
                    end, found = last, KNOWN[words]
                last += 1
                if words not in PREFIXES or last == len(spans):
                    break
                words = f"{words} {normalised(text[slice(*spans[last])])}".strip()
            if not found:
                words = normalised(text[a:b])
                found = next((k for k, starts in BEGINNINGS.items() if words.startswith(starts)), None)
            if found:
                out.append((at, end, found))
        at = end + 1
    return out


def _others(text: str, spans: list[tuple[int, int]], first: int, last: int) -> int:
    """The sentences between two spans, without enumerators, bare comment marks and continued lines."""
    n = 0
    for k in range(first + 1, last):
        words, before = normalised(text[slice(*spans[k])]), spans[k - 1][1]
        head = FIRST.match(text, *spans[k])[1]
        continued = k > first + 1 and text[before - 1] not in ".!?;:" and text.count("\n", before, spans[k][0]) == 1 and head[:1].islower()
        n += not (ENUMERATOR.fullmatch(words) or continued)
        if n > GAP:
            break
    return n


def scan(text: str | None) -> tuple[int, list[str], list[tuple[str, int, int]]]:
    """Sentences of the text, the known ones' identifiers, and (licence, start, end) of the matches."""
    spans = sentences(text)
    found = _known(text, spans) if spans else []
    out, at = [], 0
    while at < len(found):
        for licence, sequence in STARTS.get(found[at][2], ()):
            end, j = at, 1
            while j < len(sequence) and end + 1 < len(found) and found[end + 1][2] == sequence[j] and _others(text, spans, found[end][1], found[end + 1][0]) <= GAP:
                end, j = end + 1, j + 1
            if j == len(sequence):
                a, b = spans[found[at][0]][0], spans[found[end][1]][1]
                name = text[a:b].rpartition(":")[2].strip(" \t\r*/#<>!-") or licence if licence == "SPDX" else licence
                out.append((name, a, b))
                at = end
                break
        at += 1
    return len(spans), [x[2] for x in found], out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            n, ids, found = scan(text)
            rows.append((n, len(ids), [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], ids))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_sentences", "n_known", "licences", "starts", "ends", "sentence_ids"])


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document: its licences with their places, and the known sentences behind them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scanned, SCHEMA)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))
