"""Licence scan by sentence rules.

A text's paragraphs are cut into sentences, across lines, these are normalised (lower case, no punctuation, one space), and known
licence sentences get identifiers. The sequence of a text's identifiers is matched against ordered
rules, each a sequence of identifiers that stands for a licence; what a rule matches is used up, and
earlier rules win, so that a whole licence text is told before the single sentences in it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.shared import slices

#: Identifier and pattern of normalised sentences (from the public licence texts).
SENTENCES = (
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", r"the software is provided as is without warranty of any kind .*"),
    ("no-liability", r"in no event shall the (?:authors|copyright holders?|author) .*liable .*"),
    ("isc-as-is", r"the software is provided as is and .*disclaims? all warranties .*"),
    ("isc-grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that .*"),
    ("0bsd-grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsd-source", r"(?:\d )?redistributions of source code must retain the above copyright notice .*"),
    ("bsd-binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("bsd-endorse", r"(?:\d )?neither the name of .* may be used to endorse or promote products .*"),
    ("bsd-advert", r"(?:\d )?all advertising materials mentioning features or use of this software must display .*"),
    ("bsd-as-is", r"this software is provided by .* as is and any express or implied warranties .*"),
    ("apache-2-ref", r"(?:this (?:work|file|software|project) is )?licensed under the apache license version 2 0(?: the license)?"),
    ("apache-2-use", r"you may not use this file except in compliance with the license"),
    ("apache-2-copy", r"you may obtain a copy of the license at.*"),
    ("apache-2-law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*"),
    ("apache-2-limits", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-ref", r"(?:(?:this (?:work|file|software|project) is )?(?:released|licensed|distributed)|available) under the (?:terms of the )?mit licen[sc]e"),
    ("bsd-2-ref", r".*\b(?:released|licensed|distributed) under the (?:bsd 2 clause|simplified bsd|freebsd) licen[sc]e"),
    ("bsd-3-ref", r".*\b(?:released|licensed|distributed) under the (?:bsd 3 clause|new bsd|revised bsd) licen[sc]e"),
    ("bsd-ref", r".*\b(?:released|licensed|distributed) under (?:the |a )?bsd(?: style)? licen[sc]e"),
    ("gpl-3-later", r".*\bgnu general public licen[sc]e .*\bversion 3 (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("gpl-2-later", r".*\bgnu general public licen[sc]e .*\bversion 2 (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("lgpl-3", r".*\bgnu (?:lesser|library) general public licen[sc]e .*\bversion 3\b.*"),
    ("lgpl-2-1", r".*\bgnu (?:lesser|library) general public licen[sc]e .*\bversion 2 1\b.*"),
    ("agpl-3", r".*\bgnu affero general public licen[sc]e .*\bversion 3\b.*"),
    ("gpl-3-ref", r"(?:this (?:work|file|software|project|program) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu general public licen[sc]e version 3"),
    ("gpl-2-ref", r"(?:this (?:work|file|software|project|program) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu general public licen[sc]e version 2"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl-details", r"see the gnu general public licen[sc]e for more details"),
    ("gpl-copy", r"you should have received a copy of the gnu general public licen[sc]e along with this program.*"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0"),
    ("mpl-2-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("epl-2", r".*\bunder the (?:terms of the )?eclipse public licen[sc]e (?:v|version )?2 0.*"),
    ("cc-by", r"(?:this (?:work|text|article) is )?(?:released|licensed) under (?:a |the )?(?:cc by|creative commons attribution)(?: international)?(?: licen[sc]e)?(?: (\d) (\d))?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-sa", r"(?:this (?:work|text|article) is )?(?:released|licensed) under (?:a |the )?(?:cc by sa|creative commons attribution share ?alike)(?: (\d) (\d))?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc", r"(?:this (?:work|text|article) is )?(?:released|licensed) under (?:a |the )?(?:cc by nc|creative commons attribution non ?commercial)(?: (\d) (\d))?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nd", r"(?:this (?:work|text|article) is )?(?:released|licensed) under (?:a |the )?(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: (\d) (\d))?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", r"(?:this (?:work|text|article) is )?(?:released|licensed) under (?:a |the )?cc by nc sa(?: (\d) (\d))?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc-nd", r"(?:this (?:work|text|article) is )?(?:released|licensed) under (?:a |the )?cc by nc nd(?: (\d) (\d))?(?: international)?(?: licen[sc]e)?"),
    ("cc0", r".*\b(?:cc0|creative commons zero)\b.*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:this (?:work|text|article|software) is )?(?:released|placed|dedicated) (?:in|in ?to|to) the public domain"),
    ("rights-reserved", r"all rights reserved"),
    ("rights-reserved", r".*\bcopyright\b.* all rights reserved"),
    ("copyright", r"(?:copyright|©) .*\b(?:19|20)\d\d\b.*"),
    ("spdx", r"spdx license identifier (.+)"),
)
#: Licence and the identifiers of its sentences, in order. Earlier rules win.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("ISC", ("isc-grant", "isc-as-is")), ("ISC", ("isc-grant", "as-is")), ("0BSD", ("0bsd-grant", "isc-as-is")), ("0BSD", ("0bsd-grant", "as-is")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("Apache-2.0", ("apache-2-ref", "apache-2-use", "apache-2-copy", "apache-2-law", "apache-2-limits")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-hope", "gpl-details", "gpl-copy")),
    ("MPL-2.0", ("mpl-2", "mpl-2-copy")),
    ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant",)), ("Apache-2.0", ("apache-2-ref",)), ("MIT", ("mit-ref",)), ("BSD-2-Clause", ("bsd-2-ref",)), ("BSD-3-Clause", ("bsd-3-ref",)), ("BSD", ("bsd-ref",)),
    ("GPL-3.0-or-later", ("gpl-3-later",)), ("GPL-2.0-or-later", ("gpl-2-later",)), ("GPL-3.0-only", ("gpl-3-ref",)), ("GPL-2.0-only", ("gpl-2-ref",)),
    ("LGPL-3.0", ("lgpl-3",)), ("LGPL-2.1", ("lgpl-2-1",)), ("AGPL-3.0", ("agpl-3",)), ("MPL-2.0", ("mpl-2",)), ("EPL-2.0", ("epl-2",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa",)), ("CC-BY-NC-ND", ("cc-by-nc-nd",)), ("CC-BY-NC", ("cc-by-nc",)), ("CC-BY-ND", ("cc-by-nd",)), ("CC-BY-SA", ("cc-by-sa",)), ("CC-BY", ("cc-by",)),
    ("CC0-1.0", ("cc0",)), ("Unlicense", ("unlicense",)), ("Public-Domain", ("public-domain",)), ("Proprietary", ("rights-reserved",)), ("SPDX", ("spdx",)),
)
#: Every known sentence holds one of these words.
CUE = re.compile("licens|licenc|copyright|©|permi|redistribut|warrant|liable|software|advertising materials|neither the name|gnu |mozilla|mpl|eclipse|cc by|cc-by|cc0|creative commons|public domain|rights reserved|spdx")
#: Where a sentence ends; "v. 2.0" does not end one.
END = re.compile(r"(?<!\bv)(?<!\bV)[.!?]+[\"'”’)\]]*(?:\s+|$)")
#: Where a part of a sentence ends: notices often stand on lines, or before semicolons or colons, without a full stop.
PART = re.compile(r"\n|[;:]+[\"'”’)\]]*(?:\s+|$)")
JUNK = re.compile(r"[^\w©]+|_+")
SPDX = re.compile(r"spdx-license-identifier\W*?:\s*(\S+)", re.I)


@dataclass(frozen=True)
class Known:
    """A known sentence: what must follow each other in it, with anything between."""

    name: str
    pieces: tuple[re.Pattern, ...]

    @classmethod
    def of(cls, name: str, pattern: str) -> Known:
        """From a pattern over a whole sentence. It is looked for in parts joined by line breaks, from
        where a part begins to where one ends."""
        start, end = r"(?:(?<=\n)|\A)", r"(?=\n|\Z)"
        if pattern.startswith(r".*\b"):
            pattern, start = pattern[2:], ""
        if pattern.endswith(".*"):
            pattern, end = pattern[:-2], ""
        pieces = [x.replace(".+", ".+?").replace(" ", r"[ \n]") for x in pattern.split(".*")]
        pieces[0], pieces[-1] = start + f"(?:{pieces[0]})", f"(?:{pieces[-1]})" + end if len(pieces) > 1 else start + f"(?:{pieces[-1]})" + end
        return cls(name, tuple(re.compile(x, re.S) for x in pieces))

    def found(self, plain: str) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, groups) of the places that do not overlap. Each piece is looked for from the end
        of the one before; where one is missing none can follow, so the time is that of one scan."""
        at = 0
        while m := self.pieces[0].search(plain, at):
            start, at, groups = m.start(), m.end(), list(m.groups())
            for piece in self.pieces[1:]:
                m = piece.search(plain, at)
                if not m:
                    return
                at = m.end()
                groups += m.groups()
            yield start, at, groups
            at = max(at, start + 1)


KNOWN = tuple(Known.of(name, pattern) for name, pattern in SENTENCES)


def normalised(sentence: str) -> str:
    return " ".join(JUNK.sub(" ", sentence.lower()).split())


def paragraphs(text: str) -> Iterator[str]:
    """Runs of lines with words: lines that are blank, or hold comment marks alone, part them."""
    lines: list[str] = []
    for line in [*text.split("\n"), ""]:
        if normalised(line):
            lines.append(line)
        elif lines:
            yield "\n".join(lines)
            lines = []


def identifiers(text: str) -> list[tuple[str, str]]:
    """(identifier, version or name in it) of the text's known sentences, in order.

    A known sentence may take any run of parts (lines, or what semicolons part) of a sentence.
    """
    out = []
    for paragraph in paragraphs(text):
        if CUE.search(paragraph.lower()):
            for sentence in END.split(paragraph):
                if CUE.search(sentence.lower()):
                    out += identified(sentence)
    return out


def identified(sentence: str) -> list[tuple[str, str]]:
    """Of the known sentences found, those in most runs of parts that do not overlap; of as many, the longer ones."""
    plain = "\n".join(x for x in map(normalised, PART.split(sentence)) if x)
    runs: dict[tuple[int, int], tuple[int, tuple[str, str]]] = {}  # the first of SENTENCES in each run
    for known in KNOWN:
        for i, (start, end, groups) in enumerate(known.found(plain)):
            name, first = known.name, plain.rfind("\n", 0, start) + 1
            last = plain.find("\n", max(end - 1, start))
            if name == "spdx":
                named = SPDX.findall(sentence)
                extra = named[i].rstrip(".") if i < len(named) else ""
            else:
                extra = ".".join(g for g in groups if g)
            runs.setdefault((first, last if last >= 0 else len(plain)), (end - start, (name, extra)))
    ends: list[int] = []
    best: list[tuple[int, int, tuple]] = []  # number, length and chain of what is chosen up to each end
    for (first, last), (size, what) in sorted(runs.items(), key=lambda x: (x[0][1], x[0][0])):
        before = best[bisect_right(ends, first) - 1] if bisect_right(ends, first) else (0, 0, ())
        now = (before[0] + 1, before[1] + size, (before[2], what))
        ends.append(last)
        best.append(now if not best or now[:2] > best[-1][:2] else best[-1])
    out, chain = [], best[-1][2] if best else ()
    while chain:
        chain, what = chain
        out.append(what)
    return out[::-1]


def licences(ids: list[tuple[str, str]]) -> list[str]:
    """The licences of a sequence of identifiers, in the order of their places."""
    names, free, out = [n for n, _ in ids], [True] * len(ids), []
    for licence, rule in RULES:
        k = len(rule)
        for at in range(len(names) - k + 1):
            if all(free[at : at + k]) and tuple(names[at : at + k]) == rule:
                free[at : at + k] = [False] * k
                extra = ids[at][1]
                out.append((at, extra if licence == "SPDX" else f"{licence}-{extra}" if extra else licence))
    return [x for _, x in sorted(out)]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licences (arrays, in order of the text) and n_licences (distinct).

    A null or empty text has empty arrays. Every row of docs gives one row; repeated rows are alike, and
    no rows give none. Texts and sentences of any length are read whole, in time that grows with their
    length. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [identifiers(t) if t and CUE.search(t.lower()) else [] for t in batch.column(1).to_pylist()]
            found = [licences(x) for x in ids]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[n for n, _ in x] for x in ids], strings), pa.array(found, strings), pa.array([len(set(x)) for x in found], pa.int64())],
                ["doc_id", "sentence_ids", "licences", "n_licences"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sentence_ids array<string>, licences array<string>, n_licences long")
