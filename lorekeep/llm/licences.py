"""Licence scans by sentence rules.

A text is cut into sentences (at line ends and after . ! ? before white space); each is normalised
(lower case, punctuation to blanks, white space squeezed) and mapped to the identifier of a known
licence sentence, by lookup or by pattern. Ordered rules, longer statements first, then match
sequences of identifiers of neighbouring sentences; a match uses its sentences up, so a short
reference inside a full text isn't reported twice. Copyright lines may stand anywhere between, and
up to APART characters that no known sentence covers (what a statement says after its known words).
Of rules that match the same sentences the first in the list wins.

Long statements may run over line ends, and stops of abbreviations may cut them: from each sentence's
start the known statements are also matched on the normalised text of all that follows, where a blank
of a pattern may be a sentence's end. A statement with a gap in its middle (an organisation's name)
ends at the next text that closes it, unless another known statement starts before.

Edge cases: null and empty texts have no sentences and no licences; repeated sentences count each;
an empty table gives an empty result; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Known sentences: identifier -> patterns of the whole normalised sentence.
SENTENCES: dict[str, tuple[str, ...]] = {
    "Copyright": (r"(portions )?copyright( c)?( \d{4}.*| .*)?", r"c copyright .*"),
    "AllRights": (r"all rights reserved",),
    "Spdx": (r"spdx license identifier (?P<spdx>[a-z0-9 .+]+)",),
    "MitPermission": (r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*",),
    "MitNotice": (r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MitWarranty": (r"the software is provided as is without warranty of any kind express or implied.*",),
    "MitLiability": (r"in no event shall the authors or copyright holders be liable for any claim damages or other liability.*",),
    "MitReference": (r"(this (work|software|file|project|page|text) is )?(released|licensed|distributed|available|published) under the (terms of the )?mit licen[sc]e", r"licen[sc]e mit", r"mit licen[sc]e"),
    "IscPermission": (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "IscWarranty": (r"the software is provided as is and the author disclaims all warranties.*",),
    "BsdRedistribution": (r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*",),
    "BsdSource": (r"(\d )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BsdBinary": (r"(\d )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer.*",),
    "BsdEndorse": (r"(\d )?neither the name of .* nor the names of its contributors may be used to endorse or promote products.*",),
    "BsdWarranty": (r"this software is provided by the (copyright holders|regents|author).* as is and any express or implied warranties.*",),
    "BsdReference": (r"(this (work|software|file|project) is )?(released|licensed|distributed|available) under the (terms of the )?(?P<bsd>[23]) clause bsd licen[sc]e", r"(released|licensed|distributed) under the bsd licen[sc]e"),
    "ApacheReference": (r"(this (work|software|file|project|page|text) is )?(released|licensed|distributed|available) under the (terms of the )?apache licen[sc]e( version)? 2 ?0?( the license)?.*",),
    "ApacheMayNot": (r"you may not use this file except in compliance with the license",),
    "ApacheObtain": (r"you may obtain a copy of the license at.*",),
    "ApacheBasis": (r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*",),
    "ApacheSee": (r"see the license for the specific language governing permissions and limitations under the license",),
    "GplReference": (r"(this (work|program|software|file|project|page|text) is )?(released|licensed|distributed|available) under the (terms of the )?gnu general public licen[sc]e( version| v)? (?P<gpl>[23])( 0)?(?P<gpllater> or (any )?later.*)?",),
    "GplFree": (r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version (?P<gplfree>[23]) of the license or (at your option )?any later version",),
    "LgplFree": (r"this (library|program) is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation either version (?P<lgplfree>2 1|2|3) of the license or (at your option )?any later version",),
    "AgplFree": (r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version",),
    "GplHope": (r"this (program|library) is distributed in the hope that it will be useful but without any warranty.*",),
    "GplReceived": (r"you should have received a copy of the gnu (lesser |library |affero )?general public license.*",),
    "LgplReference": (r"(this (work|library|software|file) is )?(released|licensed|distributed|available) under the (terms of the )?gnu (lesser|library) general public licen[sc]e( version| v)? (?P<lgpl>2 1|2|3).*",),
    "AgplReference": (r"(this (work|program|software|file) is )?(released|licensed|distributed|available) under the (terms of the )?gnu affero general public licen[sc]e( version| v)? 3.*",),
    "MplReference": (r"this source code form is subject to the terms of the mozilla public license v 2 0", r"(released|licensed|distributed) under the mozilla public licen[sc]e( version)? 2 0"),
    "CcReference": (r"(this (work|text|page|article) is )?(released|licensed|available|distributed) under (a |the )?(cc|creative commons) (?P<cc>by|attribution)(?P<ccnc> nc| noncommercial)?(?P<ccsa> sa| sharealike)?(?P<ccnd> nd| noderivatives)?( international)? (?P<ccv>[1-4] 0)( international)?( license)?",),
    "Cc0Reference": (r".*(cc0 1 0|public domain dedication).*",),
    "Unlicense": (r"this is free and unencumbered software released into the public domain",),
}
#: Rules in order: (licence, identifiers of neighbouring sentences). {x} is filled from the pattern's group x.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MitPermission", "MitNotice", "MitWarranty", "MitLiability")),
    ("MIT", ("MitPermission", "MitNotice", "MitWarranty")),
    ("ISC", ("IscPermission", "IscWarranty")),
    ("BSD-3-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse", "BsdWarranty")),
    ("BSD-2-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdWarranty")),
    ("Apache-2.0", ("ApacheReference", "ApacheMayNot", "ApacheObtain", "ApacheBasis", "ApacheSee")),
    ("Apache-2.0", ("ApacheReference", "ApacheMayNot")),
    ("GPL-{gplfree}.0-or-later", ("GplFree", "GplHope", "GplReceived")),
    ("GPL-{gplfree}.0-or-later", ("GplFree",)),
    ("LGPL-{lgplfree}-or-later", ("LgplFree", "GplHope", "GplReceived")),
    ("LGPL-{lgplfree}-or-later", ("LgplFree",)),
    ("AGPL-3.0-or-later", ("AgplFree", "GplHope", "GplReceived")),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("{spdx}", ("Spdx",)),
    ("MIT", ("MitReference",)),
    ("Apache-2.0", ("ApacheReference",)),
    ("GPL-{gpl}.0-or-later", ("GplReference+later",)),
    ("GPL-{gpl}.0", ("GplReference",)),
    ("LGPL-{lgpl}", ("LgplReference",)),
    ("AGPL-3.0", ("AgplReference",)),
    ("MPL-2.0", ("MplReference",)),
    ("CC-BY{ccnc}{ccsa}{ccnd}-{ccv}", ("CcReference",)),
    ("CC0-1.0", ("Cc0Reference",)),
    ("BSD-{bsd}-Clause", ("BsdReference",)),
    ("Unlicense", ("Unlicense",)),
    ("MIT-partial", ("MitPermission",)),
    ("BSD-partial", ("BsdRedistribution",)),
)
#: Every pattern above holds one of these, on one line; a text without any has no known sentence.
ANCHORS = re.compile(r"licen[sc]e|copyright|spdx|permission|warrant|redistribut|reserved|domain|creative|cc0|(?<![a-z0-9+])cc(?![a-z0-9+])|liable|endorse", re.I)
BETWEEN = {"Copyright", "AllRights"}
#: Characters without a known sentence that may stand between two sentences of one rule.
APART = 800
_SHORT = {"lgplfree": {"2": "2.0", "2 1": "2.1", "3": "3.0"}, "ccnc": {" nc": "-NC", " noncommercial": "-NC"}, "ccsa": {" sa": "-SA", " sharealike": "-SA"}, "ccnd": {" nd": "-ND", " noderivatives": "-ND"}}


def normalised(sentence: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9+]+", " ", sentence.lower()).split())


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of each sentence with a word; a blank line or a full stop ends one, a line end as well."""
    out, at = [], 0
    for line in text.split("\n"):
        pos = at
        for part in re.split(r"(?<=[.!?])(?=\s)", line):
            norm = normalised(part)
            if norm:
                out.append((pos, pos + len(part), norm))
            pos += len(part)
        at += len(line) + 1
    return out


def across(pattern: str) -> str:
    """The pattern on sentences joined by line ends: a blank may be one, and what is open at the start or the end stays in its sentence."""
    return re.sub(r"\[[^]]*\]|\.\*| ", lambda m: {" ": "[ \\n]", ".*": "[^\\n]*"}.get(m[0], m[0]), pattern)


class Recogniser:
    def __init__(self, known: dict[str, tuple[str, ...]] = SENTENCES, rules=RULES):
        self.known = [(name, re.compile(p)) for name, ps in known.items() for p in ps]
        self.plain: list[tuple[str, re.Pattern]] = []
        self.gapped: list[tuple[str, re.Pattern, re.Pattern]] = []  # identifier, up to the gap, from the gap's end
        for name, p in ((name, p) for name, ps in known.items() if name not in BETWEEN for p in ps):
            head, gap, tail = p.partition(".* ")
            if gap:
                self.gapped.append((name, re.compile(across(head)), re.compile(across(f" {tail}") + "(?=\n)")))
            else:
                self.plain.append((name, re.compile(across(p) + "(?=\n)")))
        heads = [f"(?:{p.pattern})" for _, p in self.plain] + [f"(?:{p.pattern})" for _, p, _ in self.gapped]
        self.opening = re.compile(re.sub(r"\(\?P<\w+>", "(?:", "|".join(heads)))
        self.rules = rules
        self.memory: dict[str, tuple[str, dict] | None] = {}

    def identify(self, norm: str) -> tuple[str, dict] | None:
        """Identifier and groups of a normalised sentence; remembered, up to a bound."""
        if norm in self.memory:
            return self.memory[norm]
        found = None
        if ANCHORS.search(norm):
            for name, pattern in self.known:
                m = pattern.fullmatch(norm)
                if m:
                    groups = m.groupdict()
                    found = (name + "+later" * bool(groups.get("gpllater")), groups)
                    break
        if len(self.memory) > 50_000:
            self.memory.clear()
        self.memory[norm] = found
        return found

    def identified(self, text: str) -> list[tuple[int, int, int, str, dict]]:
        """(sentence number, start, end, identifier, groups); neighbouring sentences are joined where only that gives a known one."""
        sents, out, i = sentences(text), [], 0
        joined = "".join(norm + "\n" for _, _, norm in sents)
        starts = [0, *accumulate(len(norm) + 1 for _, _, norm in sents)]
        tails: dict[int, re.Match | None] = {}  # the next close of each gapped pattern, found once
        while i < len(sents):
            j, hit = i, self.identify(sents[i][2])
            if not hit and self.opening.match(joined, starts[i]):
                end, hit = self.joint(joined, starts, i, tails)
                j = bisect_left(starts, end) - 1
            if hit:
                out.append((i, sents[i][0], sents[j][1], *hit))
                i = j
            i += 1
        return out

    def joint(self, joined: str, starts: list[int], i: int, tails: dict) -> tuple[int, tuple[str, dict] | None]:
        """End, identifier and groups of the known sentence that starts at sentence i and runs on in the next ones."""
        at = starts[i]
        for name, pattern in self.plain:
            m = pattern.match(joined, at)
            if m:
                groups = m.groupdict()
                return m.end(), (name + "+later" * bool(groups.get("gpllater")), groups)
        for k, (name, head, tail) in enumerate(self.gapped):
            m = head.match(joined, at)
            if m:
                close = tails.get(k)
                if k not in tails or close and close.start() < m.end():
                    close = tails[k] = tail.search(joined, m.end())
                if close:
                    inside = starts[bisect_right(starts, at) : bisect_left(starts, close.end())]
                    if not any(self.opening.match(joined, x) for x in inside):
                        return close.end(), (name, m.groupdict() | close.groupdict())
        return at, None

    def scan(self, text: str | None) -> tuple[list[str], list[tuple[str, int, int]]]:
        """Identifiers in order, and (licence, start, end) of each rule that matched."""
        if not text or not ANCHORS.search(text):
            return [], []
        seq = self.identified(text)
        live = [x for x in seq if x[3] not in BETWEEN]
        covered = lambda a, b: sum(x[2] - x[1] for x in seq if x[3] in BETWEEN and a[2] <= x[1] < b[1])
        used, found = [False] * len(live), []
        for licence, ids in self.rules:
            for i in range(len(live) - len(ids) + 1):
                near = all(live[i + k][1] - live[i + k - 1][2] - covered(live[i + k - 1], live[i + k]) <= APART for k in range(1, len(ids)))
                if near and not any(used[i : i + len(ids)]) and all(live[i + k][3] == name for k, name in enumerate(ids)):
                    used[i : i + len(ids)] = [True] * len(ids)
                    groups: dict[str, str] = {}
                    for x in live[i : i + len(ids)]:
                        groups |= {k: v for k, v in x[4].items()}
                    names = {k: _SHORT[k].get(v or "", "") if k in _SHORT else (v or "").replace(" ", "." if k in ("ccv", "lgpl") else "-") for k, v in groups.items()}
                    found.append((licence.format(**names) if "{bsd}" not in licence or names.get("bsd") else "BSD", live[i][1], live[i + len(ids) - 1][2]))
        return [x[3] for x in seq], sorted(found, key=lambda f: f[1:])


SCHEMA = "doc_id long, n_sentence_ids long, sentence_ids array<string>, licences array<string>, starts array<bigint>, ends array<bigint>"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: identifiers of its known sentences in order, its licences and their spans."""

    def run(batches):
        import pyarrow as pa

        rec = Recogniser()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, found = rec.scan(text.as_py())
                rows.append((doc, len(ids), ids, *([f[k] for f in found] for k in range(3))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_sentence_ids", "sentence_ids", "licences", "starts", "ends"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def op2_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(documents(spark, sf_dir))
    return out.select("doc_id", "n_sentence_ids", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))
