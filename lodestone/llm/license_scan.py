"""License scans by ordered signature rules.

A text becomes its words: runs of letters, digits and characters beyond ASCII, with A-Z in small letters, joined by
single spaces. Rules are regular expressions over that form. Plain searches for the forms' own words and an automaton
over the names' keywords find which rules can match at all; only those run. Each detection is an interval of words with its rule's priority. A detection inside another
of higher priority, or of the same priority and longer, is suppressed; what is left gives the labels.

The base phrases are counted besides, by themselves, and their labels always stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places count, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, and the license's name as a pattern over words.
NAMES = {
    "mit": "mit|expat|mit expat",
    "mit-0": "mit 0|mit no attribution",
    "apache-1": "apache(?: software)? license(?: version| v)? 1 [01]|apache 1 [01]",
    "apache-2": "apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?",
    "bsd": "(?:the )?bsd(?: style)?",
    "bsd-0-clause": "0bsd|bsd (?:0|zero) clause|zero clause bsd",
    "bsd-2-clause": "bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd",
    "bsd-3-clause": "bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd",
    "bsd-4-clause": "bsd 4 clause|(?:4|four) clause bsd|original bsd",
    "gpl": "(?:gnu )?general public|gpl|gnu gpl",
    "gpl-1": "(?:gnu )?general public license(?: version| v)? 1(?: 0)?|(?:gnu )?gpl ?v?1(?: 0)?",
    "gpl-2": "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?2(?: 0)?|(?:gnu )?gpl ?v?2(?: 0)?",
    "gpl-3": "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?3(?: 0)?|(?:gnu )?gpl ?v?3(?: 0)?",
    "lgpl": "(?:gnu )?(?:lesser|library) general public|(?:gnu )?lgpl",
    "lgpl-2": "(?:gnu )?library general public license(?: version| v)? 2(?: 0)?|(?:gnu )?lgpl ?v?2 0",
    "lgpl-2.1": "(?:gnu )?lesser general public license(?: version| v)? 2 1|(?:gnu )?lgpl ?v?2 1",
    "lgpl-3": "(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?|(?:gnu )?lgpl ?v?3(?: 0)?",
    "agpl": "(?:gnu )?affero general public|(?:gnu )?agpl",
    "agpl-3": "(?:gnu )?affero general public license(?: version| v)? 3(?: 0)?|(?:gnu )?agpl ?v?3(?: 0)?",
    "gfdl": "(?:gnu )?free documentation|(?:gnu )?gfdl",
    "mpl-1.1": "mozilla public license(?: version| v)? 1 1|mpl 1 1",
    "mpl-2": "mozilla public license(?: version| v)? 2(?: 0)?|mpl 2(?: 0)?",
    "epl-1": "eclipse public license(?: version| v)? v?1(?: 0)?|epl 1 0",
    "epl-2": "eclipse public license(?: version| v)? v?2(?: 0)?|epl 2 0",
    "cddl-1": "common development and distribution license(?: version| v)? 1(?: 0)?|cddl 1 0",
    "cddl-1.1": "common development and distribution license(?: version| v)? 1 1|cddl 1 1",
    "eupl": "european union public|eupl",
    "eupl-1.2": "european union public licence(?: version| v)? 1 2|eupl 1 2",
    "cc0": "cc0|cc zero|creative commons zero",
    "cc-by": "cc by|creative commons attribution",
    "cc-by-sa": "cc by sa|creative commons attribution share ?alike",
    "cc-by-nd": "cc by nd|creative commons attribution no ?derivatives",
    "cc-by-nc": "cc by nc|creative commons attribution non ?commercial",
    "cc-by-nc-sa": "cc by nc sa|creative commons attribution non ?commercial share ?alike",
    "cc-by-nc-nd": "cc by nc nd|creative commons attribution non ?commercial no ?derivatives",
    "unlicense": "the unlicense|unlicense",
    "wtfpl": "wtfpl|do what the fuck you want to public",
    "isc": "isc",
    "zlib": "zlib|zlib libpng",
    "boost": "boost software|bsl 1 0|boost",
    "artistic-1": "artistic license(?: version| v)? 1(?: 0)?|artistic 1 0",
    "artistic-2": "artistic license(?: version| v)? 2(?: 0)?|artistic 2 0",
    "perl": "perl|same terms as perl(?: itself)?",
    "python": "python software foundation|psf|python",
    "php": "php license(?: version| v)? 3 0?1|php 3 01",
    "ruby": "ruby",
    "postgresql": "postgresql",
    "openssl": "openssl",
    "x11": "x11|mit x11",
    "ncsa": "ncsa|university of illinois ncsa open source",
    "afl-3": "academic free license(?: version| v)? 3(?: 0)?|afl 3 0",
    "osl-3": "open software license(?: version| v)? 3(?: 0)?|osl 3 0",
    "ms-pl": "microsoft public|ms pl",
    "ms-rl": "microsoft reciprocal|ms rl",
    "apsl-2": "apple public source license(?: version| v)? 2(?: 0)?|apsl 2 0",
    "cpl-1": "common public license(?: version| v)? 1(?: 0)?|cpl 1 0",
    "ipl-1": "ibm public license(?: version| v)? 1(?: 0)?|ipl 1 0",
    "ofl-1.1": "sil open font|open font license(?: version| v)? 1 1|ofl 1 1",
    "odbl": "open database|odbl",
    "odc-by": "open data commons attribution|odc by",
    "pddl": "public domain dedication and license|pddl",
    "lppl": "latex project public|lppl",
    "vim": "vim",
    "sleepycat": "sleepycat",
    "sspl": "server side public|sspl",
    "busl-1.1": "business source license(?: version| v)? 1 1|busl 1 1",
    "elastic-2": "elastic license(?: version| v)? 2(?: 0)?",
    "json": "json",
    "beerware": "beerware|beer ware",
    "openrail": "openrail|open rail m?|responsible ai",
    "unicode": "unicode",
    "w3c": "w3c software(?: notice)?(?: and)?|w3c",
}

#: How a name stands in a sentence (``@`` is the name), with priority and confidence, strongest first,
#: and last the runs of which any text that fits holds one.
FORMS = (
    ("spdx license identifier (?:@)(?: only| or later)?", 90, 1.0, ("spdx",)),
    ("(?:licen[sc]ed|released|distributed|available|published|provided|made available|covered) under (?:the terms of )?(?:the |an? )?(?:@)(?: licen[sc]e)?", 80, 0.95, (" under ",)),
    ("(?:subject to|governed by|under the terms of|terms and conditions of) (?:the )?(?:@)(?: licen[sc]e)?", 70, 0.9, ("subject to", "governed by", "terms of", "conditions of")),
    ("opensource org licen[sc]es (?:@)", 60, 0.9, ("opensource org",)),
    ("(?:@) (?:public )?licen[sc]e(?: version \\d+(?: \\d+)?)?", 50, 0.8, (" licen",)),
    ("licen[sc]e (?:is |type |name )?(?:the )?(?:@)", 40, 0.7, (" licen",)),
)

#: Rules without a license's name: label, pattern, priority, confidence.
OTHERS = (
    ("copyright", "copyright (?:c )?(?:19|20)\\d\\d", 30, 0.5),
    ("all-rights-reserved", "all rights reserved", 30, 0.6),
    ("public-domain", "(?:released|dedicated|placed) (?:in)?to the public domain|in the public domain", 45, 0.7),
    ("permissive-notice", "permission is hereby granted free of charge to any person obtaining a copy", 85, 0.9),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted", 85, 0.9),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind", 35, 0.5),
    ("proprietary", "proprietary and confidential|unauthori[sz]ed copying(?: of this file)?", 45, 0.7),
)

#: Sentences of the licenses' own texts, each a signature: label, pattern. All have the same priority and confidence.
TEXTS = (
    ("agpl-3", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "remote network interaction use with the gnu general public license"),
    ("apache-2", "apache license version 2 0 january 2004"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("epl-1", "eclipse public license v 1 0 the accompanying program is provided under the terms"),
    ("epl-2", "eclipse public license v 2 0 the accompanying program is provided under the terms"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
)

@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    pattern: re.Pattern
    priority: int
    confidence: float
    gates: tuple[bytes, ...]
    keywords: tuple[str, ...]


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern at its outermost level."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


def _required(branch: str) -> str:
    """The longest plain run that every match of a branch holds."""
    flat, depth, plain = [], 0, ""
    for i, c in enumerate(branch):
        if c in "([":
            depth += 1
        if depth == 0 and (c.isalnum() or c == " ") and branch[i + 1 : i + 2] != "?" and not (c == "d" and branch[i - 1 : i] == "\\"):
            plain += c
        else:
            flat.append(plain)
            plain = ""
        if c in ")]":
            depth -= 1
    return max([*flat, plain], key=lambda x: len(x.strip())).strip()


def build_rules() -> list[Rule]:
    """Every form for every name, and the others, in order of priority."""
    made = [(priority, label, form.replace("@", name), confidence, gates, name) for form, priority, confidence, gates in FORMS for label, name in NAMES.items()]
    made += [(priority, label, pattern, confidence, None, pattern) for label, pattern, priority, confidence in OTHERS]
    made += [(85, label, pattern, 0.9, None, pattern) for label, pattern in TEXTS]
    made.sort(key=lambda x: -x[0])
    out = []
    for i, (priority, label, pattern, confidence, gates, source) in enumerate(made):
        keywords = tuple(sorted({_required(b) for b in _branches(source)}))
        out.append(Rule(i, label, re.compile(f"(?<= )(?:{pattern})(?= )"), priority, confidence, tuple(g.encode() for g in gates or keywords), keywords))
    return out


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of detections (priority, first word, end word, rule) those inside no stronger one.

    Stronger: higher priority; then longer; then the earlier rule. One stands for equals.
    """
    kept: list[tuple[int, int, int, int]] = []
    for d in sorted(set(found), key=lambda d: (-d[0], d[1] - d[2], d[3], d[1])):
        if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d[1], d[2], d[3]))


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = build_rules()
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for r in self.rules:
            for k in r.keywords:
                by.setdefault(k, []).append(r.order)
        for k, rules in by.items():
            self.automaton.add_word(k, tuple(rules))
        self.automaton.make_automaton()
        self.gates = sorted({g for r in self.rules for g in r.gates})
        self.base = [(p.encode(), re.compile(f"(?<= )(?={p} )"), label) for p, label in BASE.items()]
        self.table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score, detections."""
        tokens = text.translate(self.table).split()
        joined = b" " + b" ".join(tokens) + b" "
        gates = {g for g in self.gates if g in joined}
        base = [(pattern, label) for phrase, pattern, label in self.base if phrase in joined]
        if not gates and not base:
            return len(tokens), 0, None, None, (), (), 0.0, ()
        line = joined.decode("utf-8", "replace")
        candidates = sorted(r for r in {r for _, rules in self.automaton.iter(line) for r in rules} if not gates.isdisjoint(self.rules[r].gates))
        found, places, labels = [], [], set()
        for pattern, label in base:
            if at := [m.start() for m in pattern.finditer(line)]:
                labels.add(label)
                places += at
        for i in candidates:
            for m in self.rules[i].pattern.finditer(line):
                found.append((self.rules[i].priority, m.start(), m.end(), i))
        if not found and not places:
            return len(tokens), 0, None, None, (), (), 0.0, ()
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        word = lambda at: int(np.searchsorted(spaces, at, "left")) - 1  # noqa: E731  the number of the word that begins at a character
        kept = suppress([(p, word(a), word(b + 1), i) for p, a, b, i in found])
        score = max([0.95] * bool(places) + [self.rules[d[3]].confidence for d in kept])
        plain = tuple(sorted(labels))
        all_labels = tuple(sorted(labels | {self.rules[d[3]].label for d in kept}))
        at = [word(a) for a in places]
        return len(tokens), len(at), min(at, default=None), max(at, default=None), plain, all_labels, score, tuple((self.rules[d[3]].label, d[1], d[2], d[0]) for d in kept)


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,end_word:long,priority:long>>"
_DETECTION = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int64())]))
_SCANNERS: list[Scanner] = []


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: RESULT. Word numbers count from 0; ``end_word`` is the word after the detection.

    Null or empty text has no words, places or labels, and score 0. A null id stays null, repeated rows are scanned
    alike, an empty table gives no rows, other columns are not read. ``score`` is the greatest confidence among the
    detections that stay.
    """

    def scan(batches):
        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        scanner = _SCANNERS[0]
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i in range(0, len(texts), 512):
                out = [scanner.scan(t.as_py() or b"") for t in texts.slice(i, 512)]
                n_words, n_base, first, last, base, labels, score, found = zip(*out, strict=True)
                join = lambda x: pa.array([",".join(v) for v in x], pa.string())
                detections = pa.array([[dict(zip(("label", "first_word", "end_word", "priority"), d, strict=True)) for d in x] for x in found], _DETECTION)
                columns = [batch.column(0).slice(i, 512), *(pa.array(c, pa.int64()) for c in (n_words, n_base, first, last)), join(base), join(labels), pa.array(score, pa.float64()), detections]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, RESULT)
