"""License scan: ordered signature rules behind a keyword prefilter, and base phrases with word positions.

Rules are regular expressions over the text with A-Z lower-cased, each with a keyword that must occur before the
expression is tried, a priority and a weight. They are written once per form of notice (identifier, address,
grant, name with version, short name, name) and filled in for each license and version. Where the interval of one
detection contains another's, the lower priority goes, of equal priority the shorter and then the later rule;
detections that merely overlap stay.

All positions are bytes of the UTF-8 text or words, runs of digits, letters a-z and characters outside ASCII.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.columns import id_and_text

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_WEIGHT = 0.5

# Label, names, short name, address, versions. A label stands for the license without a version.
LICENSES = [
    ("gpl", ["gnu general public license", "general public license", "gnu gpl"], "gpl", "gnu.org/licenses/gpl", "1.0 2.0 3.0"),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"], "lgpl", "gnu.org/licenses/lgpl", "2.0 2.1 3.0"),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl"], "agpl", "gnu.org/licenses/agpl", "1.0 3.0"),
    ("gfdl", ["gnu free documentation license"], "gfdl", "gnu.org/licenses/fdl", "1.1 1.2 1.3"),
    ("apache", ["apache license", "apache software license"], "apache", "apache.org/licenses/license-", "1.0 1.1 2.0"),
    ("mit", ["mit license", "expat license", "x11 license"], "mit", "opensource.org/licenses/mit", ""),
    ("bsd", ["bsd license", "berkeley software distribution license"], "bsd", "opensource.org/licenses/bsd", ""),
    ("bsd-2-clause", ["bsd 2 clause license", "simplified bsd license", "two clause bsd license"], "bsd-2-clause", "opensource.org/licenses/bsd-2-clause", ""),
    ("bsd-3-clause", ["bsd 3 clause license", "new bsd license", "three clause bsd license"], "bsd-3-clause", "opensource.org/licenses/bsd-3-clause", ""),
    ("0bsd", ["zero clause bsd license"], "0bsd", "opensource.org/licenses/0bsd", ""),
    ("isc", ["isc license", "internet systems consortium license"], "isc", "opensource.org/licenses/isc", ""),
    ("mpl", ["mozilla public license"], "mpl", "mozilla.org/mpl", "1.0 1.1 2.0"),
    ("epl", ["eclipse public license"], "epl", "eclipse.org/legal/epl", "1.0 2.0"),
    ("cddl", ["common development and distribution license"], "cddl", "opensource.org/licenses/cddl", "1.0 1.1"),
    ("cpl", ["common public license"], "cpl", "opensource.org/licenses/cpl", "1.0"),
    ("eupl", ["european union public licence", "european union public license"], "eupl", "joinup.ec.europa.eu/software/page/eupl", "1.0 1.1 1.2"),
    ("artistic", ["artistic license"], "artistic", "opensource.org/licenses/artistic", "1.0 2.0"),
    ("bsl", ["boost software license"], "bsl", "boost.org/license", "1.0"),
    ("busl", ["business source license"], "busl", "mariadb.com/bsl", "1.1"),
    ("sspl", ["server side public license"], "sspl", "mongodb.com/licensing/server-side-public-license", "1.0"),
    ("osl", ["open software license"], "osl", "opensource.org/licenses/osl", "1.0 2.0 2.1 3.0"),
    ("afl", ["academic free license"], "afl", "opensource.org/licenses/afl", "1.1 1.2 2.0 2.1 3.0"),
    ("ofl", ["sil open font license", "open font license"], "ofl", "scripts.sil.org/ofl", "1.0 1.1"),
    ("zlib", ["zlib license", "zlib libpng license"], "zlib", "opensource.org/licenses/zlib", ""),
    ("unlicense", ["the unlicense"], "unlicense", "unlicense.org", ""),
    ("wtfpl", ["do what the fuck you want to public license"], "wtfpl", "wtfpl.net", "2.0"),
    ("psf", ["python software foundation license"], "psf", "docs.python.org/3/license", "2.0"),
    ("php", ["php license"], "php", "php.net/license", "3.0 3.01"),
    ("ruby", ["ruby license"], "ruby", "ruby-lang.org/en/about/license", ""),
    ("postgresql", ["postgresql license"], "postgresql", "opensource.org/licenses/postgresql", ""),
    ("openssl", ["openssl license"], "openssl", "openssl.org/source/license", ""),
    ("ncsa", ["university of illinois open source license", "ncsa open source license"], "ncsa", "opensource.org/licenses/ncsa", ""),
    ("ms-pl", ["microsoft public license"], "ms-pl", "opensource.org/licenses/ms-pl", ""),
    ("ms-rl", ["microsoft reciprocal license"], "ms-rl", "opensource.org/licenses/ms-rl", ""),
    ("cecill", ["cecill license", "cecill free software license agreement"], "cecill", "cecill.info/licences", "1.0 1.1 2.0 2.1"),
    ("cc0", ["cc0 public domain dedication", "creative commons zero"], "cc0", "creativecommons.org/publicdomain/zero", "1.0"),
    ("cc-by", ["creative commons attribution", "cc by", "attribution international"], "cc-by", "creativecommons.org/licenses/by/", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"], "cc-by-sa", "creativecommons.org/licenses/by-sa/", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", ["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"], "cc-by-nc", "creativecommons.org/licenses/by-nc/", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", ["creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd"], "cc-by-nd", "creativecommons.org/licenses/by-nd/", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", ["creative commons attribution noncommercial sharealike", "cc by nc sa"], "cc-by-nc-sa", "creativecommons.org/licenses/by-nc-sa/", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", ["creative commons attribution noncommercial noderivatives", "cc by nc nd"], "cc-by-nc-nd", "creativecommons.org/licenses/by-nc-nd/", "1.0 2.0 2.5 3.0 4.0"),
    ("odbl", ["open database license", "odc open database license"], "odbl", "opendatacommons.org/licenses/odbl", "1.0"),
    ("odc-by", ["open data commons attribution license"], "odc-by", "opendatacommons.org/licenses/by", "1.0"),
    ("pddl", ["public domain dedication and license"], "pddl", "opendatacommons.org/licenses/pddl", "1.0"),
]

# Notices that are no license of a name; label, keyword (one word), pattern with blanks for separators, weight.
NOTICES = [
    ("proprietary", "reserved", "all rights reserved", 0.6),
    ("proprietary", "droits", "tous droits r..serv..s", 0.6),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 0.7),
    ("proprietary", "permission", "may not be (?:reproduced|copied|distributed) without (?:the )?(?:prior )?(?:written )?permission", 0.7),
    ("public-domain", "domain", "(?:released|dedicated|placed|is) (?:to|in|into) the public domain", 0.8),
    ("public-domain", "domain", "public domain", 0.5),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 0.4),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose", 1.0),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors", 0.9),
    ("boost", "boost", "distributed under the boost software license", 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
]

_WORD = r"[0-9a-z\x80-\xff]"
_SEP = r"[^0-9a-z\x80-\xff]+"


class Rule(NamedTuple):
    name: str
    label: str
    keyword: bytes
    priority: int
    weight: float
    pattern: re.Pattern


def _words(phrase: str) -> str:
    return phrase.replace(" ", _SEP)


def _bounded(pattern: str) -> re.Pattern:
    return re.compile(f"(?<!{_WORD})(?:{pattern})(?!{_WORD})".encode("latin-1"))


def _version(version: str) -> str:
    """``2.0`` is also written ``2``; digits that follow belong to another version."""
    major, _, minor = version.partition(".")
    return (re.escape(major) + (r"(?:\.0)?" if minor == "0" else re.escape(f".{minor}"))) + r"(?![.]?\d)"


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order; the forms are written here, once."""
    out: list[Rule] = []

    def add(form: str, label: str, keyword: str, priority: int, weight: float, pattern: str) -> None:
        out.append(Rule(f"{form}:{label}:{len(out)}", label, keyword.encode(), priority, weight, _bounded(pattern)))

    for label, names, short, address, versions in LICENSES:
        versioned = versions.split()
        later = rf"(?:-or-later|-only|\+)?"
        for v in versioned:
            own = f"{label}-{v}"
            add("identifier", own, "spdx-license-identifier", 1, 1.0, rf"spdx-license-identifier:\s*{re.escape(short)}-{re.escape(v)}{later}")
            add("address", own, address.split("/")[0], 2, 0.95, rf"{re.escape(address)}[-/v]*{_version(v)}(?:\.html|\.txt|/)?")
            add("short", own, short.split("-")[0], 5, 0.8, rf"{_words(short.replace('-', ' '))}[\s-]*v?\s*{_version(v)}{later}")
            for name in names:
                add("version", own, max(name.split(), key=len), 3, 0.9, rf"{_words(name)}[\s,(]*(?:version|v\.?|ver\.?)?\s*{_version(v)}(?:{_SEP}or{_SEP}(?:any{_SEP})?later(?:{_SEP}version)?)?")
        add("identifier", label, "spdx-license-identifier", 1, 1.0, rf"spdx-license-identifier:\s*{re.escape(short)}")
        add("address", label, address.split("/")[0], 2, 0.95, re.escape(address.rstrip("/")))
        for name in names:
            rarest = max(name.split(), key=len)
            grant = r"(?:licensed|released|distributed|available|provided|published|shared)"
            add("grant", label, rarest, 4, 0.85, rf"{grant}{_SEP}under{_SEP}(?:the{_SEP})?(?:terms{_SEP}of{_SEP}the{_SEP})?{_words(name)}")
            add("name", label, rarest, 6, 0.6, _words(name))
    for label, keyword, pattern, weight in NOTICES:
        add("notice", label, keyword, 3, weight, _words(pattern))
    return tuple(out)


@functools.cache
def _by_keyword() -> tuple[tuple[bytes, tuple[tuple[int, Rule], ...]], ...]:
    grouped: dict[bytes, list[tuple[int, Rule]]] = {}
    for nth, rule in enumerate(rules()):
        grouped.setdefault(rule.keyword, []).append((nth, rule))
    return tuple((k, tuple(v)) for k, v in grouped.items())


@functools.cache
def _base() -> tuple[tuple[bytes, str, re.Pattern], ...]:
    return tuple((phrase.split()[0].encode(), label, _bounded(_words(phrase))) for phrase, label in BASE.items())


def detect(lowered: bytes) -> list[tuple[int, int, int, Rule]]:
    """Surviving detections as (start, end, order of the rule, rule), by position."""
    found = [
        (m.start(), m.end(), nth, rule)
        for keyword, gated in _by_keyword() if keyword in lowered
        for nth, rule in gated
        for m in rule.pattern.finditer(lowered)
    ]
    # Strongest first. Only accepted ones suppress, and an accepted one can hold or be held by the next.
    found.sort(key=lambda d: (d[3].priority, d[0] - d[1], d[2], d[0]))
    kept: list[tuple[int, int, int, Rule]] = []
    taken = _Intervals()
    for start, end, nth, rule in found:
        if not taken.holds_or_held(start, end):
            taken.add(start, end)
            kept.append((start, end, nth, rule))
    return sorted(kept, key=lambda d: (d[0], d[1], d[2]))


class _Intervals:
    """Accepted intervals in cells of the text, so that a text with many detections is not compared pair by pair."""

    CELL = 256

    def __init__(self) -> None:
        self.cells: dict[int, list[tuple[int, int]]] = {}

    def _range(self, start: int, end: int) -> range:
        return range(start // self.CELL, (end - 1) // self.CELL + 1)

    def add(self, start: int, end: int) -> None:
        for cell in self._range(start, end):
            self.cells.setdefault(cell, []).append((start, end))

    def holds_or_held(self, start: int, end: int) -> bool:
        near = (i for cell in self._range(start, end) for i in self.cells.get(cell, ()))
        return any((s <= start and end <= e) or (start <= s and e <= end) for s, e in near)


_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True

_SPANS = "array<struct<start:long,end:long,label:string,rule:string,priority:int,weight:double>>"
_SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, detections {_SPANS}"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("weight", pa.float64())]))


def _word_starts(raw: bytes) -> np.ndarray:
    inside = _IS_WORD[np.frombuffer(raw, dtype=np.uint8)]
    return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))


def scan_text(text: str) -> dict[str, object]:
    lowered = text.encode().lower()
    starts = _word_starts(lowered)
    places, labels = [], set()
    for keyword, label, pattern in _base():
        if keyword in lowered:
            at = [m.start() for m in pattern.finditer(lowered)]
            places += at
            labels |= {label} if at else set()
    words = np.searchsorted(starts, places)
    return {
        "n_words": len(starts), "n_base": len(places), "first_word": int(words.min()) if places else None, "last_word": int(words.max()) if places else None,
        "base_labels": sorted(labels),
        "detections": [
            {"start": s, "end": e, "label": r.label, "rule": r.name, "priority": r.priority, "weight": r.weight} for s, e, _, r in detect(lowered)
        ],
    }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base phrases (n_base, first_word, last_word, base_labels) and detections.

    A detection has start, end, label, rule, priority and weight. A null or empty text has no words and no
    detections. Repeated rows and null ids each get their row; an empty table gives none; further columns play no part.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")][1:]
        types = [pa.int64()] * 4 + [pa.list_(pa.string()), _SPAN_TYPE]
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([r[n] for r in rows], kind) for n, kind in zip(names, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return id_and_text(docs, id_col, text_col).mapInArrow(of_batches, _SCHEMA)


def report(scanned: DataFrame) -> DataFrame:
    """Labels as sorted, comma-joined strings, base and all, and ``score``: the strongest weight of any detection."""
    found = F.array_union("base_labels", F.col("detections.label"))
    strongest = F.coalesce(F.array_max(F.col("detections.weight")), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("labels"),
        F.greatest(strongest, F.when(F.col("n_base") > 0, BASE_WEIGHT).otherwise(0.0)).alias("score"),
    )
