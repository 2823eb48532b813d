import re

import pytest

from odd_rows import ODD_ROWS
from tapewright.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_base(text):
    """Words, places and labels of the base phrases, word by word."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        parts = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        places, labels = places + at, labels | ({label} if at else set())
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "GNU-General/public\nLICENSE and Apache License 2.0; mit license",
    "cc by cc by CC_BY ccby cc byé", "the mit license mit license", "smit license", "été mit license", "apache licenses", "gnu general public license2",
    "MIT\u00a0License", "", None, "...", "cc by" * 3, "CC BY-SA 4.0 and cc by 4.0",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_phrases_match_word_by_word_search(text):
    got = L.scan_text(text or "")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], ",".join(got["base_labels"])) == brute_base(text)


def labels(text):
    return [d["label"] for d in L.scan_text(text)["detections"]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]),
        ("GNU Lesser General Public License version 2.1 or any later version", ["lgpl-2.1"]),
        ("under the Apache License, Version 2.0", ["apache-2.0"]),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa-4.0"]),
        ("CC BY-SA 4.0", ["cc-by-sa-4.0"]),
        ("GPLv3", ["gpl-3.0"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["mit"]),
        ("All rights reserved.", ["proprietary"]),
        ("permitting the omission of licensed reserves", []),
        ("version 2.0 of nothing", []),
    ],
)
def test_rules(text, want):
    assert labels(text) == want


def test_contained_detections_of_lower_priority_go_and_overlapping_ones_stay():
    found = L.scan_text("licensed under the GNU General Public License, version 3.")["detections"]
    assert [(d["label"], d["priority"]) for d in found] == [("gpl", 4), ("gpl-3.0", 3)]
    for x in found:
        assert not any(y is not x and y["start"] <= x["start"] and x["end"] <= y["end"] for y in found)
    assert [d["label"] for d in L.scan_text("the MIT License")["detections"]] == ["mit"]


def test_every_rule_needs_its_keyword():
    """The prefilter loses nothing: no rule can match a text without its keyword."""
    for rule in L.rules():
        text = rule.pattern.pattern.decode("latin-1")
        key = rule.keyword.decode()
        plain = re.sub(r"\\([^x])", r"\1", text.replace(L._SEP, " "))
        assert key in plain and " " not in key, rule.name
    assert len(L.rules()) > 300


def test_suppression_matches_pairwise_comparison():
    text = ("Licensed under the MIT License. gnu gpl v2 or later, apache license 2.0, cc by 4.0, " * 40 + "GNU General Public License").lower().encode()
    found = [(m.start(), m.end(), n, r) for n, r in enumerate(L.rules()) if r.keyword in text for m in r.pattern.finditer(text)]
    found.sort(key=lambda d: (d[3].priority, d[0] - d[1], d[2], d[0]))
    kept = []
    for d in found:
        if not any((k[0] <= d[0] and d[1] <= k[1]) or (d[0] <= k[0] and k[1] <= d[1]) for k in kept):
            kept.append(d)
    assert sorted(kept, key=lambda d: d[:3]) == L.detect(text)


def test_query_columns_over_odd_rows(odd_docs, no_docs):
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in L.report(L.scan(odd_docs)).collect()), key=repr)
    assert got == sorted(((i, *brute_base(t)) for i, t in ODD_ROWS), key=repr)
    assert L.report(L.scan(no_docs)).count() == 0


def test_labels_and_score_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in L.report(L.scan(docs)).collect()}
    for r in docs.collect():
        got = rows[r["doc_id"]]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_base(r["text"])
        assert 0 <= got["score"] <= 1 and (got["score"] > 0) == bool(got["labels"])
        assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(","))
