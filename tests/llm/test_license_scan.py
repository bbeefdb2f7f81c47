from __future__ import annotations

import re

import pytest
from awkward import AWKWARD

from sondeflow.llm import license_scan as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(_LOWER))


def plain_matches(text, templates):
    w = words(text)
    found = set()
    for t in templates:
        for begin in range(-len(t.notice.split()), len(w)):
            if all(0 <= begin + x.position < len(w) and w[begin + x.position] == x.word
                   for x in t.words if x.mandatory):
                key = min(x.position for x in t.words if x.mandatory)
                found.add((t.name, t.label, begin + key))
    return found


NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc by 4.0", "mit  LICENSE mit-license",
    "the MIT of Licenses", "license mit", "general public licence", "GENERAL public license general public license version 2",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the",
    "Permission is hereby granted, free of charge, to whom it may concern, a copy of this software and associated documentation files",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    "Kelvin mıt license MİT LICENSE mité license", "mit", "license", "public", None, "",
]


def test_matches_equal_a_plain_scan(documents):
    rows = list(enumerate(NOTICES)) + [(100, "x " * 40 + "MIT License " * 300), (101, " ".join(filter(None, NOTICES)))]
    got = {r["id"]: r for r in L.scan(documents(rows, "hits matches word n_words")).collect()}
    for i, text in rows:
        found = [tuple(m) for m in got[i]["matches"]]
        assert len(found) == len(set(found)) and set(found) == plain_matches(text, L.TEMPLATES)
        assert got[i]["n_words"] == len(words(text))
        assert 0 <= got[i]["score"] <= 1
        if any(m[0] in {t.name for t in L.BASE_TEMPLATES} for m in found):
            assert got[i]["score"] == 1
    labels = {i: {m["label"] for m in r["matches"]} for i, r in got.items()}
    assert labels[0] == {"mit"} and labels[1] == {"apache", "apache-2.0"} and labels[3] == {"cc-by-nc"}
    assert labels[4] == {"cc-by"} and labels[10] == {"mit"} and not labels[11] and labels[12] == {"bsd"}
    assert not labels[6] and not labels[7] and not labels[8] and not labels[14]
    assert got[14]["score"] == 0 or got[15]["score"] == 0


def test_rarest_words_come_first():
    t = L.Template("t", "t", "[common rare] _ other")
    order = L.rarest_first(t, 100, {"common": 90, "rare": 2, "other": 2})
    assert [p.word.word for p in order] == ["other", "rare", "common"]
    assert order[-1].share == 1 and order[0].share == pytest.approx(order[1].share / 2, abs=1e-6)
    assert [w.position for w in t.words] == [0, 1, 3] and [w.mandatory for w in t.words] == [True, True, False]


def test_awkward_rows(documents):
    got = L.scan(documents(AWKWARD, "id label template")).collect()
    assert len(got) == len(AWKWARD) and all(r["matches"] == [] and r["score"] == 0 for r in got)
    assert sorted(r["n_words"] for r in got)[-1] == 300_000
    assert L.scan(documents([])).collect() == []


def test_no_python_in_the_plan(documents):
    plan = L.scan(documents([(1, "mit license")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
