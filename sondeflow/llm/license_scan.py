"""Licence notices, found by a positional index of their rarest words.

A template is a short notice: words at relative positions. Each file keeps where the
words of any template stand in it, which is little, and the corpus tells how rare each
of them is. A template is looked up from its rarest word on: the places of that word,
less its position, are where the template may begin; the places of the next word are
intersected with them, and so on until nothing is left. What is verified is the
template's mandatory key phrases: all their words have to stand at their positions from
one beginning. Built from DataFrame functions only; files never meet in a join, so one
with a million licence words costs a task its own length and no other.

Defined results: a missing or empty text has no words, no match and a score of 0. A
template's score is the share of its weight (the sum of its words' inverse document
frequencies) that stands together, taken from the rarest word on, and a file's score the
best of them. Words of one rarity are taken in alphabetical order, then by position.
Every repeated id or row is scanned and counted as a file of its own. Other columns are
ignored. No document: no row.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .store import saved
from .words import bound, whole_text

#: A word, before A to Z are taken for a to z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Decimals of a score.
DIGITS = 6


class Word(NamedTuple):
    position: int
    word: str
    mandatory: bool


class Template:
    """A notice in lower case: key phrases in brackets, ``_`` where any word may stand."""

    def __init__(self, name: str, label: str, notice: str):
        self.name, self.label, self.notice = name, label, notice

    @cached_property
    def words(self) -> list[Word]:
        found, inside = [], False
        for position, token in enumerate(self.notice.split()):
            inside = inside or token.startswith("[")
            if token.strip("[]") != "_":
                found.append(Word(position, token.strip("[]"), inside))
            inside = inside and not token.endswith("]")
        return found


#: Fixed phrases that any scan has to find.
BASE_TEMPLATES = [
    Template("mit phrase", "mit", "[mit license]"),
    Template("apache phrase", "apache", "[apache license]"),
    Template("gpl phrase", "gpl", "[general public license]"),
]

#: Notices of well-known licences in their usual wording. Common words are left open.
TEMPLATES = [
    *BASE_TEMPLATES,
    Template("mit grant", "mit", "[permission _ hereby granted free _ charge] _ any person obtaining"
             " _ copy _ _ [software _ associated documentation files]"),
    Template("apache 2", "apache-2.0", "licensed under _ [apache license version 2 0]"),
    Template("gpl 2", "gpl-2.0", "gnu [general public license version 2]"),
    Template("gpl 3", "gpl-3.0", "gnu [general public license version 3]"),
    Template("gpl 3 or later", "gpl-3.0", "gnu [general public license] _ published by _ free"
             " software foundation either [version 3]"),
    Template("lgpl", "lgpl", "gnu [lesser general public license]"),
    Template("agpl", "agpl", "gnu [affero general public license]"),
    Template("bsd", "bsd", "[redistribution _ use _ source _ binary forms] with or without"
             " modification [are permitted provided]"),
    Template("isc", "isc", "[permission _ use copy modify _ or distribute _ software] _ any purpose"),
    Template("mpl 2", "mpl-2.0", "subject _ _ terms _ _ [mozilla public license] v 2 0"),
    Template("unlicense", "unlicense", "[free _ unencumbered software] released _ _ [public domain]"),
    Template("cc by", "cc-by", "licensed under [cc by 4 0]"),
    Template("cc by nc", "cc-by-nc", "licensed under [cc by nc]"),
    Template("cc by sa", "cc-by-sa", "licensed under [cc by sa]"),
    Template("creative commons nc", "cc-by-nc", "[creative commons attribution noncommercial]"),
    Template("creative commons sa", "cc-by-sa", "[creative commons attribution sharealike]"),
]


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w.word for t in templates for w in t.words})


def licence_words(
    docs: DataFrame, id_column: str, text_column: str, templates: Sequence[Template]
) -> DataFrame:
    """``(id, n_words, hits)``: where the words of any template stand. Reads each text once."""
    listed = vocabulary(templates)
    words = F.regexp_extract_all(whole_text(text_column), F.lit(WORD), F.lit(0))

    def plain(word: Column) -> Column:
        return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)

    def hits(found: Column) -> Column:
        # the quick way to lower case also takes other letters for those of a to z
        placed = F.transform(found, lambda w, i: F.when(
            F.lower(w).isin(listed), F.struct(plain(w).alias("word"), i.alias("place"))))
        return F.filter(placed, lambda h: h["word"].isin(listed))

    counted = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hits(w).alias("hits")))
    return docs.select(F.col(id_column).alias("id"), counted.alias("own")).select("id", "own.*")


def document_frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many each word of the vocabulary stands."""
    words = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    return files.count(), {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}


class Posting(NamedTuple):
    """A template's word, and the share of its weight from the rarest word up to this one."""

    word: Word
    share: float


def rarest_first(template: Template, total: int, frequency: dict[str, int]) -> list[Posting]:
    ordered = sorted(template.words, key=lambda w: (frequency.get(w.word, 0), w.word, w.position))
    weight = [math.log(1 + total / (1 + frequency.get(w.word, 0))) for w in ordered]
    whole = sum(weight)
    return [
        Posting(w, round(sum(weight[:k + 1]) / whole, DIGITS) if whole else 0.0) for k, w in enumerate(ordered)
    ]


def _beginnings(word: Word) -> Column:
    """Where a template may begin, told by the places of one of its words."""
    places = F.filter("hits", lambda h: h["word"] == word.word)
    return F.transform(places, lambda h: (h["place"] - word.position).cast("long"))


def _narrowed(found: Column | None, word: Word) -> Column:
    return _beginnings(word) if found is None else F.array_intersect(found, _beginnings(word))


def score(postings: Sequence[Posting], found: Column | None = None, reached: float = 0.0) -> Column:
    """Share of the weight that stands together, from the rarest word on."""
    if not postings:
        return F.lit(reached)
    first, rest = postings[0], postings[1:]
    return bound(_narrowed(found, first.word), lambda left: F.when(
        F.size(left) == 0, F.lit(reached)).otherwise(score(rest, left, first.share)))


def verified(postings: Sequence[Posting], found: Column | None = None) -> Column:
    """Where the template begins with all its mandatory words at their positions."""
    words = [p.word for p in postings if p.word.mandatory]

    def narrowed(left: Column | None, rest: Sequence[Word]) -> Column:
        if not rest:
            return left
        return bound(_narrowed(left, rest[0]), lambda more: F.when(
            F.size(more) == 0, more).otherwise(narrowed(more, rest[1:])))

    return narrowed(None, words)


def scan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    templates: Sequence[Template] = tuple(TEMPLATES),
) -> DataFrame:
    """``(id, n_words, matches, score)`` of every row of ``docs``.

    ``matches`` lists the template, its label and the number of the word that its first
    key phrase begins with (from 0), for every verified place.
    """
    if not all(any(w.mandatory for w in t.words) for t in templates):
        raise ValueError("every template needs a key phrase")
    files = saved(licence_words(docs, id_column, text_column, templates), "licence-words")
    total, frequency = document_frequencies(files)
    index = {t.name: rarest_first(t, total, frequency) for t in templates}

    def matches(template: Template) -> Column:
        key = min(w.position for w in template.words if w.mandatory)
        return F.transform(verified(index[template.name]), lambda begin: F.struct(
            F.lit(template.name).alias("template"), F.lit(template.label).alias("label"),
            (begin + key).alias("place"),
        ))

    every = F.flatten(F.array(*map(matches, templates)))
    best = F.array_max(F.array(*(score(index[t.name]) for t in templates)))
    some = F.size("hits") > 0
    none = F.array().cast("array<struct<template: string, label: string, place: bigint>>")
    return files.select(
        "id", "n_words", F.when(some, every).otherwise(none).alias("matches"),
        F.when(some, best).otherwise(0.0).alias("score"),
    )
