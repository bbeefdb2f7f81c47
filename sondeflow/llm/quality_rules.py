"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

A rule is a condition on the text. Each is timed on a bounded sample, which also
shows how many documents it rejects; rules that reject most per second come first,
and a document leaves the cascade at the first rule that it fails. The order changes
the work and never the verdict. Built from DataFrame functions only: word windows
are compared inside each text's own array, so that nothing is shuffled.

Defined results: a missing text is empty, has no words and is rejected. Any other
column, and a repeated id or row, changes nothing. No document: no row.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .store import comparable, saved
from .words import bound, whole_text, word_count, word_list

#: Symbols that hardly occur in prose.
SYMBOLS = "[#*$%&|<>]"

#: Documents that the costs and rejections are estimated on, about.
SAMPLE_ROWS = 2000

#: Words of a window that should not occur twice.
WINDOW = 5


class Rule(NamedTuple):
    """A document that meets ``fails`` is rejected."""

    name: str
    fails: Column


def _covered_words(hashes: Column, width: int) -> Column:
    """Words in windows whose hash occurs at least twice."""

    def from_places(places: Column) -> Column:
        def step(place: Column, i: Column) -> Column:
            return F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - place, F.lit(width)))

        return F.aggregate(F.transform(places, step), F.lit(0), lambda total, x: total + x)

    def from_sorted(pairs: Column) -> Column:
        def place(pair: Column, i: Column) -> Column:
            before, after = F.get(pairs, i - 1), F.get(pairs, i + 1)
            twice = (before["hash"] == pair["hash"]) | (after["hash"] == pair["hash"])
            return F.when(twice, pair["place"])

        repeated = F.filter(F.transform(pairs, place), lambda p: p.isNotNull())
        return bound(F.sort_array(repeated), from_places)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    return bound(F.sort_array(pairs), from_sorted)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found twice or more in the text."""

    def from_words(found: Column) -> Column:
        def window(i: Column) -> Column:
            return F.xxhash64(*(F.get(found, i + k) for k in range(width)))

        return F.transform(F.sequence(F.lit(0), F.size(found) - width), window)

    def from_hashes(hashes: Column) -> Column:
        # most texts repeat nothing, which a hash set finds without sorting
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, F.lit(0)).otherwise(_covered_words(hashes, width))

    counted = bound(words, lambda w: F.when(
        F.size(w) < width, F.lit(0)).otherwise(bound(from_words(w), from_hashes)))
    return counted.cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(lines: Column) -> Column:
    """Lines that equal an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` behind its own columns."""
    text = whole_text(text_column)
    split = docs.select(
        *docs.columns, word_list(text_column).alias("__words"), lines_with_words(text).alias("__lines")
    )
    return split.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("__lines")).alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


#: What the contract rejects, on the columns of ``with_statistics``.
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


#: The first of ``text_rules`` are the same base rules on the bare text.
BASE_RULES = 2


def text_rules(text_column: str = "text") -> list[Rule]:
    """All rules on the bare text, each computing only what it needs."""
    text = whole_text(text_column)

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    joined = F.char_length(F.array_join(word_list(text_column), ""))
    return [
        Rule("few_words", word_count(text_column) < 10),
        Rule("repeats_itself", bound(word_list(text_column), lambda w:
             100 * repeated_words(w) > 20 * F.size(w))),
        Rule("symbols", 100 * count(SYMBOLS) > 5 * joined),
        Rule("same_lines", bound(lines_with_words(text), lambda lines:
             100 * duplicate_lines(lines) > 30 * F.size(lines))),
        Rule("shouting", 10 * count("!") > 5 * word_count(text_column)),
        Rule("long_words", joined > 40 * word_count(text_column)),
    ]


def by_rejection_per_cost(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order that rejects most per second on a sample.

    The sample is about ``rows`` documents, picked by a hash of the whole row. What
    one rule has rejected the next one need not look at, so the share that counts is
    that of the documents still left.
    """
    total = docs.count()
    if not total:
        return list(rules)
    share = min(1.0, rows / total)
    picked = F.pmod(F.xxhash64(*comparable(docs)), F.lit(1 << 30)) < int(share * (1 << 30))
    left = saved(docs.where(picked) if share < 1 else docs, "sample")

    def seconds(condition: Column) -> tuple[float, int]:
        start = time.perf_counter()
        failed = left.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - start, failed

    seconds(F.lit(False))
    idle = seconds(F.length(whole_text(docs.columns[0])) < 0)[0]
    cost = {rule.name: max(seconds(rule.fails)[0] - idle, 1e-3) for rule in rules}
    ordered, waiting = [], list(rules)
    while waiting:
        flags = left.agg(*(F.count_if(rule.fails) for rule in waiting)).first()
        best = max(range(len(waiting)), key=lambda i: flags[i] / cost[waiting[i].name])
        ordered.append(waiting.pop(best))
        left = left.where(~F.coalesce(ordered[-1].fails, F.lit(False)))
    return ordered


def passes(rules: Sequence[Rule]) -> Column:
    """False from the first failed rule on; later rules are not evaluated."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.fails, F.lit(False)).otherwise(verdict)
    return verdict


def keep_passing(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that pass every rule."""
    return docs.where(passes(by_rejection_per_cost(docs, text_rules(text_column))))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The statistics and the verdict of every document.

    A document that fails the base rules, which are read off the statistics, does not
    enter the cascade of the others.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    cascade = passes(by_rejection_per_cost(narrow, text_rules("text")[BASE_RULES:]))
    counted = with_statistics(narrow).withColumn("base_failed", F.expr(BASE_FAILED))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade).alias("kept"),
    )
