from __future__ import annotations

import random
import re

import plain
import pytest
from awkward import AWKWARD
from pyspark.sql import functions as F

from sondeflow.llm import quality_rules


def statistics(text):
    text = text or ""
    words = plain.words(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if plain.words(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def test_statistics_equal_brute_force(documents):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["\n".join(rng.choice(["x y", "x y ", "", " ", "z\r", "#$ % |"]) for _ in range(12)) for _ in range(40)]
    texts += [None, "", "a b c d e f a b c d e", "1 2 3 4 5 " * 4, "😀 é ñ" * 5]
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.judge(documents(list(enumerate(texts)), "n_words kept")).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def test_order_changes_no_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = quality_rules.text_rules()
    one = docs.where(quality_rules.passes(rules)).select("doc_id").collect()
    two = docs.where(quality_rules.passes(rules[::-1])).select("doc_id").collect()
    judged = quality_rules.judge(docs).where("kept").select("doc_id").collect()
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns
    assert sorted(one) == sorted(two) == sorted(judged) == sorted(kept.select("doc_id").collect())


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.judge(docs).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.98
    assert judged[judged.quality == 0].kept.mean() < 0.5


def test_rules_that_reject_cheaply_come_first(documents):
    docs = documents([(i, "word " * 200) for i in range(400)])
    dear = F.length(F.regexp_replace(F.repeat("text", 40), "(w)(o)(r)(d)", "$4$3$2$1"))
    rules = [
        quality_rules.Rule("never", F.col("doc_id") < 0), quality_rules.Rule("dear", dear > 0),
        quality_rules.Rule("cheap", F.col("doc_id") >= 0),
    ]
    ordered = [r.name for r in quality_rules.by_rejection_per_cost(docs, rules)]
    assert ordered[0] == "cheap"


def test_later_rules_are_not_evaluated(documents):
    """A rule behind a failed one may not even be computable."""
    broken = quality_rules.Rule("broken", F.raise_error(F.lit("evaluated")).isNull())
    rules = [quality_rules.Rule("all", F.col("doc_id") >= 0), broken]
    assert documents([(1, "a"), (2, "b")]).where(quality_rules.passes(rules)).collect() == []


def test_awkward_rows(documents):
    got = quality_rules.judge(documents(AWKWARD)).collect()
    assert sorted(((r["doc_id"], *tuple(r)[1:6]) for r in got), key=str) == sorted(
        ((i, *statistics(t)) for i, t in AWKWARD), key=str)
    assert {r["doc_id"] for r in got if r["kept"]} == {None, 7}


def test_maps_among_the_other_columns(documents):
    docs = documents([(1, "one two three four five six seven eight nine ten eleven"), (2, "few")]).selectExpr("*", "map(1, 'x') AS m")
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


@pytest.mark.parametrize("function", [quality_rules.judge, quality_rules.keep_passing])
def test_no_document(documents, function):
    assert function(documents([])).collect() == []


def test_no_python_in_the_plan(documents):
    for function in (quality_rules.judge, quality_rules.keep_passing):
        plan = function(documents([(1, "a b")]))._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
