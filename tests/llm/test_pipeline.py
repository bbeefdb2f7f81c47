"""The pipeline's rows against a plain version of its stages."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import plain
import public_tokenizers
from awkward import AWKWARD
from test_mixing import expected_targets
from test_quality_rules import statistics
from tokenizers import Tokenizer


def good(text):
    n, chars, symbols, same, repeated = statistics(text)
    lines = len([x for x in (text or "").split("\n") if plain.words(x)])
    return not (
        n < 10 or 100 * repeated > 20 * n or 100 * symbols > 5 * chars or 100 * same > 30 * lines
        or 10 * (text or "").count("!") > 5 * n or chars > 40 * n
    )


def place(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def mixed(rows):
    """How often each document is taken: whole times, and up to the nearest total."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(plain.words(text))
    targets = expected_targets(sizes)
    times = {}
    for source, total in sizes.items():
        own = sorted((place(i), i, len(plain.words(t))) for i, t, s in rows if s == source)
        whole = int(targets[source] // total) if total else 0
        wanted, reached = targets[source] - whole * total, 0
        for _, i, n in own:
            more = reached + n <= wanted or (reached <= wanted and reached + n - wanted < wanted - reached)
            times[i] = whole + more
            reached += n
    return times


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs if good(r["text"])]
    last = {}
    for i, text, _ in rows:
        last[text] = max(last.get(text, i), i)
    rows = [r for r in rows if last[r[1]] == r[0]]
    roots = plain.link_components([r[:2] for r in rows])
    rows = [r for r in rows if roots[r[0]][1] == r[0]]
    times = mixed(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {i: (times[i], len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t, _ in rows if times[i]}
    got = {}
    for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect():
        copies, total = got.get(r["doc_id"], (0, 0))
        got[r["doc_id"]] = (copies + (r["start"] == 0), total + r["length"])
    assert got == {i: (n, n * total) for i, (n, total) in wanted.items()}


def test_stages_keep_the_columns(spark, documents):
    docs = documents(AWKWARD + [(i, " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(20, 60, 10)])
    assert [s[0] for s in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "n-gram Jaccard join", "mixing", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() > 0


def test_no_document(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
