from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from awkward import AWKWARD
from plain import words

from sondeflow.llm import periodic_runs as P
from sondeflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(w: list, repeats: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, kept under its smallest period."""
    n, found, seen = len(w), [], set()
    for p in range(1, n // repeats + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p) and (i, j + p) not in seen:
                seen.add((i, j + p))
                found.append((i, j + p - i, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(w: list[str], runs) -> str:
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def test_common_extensions_of_all_pairs():
    random.seed(5)
    for n in (0, 1, 2, 30, 31, 32, 100, 400):
        for letters in (1, 2, 50):
            line = [random.randrange(letters) for _ in range(n)]
            line[n // 2:n // 2 + 70] = line[:min(70, n - n // 2)]
            n = len(line)
            pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
            pairs = random.sample(pairs, min(len(pairs), 3000))
            wanted = []
            for i, j in pairs:
                k = 0
                while j + k < n and line[i + k] == line[j + k]:
                    k += 1
                wanted.append(k)
            index = P.Extensions(np.array(line, np.int64))
            i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
            assert index.common(i, j).tolist() == wanted


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 2), (3, 9)])
def test_runs_equal_plain_search(repeats, least):
    random.seed(repeats)
    texts = []
    for n in [0, 1, 5, 6, 7, 8, 9, 30, 31, 32, 63, 90, 200, 500] * 3:
        w = [random.randrange(random.choice([1, 2, 3, 40])) for _ in range(n)]
        if n > 20:
            a, p = random.randrange(n), random.randrange(1, n // 5)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        texts.append(w)
    offsets = np.cumsum([0] + [len(w) for w in texts])
    got = P.runs_of(np.array(sum(texts, []), np.int64), offsets, repeats, least)
    by_text = [[] for _ in texts]
    for t, s, n, p in zip(*(a.tolist() for a in got)):
        by_text[t].append((s, n, p))
    assert by_text == [plain_runs(w, repeats, least) for w in texts]


def test_pieces_of_the_grid_do_not_matter(monkeypatch):
    w = np.array([0, 1, 2] * 40 + [3] * 30 + [4, 5] * 20 + list(range(6, 90)), np.int64)
    offsets = np.array([0, 100, 100, len(w)])
    whole = [a.tolist() for a in P.runs_of(w, offsets, 4, 6)]
    monkeypatch.setattr(P, "PAIRS", 7)
    assert [a.tolist() for a in P.runs_of(w, offsets, 4, 6)] == whole and whole[0]


def test_texts_and_awkward_rows(documents):
    extra = [(20, "a b " * 9 + "c"), (21, "É é " * 5), (22, "no run in here at all"), (23, "x " * 5)]
    got = P.find_runs(documents(AWKWARD + extra, "runs collapsed n_words id")).collect()
    assert len(got) == len(AWKWARD + extra)
    texts = {i: t for i, t in AWKWARD + extra}
    for r in got:
        w = words(texts[r["id"]])
        runs = [tuple(x) for x in r["runs"]]
        assert r["n_words"] == len(w)
        if len(w) < 1000:
            assert runs == plain_runs(w)
        assert r["collapsed"] == plain_collapsed(w, runs)
    long = next(r for r in got if r["id"] == 8)
    assert [tuple(x) for x in long["runs"]] == [(0, 300_000, 2)] and long["collapsed"] == "long word"


def test_no_document(documents):
    assert P.find_runs(documents([])).collect() == []


def test_query_equals_plain_search(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = words(d["text"])
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, planted = h // 10, planted + 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w) if len(w) < 3000 else None
        r = got[d["doc_id"]]
        if runs is None:
            continue
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert planted > 10
