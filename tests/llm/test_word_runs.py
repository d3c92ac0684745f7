import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import queries, word_runs


def _plain_runs(s):
    """Maximal runs of two periods at least, by trying every period."""
    out, n = {}, len(s)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def _found(s):
    return sorted(zip(*(x.tolist() for x in word_runs.tandem_runs(np.array(s, dtype=np.int64))), strict=True))


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 4).flatmap(lambda a: st.lists(st.integers(0, a), max_size=60)), st.integers(1, 4))
def test_runs_by_every_period(s, times):
    assert _found(s * times) == _plain_runs(s * times)


def test_runs_of_known_words(monkeypatch):
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for s in (b, [0] * 500, [0] * 200 + [1] + [0] * 199, list(range(300)), ([1, 2, 3] * 50 + [4]) * 3):
        assert _found(s) == _plain_runs(s)
    monkeypatch.setattr(word_runs, "QUERIES", 7)  # borders in many small parts
    assert _found(b) == _plain_runs(b)


def test_vocabulary_is_covered():
    """Every kind of square has its leftmost occurrence on the walk from a covering square."""
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(3) for _ in range(rng.randrange(2, 40))]
        tree = word_runs.SuffixTree(np.array(s))
        if not tree.levels:
            continue
        walked = set()
        for i, k in zip(*(x.tolist() for x in word_runs.covering(tree)), strict=True):
            assert s[i : i + k] == s[i + k : i + 2 * k]
            while i + 2 * k <= len(s) and s[i : i + k] == s[i + k : i + 2 * k]:
                walked.add((i, k))
                i += 1
        seen = set()
        for i in range(len(s)):
            for k in range(1, (len(s) - i) // 2 + 1):
                if s[i : i + k] == s[i + k : i + 2 * k] and tuple(s[i : i + 2 * k]) not in seen:
                    seen.add(tuple(s[i : i + 2 * k]))
                    assert (i, k) in walked


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = []
    for k in range(400):
        words = [rng.choice(["a", "b", "the", "Ünder", "x\u00a0y", "z\x1cz"]) if k % 3 else f"w{rng.randrange(9000)}" for _ in range(rng.randrange(0, 90))]
        texts.append(rng.choice([" ", "\t \n", "\x0b"]).join(words * rng.choice([1, 1, 2, 5])))
    texts += [None, "", " \n ", "word " * 3000, "a b c d e f " * 2, "x" * 40_000, "the line of six words here\n" * 40]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(5, texts[5], "clash"), (None, "p q " * 9, None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().split()
        n = len(words)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = [r for r in _plain_runs(words) if r[1] >= max(12, 2 * r[2])] if n < 1200 else [(0, n, 1)]
        runs.sort(key=lambda r: (r[0], r[2]))
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *told, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped))))
    made = queries.op13_word_runs(spark, str(tmp_path))
    got = [tuple(r) for r in made.collect()]
    assert sum(r[1] > 0 for r in got) > 100
    assert sorted(got, key=str) == sorted(want, key=str)
    assert word_runs.find(spark.createDataFrame(rows, "doc_id long, text string, runs string").limit(0)).count() == 0


def test_odd_documents(spark, odd_docs):
    out = word_runs.find(odd_docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd_docs.count() and got[4].runs[0].length == 30_000 and got[4].collapsed == "word"
    assert got[1].collapsed == "" and got[None].runs == []
