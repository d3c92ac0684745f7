import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import lattice as m


def small():
    pieces = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab", b"aba", "é".encode()]
    return m.Lattice(pieces, np.arange(1, 10) / 100, np.full(256, 0.001))


def every(lat, word):
    """(probability, pieces, bytes) of each segmentation."""
    if not word:
        yield 1.0, Counter(), Counter()
        return
    arcs = [(len(p), math.exp(lat.log[k]), Counter([k]), Counter()) for k, p in enumerate(lat.pieces) if word.startswith(p)]
    arcs.append((1, math.exp(lat.byte_log[word[0]]), Counter(), Counter([word[0]])))
    for n, p, k, b in arcs:
        for q, k2, b2 in every(lat, word[n:]):
            yield p * q, k + k2, b + b2


WORDS = [b"ab", b"aba", b"b", "é".encode(), b"abab", b"zz", b"ab"]


def test_scores_and_expected_counts_against_all_segmentations():
    lat = small()
    assert np.allclose(lat.word_scores(WORDS), [math.log(sum(p for p, _, _ in every(lat, b" " + w))) for w in WORDS])
    assert np.allclose([lat.long_score(b" " + w) for w in WORDS], lat.word_scores(WORDS))
    pieces, octets = np.zeros(9), np.zeros(256)
    for w, n in zip(WORDS, range(1, 8)):
        segs = list(every(lat, b" " + w))
        z = sum(p for p, _, _ in segs)
        for p, k, b in segs:
            for x, c in k.items():
                pieces[x] += n * c * p / z
            for x, c in b.items():
                octets[x] += n * c * p / z
    got = lat.expected(WORDS, range(1, 8))
    assert np.allclose(got[0], pieces) and np.allclose(got[1], octets)


@pytest.mark.parametrize("bulk", [1, 3])
def test_long_words_against_all_segmentations(monkeypatch, bulk):
    lat, words = small(), WORDS + [b"ab" * 3, b"zab"] * 10
    counts = np.arange(1, len(words) + 1)
    want = lat.expected(words, counts)
    monkeypatch.setattr(m, "BULK_BYTES", bulk)
    for got, x in zip(lat.expected(words, counts), want):
        assert np.allclose(got, x)


def test_expected_counts_of_long_words(monkeypatch):
    rng = np.random.default_rng(7)
    lat = m.Lattice.from_file(m.VOCABULARY)
    texts = ["的人在是不了有我他这" * 3, "https://example.org/the/path/of/a/page.html?query=other", "a" * 41, "the" * 300]
    words = [t.encode() for t in texts] + ["".join(rng.choice(list("人民日报abcdeer"), rng.integers(30, 60))).encode() for _ in range(80)]
    words = [w for w in words if len(w) > m.BULK_BYTES]
    counts = rng.integers(1, 9, len(words))
    pieces, octets = lat.expected(words, counts)
    own = sum(pieces * [len(p) for p in lat.pieces]) + octets.sum()
    assert np.isclose(own, ((np.array(list(map(len, words))) + 1) * counts).sum())
    assert any(pieces[k] > 1 for k, p in enumerate(lat.pieces) if p == "人".encode())
    monkeypatch.setattr(m, "BULK_BYTES", 2000)
    bulk = lat.expected(words, counts)
    assert np.allclose(pieces, bulk[0]) and np.allclose(octets, bulk[1])


def test_whole_vocabulary_is_found():
    lat = m.Lattice.from_file(m.VOCABULARY)
    assert (lat.find(lat.keys) == np.arange(len(lat.pieces))).all()
    assert abs(np.exp(lat.log[:-1]).sum() + np.exp(lat.byte_log).sum() - 1) < 1e-9
    assert (lat.find(np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64)) == -1).all()


def base(docs):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) + [None]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    count = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return sorted((-1 if d is None else d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in docs)


def test_score(spark, odd_docs):
    more = [(100 + k, t) for k, t in enumerate(["the cat sat", "The dog sat on the mat", "über Straße\x1cfoo bar", "cat dog"] * 5)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = m.score(docs).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    want = base([(r.doc_id, r.text) for r in docs.collect()])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(r.score < 0 for r in rows)
    same = {r.score for r in rows if r.doc_id == 3}
    assert len(same) == 1
    assert m.score(odd_docs.limit(0)).count() == 0


def test_learning_raises_the_likelihood_of_held_out_text(spark):
    import random

    rng = random.Random(4)
    syllables = ["tion", "the", "ou", "ing", "er", "at", "re", "on", "st", "ha"]
    docs = [(k, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(60))) for k in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    one, three = (sum(r.score for r in m.score(table, rounds=k).filter("held_out").collect()) for k in (1, 3))
    assert three > one + 50


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds_raise_the_likelihood(rounds):
    lat = small()
    words, counts = WORDS, np.arange(1, 8)
    before = (lat.word_scores(words) * counts).sum()
    for _ in range(rounds):
        pieces, octets = lat.expected(words, counts)
        total = pieces.sum() + octets.sum() + 1e-9
        lat.set((pieces + 1e-12) / total, (octets + 1e-12) / total)
    assert (lat.word_scores(words) * counts).sum() > before
