import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import line_quality as q


def brute_repeat(words):
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            inside |= set(range(i, i + 8))
    return len(inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40))
def test_repeated_words(words):
    assert q.repeated_words(words) == brute_repeat(words)


def test_viterbi_and_likelihood_against_all_sequences():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(1, 6)
        x, w, t = rng.normal(size=(n, len(q.FEATURES))), rng.normal(size=(2, len(q.FEATURES))), rng.normal(size=(2, 2))
        emit = x @ w.T
        total = {y: sum(emit[k, y[k]] for k in range(n)) + sum(t[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=int(n))}
        best = max(total, key=total.get)
        assert tuple(q.viterbi(emit.tolist(), t.tolist())) == best
        ll, gw, gt = q._gradient(x, np.array(best), w, t)
        assert np.isclose(ll, total[best] - np.logaddexp.reduce(list(total.values())))
        step = np.zeros_like(w)
        step[1, 3] = 1e-5
        assert np.isclose((q._gradient(x, np.array(best), w + step, t)[0] - ll) / 1e-5, gw[1, 3], atol=1e-3)


def test_held_out_accuracy():
    weights, trans = q.trained()
    right = total = 0
    for text in q.generated_texts(150, seed=99):
        rows = q.features_of("\n".join(x for x, _ in text).encode())[0]
        got = q.viterbi((np.array(rows) @ weights.T).tolist(), trans.tolist())
        right += sum(a == y for a, (_, y) in zip(got, text))
        total += len(text)
    assert right / total > 0.95


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), brute_repeat(words) if len(words) < 3000 else None


def test_score(spark, odd_docs):
    rng = random.Random(3)
    good = " ".join(" ".join(rng.choices(["der", "of", "and", "lo", "hint", "marker"], k=9)).capitalize() + "." for _ in range(12))
    bad = " | ".join(rng.choices(["Home", "Tie", "Oranhe", "Login"], k=40))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(50, good), (51, bad), (52, good + "\nabc\n \nabc\r\n\n"), (53, "A A " * 30)], "doc_id long, text string"))
    got = q.score(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for r in docs.collect():
        g, want = by[r.doc_id], base(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines) == want[:4]
        if want[4] is not None:
            assert g.n_repeat_words == want[4]
            assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g.kept and g.base_failed)
    assert by[50].kept and by[52].kept and not by[51].kept and not by[53].kept and not by[1].kept
    assert {r.doc_id for r in q.keep(docs).collect()} == {r.doc_id for r in got if r.kept}
    assert q.keep(odd_docs).columns == odd_docs.columns and q.score(odd_docs.limit(0)).count() == 0


def test_features_hold_for_lines_of_any_length():
    line = b"Home LOGIN menu 12 " * 15
    got = dict(zip(q.FEATURES, q.line_features(line, line.split(), False, False)))
    assert got["menu words"] == 0.75 and got["shouting words"] == 0.25 and np.isclose(got["digits"], 2 / 19)


def test_long_menu_lines_are_boilerplate():
    rng = random.Random(6)
    weights, trans = q.trained()
    for n in (13, 20, 45, 120):
        words = rng.choices([w.decode() for w in sorted(q.MENU)], k=n)
        flat, short = q.judge(" ".join(words), weights, trans.tolist()), q.judge("\n".join(words), weights, trans.tolist())
        assert flat[-1] == 0 and not flat[6] and not short[6], n
