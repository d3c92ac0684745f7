import re
from collections import Counter
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import filter_audit


def _simulated(rows, filters="ABCDE"):
    """(kept, removed, redundant, alone, good, toxic) of each order and step by filtering documents one after another; rows: (failed bits, good, toxic)."""
    out, sums = {}, Counter()
    for order in permutations(filters):
        left = list(rows)
        for step, letter in enumerate(order, 1):
            bit = 1 << filters.index(letter)
            gone = [r for r in left if r[0] & bit]
            left = [r for r in left if not r[0] & bit]
            fails = [r for r in rows if r[0] & bit]
            sums[letter] += len(gone)
            out["".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(r[0] == bit for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, sums[k[0][k[1] - 1]]) for k, v in out.items()}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 1), st.integers(0, 1)), max_size=40))
def test_polynomial_gives_what_filtering_gives(rows):
    counts = {}
    for m, good, toxic in rows:
        c = counts.setdefault(m, {"mask": m, "n": 0, "good": 0, "toxic": 0})
        c["n"], c["good"], c["toxic"] = c["n"] + 1, c["good"] + good, c["toxic"] + toxic
    got = {(name, step): tuple(rest) for _, name, step, *rest in filter_audit.orders("p", list(counts.values()))}
    assert got == _simulated(rows)


def _fails(rows):
    """Masks by the plain conditions; rows: (id, text, part, ...)."""
    out = []
    for i, text, part, *_ in rows:
        t = text or ""
        w = re.findall(r"[^ \t-\r]+", t)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]
        tests.append(i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == t for r in rows))
        out.append((part or "", sum(1 << k for k, f in enumerate(tests) if f)))
    return out


def test_audit_by_brute_force(spark, odd_docs):
    words = [f"w{k}" for k in range(130)]
    texts = [" ".join(words), " ".join(words[:50] * 3), " ".join(words).upper(), " ".join(words) + " #", "a b", "", None, "É\u00a0x\u2028y\x1cz " * 60, "\x85a $ B" * 3]
    rows = [(k, texts[k * k % 9], [None, "en", "de", "", "en"][k % 5], k) for k in range(80)]
    rows += [(3, texts[0], "en", 3), (3, texts[0], "de", 3), (None, texts[0], "de", 3), (None, texts[0], "fr", 3), (200, "y" * 70_000, "fr", 1), (201, "long text " * 20_000, "fr", 1), (202, "long text " * 20_000, "de", 1)]
    rows += [(1000 + k, "the same", "en", k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    marks = [(k, k % 2, int(k % 3 == 0), "x") for k in range(0, 1200, 2)] + [(4, 1, 0, "y"), (None, 1, 1, "z"), (9, None, 1, "n")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, n string")
    good, toxic = {m[0] for m in marks if m[1] == 1 and m[0] is not None}, {m[0] for m in marks if m[2] == 1 and m[0] is not None}
    parts = {}
    for r, (part, mask) in zip(rows, _fails(rows), strict=True):
        parts.setdefault(part, []).append((mask, int(r[0] in good), int(r[0] in toxic)))
    want = {(part, *k): v for part, x in parts.items() for k, v in _simulated(x).items()}
    made = filter_audit.audit(docs, labels)
    assert made.schema["step"].dataType.simpleString() == "int"
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in made.collect()}
    assert len(got) == 600 * 4 and got == want
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
    odd = filter_audit.audit(odd_docs, labels, part_col="source")
    assert odd.count() == 600 * 4
