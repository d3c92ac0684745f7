"""Quality rules by line sequence labelling.

Each line of a text gets a vector of surface features; a linear-chain
conditional random field labels the lines content or boilerplate (Viterbi), and
the share of a text's words that stand in content lines decides whether it is
kept. The field is trained here, in numpy, by gradient ascent on the exact log
likelihood (forward-backward) over seeded, generated texts whose lines have known
labels; it takes a second or two on the driver and its 2 x 12 weights are
broadcast with the function. Plain counts of the text stand beside it.

The pass is row by row: no shuffle, no state, whatever source is hot.
"""

from __future__ import annotations

import re
from functools import lru_cache
from operator import eq

from pyspark.sql import DataFrame

from scriptorium.llm.common import SPACES, slices

#: Texts are handled as UTF-8: bytes.split() cuts at exactly the six ASCII white space characters.
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
MARKS = (b"|", b"<", b">", "»".encode(), "•".encode())
_MARK = re.compile("[#*$%&|<>]|!!|»|•".encode())
_MARKED = re.compile(rb"(?:[#*$%&|<>]|!!)(?![^\x20\x09-\x0D])")
_DIGITS = re.compile(rb"[0-9]")
_FACTOR = 0x9E3779B97F4A7C15
_POWERS: list = []
FEATURES = ("bias", "bar or arrow words", "symbol-ended words", "shouting words", "repeats of the word before", "ends as a sentence", "few words", "digits", "equals an earlier line", "starts small", "first line", "menu words")

#: Words of menus and notices.
MENU = {b"home", b"login", b"menu", b"search", b"share", b"subscribe", b"contact", b"next", b"previous", b"cookie", b"cookies", b"copyright", b"click", b"tweet", b"print", b"sitemap", b"privacy"}
ENDS = (b".", b"!", b"?", b"\"", b"'", b")", "»".encode())

CONTENT, BOILERPLATE = 0, 1

#: A text is kept when at least this share of its words stands in content lines.
LEAST_CONTENT = 0.5


def line_features(line: bytes, words: list[bytes], seen: bool, first: bool) -> list[float]:
    """Features of one line with words; shares are of its words."""
    n = len(words)
    marks = symbols = again = 0
    if _MARK.search(line):
        marks = sum(map(words.count, MARKS))
        symbols = len(_MARKED.findall(line)) - sum(map(words.count, (b"|", b"<", b">")))
    if len(set(words)) < n:
        again = sum(map(eq, words, words[1:]))
    shouts = sum(len(w) > 1 and w.isupper() for w in words)
    menu = sum(w.strip(b".,:!") in MENU for w in line.lower().split())
    digits = len(_DIGITS.findall(line)) / len(line)
    last = words[-1]
    return [1.0, 2 * marks / n, symbols / n, shouts / n, again / n, float(last.endswith(ENDS) and not last.endswith(b"!!")), float(n <= 2), digits, float(seen), float(words[0][:1].islower()), float(first), menu / n]


def _forward(emit, trans):
    import numpy as np

    alpha = np.empty_like(emit)
    alpha[0] = emit[0]
    for t in range(1, len(emit)):
        alpha[t] = emit[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + trans, axis=0)
    return alpha


def _gradient(x, y, weights, trans):
    """Log likelihood of the labels and its gradients."""
    import numpy as np

    emit = x @ weights.T
    alpha, n = _forward(emit, trans), len(x)
    beta = np.zeros_like(emit)
    for t in range(n - 2, -1, -1):
        beta[t] = np.logaddexp.reduce(trans + emit[t + 1] + beta[t + 1], axis=1)
    z = np.logaddexp.reduce(alpha[-1])
    node = np.exp(alpha + beta - z)
    gold = np.eye(2)[y]
    gt = np.zeros_like(trans)
    for t in range(n - 1):
        gt -= np.exp(alpha[t][:, None] + trans + emit[t + 1] + beta[t + 1] - z)
        gt[y[t], y[t + 1]] += 1
    score = emit[np.arange(n), y].sum() + trans[y[:-1], y[1:]].sum()
    return score - z, (gold - node).T @ x, gt


def viterbi(emit, trans) -> list[int]:
    """Best label sequence; ties go to content."""
    a, b = emit[0]
    (aa, ab), (ba, bb) = trans
    back = []
    for ea, eb in emit[1:]:
        back.append((0 if a + aa >= b + ba else 1, 0 if a + ab >= b + bb else 1))
        a, b = max(a + aa, b + ba) + ea, max(a + ab, b + bb) + eb
    y = [0 if a >= b else 1]
    for step in reversed(back):
        y.append(step[y[-1]])
    return y[::-1]


def generated_texts(count: int = 400, seed: int = 7):
    """Texts as lists of (line, label), for training and tests."""
    import random

    rng = random.Random(seed)
    parts = ["ba", "der", "in", "the", "lo", "que", "ma", "ti", "on", "re", "st", "é", "ung", "ra", "so"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))

    def sentence():
        ws = [word() + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(3, 24))]
        return " ".join(ws).capitalize() + rng.choice("....?!")

    def content():
        kind = rng.random()
        if kind < 0.06:
            return rng.choice(["Chapter", "Part", "Notes on"]) + " " + word()
        if kind < 0.12:  # one word, or a line that doesn't end as a sentence
            return word().capitalize() + rng.choice([".", ""])
        if kind < 0.2:
            return " ".join(word() for _ in range(rng.randint(3, 30)))
        return " ".join(sentence() for _ in range(rng.randint(1, 5)))

    def boilerplate(kind):
        ws = " ".join(sentence() for _ in range(rng.randint(1, 4))).split() if rng.random() < 0.7 else [word() for _ in range(rng.randint(2, 40))]
        if kind == 0:
            return " | ".join(ws) + rng.choice([" |", ""])
        if kind == 1:
            return " ".join(w + rng.choice(["###", "***", "$$$", "%%%", "&&&"]) for w in ws)
        if kind == 2:
            return " ".join(w.upper() + "!!" for w in ws)
        if kind == 3:
            return " ".join(w for w in ws for _ in range(rng.randint(4, 12)))
        return " ".join(x.decode() for x in (rng.choices(sorted(MENU), k=rng.randint(6, 60)) if rng.random() < 0.3 else rng.sample(sorted(MENU), rng.randint(1, 5)))).capitalize()

    for _ in range(count):
        text, kind = [], rng.randrange(5)
        share = rng.choice([0, 0, 0.1, 0.5, 1])
        while len(text) < rng.randint(1, 14):
            if rng.random() < share:
                text.append((boilerplate(kind if rng.random() < 0.8 else rng.randrange(5)), BOILERPLATE))
            else:
                text.append((content(), CONTENT))
            if rng.random() < 0.04:
                text.append(text[rng.randrange(len(text))])
        yield text


def features_of(text: bytes):
    """(features of each line with words, its number of words, number of lines equal to an earlier one, all words)."""
    rows, sizes, seen, again, every = [], [], set(), 0, []
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            known = line in seen
            again += known
            rows.append(line_features(line, words, known, not rows))
            sizes.append(len(words))
            seen.add(line)
            every += words
    return rows, sizes, again, every


@lru_cache(maxsize=2)
def trained(seed: int = 7, rounds: int = 12):
    """(weights, transitions) of the field: per-text gradient steps, decayed, L2-bound."""
    import numpy as np

    data = []
    for text in generated_texts(seed=seed):
        rows = features_of("\n".join(line for line, _ in text).encode())[0]
        data.append((np.array(rows), np.array([y for line, y in text if line.split()])))
    weights, trans = np.zeros((2, len(FEATURES))), np.zeros((2, 2))
    order = np.random.default_rng(seed)
    for r in range(rounds):
        rate = 0.2 / (1 + r / 3)
        for k in order.permutation(len(data)):
            _, gw, gt = _gradient(*data[k], weights, trans)
            weights += rate * (gw - 0.002 * weights)
            trans += rate * (gt - 0.002 * trans)
    return weights, trans


def repeated_words(words: list, width: int = 8) -> int:
    """Words that stand in windows of ``width`` words found twice or more in the text.

    Windows are compared by a 64-bit polynomial hash; those whose hash repeats are then compared word by word.
    """
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    if not _POWERS or len(_POWERS[0]) < len(words):
        size = max(1 << 16, 2 * len(words))
        _POWERS[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
    up, down = _POWERS
    total = np.empty(len(words) + 1, np.uint64)
    total[0] = 0
    np.cumsum(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) * up[: len(words)], out=total[1:])
    window = (total[width:] - total[:-width]) * down[:n]
    ranked = np.sort(window)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[1:] = same
    twice[:-1] |= same
    places: dict[tuple, list[int]] = {}
    for i in order[twice].tolist():
        places.setdefault(tuple(words[i : i + width]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for own in places.values():
        if len(own) > 1:
            np.add.at(edge, own, 1)
            np.add.at(edge, [i + width for i in own], -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


OUTPUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"


def judge(text: str | None, weights, trans, least_content: float = LEAST_CONTENT) -> tuple:
    import numpy as np

    text = text or ""
    rows, sizes, again, words = features_of(raw := text.encode())
    n = len(words)
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    labels = viterbi((np.array(rows) @ weights.T).tolist(), trans) if rows else []
    inside = sum(s for s, y in zip(sizes, labels) if y == CONTENT)
    share = inside / n if n else 0.0
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(raw.count, SYMBOLS)), again, repeat, failed, not failed and share >= least_content, share, len(rows), len(labels) - sum(labels)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed, kept, content_share, n_lines, n_content_lines.

    A null, empty or blank text has no words and fails. Ties of the labels go to
    content, a share equal to ``least_content`` is kept. Repeated rows each give
    their row, an empty table gives an empty table, other columns are not read.
    """
    return _with_verdict(docs, [id_col], text_col, least_content)


def keep(docs: DataFrame, text_col: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    judged = _with_verdict(renamed, names, names[docs.columns.index(text_col)], least_content)
    return judged.filter("kept").select(*names).toDF(*docs.columns)


def _with_verdict(docs: DataFrame, keep_cols: list[str], text_col: str, least_content: float) -> DataFrame:
    weights, trans = trained()
    plain = trans.tolist()

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        fields = [x.split()[0] for x in OUTPUT.split(", ")]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts, 8_000_000):
                rows = list(zip(*(judge(t, weights, plain, least_content) for t in texts[i:j])))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(c, k) for c, k in zip(rows, kinds))], [*keep_cols, *fields])

    own = docs.select(*(docs[c] for c in keep_cols))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), OUTPUT])
    return docs.select(docs[text_col].alias("_text"), *(docs[c] for c in keep_cols)).mapInArrow(run, schema)
