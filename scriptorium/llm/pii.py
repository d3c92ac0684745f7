"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network reads overlapping windows of
characters, gives each character a score per tag (outside, or one of the kinds),
and a Viterbi pass with learnt transitions decodes each window; where a span is cut
and is too long for the neighbours to hold it whole, a window that grows until it
holds the span is decoded besides; no window is longer than PIECE, as no span beyond LONGEST counts. The spans of all windows are then reconciled over the whole text by weighted interval scheduling,
so that the set of disjoint spans with the largest total margin stays. Spans that
touch a base span give way to it.

A span must hold a digit or an at sign, so windows without either can't add one
and aren't decoded; that prunes work and no result. The network is trained here,
in numpy, by back-propagation through the exact CRF likelihood over seeded,
generated texts with labelled spans (some seconds on the driver, about 5,000
weights, broadcast with the function).

The pass is row by row: no shuffle, no state, whatever source is hot.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and from one start to the next: spans below their difference stand whole in a window.
WINDOW, STRIDE = 128, 32
#: Longest span that can be personal data (a mail address takes 320 characters, spaced spellings more), and longest window.
LONGEST, PIECE = 1024, 8192
#: Longest text that the network is trained on.
TRAIN_CHARS = 64
#: Margin per window, in log units against the all-outside labelling, that a span of the network needs.
LEAST_MARGIN = 4.0

# ------------------------------------------------------------------ base spans

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, ordered by start, then kind; time is linear in the text."""
    out = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                out.append((start, 0, end))
                at = end - 1
        at += 1
    for run in _NUMBERS.finditer(text):  # a match takes four parts of a dotted run, the next one starts after it
        parts = run[0].split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            stop = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                out.append((at, 1, stop))
            at = stop + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def digest(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


# ------------------------------------------------------------------ the network

TAGS, EMBED, HIDDEN = 1 + len(KINDS), 8, 20

#: Character classes: letters by case and script, single digits classes, and the marks that matter.
MARKS = "@.-+()_%:/= \n#\""


def char_code(c: str) -> int:
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "z":
        return 2 + ord(c) - 97
    if "A" <= c <= "Z":
        return 28
    if c in MARKS:
        return 30 + MARKS.index(c)
    return 29 if c.isalpha() else 0


CODES = 30 + len(MARKS)


def _luhn_number(rng) -> str:
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def generated_texts(count: int, seed: int):
    """(text of TRAIN_CHARS or less, [(start, kind index, end)]) with personal data in many spellings, and look-alikes without labels."""
    import random

    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvw"
    word = lambda a=1, b=9: "".join(rng.choices(letters, k=rng.randint(a, b)))
    num = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))

    def email():
        name = word(2, 8) + rng.choice(["", "." + word(1, 6), "_" + word(1, 5), num(2), "." + num(2), "+" + word(2, 4)])
        host = word(2, 8) + rng.choice(["", num(1), "-" + word(1, 4)]) + "." + rng.choice(["com", "org", "net", "example.com", "example.org", "de", "co.uk"])
        return name + rng.choice(["@", "@", "@", " @ ", "@ "]) + host

    def ip():
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    def card():
        n = _luhn_number(rng)
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(n[k : k + 4] for k in range(0, 16, 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+49 {a} {num(7)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"])

    def other():
        return rng.choice([
            lambda: "version " + num(1) + "." + num(1) + rng.choice(["", "." + num(1), "." + num(1) + "."]), lambda: num(rng.randint(1, 5)), lambda: str(rng.randint(1900, 2030)), lambda: f"{num(4)}-{num(2)}-{num(2)}",
            lambda: "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k=16)), lambda: 'token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"',
            lambda: num(2) + "." + num(3), lambda: num(1) + "," + num(3), lambda: num(2) + ":" + num(2), lambda: "@" + word(3, 8), lambda: num(rng.randint(6, 11)), lambda: "CC BY-NC 4.0.", lambda: num(3) + "%", lambda: f"{num(1)}x{num(2)}", lambda: "$" + num(3) + "." + num(2),
            lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(8, 32))), lambda: f"{num(4)}-{num(4)}", lambda: num(20 + rng.randrange(12)), lambda: word().upper() + num(3),
        ])()

    makers = (email, ip, card, phone)
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(2, 9)):
            r = rng.random()
            if r < 0.28:
                k = rng.randrange(4)
                item = makers[k]()
                spans.append((len(text), k, len(text) + len(item)))
            elif r < 0.5:
                item = other()
            else:
                item = word() if rng.random() < 0.85 else word().capitalize()
            text += item + rng.choice([" ", " ", " ", ", ", ". ", "\n"])
        cut = rng.randint(0, max(0, len(text) - TRAIN_CHARS)) if rng.random() < 0.5 else 0
        own = [(a - cut, k, b - cut) for a, k, b in spans if a >= cut and b - cut <= TRAIN_CHARS]
        if any(a < cut < b or a - cut < TRAIN_CHARS < b - cut for a, _, b in spans):  # windows that cut a span teach nothing certain
            continue
        yield text[cut : cut + TRAIN_CHARS], own


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-x))


def _lstm(x, wx, wh, b, mask, keep=False):
    """Hidden states (T, N, H) over inputs (T, N, E); masked steps keep the state."""
    import numpy as np

    steps, n, _ = x.shape
    hid = wh.shape[0]
    h, c = np.zeros((n, hid), x.dtype), np.zeros((n, hid), x.dtype)
    out, saved = np.empty((steps, n, hid), x.dtype), []
    pre = x @ wx + b
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * hid])
        i, f, o = gates[:, :hid], gates[:, hid : 2 * hid], gates[:, 2 * hid :]
        g = np.tanh(z[:, 3 * hid :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        m = mask[t][:, None]
        if keep:
            saved.append((h, c, i, f, o, g, tc, m))
        h, c = np.where(m, h2, h), np.where(m, c2, c)
        out[t] = h
    return out, saved


def _lstm_back(x, wx, wh, saved, dout):
    import numpy as np

    steps, n, _ = x.shape
    hid = wh.shape[0]
    dh, dc = np.zeros((n, hid), x.dtype), np.zeros((n, hid), x.dtype)
    dz_all, gwh = np.empty((steps, n, 4 * hid), x.dtype), np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = saved[t]
        dh = dh + dout[t]
        dh2, dc2 = np.where(m, dh, 0), np.where(m, dc, 0)
        dc2 = dc2 + dh2 * o * (1 - tc * tc)
        dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        gwh += h.T @ dz
        dh = np.where(m, dz @ wh.T, dh)
        dc = np.where(m, dc2 * f, dc)
    flat = dz_all.reshape(-1, 4 * hid)
    return x.reshape(-1, x.shape[2]).T @ flat, gwh, flat.sum(0), dz_all @ wx.T


def start_weights(seed: int) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    p = {"embed": rng.normal(size=(CODES, EMBED)).astype(np.float32) * 0.5, "out": init(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        p |= {f"wx{d}": init(EMBED, 4 * HIDDEN), f"wh{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
        p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    return p


def emissions(p: dict, codes, mask, keep=False):
    """Tag scores (T, N, TAGS) of padded windows (T, N)."""
    import numpy as np

    x = p["embed"][codes]
    f, sf = _lstm(x, p["wxf"], p["whf"], p["bf"], mask, keep)
    b, sb = _lstm(x[::-1], p["wxb"], p["whb"], p["bb"], mask[::-1], keep)
    hidden = np.concatenate([f, b[::-1]], axis=2)
    return hidden @ p["out"] + p["out_b"], (x, hidden, sf, sb)


def gradients(p: dict, codes, mask, tags) -> tuple[float, dict]:
    """Mean log likelihood of the tags under the CRF, and its gradients."""
    import numpy as np

    emit, (x, hidden, sf, sb) = emissions(p, codes, mask, True)
    steps, n, k = emit.shape
    e, tr = emit.astype(np.float64), p["trans"].astype(np.float64)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        a = e[t] + np.logaddexp.reduce(alpha[t - 1][:, :, None] + tr, axis=1)
        alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        b = np.logaddexp.reduce(tr + (e[t + 1] + beta[t + 1])[:, None, :], axis=2)
        beta[t] = np.where(mask[t + 1][:, None], b, 0)
    z = np.logaddexp.reduce(alpha[-1], axis=1)
    node = np.exp(alpha + beta - z[None, :, None])
    gold = np.eye(k)[tags]
    demit = (gold - node) * mask[:, :, None]
    dtr, score = np.zeros_like(tr), (e * gold * mask[:, :, None]).sum()
    for t in range(steps - 1):
        m = mask[t + 1]
        pair = np.exp(alpha[t][:, :, None] + tr + (e[t + 1] + beta[t + 1])[:, None, :] - z[:, None, None])[m]
        dtr -= pair.sum(0)
        np.add.at(dtr, (tags[t][m], tags[t + 1][m]), 1)
        score += tr[tags[t][m], tags[t + 1][m]].sum()
    d = (demit / n).astype(np.float32)
    dh = d @ p["out"].T
    g = {"trans": (dtr / n).astype(np.float32), "out": hidden.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, k), "out_b": d.sum((0, 1))}
    g["wxf"], g["whf"], g["bf"], dxf = _lstm_back(x, p["wxf"], p["whf"], sf, dh[:, :, :HIDDEN])
    g["wxb"], g["whb"], g["bb"], dxb = _lstm_back(x[::-1], p["wxb"], p["whb"], sb, dh[::-1, :, HIDDEN:])
    g["embed"] = np.eye(CODES, dtype=np.float32)[codes.reshape(-1)].T @ ((dxf + dxb[::-1]) * mask[:, :, None]).reshape(-1, EMBED)
    return float((score - z.sum()) / n), g


def padded(texts: list[str]):
    """(codes, mask), both (T, N)."""
    import numpy as np

    steps = max(map(len, texts))
    codes, mask = np.zeros((steps, len(texts)), np.int64), np.zeros((steps, len(texts)), bool)
    for k, t in enumerate(texts):
        codes[: len(t), k] = [char_code(c) for c in t]
        mask[: len(t), k] = True
    return codes, mask


@lru_cache(maxsize=2)
def trained(seed: int = 11, count: int = 5000, rounds: int = 5, batch: int = 64) -> dict:
    """Weights of the network, by Adam over the generated texts."""
    import numpy as np

    data = [x for x in generated_texts(count, seed) if x[0]]
    p = start_weights(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rng, step, total = np.random.default_rng(seed), 0, rounds * (len(data) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(data))
        for at in range(0, len(order) - batch + 1, batch):
            own = [data[i] for i in order[at : at + batch]]
            codes, mask = padded([t for t, _ in own])
            tags = np.zeros(codes.shape, np.int64)
            for k, (_, spans) in enumerate(own):
                for a, kind, b in spans:
                    tags[a:b, k] = 1 + kind
            _, g = gradients(p, codes, mask, tags)
            step += 1
            rate = 0.015 * (1 - step / (total + 1)) + 0.0005
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                p[k] = p[k] + rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return p


def decode(p: dict, texts: list[str]) -> list[list[tuple[int, str, int, float]]]:
    """Spans (start, kind, end, margin) of each window by Viterbi; margin: the span's score above that of outside tags."""
    import numpy as np

    codes, mask = padded(texts)
    emit, _ = emissions(p, codes, mask)
    steps, n, _ = emit.shape
    tr, best, back = p["trans"], emit[0], np.zeros(emit.shape, np.int8)
    for t in range(1, steps):
        paths = best[:, :, None] + tr
        back[t] = paths.argmax(1)
        best = np.where(mask[t][:, None], paths.max(1) + emit[t], best)
    out = []
    gain = emit - emit[:, :, :1]
    for k, text in enumerate(texts):
        tag = int(best[k].argmax())
        tags = [tag]
        for t in range(len(text) - 1, 0, -1):
            tag = int(back[t, k, tag])
            tags.append(tag)
        tags.reverse()
        spans, at = [], 0
        while at < len(tags):
            end = at + 1
            while end < len(tags) and tags[end] == tags[at]:
                end += 1
            if y := tags[at]:
                margin = float(gain[at:end, k, y].sum() + (end - at - 1) * (tr[y, y] - tr[0, 0]) + tr[0, y] + tr[y, 0] - 2 * tr[0, 0])
                spans.append((at, KINDS[y - 1], end, margin))
            at = end
        out.append(spans)
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign; windows overlap by all but STRIDE."""
    starts = set()
    for m in re.finditer(r"[0-9@]", text):
        k = m.start() // STRIDE
        starts.update(x * STRIDE for x in range(k - WINDOW // STRIDE + 1, k + 1) if x >= 0)
    return sorted(starts)


def plausible(kind: str, text: str) -> bool:
    """Form that a span of the network needs, whatever its margin."""
    if len(text) > LONGEST:
        return False
    n = len(_DIGIT.findall(text))
    if kind == "email":
        return "@" in text and "." in text.rpartition("@")[2]
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        digits = re.sub(r"[ .-]", "", text)
        return digits.isascii() and digits.isdigit() and 12 <= n <= 19 and luhn(digits)
    return 9 <= n <= 15 and not re.search(r"[^0-9+() .-]", text)


def reconcile(candidates, base) -> list[tuple[int, str, int]]:
    """Disjoint candidates (start, kind, end, margin) of largest total margin that touch no base span."""
    starts: list[int] = []
    reach: list[int] = []  # largest end of the base spans up to each start
    for x, _, y in sorted(base):
        starts.append(x)
        reach.append(max(y, reach[-1] if reach else 0))
    best: dict[tuple, float] = {}
    for a, k, b, m in candidates:
        before = bisect_left(starts, b)
        if m >= LEAST_MARGIN and not (before and reach[before - 1] > a):
            best[a, k, b] = max(best.get((a, k, b), 0), m)
    items = sorted(best, key=lambda s: (s[2], s[0], KINDS.index(s[1])))
    ends = [s[2] for s in items]
    value, take = [0.0], []
    for s in items:
        before = bisect_right(ends, s[0], hi=len(take))
        take.append((before, value[before] + best[s] > value[-1]))
        value.append(max(value[-1], value[before] + best[s]))
    out, k = [], len(items)
    while k:
        before, used = take[k - 1]
        if used:
            out.append(items[k - 1])
        k = before if used else k - 1
    return out[::-1]


def _batches(jobs):
    """Jobs (row, start, end, grows) of similar length, at most 512 windows' characters at once, or one job."""
    some: list = []
    for job in sorted(jobs, key=lambda j: j[2] - j[1]):
        if some and (len(some) + 1) * (job[2] - job[1]) > 512 * WINDOW:
            yield some
            some = []
        some.append(job)
    if some:
        yield some


def _may_go_on(kind: str, part: str) -> bool:
    """Whether a cut span is part of one that is plausible and that no window of the usual length holds."""
    if not WINDOW - STRIDE <= len(part) <= LONGEST or not re.search(r"[0-9@]", part):
        return False
    return kind == "email" or (len(_DIGIT.findall(part)) <= 19 and not re.search(r"[^0-9+() .,;:\n-]", part))


def _merged(jobs, sizes):
    """Jobs (row, start, end) with those of a row that overlap as one, and whether it may grow; texts have ``sizes`` characters.

    What would be longer than PIECE becomes pieces that overlap by LONGEST, from LONGEST before it to LONGEST behind it: a
    span of LONGEST or less lies whole in one of them, so these don't grow.
    """
    whole: list = []
    for row, a, b in sorted(jobs):
        if whole and whole[-1][0] == row and a < whole[-1][2]:
            whole[-1] = (row, whole[-1][1], max(b, whole[-1][2]))
        else:
            whole.append((row, a, b))
    out = []
    for row, a, b in whole:
        if b - a <= PIECE:
            out.append((row, a, b, True))
            continue
        a, b = max(0, a - LONGEST), min(sizes[row], b + LONGEST)
        out += [(row, at, min(at + PIECE, b), False) for at in range(a, b - LONGEST, PIECE - LONGEST)]
    return out


def find(texts: list[str | None], p: dict) -> list[tuple[list, list]]:
    """(base spans, spans that the network adds) of each text."""
    jobs, out = [], []
    for row, text in enumerate(texts):
        text = text or ""
        out.append((base_spans(text), []))
        jobs += [(row, a, min(a + WINDOW, len(text)), True) for a in windows(text)]
    sizes = [len(text or "") for text in texts]
    candidates: dict[int, list] = {}
    while jobs:
        wider = []
        for some in _batches(jobs):
            parts = [texts[row][a:b] for row, a, b, _ in some]
            for (row, a, b, grows), part, spans in zip(some, parts, decode(p, parts)):
                text = texts[row]
                for x, kind, y, margin in spans:
                    # a span at the edge of a window may go on beyond it; a neighbour holds it whole, or a wider window
                    left, right = x == 0 and a > 0, y == len(part) and b < len(text)
                    if left or right:
                        if grows and _may_go_on(kind, part[x:y]):
                            wider.append((row, max(0, a - len(part) * left), min(len(text), b + len(part) * right)))
                        continue
                    while x < y and part[x] in " .,;:\n":
                        x += 1
                    while y > x and part[y - 1] in " .,;:\n":
                        y -= 1
                    if plausible(kind, part[x:y]):
                        candidates.setdefault(row, []).append((a + x, kind, a + y, margin))
        jobs = _merged(wider, sizes)
    for row, own in candidates.items():
        out[row][1].extend(reconcile(own, out[row][0]))
    return out


# ------------------------------------------------------------------ DataFrame operators


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and added (arrays of struct<start, kind, end> in code points).

    A null or empty text has no spans. Repeated rows each give their row, an
    empty table gives an empty table, other columns are not read.
    """
    p = trained()

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        struct = lambda own: [{"start": a, "kind": k, "end": b} for a, k, b in own]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                found = find(texts[i:j], p)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([struct(b) for b, _ in found], span), pa.array([struct(x) for _, x in found], span)], [id_col, "base", "added"])

    id_type = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<start: int, kind: string, end: int>>"
    needed = F.when(F.col(text_col).rlike("[0-9@]"), F.col(text_col))  # no kind can do without either
    return docs.select(id_col, needed.alias(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, base {spans}, added {spans}")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    joined = lambda col: F.array_join(F.transform(F.array_sort(F.transform(col, rank)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return detect(docs, id_col, text_col).select(
        id_col,
        *(F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )


def _is(kind: str):
    return lambda s: s["kind"] == kind


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span (overlapping ones as one) replaced by its kind in square brackets; all other columns stay.

    A null text stays null and an empty one empty; repeated rows are cleaned alike; an empty table gives an empty table;
    the names of other columns don't matter. Texts are decoded whole, about a million characters of them at once.
    """
    p = trained()
    names = [f"_c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]

    def cleaned(value, base, added):
        out, at = [], 0
        for a, kind, b in sorted([*base, *added]):
            if a >= at:
                out += [value[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join(out) + value[at:] if out else value

    def run(batches):
        import pyarrow as pa

        k = names.index(text)
        for batch in batches:
            texts = batch.column(k).to_pylist()
            for i, j in slices(texts):
                own = texts[i:j]
                new = [t if t is None else cleaned(t, *found) for t, found in zip(own, find(own, p))]
                columns = [c.slice(i, j - i) for c in batch.columns]
                columns[k] = pa.array(new, columns[k].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
