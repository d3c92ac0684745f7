"""Periodic runs of words, found through all tandem repeats of a text in near-linear time.

The method is Gusfield's and Stoye's. The suffix tree of a text is held as its suffix
array with the common prefixes of neighbours: a locus is an interval of leaves. From
the longest earlier occurrences of all suffixes come the Lempel-Ziv blocks. Around the
border of each pair of blocks, extensions to both sides give squares (a root twice) that
cover the leftmost occurrence of every kind of square. Suffix links complete the
vocabulary: from the locus of a square at leaf j the link leads to leaf j + 1, whose
square is the root rotated, as long as the text goes on; a locus that is met again isn't
walked twice. All leaves below the loci of the vocabulary are the squares' occurrences,
and those of one period at consecutive words merge into runs.

Only squares of roots without a shorter period are kept; of these a text of n words has
n log n occurrences at most. Short texts are laid side by side, with a word of its own
after each, so numpy's calls are shared; a square never holds such a word. A text has a
run of twelve words only if some six words stand in it twice, so texts where all
six-word windows differ are told by their windows' hashes, equal hashes being no proof
of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import slices

#: Words that are laid side by side at least, and border queries that are held at once.
BATCH_WORDS, QUERIES = 4096, 1 << 20
LEAST = 12


class SuffixTree:
    """Suffix array, common prefixes and ranks of all windows of 2^k ids, by doubling."""

    def __init__(self, ids):
        import numpy as np

        self.np, n = np, len(ids)
        self.n, ranks = n, np.zeros(n + 1, np.int64)
        ranks[:n] = np.unique(ids, return_inverse=True)[1].reshape(-1) + 1
        levels = []  # level k ranks windows of 2^k ids, cut at the end of the text; the empty one is 0
        while ranks.max() < n:
            levels.append(ranks.astype(np.int32))
            later = np.zeros(n + 1, np.int64)
            width = 1 << (len(levels) - 1)
            if width < n:
                later[: n - width] = ranks[width:n]
            key = ranks[:n] * (n + 1) + later[:n]
            ranks = np.zeros(n + 1, np.int64)
            ranks[:n] = np.unique(key, return_inverse=True)[1].reshape(-1) + 1
        self.levels, self.rank = levels, ranks[:n] - 1
        self.leaves = np.empty(n, np.int64)
        self.leaves[self.rank] = np.arange(n)
        common = np.zeros(n, np.int64)
        common[1:] = self.ahead(self.leaves[:-1], self.leaves[1:])
        self.least = [common.astype(np.int32)]  # of 2^k neighbours
        while 2 << (len(self.least) - 1) <= n:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def ahead(self, i, j):
        """Equal ids from i and j on, i <> j."""
        i, j = i.copy(), j.copy()
        first = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(self.np.int64) << k
            i += step
            j += step
        return i - first

    def behind(self, i, j):
        """Equal ids from i and j backwards, i <> j, both counted in; -1 is before the text."""
        np = self.np
        i, j = i + 1, j + 1
        last = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            step = ((a >= 0) & (b >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return last - i

    def locus(self, j, depth):
        """(first, last) leaf of the locus of the ids from j on to the depth."""
        np = self.np
        low, high = self.rank[j], self.rank[j]
        for k in range(len(self.least) - 1, -1, -1):
            table, width = self.least[k], 1 << k
            at = low - width + 1
            low = low - (((at >= 1) & (table[np.clip(at, 0, len(table) - 1)] >= depth)).astype(np.int64) << k)
            at = high + 1
            high = high + (((at + width <= self.n) & (table[np.clip(at, 0, len(table) - 1)] >= depth)).astype(np.int64) << k)
        return low, high

    def blocks(self):
        """Starts of the Lempel-Ziv blocks, and the text's end: each is the longest prefix of the rest that occurs earlier, one id at least."""
        np, n = self.np, self.n
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]  # leaves of earlier suffixes next to each leaf
        up, down = np.empty(n, np.int64), np.empty(n, np.int64)
        for i, r in zip(range(n - 1, -1, -1), self.rank[::-1].tolist(), strict=True):
            a, b = before[r], after[r]
            up[i], down[i] = a, b
            if a >= 0:
                after[a] = b
            if b >= 0:
                before[b] = a
        reach = np.zeros(n, np.int64)
        for near in (up, down):
            there = np.flatnonzero(near >= 0)
            reach[there] = np.maximum(reach[there], self.ahead(there, self.leaves[near[there]]))
        out, i = [0], 0
        for i_next in iter(lambda: i + max(1, int(reach[i])), None):
            i = i_next
            out.append(i)
            if i >= n:
                return np.array(out)


def _ranges(np, counts):
    """0, 1, ... below each count, and whose they are."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), owner


def covering(tree: SuffixTree):
    """(start, period) of squares that cover the leftmost occurrence of every kind of square."""
    np, border = tree.np, tree.blocks()
    start, end = border[:-1], border[1:]
    length = end - start
    following = np.append(length[1:], 0)
    found = []
    for side, most in ((0, length), (1, length + following)):
        cuts = np.searchsorted(np.cumsum(most), np.arange(QUERIES, most.sum() + QUERIES, QUERIES)) + 1
        for chunk in np.split(np.arange(len(most)), np.unique(np.minimum(cuts, len(most)))):
            k, b = _ranges(np, most[chunk])
            k, b = k + 1, chunk[b]
            pivot = end[b] if side == 0 else start[b]  # the border where a square of period k is sought
            other = pivot - k if side == 0 else pivot + k
            inside = (other >= 0) & (other < tree.n) & (pivot < tree.n)
            k, b, pivot, other = k[inside], b[inside], pivot[inside], other[inside]
            right, left = tree.ahead(pivot, other), tree.behind(pivot - 1, other - 1)
            base = np.minimum(pivot, other)
            at = np.maximum(base - left, base - k + 1)
            good = (right + left >= k) & (right > 0)
            if side:
                good &= (left > 0) & (at + k <= end[b])
            found.append((at[good], k[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _primitive(tree: SuffixTree, at, k):
    """Whether the root of the square has no shorter period that divides it."""
    np = tree.np
    most = int(k.max(initial=1))
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    out, rest = np.ones(len(k), bool), k.copy()
    while (todo := np.flatnonzero(out & (rest > 1))).size:
        p = factor[rest[todo]]
        shorter = k[todo] // p
        out[todo] = tree.ahead(at[todo], at[todo] + shorter) < 2 * k[todo] - shorter
        while (more := rest[todo] % p == 0).any():
            rest[todo[more]] //= p[more]
    return out


def _merged(np, key, first, last):
    """Ranges (key, first, last) without overlaps, touching ones joined."""
    order = np.lexsort((first, key))
    key, first, last = key[order], first[order], last[order]
    if not len(key):
        return key, first, last
    wide = int(max(last.max(), first.max())) + 2
    reach = np.maximum.accumulate(key * wide + last)  # keys ascend, so an earlier key never reaches a later one's range
    new = np.append(True, (key[1:] != key[:-1]) | (first[1:] > reach[:-1] - key[1:] * wide + 1))
    begin = np.flatnonzero(new)
    return key[begin], first[begin], np.maximum.reduceat(last, begin)


def tandem_runs(ids):
    """(start, length, period) arrays of all maximal runs of a sequence of ids, two periods long at least."""
    import numpy as np

    empty = (np.empty(0, np.int64),) * 3
    if len(ids) < 2:
        return empty
    tree = SuffixTree(np.asarray(ids))
    if not tree.levels:  # all ids differ
        return empty
    at, k = covering(tree)
    keep = _primitive(tree, at, k)
    at, k = at[keep], k[keep]
    # suffix-link walks: leaf after leaf, as long as the text goes on with the period
    k, at, last = _merged(np, k, at, at + tree.ahead(at, at + k) - k)
    step, owner = _ranges(np, last - at + 1)
    at, k = at[owner] + step, k[owner]
    low, high = tree.locus(at, 2 * k)
    order = np.lexsort((low, k))
    k, low, high = k[order], low[order], high[order]
    new = np.append(True, (k[1:] != k[:-1]) | (low[1:] != low[:-1])) if len(k) else np.empty(0, bool)
    k, low, high = k[new], low[new], high[new]
    # every leaf below a locus of the vocabulary is an occurrence
    step, owner = _ranges(np, high - low + 1)
    place = tree.leaves[low[owner] + step]
    k, first, last = _merged(np, k[owner], place, place)
    return first, last - first + 2 * k, k


def _may_repeat(np, ids, mixed) -> bool:
    """Whether two windows of six ids have the same hash: equal windows do."""
    if len(ids) < LEAST:
        return False
    x = mixed[ids]
    h = x[:-5].copy()
    for k in range(1, 6):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - 5 + k]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list:
    """For each list of words the runs (start, length, period) of ``least`` words or more, by start, then period."""
    import numpy as np

    out = [[] for _ in texts]
    generator = np.random.default_rng(13)
    mixed = generator.integers(0, 1 << 63, 1024, np.uint64)
    held, size = [], 0

    def solve():
        ids, starts, n = [], [], 0
        for _, x in held:
            starts.append(n)
            ids += [x, [-1 - n]]
            n += len(x) + 1
        start, length, period = tandem_runs(np.concatenate(ids))
        keep = length >= np.maximum(least, 2 * period)
        start, length, period = start[keep], length[keep], period[keep]
        order = np.lexsort((period, start))
        owner = np.searchsorted(starts, start, "right") - 1
        for i in order.tolist():
            o = int(owner[i])
            out[held[o][0]].append((int(start[i]) - starts[o], int(length[i]), int(period[i])))
        held.clear()

    names: dict[bytes, int] = {}  # of the texts that are held; a text alone may make it large
    for i, words in enumerate(texts):
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
        if len(names) > len(mixed):
            mixed = np.append(mixed, generator.integers(0, 1 << 63, len(names), np.uint64))
        if least >= LEAST and not _may_repeat(np, ids, mixed):
            continue
        held.append((i, ids))
        size += len(ids)
        if size >= BATCH_WORDS:
            solve()
            size = 0
            names = {}
    if held:
        solve()
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for start, length, period in runs:
        drop[start + period : start + length] = b"\1" * (length - period)
    return [w for w, d in zip(words, drop, strict=True) if not d]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The id, ``runs`` (start, length, period of each, by start, then period) and ``collapsed``, the words that runs leave, joined by a space.

    Words are what ASCII white space parts. A null or empty text has no runs and leaves
    an empty text; ids, nulls among them, are passed through, repeated rows are told each,
    an empty table gives an empty one and other columns aren't read. A text is worked on
    in one task, in memory that grows with its words (some 400 bytes a word).
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                words = [(t or "").encode().split() for t in texts[a:b]]
                runs = find_runs(words, least)
                left = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs, strict=True)]
                told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array(told, kind), pa.array(left, pa.string())], ["id", "runs", "collapsed"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return made.withColumnRenamed("id", id_col)
