"""Subword lattice likelihood of documents, beside a word unigram base.

An existing subword vocabulary (pieces, and a byte fallback for any byte) weights
all segmentations of a text. A piece never crosses a word start, so the marginal
log probability of a document is the sum over its words of each word's lattice
sum, plus its end. A word's lattice is summed in log space by a forward recursion
over byte positions, vectorized over all words of one length.

The vocabulary file's scores are merge ranks. They give the first weights
(1 / (rank + 10)), and rounds of expectation-maximization over all training words
(forward-backward, weighted by their counts) make them log probabilities.

Plan: every input task turns its documents into chunks of local word ids and the
chunk's distinct words with training counts, written once to the shared folder.
Words are counted with partial sums, so a frequent word costs one row a chunk.
Each distinct word is scored once, joined back to the chunks that hold it, and
every chunk is scored on its own. Texts are never shuffled, and only the 32,000
pieces' sums reach the driver.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import shared_dir, slices

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Characters of text per chunk, rounds of expectation-maximization, and longest word that is summed in bulk.
CHUNK_CHARS, ROUNDS, BULK_BYTES = 8_000_000, 2, 40
#: Added to each piece's expected count.
SMOOTHING = 0.01


class Lattice:
    """Piece probabilities over byte strings; a word is " " + its bytes."""

    def __init__(self, pieces: list[bytes], weights, byte_weights):
        import numpy as np

        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.keys = np.array([self._hash(p) for p in pieces], np.uint64)
        self._tables()
        self.set(weights, byte_weights)

    @classmethod
    def from_file(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, weights, byte_weights = [], [], [0.0] * 256
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k):
                continue
            text = model.id_to_piece(k)
            if model.is_byte(k):
                byte_weights[int(text[3:5], 16)] = 1 / 50_000
            elif "▁" not in text[1:]:
                pieces.append(text.replace("▁", " ").encode())
                weights.append(1 / (10 - min(0.0, max(model.get_score(k), -1e6))))
        total = sum(weights) + sum(byte_weights)
        return cls(pieces, [w / total for w in weights], [w / total for w in byte_weights])

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * 0x100000001B3 + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _tables(self):
        """Two-level hash tables of the piece keys; the second, collision-free, holds those that lose their slot in the first."""
        import numpy as np

        def slots(keys, factor, bits):
            return ((keys * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

        self.slots, left, self.levels = slots, np.arange(len(self.keys)), []
        factor = 0x9E3779B97F4A7C15
        for bits in (21, 17):
            if bits == 17:
                while len(np.unique(slots(self.keys[left], factor, bits))) < len(left):
                    factor = (factor * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1
            at = slots(self.keys[left], factor, bits)
            table = np.full(1 << bits, -1, np.int32)
            table[at[::-1]] = left[::-1]
            self.levels.append((factor, bits, table))
            left = left[table[at] != left]

    def set(self, weights, byte_weights):
        import numpy as np

        with np.errstate(divide="ignore"):
            # the last entry stands for "no such piece"
            self.log = np.append(np.log(np.asarray(weights, float)), -np.inf)
            self.byte_log = np.log(np.asarray(byte_weights, float))

    def find(self, hashes):
        """Piece of each hash, -1 if none."""
        import numpy as np

        out = np.full(hashes.shape, -1, np.int32)
        for factor, bits, table in self.levels:
            got = table[self.slots(hashes, factor, bits)]
            hit = (got >= 0) & (self.keys[got] == hashes)
            out = np.where(hit, got, out)
        return out

    def _arcs(self, block):
        """For words of one length (n, L): {piece length: piece ids (n, starts)}."""
        import numpy as np

        n, size = block.shape
        wide = block.astype(np.uint64) + np.uint64(1)
        h, arcs = np.zeros((n, size), np.uint64), {}
        for l in range(1, min(self.longest, size) + 1):
            h = h[:, : size - l + 1] * np.uint64(0x100000001B3) + wide[:, l - 1 :]
            arcs[l] = self.find(h)
        return arcs

    def forward(self, block, arcs):
        import numpy as np

        n, size = block.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for e in range(1, size + 1):
            parts = [alpha[:, e - 1] + self.byte_log[block[:, e - 1]]]
            for l in range(1, min(self.longest, e) + 1):
                parts.append(alpha[:, e - l] + self.log[arcs[l][:, e - l]])
            alpha[:, e] = _logsum(np.stack(parts))
        return alpha

    def word_scores(self, words: list[bytes]):
        """Natural log of each word's sum over all segmentations."""
        import numpy as np

        out = np.empty(len(words))
        for at, block in _blocks(words):
            if block is None:
                out[at] = self.long_score(b" " + words[at])
            else:
                out[at] = self.forward(block, self._arcs(block))[:, -1]
        return out

    def long_score(self, word: bytes) -> float:
        """The same recursion for one word of any length."""
        import numpy as np

        index = self._index()
        alpha = np.full(len(word) + 1, -np.inf)
        alpha[0] = 0
        for e in range(1, len(word) + 1):
            best = [alpha[e - 1] + self.byte_log[word[e - 1]]]
            for l in range(1, min(self.longest, e) + 1):
                k = index.get(word[e - l : e])
                if k is not None:
                    best.append(alpha[e - l] + self.log[k])
            alpha[e] = np.logaddexp.reduce(best)
        return float(alpha[-1])

    def _index(self):
        if not hasattr(self, "by_piece"):
            self.by_piece = {p: k for k, p in enumerate(self.pieces)}
        return self.by_piece

    def expected(self, words: list[bytes], counts):
        """Expected counts of pieces and of byte fallbacks over all segmentations, for words of any length."""
        import numpy as np

        pieces, octets, long = np.zeros(len(self.pieces)), np.zeros(256), []
        counts = np.asarray(counts, float)
        for at, block in _blocks(words):
            if block is None:
                long.append(at)
            else:
                self._add_expected(block, np.full(len(block), block.shape[1]), counts[at], pieces, octets)
        for at, block in _padded_blocks(words, long):
            if block is None:
                self._add_long_expected(b" " + words[at], counts[at], pieces, octets)
            else:
                self._add_expected(block, np.array([len(words[k]) + 1 for k in at]), counts[at], pieces, octets)
        return pieces, octets

    def _add_expected(self, block, ends, own, pieces, octets):
        """Adds the expected counts of the block's words, each of which ends at its place in ``ends``."""
        import numpy as np

        arcs = self._arcs(block)
        alpha = self.forward(block, arcs)
        n, size = block.shape
        beta = np.full((n, size + 1), -np.inf)
        beta[np.arange(n), ends] = 0
        for s in range(size - 1, -1, -1):
            parts = [beta[:, s + 1] + self.byte_log[block[:, s]]]
            for l in range(1, min(self.longest, size - s) + 1):
                parts.append(beta[:, s + l] + self.log[arcs[l][:, s]])
            beta[:, s] = np.where(ends == s, 0, _logsum(np.stack(parts)))
        z = alpha[np.arange(n), ends][:, None]
        p = np.exp(alpha[:, :-1] + self.byte_log[block] + beta[:, 1:] - z) * own[:, None]
        octets += np.bincount(block.reshape(-1), p.reshape(-1), 256)
        for l, ids in arcs.items():
            row, start = np.nonzero(ids >= 0)
            k = ids[row, start]
            p = np.exp(alpha[row, start] + self.log[k] + beta[row, start + l] - z[row, 0]) * own[row]
            pieces += np.bincount(k, p, len(pieces))

    def _add_long_expected(self, word: bytes, count: float, pieces, octets):
        """The same for one word of any length."""
        from math import exp, inf, log

        index, logs, byte_logs, size = self._index(), self.log.tolist(), self.byte_log.tolist(), len(word)

        def total(parts):
            top = max(parts)
            return top if top == -inf else top + log(sum(exp(x - top) for x in parts))

        alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
        for e in range(1, size + 1):
            parts = [alpha[e - 1] + byte_logs[word[e - 1]]]
            for s in range(max(0, e - self.longest), e):
                if (k := index.get(word[s:e])) is not None:
                    parts.append(alpha[s] + logs[k])
            alpha[e] = total(parts)
        z = alpha[size]
        for s in range(size - 1, -1, -1):
            parts = [beta[s + 1] + byte_logs[word[s]]]
            octets[word[s]] += count * exp(alpha[s] + parts[0] - z)
            for e in range(s + 1, min(size, s + self.longest) + 1):
                if (k := index.get(word[s:e])) is not None:
                    parts.append(beta[e] + logs[k])
                    pieces[k] += count * exp(alpha[s] + parts[-1] - z)
            beta[s] = total(parts)


def _logsum(parts):
    """Log of the sum of exponentials over the first axis; -inf where all are."""
    import numpy as np

    top = parts.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(parts - safe).sum(0)) + safe


def _blocks(words: list[bytes]):
    """(places, bytes of " " + word as a matrix) of words of one length, at most 20,000 at once; (place, None) of a long one."""
    import numpy as np

    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cut) if len(order) else []:
        length = size[group[0]]
        if length > BULK_BYTES:
            yield from ((k, None) for k in group)
            continue
        for k in range(0, len(group), 20_000):
            own = group[k : k + 20_000]
            raw = b"".join([b" " + words[i] for i in own])
            yield own, np.frombuffer(raw, np.uint8).reshape(len(own), length + 1)


def _padded_blocks(words: list[bytes], places: list[int]):
    """(places, bytes of " " + word as a matrix, padded at the end) of long words of similar length, as many bytes at once as a block's; (place, None) of one with fewer than 16 such."""
    import numpy as np

    order, at = sorted(places, key=lambda k: len(words[k])), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (size := len(words[order[end]])) <= 1.25 * len(words[order[at]]) and (end + 1 - at) * size <= 20_000 * BULK_BYTES:
            end += 1
        own = order[at:end]
        at = end
        if len(own) < 16:
            yield from ((k, None) for k in own)
            continue
        size = len(words[own[-1]]) + 1
        raw = b"".join([(b" " + words[k]).ljust(size, b"\0") for k in own])
        yield own, np.frombuffer(raw, np.uint8).reshape(len(own), size)


def held_out_tenth(id_col: str) -> Column:
    """Rows whose id's text has a CRC32 divisible by 10 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _chunks(docs: DataFrame, id_col: str, text_col: str, held_out: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents as local word ids, distinct words of each chunk with training counts)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"chunk long, id {id_type}, held boolean, ids binary, local int, word string, n long, kind int"

    def run(batches):
        import collections

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in schema.split(", ")]
        base, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, texts, held = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j in slices(texts, CHUNK_CHARS):
                known: dict = collections.defaultdict()
                known.default_factory = known.__len__
                own = [np.fromiter(map(known.__getitem__, (t or "").encode().lower().split()), np.int32) for t in texts[i:j]]
                train = [x for x, h in zip(own, held[i:j]) if not h]
                counts = np.bincount(np.concatenate(train) if train else np.zeros(0, np.int32), minlength=len(known))
                chunk = base + made
                made += 1
                n, w = j - i, len(known)
                nothing = lambda kind, size: pa.nulls(size, kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), ids.slice(i, n), pa.array(held[i:j], pa.bool_()), pa.array([x.astype("<i4").tobytes() for x in own], pa.binary()), nothing(pa.int32(), n), nothing(pa.string(), n), nothing(pa.int64(), n), pa.array(np.zeros(n, np.int32))], names)
                if w:
                    words = pa.array(list(known), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(w, chunk)), nothing(ids.type, w), nothing(pa.bool_(), w), nothing(pa.binary(), w), pa.array(np.arange(w, dtype=np.int32)), words, pa.array(counts.astype(np.int64)), pa.array(np.ones(w, np.int32))], names)

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col), held_out)
    rows.mapInArrow(run, schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    both = spark.read.schema(schema).parquet(path)
    return both.filter("kind = 0").select("chunk", "id", "held", "ids"), both.filter("kind = 1").select("chunk", "local", "word", "n")


def _fit(counts: DataFrame, lattice: Lattice, ends: int, rounds: int) -> float:
    """Rounds of expectation-maximization over (word, n); sets the lattice's weights, returns the end's natural log probability."""
    import numpy as np

    size = len(lattice.pieces)
    total = 1.0
    for _ in range(rounds):
        weights = (np.exp(lattice.log[:-1]), np.exp(lattice.byte_log))

        def run(batches, weights=weights):
            import numpy as np
            import pyarrow as pa

            lattice.set(*weights)
            sums = np.zeros(size + 256)
            for batch in batches:
                words = batch.column(0).cast(pa.binary()).to_pylist()
                sums += np.concatenate(lattice.expected(words, batch.column(1).to_numpy()))
            k = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(sums[k])], ["piece", "expected"])

        found = counts.filter("n > 0").mapInArrow(run, "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("e")).collect()
        sums = np.full(size + 256, SMOOTHING)
        for r in found:
            sums[r.piece] += r.e
        total = sums.sum() + ends + SMOOTHING
        lattice.set(sums[:size] / total, sums[size:] / total)
    return float(np.log((ends + SMOOTHING) / total)) if rounds else 0.0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    All texts are scored and those that aren't held out are learnt from. A null
    or empty text is its end alone; words of any length count; repeated rows are
    learnt from and scored each; an empty table gives an empty table; other
    columns are not read. Without training text the base gives probability 1.
    """
    import numpy as np

    spark = docs.sparkSession
    held = held_out_tenth(id_col) if held_out is None else held_out
    path = f"{shared_dir(spark)}/lattice-{uuid.uuid4().hex}"
    texts, words = _chunks(docs, id_col, text_col, held.alias("held"), f"{path}/chunks")
    words.groupBy("word").agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(f"{path}/counts")
    counts = spark.read.schema("word string, n long").parquet(f"{path}/counts")
    ends = texts.filter("not held").count()
    known = counts.filter("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = (known.n or 0) + ends, known.v + (ends > 0)
    lattice = Lattice.from_file(vocabulary)
    end_log = _fit(counts, lattice, ends, rounds)
    base = float(np.log10(n_all + 0.1 * (v_all + 1)))

    def rate(batches):
        import pyarrow as pa

        for batch in batches:
            logs = lattice.word_scores(batch.column(0).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs)], ["word", "n", "log"])

    rated = counts.mapInArrow(rate, "word string, n long, log double")
    told = words.select(F.col("chunk").alias("part"), "local", "word").join(rated, "word").select("part", "local", "n", "log")
    id_type = docs.schema[id_col].dataType.simpleString()

    def finish(left, right):
        import numpy as np
        import pyarrow as pa

        local = right.column("local").to_numpy()
        size = int(local.max()) + 1 if len(local) else 0
        count, logs = np.zeros(size), np.zeros(size)
        count[local], logs[local] = right.column("n").to_numpy(), right.column("log").to_numpy()
        per_word = np.log10(count + 0.1) - base
        end = np.log10(ends + 0.1) - base
        rows = []
        for raw in left.column("ids").to_pylist():
            ids = np.frombuffer(raw, "<i4")
            rows.append((len(ids) + 1, int((count[ids] > 0).sum()) + (ends > 0), n_all, float(per_word[ids].sum() + end), float((logs[ids].sum() + end_log) / np.log(10))))
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.Table.from_arrays([left.column("id"), left.column("held"), *(pa.array(c, k) for c, k in zip(cols, kinds))], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(told.groupBy("part")).applyInArrow(finish, schema)
