"""Harmonic packing of documents into sequences.

Lengths fall into reciprocal-capacity classes: class j holds lengths in
(C/(j+1), C/j], and each of its bins takes exactly j pieces, so a piece's bin
needs only a counter per class and every worker fills its own bins. Documents
may be cut: whole sequences are cut off first, then the rest gives up pieces of
C/2, C/4 ... down to ``least_cut`` (which fill their classes without padding), and
what remains, shorter than ``least_cut``, goes to a class of C / least_cut or more
pieces a bin. The bins that are still open when a worker's input ends are
refilled together, largest piece first, so a worker leaves about one bin unfilled.

One pass over the scan's own partitions: no shuffle; a lost task is computed
again from the same split with the same sequence ids (partition and counter).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from scriptorium.llm.common import slices

CAPACITY, LEAST_CUT, END_ID = 2048, 128, 1
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def pieces_of(n: int, capacity: int = CAPACITY, least_cut: int = LEAST_CUT) -> list[int]:
    """Piece lengths of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    n -= capacity * len(out)
    size = capacity // 2
    while size >= least_cut:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Bins:
    """The open bins of one worker: one per class. Items are (row, length) with any row."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open, self.count = capacity, {}, 0

    def add(self, row: tuple, length: int):
        """The pieces of a bin as (row, length, sequence, offset) when this one fills it."""
        j = self.capacity // length
        here = self.open.setdefault(j, [])
        here.append((row, length))
        return self._close(self.open.pop(j)) if len(here) == j else ()

    def _close(self, items):
        at, out = 0, []
        for row, length in items:
            out.append((row, length, self.count, at))
            at += length
        self.count += 1
        return out

    def rest(self):
        """Pieces of the open bins, packed together first-fit from the largest."""
        items = sorted((x for b in self.open.values() for x in b), key=lambda x: -x[1])
        bins: list[list] = []
        room: list[int] = []
        for x in items:
            k = next((k for k, r in enumerate(room) if r >= x[1]), None)
            if k is None:
                k = len(bins)
                bins.append([])
                room.append(self.capacity)
            bins[k].append(x)
            room[k] -= x[1]
        self.open = {}
        for b in bins:
            yield from self._close(b)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, least_cut: int = LEAST_CUT) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``capacity`` is a power of two. A null or empty text is the end id alone;
    very long texts are cut into whole sequences; repeated rows are packed each;
    an empty table gives an empty table; other columns are not read.
    """
    if capacity & (capacity - 1) or least_cut & (least_cut - 1):
        raise ValueError("capacity and least_cut must be powers of two")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from scriptorium.llm.tokens import encoder

        code, bins, end = encoder(vocabulary), Bins(capacity), end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 40
        made: list[tuple] = []

        def table(kind):
            cols = list(zip(*((r[0], r[1], n, r[2], r[3], base + seq, at) for r, n, seq, at in made)))
            made.clear()
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                for doc, own in zip(ids[i:j], map(code.encode, texts[i:j])):
                    own += end
                    total, at = len(own) // 4, 0
                    for n in pieces_of(total, capacity, least_cut):
                        made.extend(bins.add((doc, at, own[4 * at : 4 * (at + n)], total), n))
                        at += n
                if len(made) >= 2000:
                    yield table(kind)
        made.extend(bins.rest())
        if made:
            yield table(kind)

    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
