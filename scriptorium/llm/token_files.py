"""Token ids in byte-aligned variable-length files.

A file is a row of blocks. In a block ids are replaced by their rank of
frequency in the block (0 the most frequent), and a rank takes 1 to 4 bytes; its
length code (2 bits) stands in a separate control stream, four ranks a control
byte. A block carries its rank table, so it can be read alone. Decoding looks up
each control byte's four lengths in a table of 256 rows and gathers the data
bytes with numpy, without a loop over ids.

Block fields: ``start`` (ids before the block within its file), ``doc_ids``,
``doc_nulls``, ``doc_lengths``, ``table`` (ids by rank), ``control``, ``data``, ``n``.
Blocks are kept in Parquet as the container, so any store that Spark writes will
do, and the writer's commit makes lost executors harmless. A block ends with the
document that fills it, so a very long document makes one larger block.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import shared_dir, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Ids gathered for a block, and characters of text per file.
BLOCK_IDS, FILE_CHARS = 1 << 19, 24_000_000

BLOCK = "file int, block int, start long, doc_ids binary, doc_nulls binary, doc_lengths binary, table binary, control binary, data binary, n long"


def encode_block(ids):
    """(table, control, data) bytes of an array of unsigned 32-bit ids."""
    import numpy as np

    values, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -count))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank[place.reshape(-1)]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    octets = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = octets[np.arange(4) < size[:, None]]
    return values[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def decode_block(table: bytes, control: bytes, data: bytes, n: int):
    """The ids of a block."""
    import numpy as np

    lengths = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1  # of the four ranks of a control byte
    size = lengths[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    octets = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = octets[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        ranks[more] |= octets[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(table, "<u4")[ranks]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = 0, block_ids: int = BLOCK_IDS, file_chars: int = FILE_CHARS) -> None:
    """Write the ids of all texts, an end id after each, in ascending id order (null ids first).

    A null or empty text is the end id alone, repeated rows are written each, an
    empty table writes no block, other columns are not read. File k of the range
    partitioning holds smaller document ids than file k + 1. ``id_col`` is an integer.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from scriptorium.llm.tokens import encoder

        code, end, part = encoder(vocabulary), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        names = [x.split()[0] for x in BLOCK.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.int64()]
        held, held_ids, state = [], 0, {"block": 0, "start": 0}

        def block():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            docs_here = [d for d, _ in held]
            row = [part, state["block"], state["start"], np.array([d or 0 for d in docs_here], "<i8").tobytes(), np.array([d is None for d in docs_here], np.uint8).tobytes(), np.array([len(x) // 4 for _, x in held], "<i8").tobytes(), *encode_block(ids), len(ids)]
            state["block"] += 1
            state["start"] += len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                for key, own in zip(keys[i:j], map(code.encode, texts[i:j])):
                    held.append((key, own + end))
                    held_ids += len(own) // 4 + 1
                    if held_ids >= block_ids:
                        yield block()
                        held_ids = 0
        if held:
            yield block()

    rows = docs.select(F.col(id_col).cast("long"), text_col)
    chars = rows.agg(F.sum(F.length(text_col))).first()[0] or 0
    files = max(1, -(-chars // file_chars), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(int(files), id_col).sortWithinPartitions(id_col)
    ordered.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids (little-endian).

    Null ids come back null, repeated rows each as their row, files without a block as an empty table. The ids before a
    file are summed over one row a file.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    # one row per file: the ids of the files before it
    sums = blocks.groupBy("file").agg(F.sum("n").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = blocks.join(before.select("file", "_before"), "file").select((F.col("start") + F.col("_before")).alias("start"), "doc_ids", "doc_nulls", "doc_lengths", "table", "control", "data", "n")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                start, doc_ids, nulls, lengths, table, control, data, n = (c[k].as_py() for c in batch.columns)
                ids = decode_block(table, control, data, n)
                size = np.frombuffer(lengths, "<i8")
                at = np.cumsum(size) - size
                raw = ids.astype("<u4").tobytes()
                keys = pa.array(np.frombuffer(doc_ids, "<i8"), mask=np.frombuffer(nulls, np.uint8).astype(bool))
                texts = pa.array([raw[4 * a : 4 * (a + s)] for a, s in zip(at.tolist(), size.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + at), pa.array(size), texts], [id_col, "start", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Write to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, id_col, **options)
    return read(spark, path, id_col)
