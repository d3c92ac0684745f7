"""Text files that executors render: rows of lines in order, written as ranges of the order and joined by copying.

One value of an order column (a page that everything links to) is split like any other: ranges go by all order columns, and
no row holds more than a line or a bounded object. The driver learns one path a range and copies bytes in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources import store

#: Lines in one range, bytes copied at once.
LINES, BUFFER = 1 << 20, 1 << 16
_OPENERS, _CLOSERS = "[{", "]}"


def quoted(text: Column) -> Column:
    """A text as a JSON string; null as null."""
    held = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), "null").otherwise(F.substring(held, F.lit(6), F.length(held) - 6))


def listed(texts: Column, indent: int) -> Column:
    """An array of texts as a JSON array whose items stand on lines of their own, ``indent`` deep."""
    gap = "\n" + " " * indent
    items = F.array_join(F.transform(texts, quoted), f",{gap}")
    return F.when(F.size(texts) == 0, "[]").otherwise(F.concat(F.lit(f"[{gap}"), items, F.lit(gap[:-2] + "]")))


def fields(named: dict[str, Column], indent: int) -> Column:
    """Rendered values by name as the lines of a JSON object's inside."""
    return F.concat_ws(",\n", *(F.concat(F.lit(f'{" " * indent}"{k}": '), v) for k, v in named.items()))


def _with_commas(batches):
    """Lines with a comma wherever JSON wants one before the next line; the last line of a range waits for the next range."""
    import pyarrow as pa

    held = None
    for batch in batches:
        out = []
        for line in batch.column(0).to_pylist():
            if held is not None:
                out.append(held if held[-1] in _OPENERS or line.lstrip(" ")[0] in _CLOSERS else held + ",")
            held = line
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.string())], ["line"])


class Lines:
    """Ordered lines in a folder, one file a range; with ``commas`` they are the inside of a JSON array or object."""

    def __init__(self, rows: DataFrame, order: list[Column], line: str = "line", commas: bool = True, lines: int | None = None):
        spark = rows.sparkSession
        keys = [f"o{i}" for i in range(len(order))]
        table, held = store.kept(rows.select(F.col(line).alias("line"), *(c.alias(k) for c, k in zip(order, keys))), "lines")
        self.count = table.count()
        ranges = table.repartitionByRange(self.count // (lines or LINES) + 1, *keys).sortWithinPartitions(*keys).select("line")
        self.folder, self.commas = f"{held}-text", commas
        (ranges.mapInArrow(_with_commas, "line string") if commas else ranges).write.text(self.folder)
        store.drop(spark, held)


class Rendered:
    """A file as texts and ``Lines`` in turn. Its bytes are copied by the JVM, in blocks, from any file system that Spark writes."""

    def __init__(self, spark: SparkSession, *pieces: str | Lines):
        self.spark, self.pieces = spark, pieces

    def _copy(self, out) -> None:
        jvm = self.spark.sparkContext._jvm
        copy = jvm.org.apache.hadoop.io.IOUtils.copyBytes
        for piece in self.pieces:
            if isinstance(piece, str):
                out.write(piece.encode())
                continue
            at = jvm.org.apache.hadoop.fs.Path(piece.folder)
            fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            parts = sorted((s.getPath().getName(), s.getLen(), s.getPath()) for s in fs.listStatus(at) if s.getPath().getName().startswith("part-") and s.getLen())
            opened = True  # nothing stands before the first line
            for _, size, path in parts:
                part = fs.open(path)
                try:
                    if piece.commas:
                        first = part.read()
                        while first == 32:
                            first = part.read()
                        out.write(b"" if opened else b"\n" if chr(first) in _CLOSERS else b",\n")
                        part.seek(size - 2)
                        opened = chr(part.read()) in _OPENERS
                        part.seek(0)
                        copy(jvm.org.apache.hadoop.util.LimitInputStream(part, size - 1), out, BUFFER, False)  # without the last line break, which a comma may come before
                        if opened:
                            out.write(b"\n")
                    else:
                        copy(part, out, BUFFER, False)
                finally:
                    part.close()
            if piece.commas and parts and not opened:
                out.write(b"\n")

    def save(self, path: str) -> None:
        out = self.spark.sparkContext._jvm.java.io.FileOutputStream(path)
        try:
            self._copy(out)
            out.getFD().sync()
        finally:
            out.close()

    def digest(self) -> str:
        java = self.spark.sparkContext._jvm.java
        sha = java.security.MessageDigest.getInstance("SHA-256")
        self._copy(java.security.DigestOutputStream(java.io.OutputStream.nullOutputStream(), sha))
        return bytes(sha.digest()).hex()

    def text(self) -> str:
        """The whole file, for one that is small."""
        out = self.spark.sparkContext._jvm.java.io.ByteArrayOutputStream()
        self._copy(out)
        return bytes(out.toByteArray()).decode()

    def drop(self) -> None:
        for piece in self.pieces:
            if isinstance(piece, Lines):
                store.drop(self.spark, piece.folder)
