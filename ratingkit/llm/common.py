"""Shared helpers of the operators: staged tables, bounded Arrow batches, byte views of strings."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ensure_checkpoint_dir, ship_package

# Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
# Text bytes that numpy code works on at once (whole documents; a longer one is its own piece).
PIECE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound the Arrow batches they receive."""
    ship_package(spark)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if not 0 < int(rows) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and later reads prune columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``(doc_id, text)`` alone, so further columns of ``docs`` cannot clash with an operator's own."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *more)


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` whose own text ``keep`` (texts of a batch to booleans) marks, all columns as they were.

    The verdict is taken where the row is, so null and repeated ids cannot mix up rows.
    """
    names, at = [f"c{k}" for k in range(len(docs.columns))], docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))
    fields = docs.schema.fields
    kept = docs.toDF(*names).mapInArrow(run, StructType([StructField(n, f.dataType) for n, f in zip(names, fields)]))
    return kept.select(*(F.col(n).alias(f.name, metadata=f.metadata) for n, f in zip(names, fields)))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the ``len + 1`` row offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[i, j)`` of at most ``limit`` bytes each, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` over the rows."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _POW[name] = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``symbols[s:e]`` per row, from one prefix sum (a polynomial modulo 2**64)."""
    n = len(symbols)
    acc = np.zeros(n + 1, np.uint64)
    term = symbols.astype(np.uint64)
    term += np.uint64(1)
    term = mix(term)
    term *= _powers("mult", _MULT, n)
    np.cumsum(term, out=acc[1:])
    h = acc[ends] - acc[starts]
    h *= _powers("inv", _INV, n + 1)[starts]
    h += (ends - starts).astype(np.uint64)
    return mix(h)


# A polynomial modulo 2**64 lets long words of regular structure collide, whatever its base and symbols.
LONG_WORD = 32


def word_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``range_hashes``, but words over ``LONG_WORD`` symbols by BLAKE2: fit to stand for the word."""
    h = range_hashes(symbols, starts, ends)
    far = np.flatnonzero(ends - starts > LONG_WORD)
    if len(far):
        raw, size = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in
                           zip((starts[far] * size).tolist(), (ends[far] * size).tolist()))
        h[far] = np.frombuffer(digests, np.uint64)
    return h
