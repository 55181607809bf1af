"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Text: lower case, ASCII characters other than letters and digits become one space, a space at both
ends.  Features: the n-grams of ``NGRAMS`` characters that a document contains (not how often),
hashed into ``2 ** BITS`` buckets.

Training.  (1) Documents per bucket and label, over *all* labelled training rows, by partial sums and
one aggregation.  (2) Per bucket the naive Bayes log-count ratio ``r``; the ``N_FEATURES`` buckets whose
ratio stands out most (``|r|`` over its standard error) become features.  (3) Logistic regression on
the features, each scaled by its ``r``, fitted by MLlib on a bounded, balanced sample of training
rows (``FIT_ROWS``: the lowest id hashes of each label), so scores are those of equal label shares.
Scoring: one pass, no shuffle, one table of ``2 ** BITS`` floats per worker.

Defined cases: null and empty texts have no features, their score is the intercept's; rows without a
label, or with a null one, train nothing; repeated label rows count each; with fewer than two labels
in training the score is the smoothed share of toxic rows (a half without rows); null ids are not held
out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, keep_rows, narrow, pieces, prepare, staged

NGRAMS = (3, 4, 5, 6, 7)
BITS = 20
SLICE_BITS = 16
N_FEATURES = 1 << 12
FIT_ROWS = 8192
THRESHOLD = 0.7
SMOOTHING = 1.0

_M = np.uint64(0x9E3779B97F4A7C15)
_FLAT = np.arange(128, dtype=np.uint32)
_FLAT[[c for c in range(128) if not chr(c).isalnum()]] = 32


def clean_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned code points of all texts, and their boundaries."""
    texts = [f" {t.lower()} " for t in texts]
    p = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    low = p < 128
    p[low] = _FLAT[p[low]]
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
    keep[bounds[:-1]] = True
    return p[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def ngram_buckets(points: np.ndarray, bounds: np.ndarray, table: np.ndarray | None = None):
    """``(document, bucket)`` of the n-grams, per n; with ``table`` only buckets that it marks."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[1:][doc] - np.arange(len(points))
    h = np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h *= _M
        h[:max(0, len(h) - n + 1)] += wide[n - 1:] + np.uint64(1)
        if n not in NGRAMS:
            continue
        x = h + np.uint64(n)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(64 - BITS)
        ok = room >= n
        if table is not None:
            ok &= table[x]
        yield doc[ok], x[ok].astype(np.int64)


def present(texts: list[str], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(document, bucket)`` pairs, sorted."""
    points, bounds = clean_points(texts)
    keys = [(d << BITS) | b for d, b in ngram_buckets(points, bounds, table)]
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key >> BITS, key & ((1 << BITS) - 1)


def held_out(id_col: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class ToxicityModel:
    """``weights[bucket]`` is coefficient times ratio; the score is the logistic of their sum."""

    weights: np.ndarray
    intercept: float

    def margins(self, texts: list[str], chosen: np.ndarray) -> np.ndarray:
        doc, bucket = present(texts, chosen)
        return self.intercept + np.bincount(doc, self.weights[bucket], len(texts))

    def scores(self, column: pa.Array, chosen: np.ndarray) -> np.ndarray:
        texts, out = column.fill_null("").to_pylist(), []
        for i, j in pieces(byte_view(column)[1], 256 << 10):
            out.append(self.margins(texts[i:j], chosen))
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, score)`` per row."""
        spark = docs.sparkSession
        prepare(spark)
        own = narrow(docs, id_col, text_col)
        sent = spark.sparkContext.broadcast(self)       # 2 ** BITS floats, whatever the data

        def run(batches):
            model = sent.value
            chosen = model.weights != 0
            for batch in batches:
                score = model.scores(batch.column("text"), chosen)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())],
                                                 ["doc_id", "score"])
        return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Training documents that contain each bucket, of label 1 and of label 0: an array of fixed size.

    Every task adds up its documents and sends its counts as compressed slices; slices are added in
    two steps, so that no task meets those of all tasks.
    """
    width = 1 << SLICE_BITS

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            for i, j in pieces(byte_view(batch.column("text"))[1], 256 << 10):
                doc, bucket = present(texts[i:j])
                side = toxic[i:j][doc]
                counts[0] += np.bincount(bucket[side], minlength=1 << BITS)
                counts[1] += np.bincount(bucket[~side], minlength=1 << BITS)
        if counts.any():
            for k, part in enumerate(counts.reshape(-1, width)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([_squeeze(part)], pa.binary())], ["slice", "counts"])

    def add(key, table):
        total = sum(_widen(c) for c in table.column("counts").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_squeeze(total)], pa.binary())})
    schema = "slice int, counts binary"
    parts = rows.select("text", "toxic").mapInArrow(run, schema)
    some = parts.groupBy("slice", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("salt")).applyInArrow(add, schema)
    out = np.zeros((2 * (1 << BITS) // width, width), np.int64)
    for r in some.groupBy("slice").applyInArrow(add, schema).collect():
        out[r["slice"]] = _widen(r["counts"])
    return out.reshape(2, -1)


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts as compressed byte planes: most are small."""
    return zstandard.ZstdCompressor(level=3).compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _widen(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS,
        n_features: int = N_FEATURES, reg: float = 3e-4, id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id") -> ToxicityModel:
    """Train on the labelled documents (leave out held-out ones before)."""
    spark = docs.sparkSession
    prepare(spark)
    own = narrow(docs, id_col, text_col)
    given = labels.select(labels[label_id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1))
    n_toxic, n_rows = given.join(own.select("doc_id"), "doc_id").agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_clean = n_toxic or 0, n_rows - (n_toxic or 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), math.log((n_toxic + 1) / (n_clean + 1)))
    # merge join at every size: texts of labelled rows are shuffled, never broadcast
    p, q = (c + SMOOTHING for c in bucket_counts(own.join(given.hint("merge"), "doc_id")))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    clear = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    buckets = np.sort(np.argsort(-clear, kind="stable")[:n_features])
    r = np.zeros(1 << BITS)
    r[buckets] = ratio[buckets]
    # bounded, balanced sample of rows for the regression
    picked = None
    for side in (0, 1):
        one = given.where(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2)
        picked = one if picked is None else picked.unionByName(one)
    picked = staged(picked, "fit_rows")
    coefficients, intercept = _regress(own.join(F.broadcast(picked), "doc_id"), buckets, r, reg)
    weights = np.zeros(1 << BITS, np.float32)
    weights[buckets] = coefficients * r[buckets]
    return ToxicityModel(weights, intercept)


def _regress(rows: DataFrame, buckets: np.ndarray, r: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    spark, size = rows.sparkSession, len(buckets)
    sent = spark.sparkContext.broadcast((buckets, r))

    def run(batches):
        wanted, ratio = sent.value
        chosen = np.zeros(1 << BITS, bool)
        chosen[wanted] = True
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for i, j in pieces(byte_view(batch.column("text"))[1], 256 << 10):
                doc, bucket = present(texts[i:j], chosen)
                off = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("toxic").slice(i, j - i),
                    pa.ListArray.from_arrays(off, pa.array(np.searchsorted(wanted, bucket), pa.int32())),
                    pa.ListArray.from_arrays(off, pa.array(ratio[bucket]))], ["toxic", "at", "value"])
    feats = staged(rows.select("text", "toxic").mapInArrow(run, "toxic int, at array<int>, value array<double>"),
                   "fit_features")
    vector = F.udf(lambda at, value: SparseVector(size, at, value), VectorUDT())
    data = feats.select(F.col("toxic").cast("double").alias("label"), vector("at", "value").alias("features"))
    model = LogisticRegression(maxIter=60, regParam=reg, standardization=False, maxBlockSizeInMB=1.0).fit(data)
    return model.coefficients.toArray(), model.intercept


def remove_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns as they were."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(column):
        return sent.value.scores(column, sent.value.weights != 0) < threshold
    return keep_rows(docs, text_col, keep)
