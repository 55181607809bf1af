"""Product codes of vectors, assigned over a lexicographic trie of distinct parts.

Components become integers, ``floor(256 * x)``, and a vector is cut into ``parts`` equal parts.  Each
part position has a codebook; a part's code is the index of the nearest entry (squared Euclidean
distance, ties to the lower index).  Codebooks start as the parts of the first vectors and are replaced,
``rounds`` times, by the mean of the parts they were nearest to, rounded down.

Assignment walks a trie.  The distinct parts of a block of vectors, in lexicographic order, are the
leaves; a node is a common prefix of dimensions and holds the distances of that prefix to every entry,
computed once from its parent's by adding one dimension.  The walk is depth-first; a subtree of at most
``SUBTREE`` leaves is expanded level by level, so memory does not grow with the block.  Leaves take the
argmin and add their part, weighted by how many vectors have it, to the entry's sum.

Vectors stay where they are: a round sends ``parts * entries`` partial sums per block, added up by one
aggregation, and the codebooks (``parts * entries`` rows) are all that the driver holds.

Defined cases: vectors that are null, or that hold null or non-finite components, are left out; so are
empty vectors and those of another length than the first one kept, or of a length that ``parts`` does
not divide.  The first vectors are the smallest ids (null ids last, rows of one id by their components);
fewer than ``entries`` vectors give as many entries.  Repeated rows count as often as they stand.
Components beyond ``LIMIT`` in size count as ``LIMIT``, which keeps every sum in 64 bits.  Null labels
are one label.  An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Largest integer component: a distance over 64 dimensions and a sum over 2**36 rows stay below 2**63.
LIMIT = 1 << 26
# Vectors whose distinct parts share one trie, and the leaves of a subtree that is expanded at once.
BLOCK_ROWS = 1 << 16
SUBTREE = 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """``(vec_id, label, v)`` with integer components, without vectors that cannot be coded."""
    v = vectors[vector_col]
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1e9)), F.lit(1e9)) * SCALE))).cast("int"))
    return vectors.where(fine).select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"),
                                      scaled.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int32)


class PartTrie:
    """Distinct parts of one position in lexicographic order, with the rows that hold them."""

    def __init__(self, part: np.ndarray):
        self.n_rows, self.dims = part.shape
        order = np.lexsort(part.T[::-1])
        ordered = part[order]
        new = np.ones((len(part), self.dims), bool)            # a new node of this depth begins here
        if len(part):
            new[1:] = np.logical_or.accumulate(ordered[1:] != ordered[:-1], axis=1)
        first = np.flatnonzero(new[:, -1]) if self.dims else np.zeros(0, np.int64)
        self.leaves, self.begins = ordered[first].astype(np.int64), new[first]
        self.weight = np.diff(np.append(first, len(part)))
        self.leaf_of = np.empty(len(part), np.int64)
        self.leaf_of[order] = np.cumsum(new[:, -1]) - 1 if self.dims else 0

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the distance, per leaf."""
        code, dist = np.empty(len(self.leaves), np.int64), np.empty(len(self.leaves), np.int64)
        stack = [(0, 0, len(self.leaves), np.zeros((1, len(book)), np.int64))]
        while stack:
            depth, lo, hi, above = stack.pop()
            if hi - lo <= SUBTREE or depth == self.dims - 1:
                for a in range(lo, hi, SUBTREE):               # one wide last level is cut as well
                    b = min(a + SUBTREE, hi)
                    d = self._expand(depth, a, b, above, book)
                    code[a:b] = d.argmin(axis=1)
                    dist[a:b] = d[np.arange(b - a), code[a:b]]
                continue
            starts = lo + np.flatnonzero(self._starts(depth, lo, hi))
            for a, b in zip(starts[::-1].tolist(), np.append(starts[1:], hi)[::-1].tolist()):
                gap = self.leaves[a, depth] - book[:, depth]
                stack.append((depth + 1, a, b, above + gap * gap))
        return code, dist

    def _starts(self, depth: int, lo: int, hi: int) -> np.ndarray:
        starts = self.begins[lo:hi, depth].copy()
        starts[0] = True
        return starts

    def _expand(self, depth: int, lo: int, hi: int, above: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Distances of the leaves ``lo..hi`` below one node: each level adds its dimension once per node."""
        dist, node = above, np.zeros(hi - lo, np.int64)
        for d in range(depth, self.dims):
            starts = self._starts(d, lo, hi)
            at = np.flatnonzero(starts)
            gap = self.leaves[lo + at, d][:, None] - book[:, d]
            dist = dist[node[at]] + gap * gap
            node = np.cumsum(starts) - 1
        return dist

    def sums(self, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Weighted count and sum of the leaves of each entry."""
        count, total = np.zeros(entries, np.int64), np.zeros((entries, self.dims), np.int64)
        np.add.at(count, code, self.weight)
        np.add.at(total, code, self.leaves * self.weight[:, None])
        return count, total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


@dataclass
class Codebooks:
    """``books[p]`` holds the entries of part ``p``, one row each."""

    books: np.ndarray

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.books.shape

    def text(self) -> str:
        """All components by part, entry and position."""
        return ",".join(map(str, self.books.ravel().tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def parts_of(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n_parts, _, dims = self.shape
        for p in range(n_parts):
            yield v[:, p * dims:(p + 1) * dims], self.books[p]

    def improved(self, kept: DataFrame) -> Codebooks:
        """Entries replaced by the mean of their parts, rounded down; unused entries stay."""
        books = self.books
        n_parts, entries, dims = self.shape

        def partial(batches):
            count, total = np.zeros((n_parts, entries), np.int64), np.zeros((n_parts, entries, dims), np.int64)
            for block in _blocks(batches):
                for p, (part, book) in enumerate(Codebooks(books).parts_of(matrix(block["v"].combine_chunks()))):
                    trie = PartTrie(part)
                    c, t = trie.sums(trie.nearest(book)[0], entries)
                    count[p] += c
                    total[p] += t
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({
                "p": pa.array(p, pa.int32()), "e": pa.array(e, pa.int32()), "n": pa.array(count[p, e], pa.int64()),
                "s": pa.array(list(total[p, e]), pa.list_(pa.int64()))})
        sums = [F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims)]
        rows = kept.select("v").mapInArrow(partial, "p int, e int, n long, s array<long>").groupBy("p", "e").agg(
            F.sum("n").alias("n"), *sums).collect()              # parts * entries rows at most
        new = books.copy()
        for r in rows:
            new[r["p"], r["e"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
        return Codebooks(new)

    def encode(self, kept: DataFrame) -> DataFrame:
        """``(vec_id, label, code, error)`` per vector; two hex digits a part."""
        books = self.books
        id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

        def run(batches):
            for block in _blocks(batches):
                codes, error = [], np.zeros(len(block), np.int64)
                for part, book in Codebooks(books).parts_of(matrix(block["v"].combine_chunks())):
                    trie = PartTrie(part)
                    code, dist = trie.nearest(book)
                    codes.append(code[trie.leaf_of].astype(np.uint8))
                    error += dist[trie.leaf_of]
                text = np.stack(codes, axis=1).tobytes().hex()
                width = 2 * len(codes)
                out = pa.table({"vec_id": block["vec_id"], "label": block["label"],
                                "code": [text[k:k + width] for k in range(0, len(text), width)],
                                "error": pa.array(error)})
                yield from out.to_batches()
        return kept.select("vec_id", "label", "v").mapInArrow(
            run, f"vec_id {id_type}, label {label_type}, code string, error long")


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of the first vectors; None without vectors that ``parts`` divides."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    lead = kept.where(F.size("v") % parts == 0).orderBy(*order).select("v").limit(1).collect()
    if not lead:
        return None
    same = kept.where(F.size("v") == len(lead[0]["v"]))
    rows = [r["v"] for r in same.orderBy(*order).select("v").limit(entries).collect()]
    start = np.array(rows, np.int64)
    return Codebooks(np.stack(np.split(start, parts, axis=1)))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """Codes of all usable vectors, with the error of their label, and the final codebooks.

    At most 256 entries: a code is a byte.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    prepare(spark)
    kept = staged(usable(vectors, id_col, vector_col, label_col), "integer_vectors")
    books = first_codebooks(kept, parts, entries)
    if books is None:
        none = kept.where(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"),
                                               *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")))
        return none, None
    kept = kept.where(F.size("v") == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        books = books.improved(kept)
    coded = staged(books.encode(kept), "vector_codes")
    # null-safe by two plain keys, so the join can be split where one label holds most rows
    key = [F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0).cast(
        coded.schema["label"].dataType)).alias("label_key")]
    by_label = coded.groupBy(*key).agg(F.sum("error").alias("label_error"))
    joined = coded.select("*", *key).join(by_label, ["no_label", "label_key"])
    return joined.select("vec_id", "label", "code", "error", "label_error"), books
