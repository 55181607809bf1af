"""Packing of token sequences as a cutting-stock problem.

Every document becomes pieces: full sequences of ``size`` tokens, and a rest.  The rests' length
histogram (at most ``size - 1`` numbers, whatever the corpus) is covered by *patterns*, multisets of
lengths that fit a sequence.  A linear program over patterns is solved by column generation: duals
of the current basis price a knapsack dynamic program, its best pattern enters the basis.  The
rounded-down solution is completed greedily.  Pieces are ranked per length (counts per partition and
length, prefix sums, a local rank; no task sees a whole length), and a table from (length, rank
range) to (sequence, offset) assigns them.  It has one row per pattern and length, so at most about
``2 * size * sqrt(2 * size)`` rows, and is broadcast.

Defined cases: null or empty text is the end id alone; repeated rows are packed each; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import load_tokenizer, probe_classes, worker_encoder
from .common import byte_view, gather_ranges, narrow, pieces, prepare, staged

SEQUENCE = 1024
# Column generation ends when the rounded-up optimum is within this share of its lower bound.
GAP = 5e-4
REFACTOR = 256


@dataclass
class Pattern:
    lengths: np.ndarray   # descending
    counts: np.ndarray
    times: int


def greedy(counts: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """``(lengths, counts, times)``: fill from the longest remaining length down, use as often as possible."""
    left, out = counts.astype(np.int64).copy(), []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        room, used, k = size, {}, len(have) - 1
        while k >= 0 and room:
            n = int(have[k])
            if n <= room:
                used[n] = min(room // n, int(left[n]))
                room -= used[n] * n
            k = min(k, int(np.searchsorted(have, room, side="right"))) - 1
        lengths, amount = np.array(list(used), np.int64), np.array(list(used.values()), np.int64)
        times = int((left[lengths] // amount).min())
        left[lengths] -= amount * times
        out.append((lengths, amount, times))


def knapsack(value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of lengths (``value[n]`` each) of total length ``size`` at most."""
    back = np.full(size + 1, -np.inf)      # back[size - c] is the best of capacity c
    back[size] = 0.0
    pick = np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        cand = back[size - c + 1:] + value[1:c + 1]
        k = int(cand.argmax())
        best, carry = cand[k], back[size - c + 1]
        if best > carry:
            back[size - c], pick[c] = best, k + 1
        else:
            back[size - c] = carry
    counts, c = np.zeros(size + 1, np.int64), size
    while c:
        counts[pick[c]] += pick[c] > 0
        c -= max(int(pick[c]), 1)
    return float(back[0]), counts


def column_generation(counts: np.ndarray, size: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """``(pattern, amount)`` of a linear-programming optimum, within ``gap`` of its lower bound.

    ``counts[n]`` pieces of length ``n`` must be covered exactly; waste is free room in a pattern.
    """
    have = np.flatnonzero(counts)
    if not len(have):
        return []
    m, demand = len(have), counts[have].astype(float)
    volume = float((have * demand).sum()) / size
    slot = np.zeros(size + 1, np.int64)
    slot[have] = np.arange(m)
    # start: one length per pattern; the greedy patterns wait as ready-made columns
    basis, inverse = np.diag((size // have).astype(float)), np.diag(1.0 / (size // have))
    x = inverse @ demand
    ready = np.zeros((0, m))
    if m > 1:
        patterns = greedy(counts, size)
        ready = np.zeros((len(patterns), m))
        for k, (lengths, amount, _) in enumerate(patterns):
            ready[k, slot[lengths]] = amount
    for step in range(1, 50 * m + 1):
        duals = inverse.sum(axis=0)
        if float(x.sum()) <= volume * (1 + gap):
            break
        worth = ready @ duals
        if len(worth) and worth.max() > 1 + 0.01:
            column = ready[int(worth.argmax())]
        else:
            value = np.full(size + 1, -np.inf)
            value[have] = duals
            best, pattern = knapsack(value, size)
            if best <= 1 + gap:             # the sum of x over best bounds the optimum from below
                break
            column = pattern[have].astype(float)
        move = inverse @ column
        up = np.flatnonzero(move > 1e-7)
        if not len(up):
            break
        ratio = np.maximum(x[up], 0) / move[up]
        theta = float(ratio.min())
        near = up[ratio <= theta + 1e-9 * (1 + theta)]      # of equal ratios the steadiest pivot
        out = int(near[move[near].argmax()])
        x -= theta * move
        x[out] = theta
        basis[:, out] = column
        if step % REFACTOR:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
    return [(np.bincount(have, basis[:, k], size + 1).astype(np.int64), float(x[k])) for k in range(m) if x[k] > 0]


def plan_patterns(counts: np.ndarray, size: int, gap: float = GAP) -> list[Pattern]:
    """Patterns with whole multiplicities that use every piece of the histogram exactly once."""
    left, out = counts.astype(np.int64).copy(), []
    if left[size]:
        out.append(Pattern(np.array([size]), np.array([1]), int(left[size])))
        left[size] = 0
    for pattern, amount in column_generation(left, size, gap):
        lengths = np.flatnonzero(pattern)[::-1]
        times = int(min(amount + 1e-6, (left[lengths] // pattern[lengths]).min()))
        if times > 0:
            left[lengths] -= times * pattern[lengths]
            out.append(Pattern(lengths, pattern[lengths], times))
    out += [Pattern(a, b, t) for a, b, t in greedy(left, size)]
    return out


@dataclass
class Assignment:
    """Rank ranges per length, sorted by (length, first rank)."""

    length: np.ndarray
    rank: np.ndarray
    per: np.ndarray       # pieces of this length in one sequence of the pattern
    sequence: np.ndarray  # first sequence of the pattern
    offset: np.ndarray    # of the first such piece

    @classmethod
    def build(cls, patterns: list[Pattern], size: int) -> Assignment:
        used, rows, sequence = np.zeros(size + 1, np.int64), [], 0
        for p in patterns:
            at = 0
            for n, c in zip(p.lengths.tolist(), p.counts.tolist()):
                rows.append((n, int(used[n]), c, sequence, at))
                used[n] += c * p.times
                at += n * c
            sequence += p.times
        cols = np.array(rows, np.int64).reshape(-1, 5)
        return cls(*cols[np.lexsort((cols[:, 1], cols[:, 0]))].T)

    def locate(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 48) + self.rank
        k = np.searchsorted(key, (length << 48) + rank, side="right") - 1
        nth = rank - self.rank[k]
        return self.sequence[k] + nth // self.per[k], self.offset[k] + nth % self.per[k] * length


_PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long"


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (then ``end_id``) cut into pieces of ``size`` and a rest, without the ids."""
    spark = docs.sparkSession
    prepare(spark)
    own = narrow(docs, id_col, text_col)
    classes = spark.sparkContext.broadcast(probe_classes(load_tokenizer(tokenizer_path)))
    schema = _PIECE.format(id=own.schema["doc_id"].dataType.simpleString())

    def run(batches):
        encoder, part = worker_encoder(tokenizer_path, classes.value), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for i, j in pieces(byte_view(batch.column("text"))[1]):
                ids, off = encoder.encode(texts[i:j], end_id)
                total = np.diff(off)
                n = -(-total // size)
                doc = np.repeat(np.arange(j - i), n)
                start = gather_ranges(np.zeros(j - i, np.int64), n) * size
                length = np.minimum(total[doc] - start, size)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = ((off[doc] + start) * 4).tolist()
                crc = [zlib.crc32(raw[a:a + 4 * k]) for a, k in zip(at, length.tolist())]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.searchsorted(ranked, ranked, side="left")
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(doc + i)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(total[doc]),
                    pa.array(np.full(len(doc), part, np.int32)), pa.array(rank),
                ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"])
    return own.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = 0, gap: float = GAP,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids are gapless from 0; pieces fill a sequence from offset 0 without gaps.
    """
    cut = staged(token_pieces(docs, tokenizer_path, size, end_id, id_col, text_col), "token_pieces")
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = per_part.select("part", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = np.zeros(size + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():   # one row per length
        counts[r["length"]] = r["n"]
    table = docs.sparkSession.sparkContext.broadcast(Assignment.build(plan_patterns(counts, size, gap), size))
    id_type = cut.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = table.value.locate(length, rank)
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])
    ranked = cut.join(before, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = 0,
              pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: ``(sequence_id, n_tokens, ids)``, padded to ``size``.

    Needs unique document ids.  Groups hold ``size`` tokens at most.
    """
    spark = docs.sparkSession
    prepare(spark)
    classes = spark.sparkContext.broadcast(probe_classes(load_tokenizer(tokenizer_path)))
    places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("at"))
    both = narrow(docs, id_col, text_col).join(places, "doc_id")

    def run(batches):
        encoder = worker_encoder(tokenizer_path, classes.value)
        for batch in batches:
            texts, at = batch.column("text").fill_null("").to_pylist(), batch.column("at").to_pylist()
            ids, off = encoder.encode(texts, end_id)
            rows = [(p["sequence_id"], p["offset"], ids[off[k] + p["start"]:off[k] + p["start"] + p["length"]])
                    for k, own in enumerate(at) for p in own]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])
    parts = both.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    joined = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    return joined.select("sequence_id", ids.alias("ids")).select(
        "sequence_id", F.size("ids").alias("n_tokens"),
        F.concat("ids", F.array_repeat(F.lit(pad_id), size - F.size("ids"))).alias("ids"))
