"""Benchmark decontamination with suffix arrays of the training text.

The corpus is cut into shards (runs of whole documents of bounded size).  Each shard sorts the
suffixes of its word sequence into a suffix array; every suffix of every benchmark item is binary
searched in it.  That gives the longest verbatim match of each item suffix with its places, and all
places of each item's windows.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  Words are compared by
value: the benchmark's vocabulary numbers them exactly, a document word outside it is 0.  A suffix
array holds only suffixes that can match: those inside a run of vocabulary words at least as long as
the shortest window.  Nothing else could reach any window, so results are those of the full array.

The benchmark travels in blocks of bounded bytes, each compared with all shards.

Defined cases: null or empty texts have no words, no hits; items without words have no window; items
sharing an id count once; a null item id is listed as an empty string; repeated document rows are
judged one by one; an empty benchmark or corpus gives no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, gather_ranges, keep_rows, narrow, pieces, prepare, range_hashes, spans, staged

WINDOW = 13
# Benchmark text bytes that one pass over the corpus takes to the executors.
BLOCK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, word starts and ends, and the number of words up to each row boundary."""
    low = _LOWER[raw]
    inside = _WORD[low]
    edge = np.empty(len(raw) + 1, bool)  # a word begins, or just ended, at this byte
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(raw) else (False, False)
    edge[1:-1] = inside[1:] != inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    split = np.unique(cut[inside[cut] & inside[cut - 1]])  # words that touch across a row boundary
    starts = np.flatnonzero(edge[:-1] & inside) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(edge[1:] & inside) + 1 if len(raw) else np.zeros(0, np.int64)
    if len(split):
        starts, ends = np.sort(np.concatenate((starts, split))), np.sort(np.concatenate((ends, split)))
    return low, starts, ends, np.searchsorted(starts, offsets, side="left")


def sort_suffixes(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes of ``words`` beginning there, up to ``depth`` words.

    Multikey refinement: sort by the packed next words, then only within ties by the ones after.
    ``words`` must end in ``depth`` zeros.
    """
    at = np.sort(at)
    group = np.zeros(len(at), np.int64)
    for d in range(0, depth, 2):
        key = (words[at + d].astype(np.uint64) << np.uint64(32)) | words[at + d + 1].astype(np.uint64)
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        t = np.flatnonzero(tied)
        if not len(t):
            break
        order = t[np.lexsort((key[t], group[t]))]
        at[t], key[t] = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
    return at


def search(words: np.ndarray, array: np.ndarray, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
           after: bool) -> np.ndarray:
    """Binary search of all query suffixes at once: the first place in ``array`` not before the
    first ``lengths`` words of each (``after``: the first place beyond all that begin with them)."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    steps = int(lengths.max(initial=0))
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        live, less, d = open_, np.full(len(open_), after), 0
        slot = np.arange(len(open_))
        while len(live) and d < steps:
            go = d < lengths[live]
            live, slot = live[go], slot[go]
            a, b = words[array[mid[slot]] + d], query[starts[live] + d]
            less[slot[a != b]] = (a < b)[a != b]
            same = a == b
            live, slot, d = live[same], slot[same], d + 1
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


def common_words(words: np.ndarray, at: np.ndarray, query: np.ndarray, starts: np.ndarray,
                 limits: np.ndarray) -> np.ndarray:
    """Length of the common prefix of ``words[at:]`` and ``query[starts:]``, ``limits`` at most."""
    out, live, d = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(live):
        live = live[d < limits[live]]
        live = live[words[at[live] + d] == query[starts[live] + d]]
        out[live] += 1
        d += 1
    return out


@dataclass
class Block:
    """One bounded block of benchmark items as numbered words."""

    items: list[str]          # id of each text
    words: np.ndarray         # word numbers of all texts, each followed by a 0
    first: np.ndarray         # where each text begins in ``words``
    count: np.ndarray         # its number of words
    hashes: np.ndarray        # sorted hashes of the vocabulary
    numbers: np.ndarray       # word number of each hash
    spelling: list[bytes]     # word of each number, for the exact comparison
    window: int

    @classmethod
    def build(cls, items: list[tuple[str, str]], window: int) -> Block:
        raw, off = byte_view(pa.array([t for _, t in items], pa.large_string()))
        low, s, e, upto = word_spans(raw, off)
        text = low.tobytes()
        spelled = [text[a:b] for a, b in zip(s.tolist(), e.tolist())]
        spelling = [b"", *sorted(set(spelled))]
        number = {w: k for k, w in enumerate(spelling)}
        count = np.diff(upto)
        first = upto[:-1] + np.arange(len(items))
        words = np.zeros(len(spelled) + len(items) + 2, np.uint32)
        words[np.arange(len(spelled)) + np.repeat(np.arange(len(items)), count)] = [number[w] for w in spelled]
        h = range_hashes(low, s, e)
        hashes, at = np.unique(h, return_index=True)
        return cls([k for k, _ in items], words, first, count, hashes,
                   np.array([number[spelled[k]] for k in at], np.uint32), spelling, window)

    def shortest(self) -> int:
        has = self.count[self.count > 0]
        return int(min(has.min(), self.window)) if len(has) else 0

    def number(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words (0: not in it); equal hashes are compared byte by byte."""
        out = np.zeros(len(s), np.uint32)
        if not len(s) or not len(self.hashes):
            return out
        h = range_hashes(low, s, e)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[k] == h)
        got = self.numbers[k[found]]
        length = np.array([len(w) for w in self.spelling])
        flat = np.frombuffer(b"".join(self.spelling) or b"\0", np.uint8)
        begin = np.cumsum(length) - length
        n = e[found] - s[found]
        right = length[got] == n
        found, got, n = found[right], got[right], n[right]
        differs = low[gather_ranges(s[found], n)] != flat[gather_ranges(begin[got], n)]
        bad = np.zeros(len(found), bool)
        bad[np.repeat(np.arange(len(found)), n)[differs]] = True
        out[found[~bad]] = got[~bad]
        return out


@dataclass
class Shard:
    """Suffix array of one run of documents."""

    words: np.ndarray    # numbered words, a 0 after each document, then ``depth`` zeros
    first: np.ndarray    # where each document begins in ``words``
    n_words: np.ndarray  # its number of words
    array: np.ndarray    # the suffix array

    @classmethod
    def build(cls, raw: np.ndarray, offsets: np.ndarray, block: Block) -> Shard:
        low, s, e, upto = word_spans(raw, offsets)
        depth, n_docs = int(block.count.max(initial=0)), len(offsets) - 1
        words = np.zeros(len(s) + n_docs + depth + 2, np.uint32)
        n = np.diff(upto)
        words[np.arange(len(s)) + np.repeat(np.arange(n_docs), n)] = block.number(low, s, e)
        a, b = spans(words != 0)
        length, least = b - a, max(1, block.shortest())
        long_ = length >= least
        starts = gather_ranges(a[long_], length[long_] - least + 1)
        return cls(words, upto[:-1] + np.arange(n_docs), n, sort_suffixes(words, starts, depth))

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def _windows(block: Block):
    """Start and length of every window of every item, and its item."""
    n = np.where(block.count == 0, 0, np.maximum(block.count - block.window + 1, 1))
    start = gather_ranges(block.first, n)
    item = np.repeat(np.arange(len(n)), n)
    return start, np.minimum(block.count[item], block.window), item


def window_hits(shard: Shard, block: Block):
    """Per document: number of words inside any window found in it, and the items found."""
    start, length, item = _windows(block)
    lo = search(shard.words, shard.array, block.words, start, length, False)
    hi = search(shard.words, shard.array, block.words, start, length, True)
    # equal windows of several items lead to the same places: mark these once
    found = np.flatnonzero(hi > lo)
    edge = np.zeros(len(shard.words) + 1, np.int64)
    _, once = np.unique(np.stack((lo[found], length[found])), axis=1, return_index=True)
    for k in found[once]:
        at = shard.array[lo[k]:hi[k]]
        edge[at] += 1
        edge[at + length[k]] -= 1
    hit = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    n_hit = hit[shard.first + shard.n_words] - hit[shard.first]
    items: dict[int, set[int]] = {}
    for k in found:
        for d in np.unique(shard.document(shard.array[lo[k]:hi[k]])).tolist():
            items.setdefault(d, set()).add(int(item[k]))
    return n_hit, items, hit


def _blocks(benchmark: DataFrame, window: int, block_bytes: int, item_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes``; one at a time is on the driver."""
    b = staged(benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item_id"),
                                F.coalesce(benchmark[text_col], F.lit("")).alias("text")).distinct(), "benchmark")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Block.build(sorted({(r["item_id"], r["text"]) for r in rows}), window)


_HITS = "doc_id {id}, n_words long, n_hit long, items array<string>, hit_runs array<struct<start:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Per document row: n_words, n_hit, ``items`` (sorted ids of items with a window in it) and
    ``hit_runs`` (word ranges inside windows)."""
    spark = docs.sparkSession
    prepare(spark)
    own = narrow(docs, id_col, text_col)
    id_type = own.schema["doc_id"].dataType.simpleString()
    parts = []
    for block in _blocks(benchmark, window, block_bytes, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)  # bounded by block_bytes
        parts.append((sent, _HITS.format(id=id_type)))
    if len(parts) == 1:
        return own.mapInArrow(_hit_batches(parts[0][0]), parts[0][1])
    # several blocks: each row gets a number so that repeated ids stay apart
    keyed = staged(own.withColumn("row_no", F.monotonically_increasing_id()), "decontaminate_rows")
    schema = f"row_no long, {parts[0][1]}"
    every = None
    for sent, _ in parts:
        one = keyed.select("row_no", "doc_id", "text").mapInArrow(_hit_batches(sent), schema)
        every = one if every is None else every.unionByName(one)
    merged = every.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("hit_runs"))).alias("runs"))
    # unite overlapping runs: (runs so far, end of the last one)
    unite = F.aggregate("runs", F.array().cast("array<struct<start:long,end:long>>"), _unite)
    return merged.withColumn("hit_runs", unite).select(
        "doc_id", "n_words", F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
        .alias("n_hit"), "items", "hit_runs")


def _unite(done, run):
    last = F.element_at(done, -1)
    joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end")))
    return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= run["start"]),
                  F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(
        F.concat(done, F.array(run)))


def _hit_batches(sent):
    def run(batches):
        block = sent.value
        for batch in batches:
            raw, off = byte_view(batch.column("text"))
            for i, j in pieces(off):
                base = off[i:j + 1] - off[i]
                shard = Shard.build(raw[off[i]:off[j]], base, block)
                n_hit, items, hit = window_hits(shard, block)
                runs: list[list] = [[] for _ in range(j - i)]
                a, b = spans(np.diff(hit) > 0)
                doc = shard.document(a)
                for d, x, y in zip(doc.tolist(), (a - shard.first[doc]).tolist(), (b - shard.first[doc]).tolist()):
                    runs[d].append({"start": x, "end": y})
                part = batch.slice(i, j - i)
                names, cols = [c for c in part.schema.names if c != "text"], []
                cols = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([
                    *cols, pa.array(shard.n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted({block.items[x] for x in items.get(d, ())}) for d in range(j - i)],
                             pa.list_(pa.string())),
                    pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ], [*names, "n_words", "n_hit", "items", "hit_runs"])
    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text") -> DataFrame:
    """Longest verbatim match of every benchmark suffix in the corpus, with one row per place:
    ``(item_id, item_start, length, doc_id, doc_start)``; matches under ``least`` words (or the whole
    item, if shorter) are left out.  Each shard reports its longest, an aggregation keeps the corpus's."""
    spark = docs.sparkSession
    prepare(spark)
    own = narrow(docs, id_col, text_col)
    id_type = own.schema["doc_id"].dataType.simpleString()
    schema = f"item_id string, item_no long, item_start long, length long, doc_id {id_type}, doc_start long"
    every = None
    for k, block in enumerate(_blocks(benchmark, least, block_bytes, item_col, item_text_col)):
        one = own.mapInArrow(_match_batches(spark.sparkContext.broadcast(block), k), schema)
        every = one if every is None else every.unionByName(one)
    found = staged(every, "longest_matches")
    best = found.groupBy("item_no", "item_start").agg(F.max("length").alias("length"))
    return found.join(best, ["item_no", "item_start", "length"], "left_semi").drop("item_no")


def _match_batches(sent, block_no):
    def run(batches):
        block = sent.value
        n = block.count
        start, item = gather_ranges(block.first, n), np.repeat(np.arange(len(n)), n)
        left = block.first[item] + n[item] - start
        for batch in batches:
            raw, off = byte_view(batch.column("text"))
            for i, j in pieces(off):
                shard = Shard.build(raw[off[i]:off[j]], off[i:j + 1] - off[i], block)
                if not len(shard.array) or not len(start):
                    continue
                # the longest match lies next to the place where the whole suffix would be
                at = search(shard.words, shard.array, block.words, start, left, False)
                best = np.zeros(len(start), np.int64)
                for near in (at - 1, at):
                    ok = (near >= 0) & (near < len(shard.array))
                    best[ok] = np.maximum(best[ok], common_words(
                        shard.words, shard.array[near[ok]], block.words, start[ok], left[ok]))
                keep = best >= np.minimum(block.window, n[item])
                s, m, it = start[keep], best[keep], item[keep]
                lo = search(shard.words, shard.array, block.words, s, m, False)
                hi = search(shard.words, shard.array, block.words, s, m, True)
                rep = np.repeat(np.arange(len(s)), hi - lo)
                place = shard.array[gather_ranges(lo, hi - lo)]
                doc = shard.document(place)
                ids = batch.column("doc_id").take(pa.array(doc + i))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.items[x] for x in it[rep]], pa.string()),
                    pa.array((np.int64(block_no) << 40) + it[rep], pa.int64()),
                    pa.array(s[rep] - block.first[it[rep]], pa.int64()), pa.array(m[rep], pa.int64()),
                    ids, pa.array(place - shard.first[doc], pa.int64()),
                ], ["item_id", "item_no", "item_start", "length", "doc_id", "doc_start"])
    return run


def judged(hits: DataFrame) -> DataFrame:
    """``contaminated``: at least one word in twenty lies inside a window."""
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, all columns as they were."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = _blocks(benchmark, window, block_bytes, item_col, item_text_col)
    first = next(blocks)
    if next(blocks, None) is None:
        return keep_rows(docs, text_col, _clean(spark.sparkContext.broadcast(first)))
    # several blocks: rows get numbers, and hits are united per number
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    keyed = staged(docs.select(row, docs[text_col].alias("text"), F.monotonically_increasing_id().alias("no")),
                   "decontaminate_docs")
    hits = judged(contamination(keyed, benchmark, window, block_bytes, "no", "text", item_col, item_text_col))
    bad = staged(hits.where("contaminated").select(F.col("doc_id").alias("no")), "contaminated")
    return keyed.join(bad, "no", "left_anti").select("row.*")


def _clean(sent):
    def keep(column):
        raw, off = byte_view(column)
        out = np.ones(len(column), bool)
        for i, j in pieces(off):
            shard = Shard.build(raw[off[i]:off[j]], off[i:j + 1] - off[i], sent.value)
            n_hit = window_hits(shard, sent.value)[0]
            out[i:j] = (n_hit == 0) | (20 * n_hit < shard.n_words)
        return out
    return keep
