"""Jaccard self-join of word shingles: filters under several token orders, then verification.

Two documents link when their shingle sets reach the threshold (``num / den``); they then differ in at
most ``D`` tokens, ``D`` growing with their sizes.  A single shared token says little of long texts,
so the pairs come from many orders: the tokens' hash order is cut into over ``D`` parts, and each order
begins with another part.  A differing token spoils the beginning of one order only, so two linked
sets begin alike, with the same whole run of tokens, under at least one of them; the hashes of these
runs are joined.  The number of parts must be the same for both sets, so sizes are cut into classes
and a set takes part in each class that a larger partner may be of.  Runs without a token that is not
common say little and are not joined; a set left with too few others joins by its prefix tokens.

A pair survives only if sizes and parity sketches allow it (``|x ^ y| >= popcount(px ^ py)``; 256 bits
travel with the token rows, 1,024 are met afterwards) and if it passes the prefix filter under
``ORDERS`` further orders: for any total order two linked sets share a token among their first
``n - ceil(t n) + 1``.  Each of these puts tokens of the same frequency class in the order of another
hash, rare classes first (the classes come from counts of all documents, in a table of fixed size).
Only then are the whole sets fetched and compared.  All filters are lossless.

What is asked for is components, so equal sets are one class from the start, and pairs that cannot
change a component are not made.  A round links the members of each token list whose members lie in
several components to a leader of the list (in later rounds to four, other ones each round) and contracts;
rounds go on while they find a fair share of what the first one found.  At the end the pairs of a list
that still lie in different components are made, long lists being cut into blocks, so no task meets
one whole.  When the rounds end decides about work only.

Words: A-Z lower-cased, runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Tokens and sets are known by
64-bit hashes.

Defined cases: documents without words have 0 shingles and are their own component; with fewer words
than a shingle the whole sequence is one; rows with a null id are counted but linked with nothing
(component null); repeated ids are linked by each of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, gather_ranges, mix, narrow, pieces, prepare, word_hashes, staged
from .components import components

ORDERS = 3
# Buckets of the frequency table (one byte each on the executors).
SKETCH_BITS = 21
SLICE_BITS = 15
PARITY_WORDS = 16
# Lower bounds of the size classes, each some three tenths above the one before.
SIZES = [1]
while SIZES[-1] < 1 << 40:
    SIZES.append(max(SIZES[-1] + 1, SIZES[-1] * 13 // 10))
# A token is common when its bucket is met this many times as often (a power of two) as the mean one.
COMMON = 3
# Largest Bloom filter of the ids whose sets are fetched for verification (64 MB).
FILTER_BITS = 1 << 29
# Members per block of a long token list.
BLOCK = 2048
# Rounds of leaders go on while one finds more than this part of the first one's links.
YIELD = 4
# Lists of more members have four leaders, not one, after the first round.
MANY = 8
# Text bytes shingled at once (whole documents): some 60 bytes of arrays each.
TEXT_BYTES = 256 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_M = np.uint64(0x9E3779B97F4A7C15)
_Q = [f"q{k}" for k in range(PARITY_WORDS)]
# Words of the folded sketch that travels with token rows.
FOLDS = 4
_F = [f"f{k}" for k in range(FOLDS)]
_ORDERS = [f"order{k}" for k in range(ORDERS)]


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, token)``, distinct and sorted, of texts given as bytes and row offsets."""
    low = _LOWER[raw]
    inside = ~_GAP[low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(raw)]
    begin[cut] = inside[cut]                     # words do not continue across rows
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1:]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    h = word_hashes(low, s, e)
    upto = np.searchsorted(s, offsets)
    n_words = np.diff(upto)
    n = np.where(n_words == 0, 0, np.maximum(n_words - words + 1, 1))
    at, row = gather_ranges(upto[:-1], n), np.repeat(np.arange(len(n)), n)
    left = np.minimum(n_words[row], words)
    token = left.astype(np.uint64)
    wide = np.append(h, np.zeros(words, np.uint64))
    for k in range(words):
        token = np.where(k < left, token * _M + wide[at + k], token)
    token = mix(token)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return row[new], token[new]


def set_ids(row: np.ndarray, token: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id of each row's set."""
    n = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n) - n
    total, odd = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    has = n > 0
    if has.any():
        total[has] = np.add.reduceat(token, first[has])
        odd[has] = np.bitwise_xor.reduceat(mix(token + _M), first[has])
    return n, mix(total * _M + odd + n.astype(np.uint64)).view(np.int64)


def prefix_size(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def prefix(row: np.ndarray, token: np.ndarray, n: np.ndarray, classes: np.ndarray, order: int,
           num: int, den: int) -> np.ndarray:
    """Indices of the prefix tokens under one order."""
    kind = classes[token >> np.uint64(64 - SKETCH_BITS)]
    key = mix(token ^ np.uint64(0xA0761D6478BD642F * (order + 1) % (1 << 64)))
    by = np.lexsort((key, kind, row))
    return by[gather_ranges(np.cumsum(n) - n, np.where(n > 0, prefix_size(n, num, den), 0))]


def most_differing(both, num: int, den: int):
    """Most tokens in which two linked sets of ``both`` tokens together differ."""
    return both * (den - num) // (den + num)


def common_buckets(classes: np.ndarray) -> np.ndarray:
    """Buckets of tokens so frequent that sharing one says little."""
    mean = max(1.0, float(np.exp2(classes / 2.0).mean()))
    return classes > 2 * (np.log2(mean) + COMMON)


def run_keys(row: np.ndarray, token: np.ndarray, n: np.ndarray, classes: np.ndarray, common: np.ndarray, num: int,
             den: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: what rows begin with under the orders of each size class; linked unequal rows share a key.

    ``token`` ascends inside a row, so a part of the hash range is a run of it.
    """
    rows, keys, bounds = [], [], np.array(SIZES)
    own, last = (np.searchsorted(bounds, x, side="right") - 1 for x in (n, den * n // num))
    for k in range(int((last - own).max(initial=-1)) + 1):
        level = np.minimum(own + k, len(bounds) - 2)
        high = bounds[level + 1] - 1
        differ = most_differing(2 * high, num, den)
        takes = (n > 0) & (own + k <= last) & (differ > 0)       # linked sets that differ in nothing are equal
        at = np.flatnonzero(takes[row])
        if not len(at):
            continue
        r, t = row[at], token[at]
        parts = (differ + 2 + differ // 16).astype(np.uint64)    # some more, as some runs are empty or common
        part = (t >> np.uint64(32)) * parts[r] >> np.uint64(32)
        new = np.ones(len(at), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        rare = np.logical_or.reduceat(~common[t >> np.uint64(64 - SKETCH_BITS)], first)
        key, r = np.add.reduceat(mix(t + _M), first)[rare], r[first][rare]
        rows.append(r)
        keys.append(mix(key * _M + level[r].astype(np.uint64)))
        # of two linked sets one with enough runs has one in common with the other, else both are here
        few = takes & (np.bincount(r, minlength=len(n)) <= most_differing(n + high, num, den))
        if few.any():
            kept = np.flatnonzero(few[row])
            at = kept[prefix(row[kept], token[kept], np.where(few, n, 0), classes, 0, num, den)]
            rows.append(row[at])
            keys.append(mix(token[at] * _M - level[row[at]].astype(np.uint64) - np.uint64(1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def _texts(batch):
    raw, off = byte_view(batch.column("text"))
    for i, j in pieces(off, TEXT_BYTES):
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]


def sketch(row: np.ndarray, token: np.ndarray, n_rows: int) -> np.ndarray:
    """Parity of the tokens in each of ``64 * PARITY_WORDS`` buckets, as words per row."""
    bits = PARITY_WORDS * 64
    bit = (mix(token.copy()) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(row * bits + bit, minlength=n_rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n_rows, PARITY_WORDS)


def _profile(own: DataFrame, words: int) -> DataFrame:
    """Per row ``(doc_id, h1, h2, n, sid, q0, ...)``: the text by two hashes, size, id and parity sketch of its set;
    and slices of the task's token counts (``slice``, ``counts``)."""
    id_type = own.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h1", "h2", "n", "sid", *_Q, "slice", "counts"]

    def run(batches):
        seen, kind = np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for i, j, raw, off in _texts(batch):
                row, token = shingles(raw, off, words)
                n, sid = set_ids(row, token, j - i)
                packed = sketch(row, token, j - i)
                np.add.at(seen, token >> np.uint64(64 - SKETCH_BITS), 1)
                none = pa.nulls(j - i)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(i, j - i) for c in ("doc_id", "h1", "h2")), pa.array(n, pa.int64()),
                    pa.array(sid), *(pa.array(np.ascontiguousarray(packed[:, k])) for k in range(PARITY_WORDS)),
                    none.cast(pa.int32()), none.cast(pa.binary())], names)
        if kind is not None:
            parts = seen.reshape(-1, 1 << SLICE_BITS)
            for k in range(0, len(parts), 8):
                own_ = parts[k:k + 8]
                none = pa.nulls(len(own_), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(len(own_), kind), none, pa.nulls(len(own_), pa.int32()), none, none, *[none] * PARITY_WORDS,
                    pa.array(np.arange(k, k + len(own_)), pa.int32()),
                    pa.array([zlib.compress(p.astype("<i8").tobytes(), 1) for p in own_], pa.binary())],
                    names)
    rows = own.withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text")})
    return rows.mapInArrow(run, f"doc_id {id_type}, h1 long, h2 int, n long, sid long, "
                           + "".join(f"{q} long, " for q in _Q) + "slice int, counts binary")


def _classes(profile: DataFrame) -> np.ndarray:
    """Frequency class (twice the logarithm of the count) of each bucket: a table of fixed size."""
    slices = profile.where(F.col("slice").isNotNull()).select(
        "slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))

    def added(final):
        def run(key, table):
            total = np.zeros(1 << SLICE_BITS, np.int64)
            for c in table.column("counts").to_pylist():
                total += np.frombuffer(zlib.decompress(c), "<i8")
            if final:
                data = np.minimum(2 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8).tobytes()
            else:
                data = zlib.compress(total.astype("<i8").tobytes(), 1)
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([data], pa.binary())})
        return run
    some = slices.groupBy("slice", "salt").applyInArrow(added(False), "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8).reshape(-1, 1 << SLICE_BITS)
    for r in some.groupBy("slice").applyInArrow(added(True), "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def _fresh(seen: set[int], sid: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Wanted rows whose set the task has not met before."""
    out = wanted.copy()
    for k, s in enumerate(sid.tolist()):
        if s in seen:
            out[k] = False
        elif wanted[k]:
            seen.add(s)
    return out


def _keys(own: DataFrame, sent, words: int, num: int, den: int) -> DataFrame:
    """``(token, sid)``: keys of each set's leading runs; each set once per task."""
    def run(batches):
        seen: set[int] = set()
        common = common_buckets(sent.value)
        for batch in batches:
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for i, j, raw, off in _texts(batch):
                row, token = shingles(raw, off, words)
                n, sid = set_ids(row, token, j - i)
                fresh = _fresh(seen, sid, known[i:j] & (n > 0))
                keep = fresh[row]
                at, key = run_keys(row[keep], token[keep], np.where(fresh, n, 0), sent.value, common, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid[at])], ["token", "sid"])
    return own.mapInArrow(run, "token long, sid long")


def _prefixes(own: DataFrame, wanted, sent, words: int, num: int, den: int) -> DataFrame:
    """``(sid, order0, order1, ...)``: prefix tokens under every order, of the rows whose id passes the filter.

    The orders only filter, so half of a token's bits do.  Each set comes once per task.
    """
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            passed = _passes(wanted.value, batch.column("key").to_numpy(zero_copy_only=False))
            if not passed.any():
                continue
            for i, j, raw, off in _texts(batch.filter(pa.array(passed))):
                row, token = shingles(raw, off, words)
                n, sid = set_ids(row, token, j - i)
                fresh = _fresh(seen, sid, n > 0)
                keep = fresh[row]
                row, token, n = row[keep], token[keep], np.where(fresh, n, 0)
                cols = [pa.array(sid)]
                for k in range(ORDERS):
                    at = prefix(row, token, n, sent.value, k, num, den)
                    cols.append(_lists((token[at].view(np.int64) >> 32).astype(np.int32),
                                       np.bincount(row[at], minlength=j - i)))
                yield pa.RecordBatch.from_arrays(cols, ["sid", *_ORDERS]).filter(pa.array(fresh))
    return _with_key(own).mapInArrow(run, "sid long, " + ", ".join(f"{c} array<int>" for c in _ORDERS))


def _with_key(own: DataFrame) -> DataFrame:
    """Texts of known ids with what the filters of ids look up."""
    return own.where(F.col("doc_id").isNotNull()).select("text", F.xxhash64("doc_id").alias("key"))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bloom filter (two bits an id) as an array of booleans: 16 bits per id, ``FILTER_BITS`` at most.

    Beyond that more ids pass by chance, which costs work and changes no result.
    """
    bits = min(FILTER_BITS, max(1 << 20, 1 << (16 * ids.count()).bit_length()))
    key = F.xxhash64(column)
    place = F.explode(F.array(F.pmod(key, F.lit(bits)), F.pmod(F.shiftrightunsigned(key, 32), F.lit(bits)))).alias("p")
    blocks = ids.select(place).groupBy(F.floor(F.col("p") / 32768).cast("int").alias("b")).agg(
        F.bitmap_construct_agg(F.pmod("p", F.lit(32768))).alias("m"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for row in blocks.collect():
        out[row["b"]] = np.frombuffer(row["m"], np.uint8)
    return out.reshape(-1)


def _passes(have: np.ndarray, key: np.ndarray) -> np.ndarray:
    size = np.int64(len(have) * 8 - 1)
    out = np.ones(len(key), bool)
    for at in (key & size, (key.view(np.uint64) >> np.uint64(32)).astype(np.int64) & size):
        out &= (have[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _bodies(own: DataFrame, wanted, words: int) -> DataFrame:
    """Whole sets ``(sid, tokens)`` of the rows whose id passes the filter.

    A scan with a broadcast filter of bounded size, so that texts are not shuffled.
    """
    def run(batches):
        for batch in batches:
            passed = _passes(wanted.value, batch.column("key").to_numpy(zero_copy_only=False))
            if not passed.any():
                continue
            for i, j, raw, off in _texts(batch.filter(pa.array(passed))):
                row, token = shingles(raw, off, words)
                n, sid = set_ids(row, token, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(sid), _lists(token.view(np.int64), n)], ["sid", "tokens"])
    return _with_key(own).mapInArrow(run, "sid long, tokens array<long>")


def _filters(prefixes: DataFrame, wanted) -> DataFrame:
    """Prefixes of the sets whose id passes the filter: a scan, no shuffle of the others."""
    def run(batches):
        for batch in batches:
            passed = _passes(wanted.value, batch.column("key").to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(passed)).drop_columns(["key"])
    rows = prefixes.select("sid", *_ORDERS, F.xxhash64("sid").alias("key"))
    return rows.mapInArrow(run, prefixes.schema)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return F.lit(den) * F.least(a, b) >= F.lit(num) * F.greatest(a, b)


def _parity_fits(a: str, b: str, columns: list[str], num: int, den: int) -> Column:
    """Lossless: linked sets differ in at most ``n + m - 2 ceil(num (n + m) / (num + den))`` tokens."""
    both = F.col(f"{a}.n").cast("long") + F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{q}").bitwiseXOR(F.col(f"{b}.{q}"))) for q in columns), F.lit(0))
    return differ <= both - 2 * F.ceil(F.lit(num) * both / F.lit(num + den) - 1e-9)


def _with_both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs(a, b)`` with the columns of both sets as structs ``x`` and ``y``: merge joins at every size."""
    kept = F.struct(*columns)
    return pairs.join(table.select(F.col("sid").alias("a"), kept.alias("x")).hint("merge"), "a").join(
        table.select(F.col("sid").alias("b"), kept.alias("y")).hint("merge"), "b")


def _set_ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()


def likely(pairs: DataFrame, sketches: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of set ids that whole sketches allow and that share a prefix token under every order."""
    near = staged(_with_both(pairs, sketches, "n", *_Q).where(
        _sizes_fit(F.col("x.n"), F.col("y.n"), num, den) & _parity_fits("x", "y", _Q, num, den)).select("a", "b"), "near_pairs")
    ids = staged(_set_ids_of(near), "near_ids")
    wanted = near.sparkSession.sparkContext.broadcast(id_filter(ids, "sid"))
    further = staged(_filters(prefixes, wanted).join(ids.hint("merge"), "sid", "left_semi").dropDuplicates(["sid"]),
                     "needed_prefixes")
    both = _with_both(near, further, *_ORDERS)
    for c in _ORDERS:
        both = both.where(F.arrays_overlap(f"x.{c}", f"y.{c}"))
    return staged(both.select("a", "b"), "candidate_pairs")


def verified(pairs: DataFrame, own: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs that link by their whole sets."""
    needed = staged(_set_ids_of(pairs).join(sets.hint("merge"), "sid"), "needed_sets")
    wanted = own.sparkSession.sparkContext.broadcast(id_filter(needed, "rep"))
    bodies = _bodies(own, wanted, words).join(needed.select("sid").hint("merge"), "sid", "left_semi")
    if needed.where("copies > 1").limit(1).count():     # the id of a needed set repeats: one body each
        bodies = bodies.dropDuplicates(["sid"])
    both = _with_both(pairs, staged(bodies, "candidate_sets"), "tokens")
    common = F.size(F.array_intersect("x.tokens", "y.tokens"))
    return staged(both.where(F.lit(den) * common >= F.lit(num) * (F.size("x.tokens") + F.size("y.tokens") - common)).select(
        "a", "b"), "links")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    return _row_components(docs, words, num, den, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _row_components(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Per row ``(doc_id, h1, h2, n, sid, component, kept)``; ``kept``: the component's set that stays."""
    spark = docs.sparkSession
    prepare(spark)
    own = narrow(docs, id_col, text_col)
    profile = staged(_profile(own, words), "profiles")
    sent = spark.sparkContext.broadcast(_classes(profile))          # 2 ** SKETCH_BITS bytes
    rows = profile.where(F.col("slice").isNull()).drop("slice", "counts", *_Q)
    counted = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    per_id = counted.groupBy("sid", "doc_id").agg(F.count("*").alias("copies"))
    sets = staged(per_id.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "copies")).alias("m")).select(
        "sid", "m.rep", "m.copies"), "sets")

    lists = staged(_token_lists(_keys(own, sent, words, num, den)), "token_lists")
    members = staged(lists.select("sid").distinct().join(sets.hint("merge"), "sid"), "members")
    wanted = spark.sparkContext.broadcast(id_filter(members, "rep"))
    prefixes = staged(_prefixes(own, wanted, sent, words, num, den), "prefixes")
    sketches = staged(profile.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).join(
        members.select("sid").hint("merge"), "sid", "left_semi").groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", *_Q))), "sketches")

    roots, first = None, None
    for turn in itertools.count():
        pairs = _leader_pairs(_with_nodes(lists, sketches, roots, turn), num, den)
        new = verified(likely(pairs, sketches, prefixes, num, den), own, sets, words, num, den)
        found = new.count()
        if found or roots is None:
            roots = staged(components(_with_links(roots, new)), "roots")
            lists = staged(_still_open(lists, roots), "open_lists")
        first = found if first is None else first
        if found * YIELD <= first:
            break
    pairs = _rest_pairs(_with_nodes(lists, sketches, roots, turn + 1), num, den)
    rest = verified(likely(pairs, sketches, prefixes, num, den), own, sets, words, num, den)
    if rest.limit(1).count():
        roots = staged(components(_with_links(roots, rest)), "roots")

    # smallest id per component, then every row by its set
    named = sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep").alias("component"), F.col("sid").alias("kept"))).alias("m"))
    named = named.join(least, "root").select("sid", "m.component", "m.kept")
    linked = counted.join(named, "sid")
    alone = rows.where((F.col("n") == 0) | F.col("doc_id").isNull()).withColumns(
        {"component": F.col("doc_id"), "kept": F.col("sid")})
    return linked.unionByName(alone)


def _token_lists(keys: DataFrame) -> DataFrame:
    """``(token, sid)`` of the keys that several sets have: one exchange of the keys."""
    group = Window.partitionBy("token")
    rows = keys.select("token", "sid", F.min("sid").over(group).alias("lo"), F.max("sid").over(group).alias("hi"))
    return rows.where("lo <> hi").select("token", "sid").distinct()


def _rooted(table: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return table.withColumn("root", F.col("sid"))
    return table.join(roots.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn(
        "root", F.coalesce("root", "sid"))


def _with_links(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Edges of the components so far, one a node, and of the new links."""
    return links if roots is None else roots.toDF("a", "b").select(*links.columns).unionByName(links)


def _still_open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the lists whose members lie in several components."""
    rows = staged(_rooted(lists, roots), "rooted_lists")
    mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return rows.join(mixed.select("token").hint("merge"), "token", "left_semi").select("token", "sid")


def _with_nodes(lists: DataFrame, sketches: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """The lists with their sets' component, size and small sketch: ``(token, sid, root, n, f0, ..., leads, members)``."""
    folded = [functools.reduce(Column.bitwiseXOR, (F.col(q) for q in _Q[k::FOLDS])).alias(_F[k]) for k in range(FOLDS)]
    nodes = _rooted(sketches.select("sid", "n", *folded), roots)
    rows = staged(lists.join(nodes.hint("merge"), "sid"), "lists_by_component")
    key, other = (F.xxhash64("token", "sid", F.lit(turn), F.lit(k)) for k in range(2))
    heads = rows.groupBy("token").agg(
        F.max(key).alias("top"), F.min(key).alias("low"), F.max(other).alias("high"), F.min(other).alias("least"),
        F.count("*").alias("members"))
    leads = key == F.col("top")
    if turn:
        leads |= (F.col("members") > MANY) & ((key == F.col("low")) | other.isin(F.col("high"), F.col("least")))
    # both sides of the later joins ask for ``top``, so that one exchange serves them
    return rows.join(heads.where(F.col("top").isNotNull() & (F.col("members") > 1)).hint("merge"), "token").withColumn(
        "leads", leads).drop("low", "high", "least")


def _apart(num: int, den: int) -> Column:
    return ((F.col("x.root") != F.col("y.root")) & _sizes_fit(F.col("x.n"), F.col("y.n"), num, den)
            & _parity_fits("x", "y", _F, num, den))


def _leader_pairs(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each list's leaders with the members of other components."""
    met = open_.alias("x").join(open_.where("leads").alias("y").hint("merge"),
                                (F.col("x.token") == F.col("y.token")) & _apart(num, den))
    return met.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def _rest_pairs(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a token list that lie in different components, long lists block by block."""
    pair = (F.col("x.sid") < F.col("y.sid")) & _apart(num, den)
    ids = F.col("x.sid").alias("a"), F.col("y.sid").alias("b")
    short = open_.where(F.col("members") <= BLOCK)
    met = short.alias("x").join(short.alias("y").hint("merge"), (F.col("x.token") == F.col("y.token")) & pair).select(*ids)
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    cut = open_.where(F.col("members") > BLOCK).withColumn("block", F.pmod(F.xxhash64("sid"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # a pair meets once: in (block of x, block of y), x being the one with the smaller id
    long = cut.alias("x").join(cut.alias("y").hint("merge"), (F.col("x.token") == F.col("y.token")) & (
        F.col("x.other") == F.col("y.block")) & (F.col("x.block") == F.col("y.other")) & pair).select(*ids)
    return met.unionByName(long).distinct()


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (its smallest id, one set of it), all columns as they were.

    A verdict is on an id with its text, so other texts of the id stay.  Of rows that repeat an id and its
    text one stays (the least by a hash of the row); rows with a null id or without words all stay.
    """
    found = staged(_row_components(docs, words, num, den, id_col, text_col), "row_components")
    row = ["doc_id", "h1", "h2"]
    gone = staged(found.where((F.col("doc_id") != F.col("component")) | (F.col("sid") != F.col("kept"))).select(
        *row).distinct(), "near_copies")
    again = staged(found.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*row).count().where(
        "count > 1").select(*row), "repeated_rows")

    names = [f"c{k}" for k in range(len(docs.columns))]
    at, text = names[docs.columns.index(id_col)], F.col(names[docs.columns.index(text_col)])
    keyed = docs.toDF(*names).withColumns({"doc_id": F.col(at), "h1": F.xxhash64(text), "h2": F.hash(text)})
    kept = keyed.join(gone, row, "left_anti")
    if again.limit(1).count():
        body = F.struct(*names)
        one = kept.join(again, row, "left_semi").groupBy(*row).agg(F.min_by(body, F.xxhash64(*names)).alias("r"))
        kept = kept.join(again, row, "left_anti").select(*names).unionByName(one.select("r.*"))
    return kept.select(*(F.col(n).alias(f.name, metadata=f.metadata) for n, f in zip(names, docs.schema.fields)))
