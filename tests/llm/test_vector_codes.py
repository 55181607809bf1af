import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingkit.llm import vector_codes as vc

from .helpers import CLASH


def brute_force(rows, parts, entries, rounds):
    """Codes by plain loops; rows are ``(vec_id, vector, label)``."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[p * size:(p + 1) * size] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e
                        for k, e in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        found = [nearest(part, book) for part, book in zip(cut(v), books)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, lab, c, e, total[lab]) for i, lab, c, e in out), key=str), books


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in (*CLASH, "v", "code", "error", "p", "e", "n", "s")})


def vectors(n, dims, seed=1, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, 0.3))
    return [(k, [float(np.float32(value())) for _ in range(dims)], rng.choice([None, 0, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("name", ["gauss", "ties", "awkward", "few"])
def test_equal_to_brute_force(spark, name):
    parts, entries = 4, 8
    rows = vectors(150, 12)
    if name == "ties":
        rows = vectors(200, 8, grid=[-0.5, 0.0, 0.25])
    elif name == "awkward":
        rows = vectors(60, 8) + [(3, None, 1), (900, [math.nan] * 8, 1), (901, [math.inf] + [0.0] * 7, 1),
                                 (902, [None] * 8, 2)] + [vectors(1, 8)[0]] * 4 + [(None, [0.5] * 8, None)]
    elif name == "few":
        rows = vectors(5, 8)
    want, books = brute_force(rows, parts, entries, 2)
    coded, got = vc.compress(table(spark, rows), parts, entries, 2)
    assert sorted((tuple(r) for r in coded.collect()), key=str) == want
    assert got.books.tolist() == books
    assert got.text() == ",".join(str(x) for b in books for e in b for x in e)


def test_trie_equals_direct_distances(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(vc, "SUBTREE", 7)
    for dims, low, n in ((1, -50, 300), (4, -3, 2000), (4, -60, 800), (2, -1, 50), (3, 0, 1)):
        part, book = rng.integers(low, 4, (n, dims)), rng.integers(-4, 4, (9, dims))
        trie = vc.PartTrie(part.astype(np.int32))
        code, dist = trie.nearest(book)
        direct = ((part[:, None].astype(np.int64) - book) ** 2).sum(axis=2)
        assert (code[trie.leaf_of] == direct.argmin(axis=1)).all()
        assert (dist[trie.leaf_of] == direct.min(axis=1)).all()
        assert len(trie.leaves) == len(np.unique(part, axis=0)) and trie.weight.sum() == n
        count, total = trie.sums(code, 9)
        assert total.sum(axis=0).tolist() == part.sum(axis=0).tolist() and count.sum() == n


def test_lengths_limits_and_empty(spark):
    rows = [(1, [0.1] * 8, 1), (2, [0.2] * 4, 1), (3, [0.3] * 6, 1), (4, [], 1), (5, [1e30, -1e30] + [0.0] * 6, 1)]
    coded, books = vc.compress(table(spark, rows), 4, 2, 1)
    assert sorted(r["vec_id"] for r in coded.collect()) == [1, 5] and books.shape == (4, 2, 2)
    assert abs(books.books).max() == vc.LIMIT
    none, books = vc.compress(table(spark, rows).where(F.lit(False)), 4, 2, 1)
    assert books is None and none.collect() == [] and none.columns == coded.columns
