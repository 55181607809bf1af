import random

import numpy as np
import pytest

from ratingkit.llm import decontaminate as D

from .helpers import awkward_rows, frame, words_of

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(rows, items, window):
    windows = {}
    for i, t in items:
        w = words_of(t, PATTERN)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t, *_ in rows:
        w, hit, found = words_of(t, PATTERN), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((str(d), len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    rows = awkward_rows()
    texts = [t for _, t, _ in rows if t and len(t) > 80]
    items = [(k, " ".join(rng.choice(texts).split()[5:5 + rng.randint(2, 60)])) for k in range(30)]
    items += [(None, rows[6][1]), (31, None), (32, ""), (33, "two words"), (3, "one"), (3, rows[12][1]), (34, "ünï 中文")]
    rows += [(6, "Two... WORDS two-words", "s"), (None, rows[6][1], "s"), (6, rows[6][1], "s"), (6, rows[6][1], "s")]
    return rows, items


@pytest.mark.parametrize("window,block", [(13, D.BLOCK_BYTES), (5, D.BLOCK_BYTES), (13, 2000)])
def test_hits_against_brute_force(spark, window, block):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(frame(spark, rows), bench, window, block).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute(rows, items, window)
    assert all(sum(x["end"] - x["start"] for x in r["hit_runs"]) == r["n_hit"] for r in got)


def test_longest_matches(spark):
    rows, items = corpus()
    items = [x for x in items if x[0] is not None and x[0] > 5]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in D.longest_matches(frame(spark, rows), bench, 13).collect():
        got.setdefault((r["item_id"], r["item_start"]), set()).add((r["length"], str(r["doc_id"]), r["doc_start"]))
    docs = [(str(d), words_of(t, PATTERN)) for d, t, _ in rows]
    for i, t in items:
        w = words_of(t, PATTERN)
        for k in range(len(w)):
            best, places = 0, set()
            for d, dw in docs:
                for p in range(len(dw)):
                    n = 0
                    while k + n < len(w) and p + n < len(dw) and w[k + n] == dw[p + n]:
                        n += 1
                    if n > best:
                        best, places = n, set()
                    if n == best and n:
                        places.add((n, d, p))
            if best < min(13, len(w)):
                places = set()
            assert got.get((str(i), k), set()) == places


def test_decontaminate_keeps_columns(spark):
    rows, items = corpus()
    docs = frame(spark, rows)
    kept = D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    bad = {d for d, n, h, _ in brute(rows, items, 13) if h and 20 * h >= n}
    assert {str(r["doc_id"]) for r in kept.collect()} == {str(d) for d, *_ in rows} - bad


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 60])
def test_decontaminate_is_by_row(spark, block):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(None, item, "s"), (None, "clean text", "s"), (4, item, "s"), (4, "clean text", "s"), (None, None, "s")]
    bench = spark.createDataFrame([(1, item), (2, "other " + item)], "item_id long, text string")
    docs = frame(spark, rows)
    kept = D.decontaminate(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [
        ("4", "clean text"), ("None", "None"), ("None", "clean text")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = awkward_rows()
    assert sum(r["n_hit"] for r in D.contamination(frame(spark, rows), none).collect()) == 0
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert D.contamination(frame(spark, []), some).collect() == []
    assert D.longest_matches(frame(spark, rows), none).collect() == []


def test_suffix_order():
    rng = np.random.default_rng(1)
    words = np.concatenate((rng.integers(0, 3, 300), np.zeros(40))).astype(np.uint32)
    at = np.flatnonzero(words[:300])
    got = D.sort_suffixes(words, at, 20)
    want = sorted(at.tolist(), key=lambda p: words[p:p + 20].tolist())
    assert [words[p:p + 20].tolist() for p in got] == [words[p:p + 20].tolist() for p in want]
