import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratingkit.llm import components, jaccard, line_spread, suffix_dedup

from .helpers import awkward_rows, by_id, frame, words_of


def brute_components(rows, words, num, den):
    sets = {}
    for d, t, *_ in rows:
        w = words_of(t, r"[^\x20\x09-\x0D]+")
        sets[d] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_near_duplicates_against_brute_force(spark, words, num, den):
    rows = awkward_rows()
    got = by_id(jaccard.near_duplicates(frame(spark, rows), words, num, den))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_components(rows, words, num, den)


def test_blocks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(300)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((d, " ".join(w), "s"))
    got = by_id(jaccard.near_duplicates(frame(spark, rows), 4, 85, 100))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_components(rows, 4, 85, 100)


def test_near_duplicate_cases(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(5, base, "s"), (5, base, "s"), (None, base, "s"), (9, base, "s"), (2, None, "s"), (3, "", "s")]
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {
        (5, 36, 5), (None, 36, None), (9, 36, 5), (2, 0, 2), (3, 0, 3)}
    kept = jaccard.keep_one(frame(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "5", "None"]
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []


def test_keep_one_is_by_row(spark):
    say = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(3, say("a"), "s"), (7, say("a") + " end", "s"), (7, say("b"), "s"), (None, say("a"), "s"),
            (None, say("c"), "s"), (8, say("d"), "s"), (8, say("d") + " end", "s")]
    kept = sorted((str(r["doc_id"]), r["text"][:2]) for r in jaccard.keep_one(frame(spark, rows)).collect())
    assert kept == [("3", "a0"), ("7", "b0"), ("8", "d0"), ("None", "a0"), ("None", "c0")]


def test_prefix_filter_is_lossless():
    rng = np.random.default_rng(4)
    classes = rng.integers(0, 3, 1 << jaccard.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        x, y = (np.sort(rng.choice(pool, rng.integers(3, len(pool)), replace=False)) for _ in range(2))
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * (len(x) + len(y) - both):
            continue
        row, token = np.repeat([0, 1], [len(x), len(y)]), np.concatenate((x, y))
        n = np.array([len(x), len(y)])
        for order in range(jaccard.ORDERS):
            at = jaccard.prefix(row, token, n, classes, order, 85, 100)
            assert set(token[at[row[at] == 0]]) & set(token[at[row[at] == 1]])


def hashed_sets(sets):
    """Sets of tokens as ``run_keys`` takes them."""
    n = np.array([len(x) for x in sets])
    return np.repeat(np.arange(len(sets)), n), np.concatenate([np.sort(x) for x in sets]), n


@pytest.mark.parametrize("num", [50, 80, 85, 95])
@pytest.mark.parametrize("common", [0.0, 0.5, 1.0])
def test_run_keys_are_lossless(num, common):
    rng = np.random.default_rng(num)
    classes = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    often = rng.random(len(classes)) < common
    linked = 0
    for size in [*range(1, 60), *rng.integers(60, 3000, 60)]:
        x = rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)
        most = jaccard.most_differing(2 * size, num, 100)
        gone, more = (int(rng.integers(0, most + 2)) for _ in range(2))
        y = np.concatenate((x[gone:], rng.integers(0, 2**63, more).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < num * (len(x) + len(y) - both) or len(x) == len(y) == both:
            continue
        row, key = jaccard.run_keys(*hashed_sets([x, y]), classes, often, num, 100)
        assert set(key[row == 0]) & set(key[row == 1])
        linked += 1
    assert linked > 10


def test_long_unrelated_sets_share_few_keys(spark):
    """Single prefix tokens pair most long texts that have some phrases in common, runs do not."""
    rng = random.Random(3)
    phrases = [" ".join(f"p{k}x{i}" for i in range(7)) for k in range(1500)]
    rows = [(d, " ".join(" ".join((rng.choice(phrases), *(f"d{d}w{k}x{i}" for i in range(8)))) for k in range(120)), "s")
            for d in range(60)]
    docs = frame(spark, rows, extra=False)
    classes = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    lists = jaccard._token_lists(jaccard._keys(docs, spark.sparkContext.broadcast(classes), 4, 85, 100)).collect()
    groups = {}
    for r in lists:
        groups.setdefault(r["token"], set()).add(r["sid"])
    pairs = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert len(pairs) < 60 * 59 / 2 * 0.02
    got = by_id(jaccard.near_duplicates(docs, 4, 85, 100))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_components(rows, 4, 85, 100)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 400)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        own = [b[k:k + length] for k in range(len(b) - length + 1)]
        for k, s in enumerate(own):
            if s in seen:
                gone[k:k + length] = [True] * length
        seen.update(own)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)),
                  hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,gram,size", [(50, 24, 1 << 20), (50, 24, 3000), (20, 8, 2000), (9, 9, 5000)])
def test_repeats_against_brute_force(spark, length, gram, size):
    rows = awkward_rows()
    got = by_id(suffix_dedup.cut_repeats(frame(spark, rows), length=length, gram=gram, range_bytes=size))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute_repeats(rows, length)


def test_repeats_with_null_and_repeated_ids(spark):
    text = "".join(chr(97 + (k * k) % 26) for k in range(120))
    rows = [(None, text, "s"), (None, text, "s"), (4, text, "s"), (4, text, "s"), (6, text, "s"), (8, None, "s")]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.cut_repeats(frame(spark, rows)).collect())
    assert got == [("4", 0), ("4", 0), ("6", 120), ("8", 0), ("None", 0), ("None", 0)]
    assert suffix_dedup.cut_repeats(frame(spark, [])).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, group = suffix_dedup.multikey_order(words)
    rows = list(zip(*(w.tolist() for w in words)))
    assert [rows[k] for k in order] == sorted(rows)
    assert len(set(group.tolist())) == len(set(rows))


def brute_lines(rows, min_sites, min_chars):
    trim = lambda x: x.strip(" \t\r")
    site = lambda s: hashlib.md5(b"" if s is None else b"1" + s.encode()).hexdigest()
    of_text, spread = {}, {}
    for _, t, s in rows:
        if t:
            of_text[t] = min(of_text.get(t, "g"), site(s))
    for t, s in of_text.items():
        for x in t.split("\n"):
            if len(trim(x)) >= min_chars:
                spread.setdefault(trim(x), set()).add(s)
    shared = {x for x, s in spread.items() if len(s) >= min_sites}
    return sorted(((str(d), t and "\n".join(x for x in t.split("\n") if trim(x) not in shared)) for d, t, _ in rows), key=str)


def line_corpus():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(n))
    foot, head, rows = "all rights reserved here", "  read more about this \r", []
    for d in range(120):
        lines = [say(rng.randint(1, 9)) for _ in range(rng.randint(0, 8))]
        for x, p in ((foot, .5), (head, .3), ("ok then", .5), ("one site only line", 1.0 if d % 10 == 3 else 0)):
            if rng.random() < p:
                lines.insert(rng.randint(0, len(lines)), x)
        rows.append((d, "\n".join(lines), f"s{d % 10}" if d % 10 else None))
    return rows + [(500, None, "s1"), (501, "", "s2"), (502, foot, "s3"), rows[7], rows[7], (None, f"{say(9)}\n{foot}", "s4")]


@pytest.mark.parametrize("sites", [3, 8, 10])
def test_shared_lines_against_brute_force(spark, sites):
    rows = line_corpus()
    docs = frame(spark, rows)
    got = line_spread.cut_shared_lines(docs, min_sites=sites)
    assert got.columns == [*docs.columns, "__lines_cut", "__chars_cut"]
    assert sorted(((str(r["doc_id"]), r["text"]) for r in got.collect()), key=str) == brute_lines(rows, sites, 10)


def test_shared_lines_of_an_empty_table(spark):
    assert line_spread.cut_shared_lines(frame(spark, [])).collect() == []


def test_shared_lines_of_copies_and_of_scripts_without_spaces(spark):
    cjk, foot = "\u3053\u306e\u30b5\u30a4\u30c8\u306e\u5185\u5bb9\u306f\u4fdd\u8b77\u3055\u308c\u3066\u3044\u307e\u3059", "all rights reserved by the owners"
    rows = [(k, f"text {k}\n{foot}\n{cjk}", f"s{k}") for k in range(12)]
    rows += [(20 + k, f"a copied text\n{foot}", f"s{k}") for k in range(15)]       # copies on 15 sites
    rows += [(None, f"a copied text\n{foot}", None), (50, f"{foot}\n {cjk}\t", "s1"), (51, "short\nshort", "s2")]
    rows += [(60 + k, "short", f"s{k}") for k in range(9)]
    got = line_spread.cut_shared_lines(frame(spark, rows)).collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert all(texts[k] == f"text {k}" for k in range(12))
    assert all(texts[k] == "a copied text" for k in (*range(20, 35), None))
    assert texts[50] == "" and texts[51] == "short\nshort" and texts[60] == "short"
    cut = {r["doc_id"]: (r["__lines_cut"], r["__chars_cut"]) for r in got}
    assert cut[3] == (2, len(foot) + len(cjk)) and cut[50] == (2, len(foot) + len(cjk) + 2) and cut[51] == (0, 0)


def test_pipeline_cuts_copies_alike(spark):
    import corpus_pipeline
    head, foot = "welcome to this fine page", "all rights reserved by the owners"
    page = lambda x: f"{head}\n{x}\n{foot}"
    rows = [(k, page(f"text {k}"), f"s{k}") for k in range(9)]           # short pages, no copies
    rows += [(k, page("same"), f"s{k}") for k in range(20, 32)]          # copies
    rows += [(33, page("again"), "s2"), (33, page("again"), "s2"), (None, page("same"), "s3"), (40, foot, "s4"), (41, "", "s4")]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text"))
    got = corpus_pipeline.cut_boilerplate(spark, docs, "").collect()
    want = [(k, f"text {k}") for k in range(9)] + [(k, "same") for k in (*range(20, 32), None)] + [
        (33, "again"), (33, "again"), (40, ""), (41, "")]
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(d), t) for d, t in want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_equal_classes_compare_all_columns(monkeypatch):
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4, 400).astype(np.uint64) for _ in range(3)]
    rows = list(zip(*(w.tolist() for w in words)))

    def check():
        order, group = suffix_dedup.equal_classes(words)
        assert sorted(order) == list(range(400))
        of = dict(zip(order.tolist(), group.tolist()))
        assert len(set(group.tolist())) == len(set(rows)) == len({(rows[k], of[k]) for k in range(400)})
        assert (np.diff(group) >= 0).all()
    check()
    monkeypatch.setattr(suffix_dedup, "mix", lambda h: h & np.uint64(1))       # hashes that collide
    check()


def test_hits_travel_packed():
    doc, start, end = np.array([-7, -7, 3, 2 ** 40]), np.array([0, 90, 5, 2 ** 31]), np.array([50, 150, 61, 2 ** 31 + 50])
    back = suffix_dedup._unpack_hits(suffix_dedup._pack_hits(doc, start, end))
    assert [x.tolist() for x in back] == [doc.tolist(), start.tolist(), end.tolist()]
    docs = pa.table({"doc_id": pa.array([3, 4, 3, 9]), "text": ["x" * 70, "y" * 10, "x" * 20, None], "part": [0, 0, 0, 0]})
    got = suffix_dedup._cut_rows(docs, (np.array([3, 3, 4]), np.array([5, 60, 0]), np.array([55, 200, 10])), True)
    assert got.column("n_removed").to_pylist() == [60, 10, 15, 0] and got.column("n_spans").to_pylist() == [2, 1, 1, 0]
    assert [len(x) for x in got.column("kept").to_pylist()] == [10, 0, 5, 0]
