import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from ratingkit.llm import bitplanes, bpe, packing
from ratingkit.llm.common import shared_path, word_hashes
from ratingkit.llm.piece_counts import PieceAutomaton, PieceCounter, byte_vocabulary, token_counts

from .helpers import awkward_rows, by_id, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = bpe.load_tokenizer(PATH)
ENCODER = bpe.Encoder(PATH, bpe.probe_classes(TOKENIZER))


def ids_of(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("abst 'relvmd\n\t1!é \x85😀<|endoftext|>", max_size=40)), max_size=6))
def test_encoder_equals_the_library(texts):
    texts = [t for t in texts if t.isprintable() or not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    ids, off = ENCODER.encode(texts, 7)
    assert [ids[off[k]:off[k + 1]].tolist() for k in range(len(texts))] == [ids_of(t, 7) for t in texts]


def test_long_regular_words_stay_apart():
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))      # these collide modulo 2**64
    b = a.translate(str.maketrans("ab", "ba"))
    encoder = bpe.Encoder(PATH, ENCODER.classes)
    for text in (a, b, f"{a} {b}", f"x {b}"):
        assert encoder.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    counter = PieceCounter(PieceAutomaton(byte_vocabulary(PATH)), ENCODER.classes)
    fresh = PieceCounter(counter.automaton, ENCODER.classes)
    counter.count([a])
    assert counter.count([b])[1] == fresh.count([b])[1]
    points = np.frombuffer(("\u4e00" * 40 + a + "\u4e00" * 40 + a).encode("utf-32-le"), np.uint32)
    h = word_hashes(points, np.array([0, 40, 1064, 1104]), np.array([40, 1064, 1104, 2128]))
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.sampled_from([1, 8]), st.integers(1, 64))
def test_planes_round_trip(ids, kind, block):
    ids = np.array(ids, np.uint32)
    assert (bitplanes.unpack_ids(bitplanes.pack_ids(ids, kind, block)) == ids).all()


@pytest.mark.parametrize("kind", [1, 8])
def test_files_round_trip(spark, kind):
    rows = awkward_rows() + [(6, "again", "s"), (6, "again", "s"), (None, "null id", "s")]
    path = shared_path(spark, "ids")
    bitplanes.write_ids(frame(spark, rows), path, PATH, kind=kind, chunk_ids=500)
    got = sorted(bitplanes.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, *_ in rows), key=lambda d: -1 if d is None else d)
    texts, at = {}, 0
    for d, t, _ in rows:
        texts.setdefault(d, []).append(ids_of(t, 2))
    for r in got:
        assert r["ids"] in texts[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_files_of_an_empty_table(spark):
    path = shared_path(spark, "ids")
    bitplanes.write_ids(frame(spark, []), path, PATH)
    assert bitplanes.read_documents(spark, path).collect() == []


def check_pack(pieces, rows, size):
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(np.array(ids_of(t, 0), "<u4"))
    sequences = {}
    for p in pieces:
        assert any(zlib.crc32(w[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
                   and len(w) == p["doc_tokens"] for w in want[p["doc_id"]])
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(w) for ws in want.values() for w in ws)
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size


@pytest.mark.parametrize("size", [64, 1024])
def test_packing(spark, size):
    rows = awkward_rows() + [(6, "again", "s"), (6, "again", "s"), (None, "null id", "s")]
    got = packing.pack(frame(spark, rows), PATH, size).collect()
    check_pack(got, rows, size)
    assert packing.pack(frame(spark, []), PATH, size).collect() == []


def test_sequences_hold_the_ids(spark):
    rows = awkward_rows()
    docs = frame(spark, rows)
    packed = packing.pack(docs, PATH, 256)
    out = {r["sequence_id"]: r for r in packing.sequences(docs, packed, PATH, 256, pad_id=9).collect()}
    texts = {d: ids_of(t, 0) for d, t, _ in rows}
    for p in packed.collect():
        ids = out[p["sequence_id"]]["ids"]
        assert len(ids) == 256 and ids[p["offset"]:p["offset"] + p["length"]] == texts[p["doc_id"]][p["start"]:p["start"] + p["length"]]
    assert all(set(r["ids"][r["n_tokens"]:]) <= {9} for r in out.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 50)), max_size=12))
def test_patterns_use_every_piece(counts):
    histogram = np.zeros(33, np.int64)
    for n, c in counts:
        histogram[n] += c
    used = np.zeros(33, np.int64)
    plan = packing.plan_patterns(histogram, 32)
    for p in plan:
        assert (p.lengths * p.counts).sum() <= 32
        used[p.lengths] += p.counts * p.times
    assert (used == histogram).all()


def test_column_generation_reaches_the_optimum():
    # 2 x 21 + 22 = 64: greedy from the longest wastes room, the optimum does not
    counts = np.zeros(65, np.int64)
    counts[[40, 24, 33, 31, 22, 21]] = [100, 100, 50, 50, 100, 200]
    total = sum(x for _, x in packing.column_generation(counts, 64))
    assert total <= (counts * np.arange(65)).sum() / 64 * 1.001
    assert sum(p.times for p in packing.plan_patterns(counts, 64)) == 250


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        value = np.full(21, -np.inf)
        value[rng.choice(np.arange(1, 21), 6, replace=False)] = rng.normal(0.5, 0.4, 6)
        best = np.zeros(21)
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - n] + value[n] for n in range(1, c + 1) if np.isfinite(value[n]))])
        got, counts = packing.knapsack(value, 20)
        assert got == pytest.approx(best[20])
        assert (counts * np.arange(21)).sum() <= 20
        assert (counts[np.isfinite(value)] * value[np.isfinite(value)]).sum() == pytest.approx(got)


def greedy(word, initial, continuing):
    at, n = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        k = max((k for k in range(1, len(word) - at + 1) if word[at:at + k] in pieces), default=0)
        if not k:
            return 1
        at, n = at + k, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=4), max_size=8), st.sets(st.text("ab", min_size=1, max_size=4), max_size=8),
       st.text("abc", max_size=12))
def test_automaton_against_greedy(initial, continuing, word):
    a, b = ({w.encode() for w in s} for s in (initial, continuing))
    assert PieceAutomaton(a, b).length(word.encode()) == greedy(word.encode(), a, b)
    assert PieceAutomaton(a).length(word.encode()) == greedy(word.encode(), a, a)


def test_piece_counts(spark):
    rows = awkward_rows() + [(None, "null id", "s")]
    vocabulary = set(byte_vocabulary(PATH))
    got = by_id(token_counts(frame(spark, rows), PATH))
    for d, t, _ in rows:
        words = regex.findall(public_tokenizers.PATTERN, t or "")
        short = {w: greedy(w.encode(), vocabulary, vocabulary) for w in set(words) if len(w) < 400}
        assert got[d]["n_words"] == len(words)
        assert got[d]["n_pieces"] == sum(short[w] for w in words)
    assert token_counts(frame(spark, []), PATH).collect() == []
