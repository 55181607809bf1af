import hashlib
import zlib

import pytest

from ratingkit.llm import digest_index, sharding

from .helpers import awkward_rows, by_id, frame


def _expect(rows):
    groups = {}
    for d, t, _ in rows:
        text = t or ""
        norm = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(text), d))
    return {d: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, d in g}


def test_digests_against_brute_force(spark):
    rows = awkward_rows()
    index = digest_index.DigestIndex.create(spark, len(rows))
    got = by_id(index.add(frame(spark, rows)))
    want = _expect(rows)
    assert {d: (r["keep_id"], r["group_size"], r["digest"].hex()) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["keep_id"]) for d, r in got.items())


def test_second_batch_meets_the_index(spark):
    rows = awkward_rows()
    index = digest_index.DigestIndex.create(spark, 10)
    index.add(frame(spark, rows[:30])).collect()
    again = digest_index.DigestIndex.open(spark, index.path, index.n_buckets)
    got = by_id(again.add(frame(spark, [(d + 1000, t, s) for d, t, s in rows])))
    old = _expect(rows[:30])
    texts = {v[2]: v[0] for v in old.values()}
    for r in got.values():
        known = texts.get(r["digest"].hex())
        assert (r["keep_id"] == known and not r["kept"]) if known is not None else r["keep_id"] >= 1000
    assert again.rows().count() == again.rows().select("digest").distinct().count()


def test_hot_digest_null_id_and_empty_table(spark):
    rows = [(k, "same text", "s") for k in range(3000)] + [(5000, "other", "s"), (None, "lost", "s"), (None, "lost", "s")]
    index = digest_index.DigestIndex.create(spark, len(rows))
    got = index.add(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got if r["doc_id"] is not None) == 2
    assert {r["keep_id"] for r in got if r["doc_id"] is not None and r["group_size"] == 3000} == {0}
    empty = digest_index.DigestIndex.create(spark, 0)
    assert empty.add(frame(spark, [])).collect() == []


def test_anti_join_reads_the_index_without_a_shuffle(spark):
    index = digest_index.DigestIndex.create(spark, 10)
    docs = frame(spark, awkward_rows())
    index.add(docs).collect()
    plan = index.fresh(digest_index.representatives(digest_index.digests(docs)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan


@pytest.mark.parametrize("n_shards", [1, 3, 16])
def test_shards(spark, n_shards):
    rows = awkward_rows() + [(7, "dup", "s"), (7, "dup", "s"), (None, "null id", "s")]
    placed, slot_map, path = sharding.shard_by_slots(frame(spark, rows), n_shards)
    got = placed.collect()
    assert len(got) == len(rows)
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for s in range(n_shards):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    first, last = sharding.SlotMap.load(spark, path, 0), sharding.SlotMap.load(spark, path)
    assert (first.version, last.version) == (0, 1) and last.shards == slot_map.shards


def test_rebalance_and_growth():
    load = [(k * 7919) % 1000 + (20_000 if k == 5 else 0) for k in range(4096)]
    balanced = sharding.SlotMap.initial(16).rebalanced(load)
    sizes = balanced.sizes(load)
    assert sum(sizes) == sum(load) and max(sizes) - min(sizes) <= 2
    grown = balanced.grown(load)
    assert all(a == b or b == 16 for a, b in zip(balanced.shards, grown.shards))
    assert abs(grown.sizes(load)[16] - sum(load) / 17) < 1500


def test_cells_split_hot_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 5)
    rows = [(k, f"t{k}", "s") for k in range(400)]
    placed, _, _ = sharding.shard_by_slots(frame(spark, rows), 2, n_slots=8)
    got = placed.collect()
    for s in range(2):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))


def test_cells_split_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 40)
    rows = [(1, "same", "s")] * 600 + [(None, None, "s")] * 200 + [(k, f"t{k}", "s") for k in range(2, 200)]
    docs = frame(spark, rows).repartition(4)
    got = sharding.shard_by_slots(docs, 2, n_slots=8)[0].collect()
    assert len(got) == len(rows)
    for s in range(2):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    records = sharding.staged(sharding.sized_records(docs, n_slots=8), "records")
    cells = sharding.in_cells(records, sharding.slot_loads(records, 8)[1]).groupBy("virtual_slot", "cell").count()
    assert max(r["count"] for r in cells.collect()) < 80


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_by_slots(frame(spark, []), 4)[0].collect() == []


def test_one_row_of_repeated_ones_is_kept(spark):
    """An id's rows differ in length, and the longest stands twice: one row of the digest stays."""
    rows = [(1, "a b", "s"), (1, "a b", "s"), (1, "ab", "s"), (2, "ab", "s"), (None, "c", "s"), (None, "c", "s")]
    index = digest_index.DigestIndex.create(spark, len(rows))
    got = index.add(frame(spark, rows)).collect()
    kept = [(r["doc_id"], r["n_points"]) for r in got if r["kept"]]
    assert sorted(kept, key=str) == [(1, 3), (None, 1)] and {r["keep_id"] for r in got} == {1, None}
    again = index.add(frame(spark, rows)).collect()
    assert not any(r["kept"] for r in again)
