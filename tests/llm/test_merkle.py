import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ratingkit.llm import merkle

from .helpers import CLASH, awkward_rows, frame


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    """All levels of a tree, bottom first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[k:k + 8]) for k in range(0, len(below), 8)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        lo = at - at % 8
        out.append(("".join(nodes[lo:at]), "".join(nodes[at + 1:lo + 8])))
        at //= 8
    return out


def brute_force(rows):
    """Per row (as a multiset): id, leaf, subroot, root, proof, root folded from the changed leaf."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, ranked = {}, {}
    for g in order:
        ranked[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = up([leaf(r) for r in ranked[g]])
    top = up([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for k, r in enumerate(ranked[g]):
            steps = path(trees[g], k) + path(top, n)
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            h = leaf(changed)
            for left, right in steps:
                h = H(left, h, right)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*(s for st in steps for s in st)), h))
    return sorted(out, key=str)


def result(docs):
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tree = merkle.manifest(docs, carry={"changed": F.when(hit, merkle.tampered_leaf(docs))})
    cols = tree.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"),
                       merkle.fold(F.coalesce("changed", "leaf"), F.col("path")).alias("f"))
    return sorted((tuple(r) for r in cols.collect()), key=str)


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.repartition(3).withColumns({c: F.lit("clash") for c in (*CLASH, "g", "h", "hash", "rank", "block", "path")})


def sized(lang, n, start=0):
    return [(start + k, f"s{k % 3}", lang, k, f"Text {k} of {lang}") for k in range(n)]


@pytest.mark.parametrize("name", ["awkward", "heights", "lone", "many groups"])
def test_equal_to_brute_force(spark, name):
    if name == "awkward":
        rows = [(d, s, (None, "", "é", "de", "zz")[k % 5], len(t or ""), t)
                for k, (d, t, s) in enumerate(awkward_rows())]
        rows += [(7, None, "de", None, None)] * 3 + [(None, None, None, None, None), (None, "s", None, 1, "A")]
    elif name == "heights":                     # two passes and more; runs of 1; full and ragged blocks
        rows = sized("a", 1) + sized("b", 8, 10) + sized("c", 9, 30) + sized("d", 513, 100) + sized(None, 512, 2000)
    elif name == "lone":
        rows = sized(None, 1)
    else:
        rows = [(k, "s", f"l{k % 70}", k, "T") for k in range(150)]
    assert result(table(spark, rows)) == brute_force(rows)


def test_rank_order_is_spread_and_gapless(spark):
    rows = sized("a", 300) + [(5, "s", "a", 1, "same")] * 200
    docs = table(spark, rows).select(F.col("lang").alias("g"), "doc_id")
    got = merkle.numbered(docs, ["doc_id"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(500)) and {r["n"] for r in got} == {500}
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])]
    assert ids == sorted(ids)


def test_a_change_anywhere_is_seen_and_empty_table(spark):
    docs = table(spark, sized("a", 70) + sized("b", 3, 100))
    tree = merkle.manifest(docs)
    bad = tree.select(merkle.fold(F.sha2("leaf", 256), F.col("path")).alias("f"),
                      merkle.fold(F.col("leaf"), F.col("path")).alias("ok"), "root").collect()
    assert all(r["f"] != r["root"] and r["ok"] == r["root"] for r in bad) and len(bad) == 73
    assert merkle.manifest(docs.where(F.lit(False))).collect() == []
