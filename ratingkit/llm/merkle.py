"""Merkle manifest of a table: a digest tree per group, a tree over the groups, proofs by nested rollup.

Every row is a leaf.  Leaves of a group ascend by id; ``FAN_OUT`` consecutive nodes become one, until
one is left (the subroot), and the subroots, by group, likewise give the root.  A leaf's rank is written
in digits base ``FAN_OUT``.  Inside a block of ``FAN_OUT ** LEVELS`` leaves the digit columns are grouped
away one after the other, each time nesting the children's structs; the block needs one exchange for all
its levels.  Block tops are the leaves of the next, so much smaller, pass.  On the way down a transform
walks the nested structs and an explode emits every node with its path: no join of leaves with nodes.
A block meets its own path by union and grouping, at one row a block.

A path is an array of ``(left, right)``: the digests of the siblings before and after the node, from the
leaf's level to the root's.  ``fold`` recomputes the root from any leaf and its path.

Digest ``H``: lowercase hex sha256 of its inputs joined, digests as hex text.

Defined cases: a null field enters its leaf as ``-``; null groups form one group, the first; null ids
come first in their group; rows of one id are ordered by their leaf, and equal rows are leaves of
their own; a lone leaf is its subroot, a lone subroot the root; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, staged

FAN_OUT_BITS = 3
FAN_OUT = 1 << FAN_OUT_BITS
# Levels that one pass nests: a block row holds at most FAN_OUT ** LEVELS leaves.
LEVELS = 3
# Rows that one task of the ranking sorts.
ROWS_PER_TASK = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*(encoded(f) for f in fields))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` of each row in its group ``g`` (gapless from 0) and ``n``, the rows of the group.

    One range exchange by group and order, so a group that holds most rows spreads over many tasks; the
    ranks before a task come from a table of one row per task and group.
    """
    tasks = max(partitions(nodes.sparkSession), -(-nodes.count() // ROWS_PER_TASK))
    keys = [F.col("g").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    placed = staged(nodes.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
                    .withColumn("at", F.monotonically_increasing_id())
                    .withColumn("task", F.shiftright("at", 33).cast("int")), "merkle_order")
    runs = placed.groupBy("task", "g").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    group = Window.partitionBy("g")
    before = F.sum("m").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("task").alias("run_task"), F.col("g").alias("run_g"), F.sum("m").over(group).alias("n"),
                       (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    joined = placed.join(runs, (F.col("task") == F.col("run_task")) & F.col("g").eqNullSafe(F.col("run_g")))
    return joined.select(*nodes.columns, (F.col("at") + F.col("shift")).alias("rank"), "n")


def height(n: Column) -> Column:
    """Levels above ``n`` leaves; exact for any long."""
    levels = F.lit(0)
    for k in range(21):
        levels = levels + (n > F.lit(FAN_OUT ** k)).cast("int")
    return levels


def _nested(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per block ``(g, block, h, hash, kids)``; ``kids`` nests ``LEVELS`` levels of structs."""
    digits = [f"d{k}" for k in range(LEVELS)]
    digit = {d: F.shiftright("rank", FAN_OUT_BITS * k).bitwiseAND(FAN_OUT - 1).cast("int")
             for k, d in enumerate(digits)}
    rows = nodes.select("g", F.shiftright("rank", FAN_OUT_BITS * LEVELS).alias("block"), "h",
                        *(c.alias(d) for d, c in digit.items()), "hash",
                        F.struct(*payload).alias("kids")).repartition("g", "block")
    for k, d in enumerate(digits):
        rows = rows.groupBy("g", "block", "h", *digits[k + 1:]).agg(
            F.sort_array(F.collect_list(F.struct(d, "hash", "kids"))).alias("kids"))
        own = F.col("kids")["hash"]
        rows = rows.withColumn("hash", F.when(F.col("h") > k, F.sha2(F.concat_ws("", own), 256)).otherwise(own[0]))
    return rows


def _walk(kids: Column, path: Column, level: int) -> Column:
    """All bottom nodes below ``kids``: rank in the block, payload and path."""
    hashes = kids["hash"]

    def step(i: Column) -> Column:
        beside = F.struct(F.concat_ws("", F.slice(hashes, F.lit(1), i)).alias("left"),
                          F.concat_ws("", F.slice(hashes, i + 2, F.lit(FAN_OUT))).alias("right"))
        return F.concat(F.when(F.col("h") > level, F.array(beside)).otherwise(F.array().cast(_PATH)), path)
    if level == 0:
        return F.transform(kids, lambda x, i: F.struct(
            x["d0"].alias("digit"), x["hash"].alias("hash"), x["kids"].alias("payload"), step(i).alias("path")))
    return F.flatten(F.transform(kids, lambda x, i: F.transform(
        _walk(x["kids"], step(i), level - 1), lambda y: F.struct(
            (x[f"d{level}"] * FAN_OUT ** level + y["digit"]).alias("digit"), y["hash"].alias("hash"),
            y["payload"].alias("payload"), y["path"].alias("path")))))


def climb(nodes: DataFrame, payload: list[str], top_n: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(g, rank, hash, payload, path, subroot, root)`` per node ``(g, rank, h, hash, *payload)``.

    ``top_n`` is the largest group.  ``crown`` takes the one node left of each group, ``(g, hash)``, and
    returns ``(g, path, subroot, root)``.
    """
    blocks = staged(_nested(nodes, payload), "merkle_blocks")
    top_blocks = -(-top_n // FAN_OUT ** LEVELS)
    if top_blocks <= 1:
        above = crown(blocks.select("g", "hash")).select("g", F.lit(0).cast("bigint").alias("block"),
                                                         "path", "subroot", "root")
    else:
        upper = blocks.select("g", F.col("block").alias("rank"), F.greatest(F.col("h") - LEVELS, F.lit(0)).alias("h"),
                              "hash")
        above = climb(upper.withColumn("none", F.lit(None).cast("int")), ["none"], top_blocks, crown).select(
            "g", F.col("rank").alias("block"), "path", "subroot", "root")
    kids = blocks.schema["kids"].dataType
    both = blocks.select("g", "block", "h", "kids", F.lit(None).cast(_PATH).alias("path"),
                         *(F.lit(None).cast("string").alias(c) for c in ("subroot", "root"))).unionByName(
        above.select("g", "block", F.lit(None).cast("int").alias("h"), F.lit(None).cast(kids).alias("kids"),
                     "path", "subroot", "root"))
    met = both.groupBy("g", "block").agg(*(F.first(c, ignorenulls=True).alias(c)
                                           for c in ("h", "kids", "path", "subroot", "root")))
    out = met.select("g", "block", "subroot", "root", F.explode(_walk(F.col("kids"), F.col("path"), LEVELS - 1)).alias("x"))
    return out.select("g", (F.shiftleft("block", FAN_OUT_BITS * LEVELS) + F.col("x.digit")).alias("rank"), "x.hash",
                      "x.payload", "x.path", "subroot", "root")


def _crown_groups(tops: DataFrame) -> DataFrame:
    """The tree over the subroots: one more climb, all groups being one."""
    subs = tops.select(F.lit(0).alias("g"), F.col("g").alias("key"), "hash")
    ranked = staged(numbered(subs, ["key"]), "merkle_subroots")
    ranked = ranked.withColumn("h", height(F.col("n")))
    whole = climb(ranked, ["key"], ranked.count(), lambda last: last.select(
        "g", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root")))
    return whole.select(F.col("payload.key").alias("g"), "path", F.col("hash").alias("subroot"), "root")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``doc_id, lang, leaf, subroot, root, path`` and what ``carry`` computes from the row.

    Texts go no further than the first scan; what is shuffled are ids, digests and ``carry``.
    """
    carry = carry or {}
    names = [f"c{k}" for k in range(len(carry))]
    leaves = staged(docs.select(
        docs[group_col].alias("g"), docs[id_col].alias("id"), leaf_digest([docs[f] for f in fields]).alias("hash"),
        F.monotonically_increasing_id().alias("row"), *(c.alias(n) for n, c in zip(names, carry.values()))),
        "merkle_leaves")
    ranked = staged(numbered(leaves, ["id", "hash", "row"]).withColumn("h", height(F.col("n"))), "merkle_ranks")
    top_n = ranked.agg(F.max("n")).first()[0] or 0
    tree = climb(ranked, ["id", *names], top_n, _crown_groups)
    return tree.select(F.col("payload.id").alias("doc_id"), F.col("g").alias("lang"), F.col("hash").alias("leaf"),
                       "subroot", "root", "path", *(F.col(f"payload.{n}").alias(c) for n, c in zip(names, carry)))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_leaf(docs: DataFrame, fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> Column:
    """Leaf of the row with its text's A-Z lower-cased."""
    return leaf_digest([F.translate(docs[f], _UPPER, _LOWER) if f == text_col else docs[f] for f in fields])
