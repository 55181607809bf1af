"""Sharding by fixed virtual slots (native: DataFrame functions only).

Records are hashed into a fixed number of virtual slots.  Bytes are aggregated per slot, and a
versioned slot-to-shard map says which shard holds a slot.  Rebalancing *edits* the map: slots
move from the heaviest to the lightest shard, or two slots trade places, until no move narrows the
gap.  Growing adds a shard and moves slots only into it.  The map has one entry per slot whatever
the data, so it is the only thing the driver holds.

Defined cases: a null text has no bytes (size 1) and crc32 0; a null id is hashed like any value;
fully equal rows share a slot and get different positions; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, shared_path, staged

N_SLOTS = 4096
# Rows that one window task numbers; slots with more are split into sub-ranges of their hash.
ROWS_PER_CELL = 50_000


@dataclass
class SlotMap:
    """``shards[slot]`` is the shard of a slot; each edit makes a new version."""

    n_shards: int
    shards: list[int]
    version: int = 0
    moved: int = field(default=0, compare=False)

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        return cls(n_shards, [s % n_shards for s in range(n_slots)])

    def sizes(self, load: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += load[slot]
        return out

    def rebalanced(self, load: list[int]) -> SlotMap:
        """Edited map: moves and trades between the heaviest and the lightest shard."""
        shards, sizes = list(self.shards), self.sizes(load)
        held = [sorted((load[s], s) for s in range(len(shards)) if shards[s] == k) for k in range(self.n_shards)]
        for _ in range(4 * len(shards)):
            hi, lo = max(range(self.n_shards), key=sizes.__getitem__), min(range(self.n_shards), key=sizes.__getitem__)
            gap = sizes[hi] - sizes[lo]
            give = _best_trade(held[hi], held[lo], gap)
            if give is None:
                break
            for (weight, slot), src, dst in zip(give, (hi, lo), (lo, hi)):
                if slot >= 0:
                    held[src].remove((weight, slot))
                    held[dst].insert(bisect_left(held[dst], (weight, slot)), (weight, slot))
                    shards[slot] = dst
                    sizes[src] -= weight
                    sizes[dst] += weight
        moved = sum(a != b for a, b in zip(shards, self.shards))
        return SlotMap(self.n_shards, shards, self.version + 1, moved)

    def grown(self, load: list[int]) -> SlotMap:
        """One more shard, filled from the heaviest ones up to the new mean; nothing else moves."""
        shards, sizes, new = list(self.shards), self.sizes(load), self.n_shards
        held = [sorted((load[s], s) for s in range(len(shards)) if shards[s] == k) for k in range(new)]
        target, filled = sum(sizes) / (new + 1), 0
        while filled < target and any(held):
            src = max((k for k in range(new) if held[k]), key=sizes.__getitem__)
            fit = bisect_left(held[src], (target - filled, len(shards)))
            if not fit:
                break
            weight, slot = held[src].pop(fit - 1)
            shards[slot] = new
            sizes[src] -= weight
            filled += weight
        moved = sum(a != b for a, b in zip(shards, self.shards))
        return SlotMap(new + 1, shards, self.version + 1, moved)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(len(self.shards)).select(
            F.col("id").cast("int").alias("virtual_slot"), _entry(self.shards, F.col("id")).alias("shard"),
            F.lit(self.version).alias("map_version"), F.lit(self.n_shards).alias("n_shards"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's table (one folder per version, older ones stay)."""
        self.frame(spark).drop("map_version").coalesce(1).write.mode("errorifexists").parquet(
            f"{path}/map_version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        t = spark.read.parquet(path)
        last = t.agg(F.max("map_version")).first()[0] if version is None else version
        rows = t.where(F.col("map_version") == last).orderBy("virtual_slot").collect()
        return cls(rows[0]["n_shards"], [r["shard"] for r in rows], last)


def _best_trade(heavy: list, light: list, gap: int):
    """What narrows ``gap`` most: a slot of ``heavy``, for nothing or for a lighter slot of ``light``."""
    best, best_left = None, gap
    for give in heavy:
        if give[0] <= 0:
            continue
        for back in _near(light, give[0] - gap / 2):
            step = give[0] - back[0]
            if 0 < step < gap and abs(gap - 2 * step) < best_left:
                best, best_left = (give, back), abs(gap - 2 * step)
        if best_left == 0:
            break
    return best


def _near(light: list, want: float) -> list:
    if want <= 0:
        return [(0, -1)]
    i = bisect_left(light, (want, -1))
    return [*light[max(0, i - 1):i + 1], (0, -1)]


def _entry(values: list[int], index):
    """``values[index]``; the list is one folded literal, not a join."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), (index + 1).cast("int"))


def sized_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  n_slots: int = N_SLOTS) -> DataFrame:
    """Per row: id, size (UTF-8 bytes plus 1), crc32, virtual slot and hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return narrow(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("hash"),
    ).withColumn("virtual_slot", F.pmod("hash", F.lit(n_slots)).cast("int"))


def slot_loads(records: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: one aggregation with ``n_slots`` rows at most."""
    load, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        load[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return load, rows


def in_cells(records: DataFrame, rows: list[int]) -> DataFrame:
    """``records`` (read from files) with ``cell``: slots of many rows are dealt to cells by a row's place in its
    file, which is its own among equal rows too."""
    split = [max(1, -(-n // ROWS_PER_CELL)) for n in rows]
    own = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    return records.withColumn("cell", F.pmod(own, _entry(split, F.col("virtual_slot"))).cast("int"))


def place(records: DataFrame, slot_map: SlotMap, rows: list[int]) -> DataFrame:
    """Shard and gapless position in it per record.

    Positions are numbered inside cells and shifted by the rows of the cells before, so no task numbers a
    whole shard, nor all of many equal rows.
    """
    n_slots = len(slot_map.shards)
    cells = in_cells(records, rows)
    base, at = [0] * n_slots, [0] * slot_map.n_shards
    for slot, shard in enumerate(slot_map.shards):
        base[slot] = at[shard]
        at[shard] += rows[slot]
    numbered = cells.withColumn("rn", F.row_number().over(
        Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "hash")) - 1)
    if max(rows) > ROWS_PER_CELL:
        counts = cells.groupBy("virtual_slot", "cell").agg(F.count("*").alias("n"))
        before = counts.select("virtual_slot", "cell", (F.sum("n").over(
            Window.partitionBy("virtual_slot").orderBy("cell")) - F.col("n")).alias("before"))
        numbered = numbered.join(before, ["virtual_slot", "cell"])
    else:
        numbered = numbered.withColumn("before", F.lit(0))
    base_col = F.element_at(F.split(F.lit(",".join(map(str, base))), ",").cast("array<bigint>"),
                            F.col("virtual_slot") + 1)
    return numbered.select(
        "doc_id", "size", "text_crc32", "virtual_slot",
        _entry(slot_map.shards, F.col("virtual_slot")).alias("shard"),
        (base_col + F.col("before") + F.col("rn")).cast("long").alias("slot"))


def shard_by_slots(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, id_col: str = "doc_id",
                   text_col: str = "text", map_path: str | None = None) -> tuple[DataFrame, SlotMap, str]:
    """Shards of near equal bytes; returns the placed records, the map, and where its versions lie.

    With ``map_path`` naming a stored map, its last version is rebalanced to these data and stored as
    the next one; otherwise version 0 deals the slots in turn.
    """
    spark = docs.sparkSession
    records = staged(sized_records(docs, id_col, text_col, n_slots), "sized_records")
    load, rows = slot_loads(records, n_slots)
    if map_path is None:
        map_path, first = shared_path(spark, "slot_map"), SlotMap.initial(n_shards, n_slots)
        first.save(spark, map_path)
    else:
        first = SlotMap.load(spark, map_path)
    slot_map = first.rebalanced(load)
    slot_map.save(spark, map_path)
    return place(records, slot_map, rows), slot_map, map_path
