"""Splits, folds, samples and row indices (SP1-SP8, P4, P11, P12).

Every assignment is a pure function of the row key and a seed (an md5 of both), so it does
not change when Spark re-partitions, retries a task or replays a lost executor.  Global ranks
never go through an unpartitioned window (one task at scale): the md5 hex prefix is an
order-preserving bucket, so ``rank = rows in earlier buckets + rank inside the bucket``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def hash_key(cols: Sequence[str], seed: int | str = 42) -> Column:
    """``md5(seed|c1|c2...)`` as lowercase hex; the same text in DuckDB for integer keys."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def bucketed_row_number(df: DataFrame, partition_cols: Sequence[str], bucket_cols: Sequence[str],
                        bucket_order: Sequence[Column], order: Sequence[Column], out: str) -> DataFrame:
    """Exact ``row_number() over (partition by P order by O)`` without a per-P hot task.

    ``bucket_cols`` must be an order-preserving coarsening of ``order`` inside ``P`` (ordering
    by ``bucket_order`` first and ``order`` second equals ordering by ``order``).  The offset
    table holds one row per ``(P, bucket)`` and is small by construction.
    """
    counts = df.groupBy(*partition_cols, *bucket_cols).agg(F.count(F.lit(1)).alias("_bucket_n"))
    before = Window.partitionBy(*partition_cols).orderBy(*bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*partition_cols, *bucket_cols,
                            F.coalesce(F.sum("_bucket_n").over(before), F.lit(0)).alias("_bucket_off"))
    inside = Window.partitionBy(*partition_cols, *bucket_cols).orderBy(*order)
    return (null_safe_join(df, offsets, [*partition_cols, *bucket_cols])
              .withColumn(out, F.col("_bucket_off") + F.row_number().over(inside))
              .drop("_bucket_off"))


def null_safe_join(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a null key matches a null key, so rows without a stratum or group stay."""
    right = table.withColumnsRenamed({c: f"_ns_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_ns_{c}"))
    return df.join(right, same).drop(*[f"_ns_{c}" for c in keys])


def bucket_digits(df: DataFrame) -> int:
    """Hex digits of the rank buckets: about 16 buckets per shuffle partition, so they grow with the
    cluster the job is sized for.  Ranks do not depend on it."""
    n = 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, len(format(n, "x")))


def stratified_kfold(df: DataFrame, key_cols: Sequence[str], strat_col: str | None, k: int = 5,
                     seed: int = 42, fold_col: str = "fold", salt_digits: int | None = None) -> DataFrame:
    """Stratified k-fold (SP3): inside each stratum rows are ranked by ``md5(seed|key)`` and
    dealt round-robin, so every fold gets ``n/k`` rows of each stratum (±1).  ``strat_col=None``
    gives plain shuffled k-fold with exact balance (SP2).  Rows without a stratum form one."""
    part = [strat_col] if strat_col else []
    salt_digits = salt_digits or bucket_digits(df)
    h = df.withColumn("_hk", hash_key(key_cols, seed)).withColumn("_hb", F.substring("_hk", 1, salt_digits))
    order = [F.col("_hk")] + [F.col(c) for c in key_cols]
    ranked = bucketed_row_number(h, part, ["_hb"], [F.col("_hb")], order, "_rn")
    return ranked.withColumn(fold_col, ((F.col("_rn") - 1) % k).cast("int")).drop("_hk", "_hb", "_rn")


def kfold(df: DataFrame, key_cols: Sequence[str], k: int = 5, seed: int = 42, fold_col: str = "fold",
          mode: str = "exact") -> DataFrame:
    """Shuffled k-fold (SP2).  ``exact``: sizes differ by at most one; ``hash``: one map-side
    expression, no shuffle, sizes balanced in expectation."""
    if mode == "hash":
        return df.withColumn(fold_col, F.pmod(F.xxhash64(F.lit(seed), *key_cols), F.lit(k)).cast("int"))
    return stratified_kfold(df, key_cols, None, k, seed, fold_col)


def binned_stratum(col: str, width: float, out: str = "stratum") -> Column:
    """Stratum from a binned continuous target, ``floor(y / width)`` (SP6)."""
    return F.floor(F.col(col) / F.lit(width)).cast("long").alias(out)


def _offsets_by_size(sizes: DataFrame) -> DataFrame:
    """``(_gsize, _hb, _off)``: groups ranked before a bucket when sizes fall and hash buckets rise.

    Prefix sums on three levels, so no task orders all sizes: bands of near sizes (64 for each power of
    two, at most some 4,000 whatever the data), sizes inside a band, hash buckets inside a size.
    """
    counts = sizes.groupBy("_gsize", "_hb").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_band", F.floor(F.log2("_gsize") * 64))
    per_size = counts.groupBy("_band", "_gsize").agg(F.sum("_n").alias("_n"))
    bands = per_size.groupBy("_band").agg(F.sum("_n").alias("_n")).agg(
        F.sort_array(F.collect_list(F.struct("_band", "_n")), asc=False).alias("_all"))
    band_off = bands.select(F.explode(F.transform("_all", lambda x, i: F.struct(
        x["_band"].alias("_band"), F.aggregate(F.slice("_all", F.lit(1), i), F.lit(0).cast("long"),
                                               lambda acc, y: acc + y["_n"]).alias("_band_off")))).alias("_x")).select("_x.*")
    before = lambda part, order: F.coalesce(F.sum("_n").over(Window.partitionBy(part).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    size_off = per_size.select("_band", "_gsize", before("_band", F.col("_gsize").desc()).alias("_size_off")).join(
        band_off, "_band").select("_gsize", (F.col("_band_off") + F.col("_size_off")).alias("_size_off"))
    inside = counts.select("_gsize", "_hb", before("_gsize", F.col("_hb")).alias("_hb_off"))
    return inside.join(size_off, "_gsize").select("_gsize", "_hb", (F.col("_size_off") + F.col("_hb_off")).alias("_off"))


def group_kfold(df: DataFrame, group_col: str, k: int = 5, fold_col: str = "fold", seed: int = 42,
                salt_digits: int | None = None) -> DataFrame:
    """Group k-fold (SP4): a group never spans two folds.  Groups are ranked by size (desc, ties
    by ``md5``) and dealt in snake order ``0..k-1, k-1..0, ...`` so fold sizes stay close.  Rows
    without a group are one group."""
    salt_digits = salt_digits or bucket_digits(df)
    sizes = cut_lineage(df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_gsize"))
                          .withColumn("_hk", hash_key([group_col], seed))
                          .withColumn("_hb", F.substring("_hk", 1, salt_digits)))
    inside = Window.partitionBy("_gsize", "_hb").orderBy("_hk", group_col)
    ranked = sizes.join(_offsets_by_size(sizes), ["_gsize", "_hb"]).withColumn(
        "_rn", F.col("_off") + F.row_number().over(inside))
    r = F.col("_rn") - 1
    snake = F.when((F.floor(r / k) % 2) == 0, r % k).otherwise(k - 1 - r % k)
    folds = ranked.select(group_col, snake.cast("int").alias(fold_col))
    return null_safe_join(df, folds, [group_col])


def holdout(df: DataFrame, key_cols: Sequence[str], frac: float = 0.2, seed: int = 42,
            out: str = "is_valid") -> DataFrame:
    """Random hold-out (SP1): a row is held out when its md5 falls below ``frac``; no shuffle."""
    threshold = format(int(round(frac * 16 ** 8)), "08x")
    return df.withColumn(out, F.substring(hash_key(key_cols, seed), 1, 8) < F.lit(threshold))


def sample_n(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows chosen by smallest ``md5(seed|key)`` (SP7); a top-n, so Spark keeps n rows per task."""
    return (df.withColumn("_hk", hash_key(key_cols, seed))
              .orderBy("_hk", *key_cols).limit(n).drop("_hk"))


def iter_folds(df: DataFrame, fold_col: str, k: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Train/validation frames per fold (SP5): ``fold != i`` / ``fold == i`` on one frame."""
    for i in range(k):
        yield i, df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)


def row_index(df: DataFrame, order_cols: Sequence[str], out: str = "row_nr", n_partitions: int | None = None,
              start: int = 0) -> DataFrame:
    """Dense row number in ``order_cols`` order (P11), kept if ``out`` already exists.

    Range-partition and sort once, cut the lineage so both passes see the same partitions,
    then add per-partition offsets (one row per partition, so the offset table is bounded).
    """
    if out in df.columns:
        return df
    n = n_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                   .withColumn("_pid", F.spark_partition_id())
                   .withColumn("_mid", F.monotonically_increasing_id()))
    sorted_df = cut_lineage(sorted_df)
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pn"), F.min("_mid").alias("_p0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_p0", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_poff"))
    return (sorted_df.join(F.broadcast(offsets), "_pid")
              .withColumn(out, F.col("_poff") + F.col("_mid") - F.col("_p0") + F.lit(start))
              .drop("_pid", "_mid", "_p0", "_poff"))


def dense_index(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Sorted distinct values of ``col`` with a dense 0-based index (P12); join it either way."""
    out = out or f"{col}_idx"
    return row_index(df.select(col).distinct(), [col], out=out)
