import hashlib
import random
import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ratingkit.operators import folds


def _frame(spark, n=500):
    return spark.createDataFrame([(i % 37, i, (i * 7) % 10 + 1) for i in range(n)], "user_id long, item_id long, score int")


def test_bucketed_row_number_equals_window(spark):
    df = _frame(spark).withColumn("_hk", folds.hash_key(["user_id", "item_id"], 1))
    exact = df.withColumn("rn", F.row_number().over(Window.partitionBy("score").orderBy("_hk", "item_id")))
    bucketed = folds.bucketed_row_number(df.withColumn("_hb", F.substring("_hk", 1, 2)), ["score"], ["_hb"],
                                         [F.col("_hb")], [F.col("_hk"), F.col("item_id")], "rn")
    a = exact.select("item_id", "rn").toPandas().sort_values("item_id").reset_index(drop=True)
    b = bucketed.select("item_id", "rn").toPandas().sort_values("item_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_stratified_folds_partition_and_balance(spark):
    out = folds.stratified_kfold(_frame(spark), ["user_id", "item_id"], "score", k=5).toPandas()
    assert len(out) == 500 and out.item_id.is_unique
    counts = out.groupby(["score", "fold"]).size().unstack()
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 1


def test_stratified_folds_stable_under_repartition(spark):
    df = _frame(spark)
    a = folds.stratified_kfold(df, ["user_id", "item_id"], "score").toPandas().sort_values("item_id")
    b = folds.stratified_kfold(df.repartition(7), ["user_id", "item_id"], "score").toPandas().sort_values("item_id")
    assert list(a.fold) == list(b.fold)


def test_group_kfold_no_group_in_two_folds(spark):
    out = folds.group_kfold(_frame(spark), "user_id", k=5).toPandas()
    assert (out.groupby("user_id").fold.nunique() == 1).all()
    sizes = out.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 14          # at most one group size apart


def test_group_kfold_deals_the_global_order(spark):
    rng = random.Random(2)
    sizes = [1] * 60 + [2] * 40 + [rng.randint(3, 400) for _ in range(60)] + [900, 901, 902, 903]   # near sizes share a band
    groups = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "g long, n int")
    df = groups.selectExpr("g", "explode(sequence(1, n)) AS i")
    got = {r.g: r.fold for r in folds.group_kfold(df, "g", 5).select("g", "fold").distinct().collect()}
    key = lambda g: hashlib.md5(f"42|{g}".encode()).hexdigest()
    order = sorted(range(len(sizes)), key=lambda g: (-sizes[g], key(g), g))
    assert got == {g: r % 5 if r // 5 % 2 == 0 else 4 - r % 5 for r, g in enumerate(order)}
    plan = folds.group_kfold(df, "g", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(" in plan
    assert not re.search(r"windowspecdefinition\(\S+ (ASC|DESC)", plan)      # every window has a partition
    assert folds.group_kfold(df.limit(0), "g", 5).collect() == []


def test_row_index_dense_in_order(spark):
    out = folds.row_index(_frame(spark).repartition(5), ["item_id"]).toPandas().sort_values("item_id")
    assert list(out.row_nr) == list(range(500))
    again = folds.row_index(_frame(spark).withColumn("row_nr", F.lit(1)), ["item_id"])
    assert again.select(F.max("row_nr")).first()[0] == 1      # kept when present


def test_holdout_and_sample(spark):
    df = _frame(spark, 4000)
    frac = folds.holdout(df, ["item_id"], 0.2).where("is_valid").count() / 4000
    assert 0.17 < frac < 0.23
    s1 = {r.item_id for r in folds.sample_n(df, 10, ["item_id"]).collect()}
    s2 = {r.item_id for r in folds.sample_n(df.repartition(3), 10, ["item_id"]).collect()}
    assert s1 == s2 and len(s1) == 10


def test_iter_folds(spark):
    df = folds.kfold(_frame(spark), ["item_id"], k=3, mode="hash")
    for i, tr, va in folds.iter_folds(df, "fold", 3):
        assert tr.count() + va.count() == 500
        assert va.where(F.col("fold") != i).count() == 0


def test_rows_without_stratum_or_group_stay(spark):
    from ratingkit.operators import folds
    rows = [(k, k % 3 if k % 4 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, s int")
    got = folds.stratified_kfold(df, ["id"], "s", 5)
    assert got.count() == 40
    assert {r["count"] for r in got.where("s is null").groupBy("fold").count().collect()} == {2}
    grouped = folds.group_kfold(df, "s", 2)
    assert grouped.count() == 40 and grouped.where("s is null").select("fold").distinct().count() == 1
    assert folds.stratified_kfold(df, ["id"], "s", 5, salt_digits=1).exceptAll(got).count() == 0
