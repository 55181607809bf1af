import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratingkit.operators import folds, stats


@pytest.fixture
def ratings(spark):
    rows = [(1, 10, 5), (1, 11, 7), (1, 12, 9), (1, 13, 4), (1, 14, 6),   # user 1: 5 ratings
            (2, 10, 3), (2, 11, 1),                                       # user 2: below min_count
            (3, 10, 8), (3, 12, 8), (3, 13, 2), (3, 14, 10), (3, 15, 9), (3, 16, 1)]
    return spark.createDataFrame(rows, "user_id long, item_id long, score int")


def test_key_stats_and_window_stats_agree(ratings):
    ks = {r["user_id"]: r for r in stats.key_stats(ratings, "user_id", "score", prefix="user").collect()}
    assert ks[1]["user_score_mean"] == pytest.approx(6.2)
    assert ks[1]["user_score_count"] == 5
    ws = stats.window_stats(ratings, ["user_id"], "score", prefixes={"user_id": "user"})
    for r in ws.collect():
        assert r["user_score_mean"] == pytest.approx(ks[r["user_id"]]["user_score_mean"])
    assert ws.count() == ratings.count()


def test_target_encoder_min_count_and_unseen(spark, ratings):
    spec = {("user_id", "score"): ["mean", "count"], ("item_id", "score"): ["mean", "std"]}
    model = stats.TargetEncoder(spec, min_count=5).fit(ratings)
    test = spark.createDataFrame([(2, 10), (1, 99), (4, 11)], "user_id long, item_id long")
    out = {(r.user_id, r.item_id): r for r in model.transform(test).collect()}
    assert out[(2, 10)]["te_user_id_mean_score"] is None           # user 2 has < 5 rows
    # item 10 encoded from users 1 and 3 only (user 2 excluded from every encoding)
    assert out[(2, 10)]["te_item_id_mean_score"] == pytest.approx((5 + 8) / 2)
    assert out[(1, 99)]["te_item_id_mean_score"] is None           # unseen item
    assert out[(4, 11)]["te_item_id_std_score"] is None            # one eligible value -> null std


def test_oof_encoding_matches_per_fold_fit(ratings):
    folded = folds.kfold(ratings, ["user_id", "item_id"], k=3, seed=7)
    spec = {("user_id", "score"): ["mean", "max"], ("item_id", "score"): ["mean", "count"]}
    enc, _ = stats.oof_target_encode(folded, spec, "fold", 3, min_count=3)
    got = {(r.user_id, r.item_id): r for r in enc.collect()}
    pdf = folded.toPandas()
    for f in range(3):
        fit = pdf[pdf.fold != f]
        ok = fit.groupby("user_id").size()
        fit = fit[fit.user_id.isin(ok[ok >= 3].index)]
        um, ux = fit.groupby("user_id").score.mean(), fit.groupby("user_id").score.max()
        im, ic = fit.groupby("item_id").score.mean(), fit.groupby("item_id").score.count()
        for r in pdf[pdf.fold == f].itertuples():
            g = got[(r.user_id, r.item_id)]
            for name, table, key in (("te_user_id_mean_score", um, r.user_id), ("te_user_id_max_score", ux, r.user_id),
                                     ("te_item_id_mean_score", im, r.item_id), ("te_item_id_count_score", ic, r.item_id)):
                exp = table.get(key)
                if exp is None or (isinstance(exp, float) and math.isnan(exp)):
                    assert g[name] is None
                else:
                    assert g[name] == pytest.approx(float(exp))


def test_severity_scale(ratings):
    df = ratings.select("user_id", "item_id", F.col("score").cast("double").alias("te_item"),
                        (F.col("score") / 2).alias("te_user"))
    out = stats.severity_scale(df, "te_item", "te_user").collect()
    mm = sum(r.te_item for r in out) / len(out)
    for r in out:
        assert r.user_anime_mean_mean == pytest.approx(mm)
        assert r.calibrated_anime_mean_score == pytest.approx(r.te_item + r.te_user - mm)


def test_ratios_zero_denominator(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 3, 6)], "id int, watching long, members long")
    out = {r.id: r.watching_rate for r in stats.ratios(df, ["watching"], "members").collect()}
    assert out[1] is None and out[2] == pytest.approx(0.5)


def test_mean_encoder_replaces_columns(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "type string, target double")
    test = spark.createDataFrame([("a",), ("c",)], "type string")
    enc = stats.MeanEncoder(["type"], "target")
    out = {r[0] for r in enc.transform_with(enc.fit(train), test).collect()}
    assert out == {2.0, None}


def test_flagship_matches_pandas(spark):
    import numpy as np
    from ratingkit.plans import flagship
    rng = np.random.default_rng(4)
    rows = list({(int(u), int(i)): (int(u), int(i), int(rng.integers(1, 11)))
                 for u, i in zip(rng.integers(0, 30, 600), rng.integers(0, 40, 600))}.values())
    df = spark.createDataFrame(rows, "user_id long, item_id long, score int")
    got = {r.fold: r.rmse for r in flagship.oof_severity_rmse(df).collect()}
    folded = folds.stratified_kfold(df, ["user_id", "item_id"], "score", 5, 42).toPandas()
    parts = []
    for f in range(5):
        fit, val = folded[folded.fold != f], folded[folded.fold == f].copy()
        n = fit.groupby("user_id").size()
        fit = fit[fit.user_id.isin(n[n >= 5].index)]
        val["um"] = val.user_id.map(fit.groupby("user_id").score.mean())
        val["im"] = val.item_id.map(fit.groupby("item_id").score.mean())
        mm = val.im.mean()
        pred = (val.im + (val.um - mm)).fillna(val.im).fillna(val.um).fillna(fit.score.mean())
        val["pred"] = pred.clip(1, 10)
        parts.append(val)
        assert got[f] == pytest.approx(np.sqrt(((val.score - val.pred) ** 2).mean()), abs=1e-6)
    allv = pd.concat(parts)
    assert got[-1] == pytest.approx(np.sqrt(((allv.score - allv.pred) ** 2).mean()), abs=1e-6)


def test_rmse_by_fold_ignores_missing_predictions(spark):
    from ratingkit.operators import evaluate
    df = spark.createDataFrame([(0, 5, 3.0), (0, 5, None), (0, 5, 3.0)], "fold int, score int, pred double")
    assert {(r.fold, r.n_rows, r.rmse) for r in evaluate.rmse_by_fold(df).collect()} == {(0, 3, 2.0), (-1, 3, 2.0)}


def test_severity_reads_its_tables_once(spark, monkeypatch, tmp_path):
    """The mean and the rows share one stored encoding; the ratings are joined once."""
    from ratingkit.plans import queries as q
    spark.createDataFrame([(o, o % 3, 5.0 + 5 * (o % 7)) for o in range(40)], "l_orderkey long, l_partkey long, l_quantity double"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 4) for o in range(40)], "o_orderkey long, o_custkey long").write.parquet(
        f"{tmp_path}/orders.parquet")
    frames = []
    keep = q.stored
    monkeypatch.setattr(q, "stored", lambda df, name: frames.append(name) or keep(df, name))
    out = q.q_severity(spark, str(tmp_path))
    assert frames == ["train", "encoded"]
    assert "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert len(rows) == q._train(spark, str(tmp_path)).count() > 0
    for r in rows:
        if r.te_item_id_mean_score is not None:
            assert abs(r.calibrated_anime_mean_score - r.te_item_id_mean_score - r.severity_scale) < 3e-6
