"""Flagship: how well do out-of-fold user/item means, calibrated by user severity, predict a rating?

stratified 5-fold on score -> out-of-fold user and item mean encodings (users below
``min_count`` left out of each fit) -> severity-calibrated item mean per fold -> clipped
prediction -> RMSE per fold and overall.  Pure DataFrame work: four shuffles of the train rows
(fold rank, user counts, two encoding joins) plus small per-key and per-fold tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import rmse_by_fold
from ..operators.folds import stratified_kfold
from ..operators.stats import oof_target_encode, severity_scale, te_name
from ..session import cut_lineage


def oof_severity_predictions(train: DataFrame, k: int = 5, seed: int = 42, min_count: int = 5,
                             user_col: str = "user_id", item_col: str = "item_id", score_col: str = "score",
                             lo: float = 1.0, hi: float = 10.0) -> DataFrame:
    # the fold table feeds every branch below (counts, fits, joins): write it once
    folded = cut_lineage(stratified_kfold(train, [user_col, item_col], score_col, k, seed))
    spec = {(user_col, score_col): ["mean"], (item_col, score_col): ["mean"]}
    enc, _ = oof_target_encode(folded, spec, "fold", k, min_count, user_col, global_target=score_col)
    um, im = te_name(user_col, "mean", score_col), te_name(item_col, "mean", score_col)
    sev = severity_scale(enc, im, um, by=["fold"])
    pred = F.coalesce(F.col("calibrated_anime_mean_score"), F.col(im), F.col(um), F.col(f"te_global_mean_{score_col}"))
    return sev.withColumn("pred", F.least(F.greatest(pred, F.lit(lo)), F.lit(hi)))


def oof_severity_rmse(train: DataFrame, **kw) -> DataFrame:
    return rmse_by_fold(oof_severity_predictions(train, **kw), "fold", kw.get("score_col", "score"), "pred")


PRED_CTES = """
WITH t AS (SELECT user_id, item_id, score FROM pairs WHERE split = 'train'),
f AS (SELECT user_id, item_id, score,
        CAST((row_number() OVER (PARTITION BY score ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), user_id, item_id) - 1) % 5 AS INT) AS fold
      FROM t),
ut AS (SELECT user_id, count(*) AS tot FROM f GROUP BY user_id),
uk AS (SELECT user_id, fold, count(*) AS c FROM f GROUP BY user_id, fold),
elig AS (SELECT ut.user_id, k.k FROM ut CROSS JOIN (SELECT range AS k FROM range(5)) k
         LEFT JOIN uk ON uk.user_id = ut.user_id AND uk.fold = k.k
         WHERE ut.tot - coalesce(uk.c, 0) >= 5),
x AS (SELECT f.*, elig.k AS fit FROM f JOIN elig ON f.user_id = elig.user_id AND f.fold <> elig.k),
ue AS (SELECT user_id, fit, avg(score) AS um FROM x GROUP BY user_id, fit),
ie AS (SELECT item_id, fit, avg(score) AS im FROM x GROUP BY item_id, fit),
ge AS (SELECT fit, avg(score) AS gm FROM x GROUP BY fit),
v AS (SELECT f.user_id, f.item_id, f.fold, f.score, ue.um, ie.im, ge.gm FROM f
      LEFT JOIN ue ON ue.user_id = f.user_id AND ue.fit = f.fold
      LEFT JOIN ie ON ie.item_id = f.item_id AND ie.fit = f.fold
      LEFT JOIN ge ON ge.fit = f.fold),
mm AS (SELECT fold, avg(im) AS mm FROM v GROUP BY fold),
p AS (SELECT v.user_id, v.item_id, v.fold, v.score,
        greatest(least(coalesce(v.im + (v.um - mm.mm), v.im, v.um, v.gm), 10.0), 1.0) AS pred
      FROM v LEFT JOIN mm ON mm.fold = v.fold)
"""

ORACLE = PRED_CTES + """
SELECT fold, count(*) AS n_rows, round(sqrt(avg((score - pred) * (score - pred))), 6) AS rmse FROM p GROUP BY fold
UNION ALL
SELECT CAST(-1 AS INT) AS fold, count(*) AS n_rows, round(sqrt(avg((score - pred) * (score - pred))), 6) AS rmse FROM p
"""
