"""Named queries over the fixture views, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, stats
from ..session import cut_lineage, ensure_checkpoint_dir, stored
from ..sources import fixtures as fx
from . import flagship
from .registry import register


def _train(spark: SparkSession, d: str) -> DataFrame:
    return fx.split_frame(spark, d, "train")


# ---------------------------------------------------------------- fixtures (IO1, IO2)

@register("ratings", "SELECT user_id, item_id, score FROM ratings")
def q_ratings(spark, d):
    return fx.ratings(spark, d)


@register("split_counts", """
SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
       CAST(sum(score) AS BIGINT) AS score_sum
FROM pairs GROUP BY split""")
def q_split_counts(spark, d):
    return fx.pairs(spark, d).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"), F.sum("score").cast("bigint").alias("score_sum"))


@register("items", "SELECT * FROM items")
def q_items(spark, d):
    return fx.items(spark, d)


# ---------------------------------------------------------------- flagship (SEV1, EV1, EV2 over A3 + SP3)

@register("rmse_by_fold", flagship.ORACLE)
def q_rmse_by_fold(spark, d):
    return flagship.oof_severity_rmse(_train(spark, d))


# ---------------------------------------------------------------- helpers

def round_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column once, at the end, so engines agree on the last bits."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])


TE_AGGS = ["mean", "sum", "count", "std", "min", "max"]
TE_SPEC = {("user_id", "score"): TE_AGGS, ("item_id", "score"): TE_AGGS}


def _te_sql(key: str, src: str, extra_group: str = "", digits: int | None = 6) -> str:
    g = f", {extra_group}" if extra_group else ""

    def r(e: str) -> str:
        return f"round({e}, {digits})" if digits is not None else e
    return (f"SELECT {key}{g}, {r('avg(score)')} AS te_{key}_mean_score, CAST(sum(score) AS BIGINT) AS te_{key}_sum_score, "
            f"count(score) AS te_{key}_count_score, {r('stddev_samp(score)')} AS te_{key}_std_score, "
            f"min(score) AS te_{key}_min_score, max(score) AS te_{key}_max_score FROM {src} GROUP BY {key}{g}")


FOLD_SQL = """f AS (SELECT user_id, item_id, score,
   CAST((row_number() OVER (PARTITION BY score ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), user_id, item_id) - 1) % 5 AS INT) AS fold
   FROM pairs WHERE split = 'train')"""


# ---------------------------------------------------------------- A1, W1, W3, A6, A13

@register("user_stats", """
SELECT user_id, round(avg(score), 6) AS user_score_mean, count(score) AS user_score_count,
       round(stddev_samp(score), 6) AS user_score_std, max(score) AS user_score_max, min(score) AS user_score_min
FROM pairs WHERE split = 'train' GROUP BY user_id""")
def q_user_stats(spark, d):
    return round_floats(stats.key_stats(_train(spark, d), "user_id", "score", prefix="user"))


@register("item_stats", """
SELECT item_id, round(avg(score), 6) AS item_score_mean, count(score) AS item_score_count,
       round(stddev_samp(score), 6) AS item_score_std, max(score) AS item_score_max, min(score) AS item_score_min
FROM pairs WHERE split = 'train' GROUP BY item_id""")
def q_item_stats(spark, d):
    return round_floats(stats.key_stats(_train(spark, d), "item_id", "score", prefix="item"))


@register("window_stats", """
SELECT user_id, item_id, score,
  round(avg(score) OVER (PARTITION BY user_id), 6) AS user_score_mean, min(score) OVER (PARTITION BY user_id) AS user_score_min,
  max(score) OVER (PARTITION BY user_id) AS user_score_max, round(stddev_samp(score) OVER (PARTITION BY user_id), 6) AS user_score_std,
  count(score) OVER (PARTITION BY user_id) AS user_score_count,
  round(avg(score) OVER (PARTITION BY item_id), 6) AS item_score_mean, min(score) OVER (PARTITION BY item_id) AS item_score_min,
  max(score) OVER (PARTITION BY item_id) AS item_score_max, round(stddev_samp(score) OVER (PARTITION BY item_id), 6) AS item_score_std,
  count(score) OVER (PARTITION BY item_id) AS item_score_count
FROM pairs WHERE split = 'train'""")
def q_window_stats(spark, d):
    return round_floats(stats.window_stats(_train(spark, d), ["user_id", "item_id"], "score",
                                           prefixes={"user_id": "user", "item_id": "item"}))


@register("value_counts", """
SELECT item_id, count(*) AS counts FROM pairs GROUP BY item_id""")
def q_value_counts(spark, d):
    return fx.pairs(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("counts"))


@register("user_count_histogram", """
WITH c AS (SELECT user_id, count(*) AS cnt FROM pairs WHERE split = 'train' GROUP BY user_id),
b AS (SELECT CAST(min(cnt) AS DOUBLE) AS lo, CAST(max(cnt) AS DOUBLE) AS hi FROM c),
w AS (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / 300 ELSE 1.0 END AS width FROM b)
SELECT CAST(least(greatest(floor((CAST(cnt AS DOUBLE) - lo) / width), 0), 299) AS INT) AS bin, count(*) AS count,
       round(min(lo) + CAST(least(greatest(floor((CAST(cnt AS DOUBLE) - lo) / width), 0), 299) AS INT) * min(width), 6) AS bin_lo,
       round(min(lo) + (CAST(least(greatest(floor((CAST(cnt AS DOUBLE) - lo) / width), 0), 299) AS INT) + 1) * min(width), 6) AS bin_hi
FROM c, w GROUP BY 1""")
def q_user_count_histogram(spark, d):
    from ..operators.evaluate import histogram
    counts = stats.count_over(_train(spark, d), "user_id").select("user_id", "cnt").distinct()
    return round_floats(histogram(counts, "cnt", bins=300))


# ---------------------------------------------------------------- A2, A3, A4, A5, SEV1

@register("target_encoding", f"""
WITH t AS (SELECT user_id, item_id, score FROM pairs WHERE split = 'train'),
e AS (SELECT * FROM t WHERE user_id IN (SELECT user_id FROM t GROUP BY user_id HAVING count(*) >= 5)),
u AS ({_te_sql('user_id', 'e')}), i AS ({_te_sql('item_id', 'e')})
SELECT p.user_id, p.item_id, u.* EXCLUDE (user_id), i.* EXCLUDE (item_id)
FROM pairs p LEFT JOIN u ON u.user_id = p.user_id LEFT JOIN i ON i.item_id = p.item_id WHERE p.split = 'test'""")
def q_target_encoding(spark, d):
    model = stats.TargetEncoder(TE_SPEC, min_count=5).fit(_train(spark, d))
    test = fx.split_frame(spark, d, "test").select("user_id", "item_id")
    return round_floats(model.transform(test))


def _oof_sql(digits: int | None) -> str:
    return f"""
WITH {FOLD_SQL},
ut AS (SELECT user_id, count(*) AS tot FROM f GROUP BY user_id),
uk AS (SELECT user_id, fold, count(*) AS c FROM f GROUP BY user_id, fold),
elig AS (SELECT ut.user_id, k.k FROM ut CROSS JOIN (SELECT range AS k FROM range(5)) k
         LEFT JOIN uk ON uk.user_id = ut.user_id AND uk.fold = k.k WHERE ut.tot - coalesce(uk.c, 0) >= 5),
x AS (SELECT f.user_id, f.item_id, f.score, elig.k AS fit FROM f JOIN elig ON f.user_id = elig.user_id AND f.fold <> elig.k),
u AS ({_te_sql('user_id', 'x', 'fit', digits)}), i AS ({_te_sql('item_id', 'x', 'fit', digits)}),
enc AS (SELECT f.user_id, f.item_id, f.fold, u.* EXCLUDE (user_id, fit), i.* EXCLUDE (item_id, fit)
        FROM f LEFT JOIN u ON u.user_id = f.user_id AND u.fit = f.fold LEFT JOIN i ON i.item_id = f.item_id AND i.fit = f.fold)
"""


def _oof(spark, d):
    folded = cut_lineage(folds.stratified_kfold(_train(spark, d), ["user_id", "item_id"], "score", 5, 42))
    enc, tables = stats.oof_target_encode(folded, TE_SPEC, "fold", 5, 5, "user_id")
    return enc, tables


@register("oof_encoding", _oof_sql(6) + "SELECT * FROM enc")
def q_oof_encoding(spark, d):
    enc, _ = _oof(spark, d)
    return round_floats(enc.drop("score"))


@register("oof_to_test", _oof_sql(None) + """,
ia AS (SELECT item_id, round(avg(te_item_id_mean_score), 6) AS te_item_id_mean_score, round(avg(te_item_id_std_score), 6) AS te_item_id_std_score FROM enc GROUP BY item_id),
ua AS (SELECT user_id, round(avg(te_user_id_mean_score), 6) AS te_user_id_mean_score, round(avg(te_user_id_std_score), 6) AS te_user_id_std_score FROM enc GROUP BY user_id)
SELECT p.user_id, p.item_id, ia.te_item_id_mean_score, ia.te_item_id_std_score, ua.te_user_id_mean_score, ua.te_user_id_std_score
FROM pairs p LEFT JOIN ia ON ia.item_id = p.item_id LEFT JOIN ua ON ua.user_id = p.user_id WHERE p.split = 'test'""")
def q_oof_to_test(spark, d):
    enc = _oof(spark, d)[0]
    test = fx.split_frame(spark, d, "test").select("user_id", "item_id")
    for key in ("item_id", "user_id"):
        cols = [f"te_{key}_mean_score", f"te_{key}_std_score"]
        test = test.join(stats.oof_mean_by_key(enc, key, cols), key, "left")
    return round_floats(test)


@register("mean_encoder", """
WITH t AS (SELECT p.user_id, p.item_id, p.score, i.type, i.source FROM pairs p LEFT JOIN items i ON i.item_id = p.item_id WHERE p.split = 'train'),
mt AS (SELECT type, avg(score) AS m FROM t GROUP BY type), ms AS (SELECT source, avg(score) AS m FROM t GROUP BY source)
SELECT p.user_id, p.item_id, round(mt.m, 6) AS type, round(ms.m, 6) AS source
FROM pairs p LEFT JOIN items i ON i.item_id = p.item_id LEFT JOIN mt ON mt.type = i.type LEFT JOIN ms ON ms.source = i.source
WHERE p.split = 'test'""")
def q_mean_encoder(spark, d):
    cat = fx.items(spark, d).select("item_id", "type", "source")
    train = _train(spark, d).join(cat, "item_id", "left")
    test = fx.split_frame(spark, d, "test").select("user_id", "item_id").join(cat, "item_id", "left")
    enc = stats.MeanEncoder(["type", "source"], "score")
    return round_floats(enc.transform_with(enc.fit(train), test))


@register("severity", """
WITH t AS (SELECT user_id, item_id, score FROM pairs WHERE split = 'train'),
e AS (SELECT * FROM t WHERE user_id IN (SELECT user_id FROM t GROUP BY user_id HAVING count(*) >= 5)),
u AS (SELECT user_id, avg(score) AS um FROM e GROUP BY user_id), i AS (SELECT item_id, avg(score) AS im FROM e GROUP BY item_id),
r AS (SELECT t.user_id, t.item_id, u.um, i.im FROM t LEFT JOIN u ON u.user_id = t.user_id LEFT JOIN i ON i.item_id = t.item_id),
g AS (SELECT avg(im) AS mm FROM r)
SELECT user_id, item_id, round(um, 6) AS te_user_id_mean_score, round(im, 6) AS te_item_id_mean_score,
       round(mm, 6) AS user_anime_mean_mean, round(um - mm, 6) AS severity_scale,
       round(im + (um - mm), 6) AS calibrated_anime_mean_score
FROM r, g""")
def q_severity(spark, d):
    train = stored(_train(spark, d), "train")       # read by both encodings and by the rows
    spec = {("user_id", "score"): ["mean"], ("item_id", "score"): ["mean"]}
    enc = stored(stats.TargetEncoder(spec, 5).fit_transform(train).drop("score"), "encoded")    # by the mean and the rows
    return round_floats(stats.severity_scale(enc, "te_item_id_mean_score", "te_user_id_mean_score"))


# ---------------------------------------------------------------- SP1-SP4, SP7, P11, P12

@register("stratified_kfold", f"WITH {FOLD_SQL} SELECT user_id, item_id, score, fold FROM f")
def q_stratified_kfold(spark, d):
    return folds.stratified_kfold(_train(spark, d), ["user_id", "item_id"], "score", 5, 42)


@register("kfold", """
SELECT user_id, item_id, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), user_id, item_id) - 1) % 5 AS INT) AS fold
FROM pairs WHERE split = 'train'""")
def q_kfold(spark, d):
    return folds.kfold(_train(spark, d).select("user_id", "item_id"), ["user_id", "item_id"], 5, 42)


@register("group_kfold", """
WITH g AS (SELECT user_id, count(*) AS n FROM pairs WHERE split = 'train' GROUP BY user_id),
r AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', '42', CAST(user_id AS VARCHAR))), user_id) - 1 AS r FROM g),
gf AS (SELECT user_id, CAST(CASE WHEN CAST(floor(r / 5) AS BIGINT) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INT) AS fold FROM r)
SELECT p.user_id, p.item_id, gf.fold FROM pairs p JOIN gf ON gf.user_id = p.user_id WHERE p.split = 'train'""")
def q_group_kfold(spark, d):
    return folds.group_kfold(_train(spark, d).select("user_id", "item_id"), "user_id", 5)


@register("holdout", f"""
SELECT user_id, item_id, substring(md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), 1, 8) < '{format(int(round(0.2 * 16 ** 8)), "08x")}' AS is_valid
FROM pairs WHERE split = 'train'""")
def q_holdout(spark, d):
    return folds.holdout(_train(spark, d).select("user_id", "item_id"), ["user_id", "item_id"], 0.2, 42)


@register("sample_n", """
SELECT user_id, item_id, score FROM pairs WHERE split = 'train'
ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), user_id, item_id LIMIT 100""")
def q_sample_n(spark, d):
    return folds.sample_n(_train(spark, d), 100, ["user_id", "item_id"], 42)


@register("row_index", """
SELECT user_id, item_id, score, row_number() OVER (ORDER BY user_id, item_id) - 1 AS row_nr
FROM pairs WHERE split = 'train'""")
def q_row_index(spark, d):
    return folds.row_index(_train(spark, d), ["user_id", "item_id"])


@register("dense_index", """
SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_id_idx FROM (SELECT DISTINCT item_id FROM pairs)""")
def q_dense_index(spark, d):
    return folds.dense_index(fx.pairs(spark, d), "item_id")


# ---------------------------------------------------------------- catalogue (F1-F9, F12, P9, U2)

from ..functions import text as tx  # noqa: E402
from ..operators import catalog  # noqa: E402

INDICATOR_COLS = ["genres", "licensors", "producers"]
_PARTS = "string_split(aired, ' to ')"
_START = f"try_strptime({_PARTS}[1], '%b %d, %Y')"
_END = f"CASE WHEN len({_PARTS}) < 2 THEN {_START} ELSE try_strptime({_PARTS}[2], '%b %d, %Y') END"
CATALOG_SQL = {
    "has_genres_cnt": "CAST(len(string_split(genres, ', ')) AS INTEGER)",
    "has_licensors_cnt": "CAST(len(string_split(licensors, ', ')) AS INTEGER)",
    "rating_cd": "CASE rating WHEN 'G - All Ages' THEN 0 WHEN 'PG - Children' THEN 1 WHEN 'R+ - Mild Nudity' THEN 2 "
                 "WHEN 'PG-13 - Teens 13 or older' THEN 3 WHEN 'Rx - Hentai' THEN 4 "
                 "WHEN 'R - 17+ (violence & profanity)' THEN 5 WHEN 'Unknown' THEN -1 END",
    "episodes": "TRY_CAST(replace(episodes, 'Unknown', '-1') AS INTEGER)",
    "duration_min": r"coalesce(TRY_CAST(regexp_extract(duration, '(\d+) hr.', 1) AS INTEGER), 0) * 60 + "
                    r"coalesce(TRY_CAST(regexp_extract(duration, '(\d+) min.', 1) AS INTEGER), 0)",
    "start_year": f"CAST(year({_START}) AS INTEGER)",
    "end_year": f"CAST(year({_END}) AS INTEGER)",
    "aired_days": f"CAST(CASE WHEN contains(aired, 'Unknown') OR contains(aired, '?') THEN -1 "
                  f"ELSE coalesce(datediff('day', {_START}, {_END}) + 1, -1) END AS INTEGER)",
    **{f"{c}_rate": f"round(CAST({c} AS DOUBLE) / NULLIF(members, 0), 6)"
       for c in ("watching", "completed", "on_hold", "dropped")},
}


def _catalog_select(cols: list[str]) -> str:
    return "SELECT item_id, " + ", ".join(f"{CATALOG_SQL[c]} AS {c}" for c in cols) + " FROM items"


@register("catalog_features", "SELECT * REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in CATALOG_SQL.items() if k == "episodes")
          + "), " + ", ".join(f"{v} AS {k}" for k, v in CATALOG_SQL.items() if k != "episodes") + " FROM items")
def q_catalog_features(spark, d):
    return round_floats(catalog.catalogue_features(fx.items(spark, d)))


@register("token_counts", _catalog_select(["has_genres_cnt", "has_licensors_cnt"]))
def q_token_counts(spark, d):
    return fx.items(spark, d).select("item_id", tx.token_count("genres").alias("has_genres_cnt"),
                                     tx.token_count("licensors").alias("has_licensors_cnt"))


@register("token_vocabulary", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", unnest(string_split({c}, ', ')) AS token FROM items" for c in INDICATOR_COLS))
def q_token_vocabulary(spark, d):
    items = fx.items(spark, d)
    parts = [catalog.vocabulary(items, c).select(F.lit(c).alias("column"), "token") for c in INDICATOR_COLS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("token_indicator_exact", " UNION ALL ".join(
    f"SELECT DISTINCT item_id, '{c}' AS \"column\", token FROM (SELECT item_id, unnest(string_split({c}, ', ')) AS token FROM items)"
    for c in INDICATOR_COLS))
def q_token_indicator_exact(spark, d):
    return catalog.indicators(fx.items(spark, d), "item_id", INDICATOR_COLS, mode="exact")


@register("token_indicator_regex", " UNION ALL ".join(
    f"SELECT i.item_id, '{c}' AS \"column\", v.token FROM items i JOIN "
    f"(SELECT DISTINCT unnest(string_split({c}, ', ')) AS token FROM items) v ON regexp_matches(i.{c}, v.token)"
    for c in INDICATOR_COLS))
def q_token_indicator_regex(spark, d):
    return catalog.indicators(fx.items(spark, d), "item_id", INDICATOR_COLS, mode="regex")


@register("episodes", _catalog_select(["episodes"]))
def q_episodes(spark, d):
    return fx.items(spark, d).select("item_id", tx.unknown_to_int("episodes").alias("episodes"))


@register("duration_minutes", _catalog_select(["duration_min"]))
def q_duration_minutes(spark, d):
    return fx.items(spark, d).select("item_id", tx.duration_minutes("duration").alias("duration_min"))


@register("aired_years", _catalog_select(["start_year", "end_year"]))
def q_aired_years(spark, d):
    s, e = tx.aired_years("aired")
    return fx.items(spark, d).select("item_id", s.alias("start_year"), e.alias("end_year"))


@register("aired_days", _catalog_select(["aired_days"]))
def q_aired_days(spark, d):
    return fx.items(spark, d).select("item_id", tx.aired_days("aired").alias("aired_days"))


@register("rating_code", _catalog_select(["rating_cd"]))
def q_rating_code(spark, d):
    return fx.items(spark, d).select("item_id", tx.rating_code("rating").alias("rating_cd"))


@register("member_ratios", _catalog_select([f"{c}_rate" for c in ("watching", "completed", "on_hold", "dropped")]))
def q_member_ratios(spark, d):
    out = stats.ratios(fx.items(spark, d), ["watching", "completed", "on_hold", "dropped"], "members")
    return round_floats(out.select("item_id", *[f"{c}_rate" for c in ("watching", "completed", "on_hold", "dropped")]))


@register("category_code", """
WITH t AS (SELECT type, row_number() OVER (ORDER BY min(item_id)) - 1 AS c FROM items GROUP BY type),
s AS (SELECT source, row_number() OVER (ORDER BY min(item_id)) - 1 AS c FROM items GROUP BY source)
SELECT i.item_id, CAST(t.c AS INTEGER) AS type_code, CAST(s.c AS INTEGER) AS source_code
FROM items i LEFT JOIN t ON t.type = i.type LEFT JOIN s ON s.source = i.source""")
def q_category_code(spark, d):
    items = fx.items(spark, d).select("item_id", "type", "source")
    out = catalog.category_code(items, "type", "item_id")
    out = catalog.category_code(out, "source", "item_id")
    return out.select("item_id", "type_code", "source_code")


# ---------------------------------------------------------------- similarity (J5, A6, A7, SIM1-SIM3, W2, T3, A8)

from ..operators import similarity as sim  # noqa: E402

SIM_SQL = """
ui AS (SELECT user_id, item_id, count(*) AS m FROM pairs GROUP BY user_id, item_id),
c AS (SELECT item_id, sum(m) AS c FROM ui GROUP BY item_id),
co AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.m * b.m) AS n FROM ui a JOIN ui b ON a.user_id = b.user_id GROUP BY 1, 2),
s AS (SELECT co.i AS item_id, co.j AS item_id_right, co.n / sqrt(ci.c * cj.c) AS weight
      FROM co JOIN c ci ON ci.item_id = co.i JOIN c cj ON cj.item_id = co.j),
r AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY weight DESC) AS rk,
             count(*) OVER (PARTITION BY item_id, weight) AS ties FROM s),
top AS (SELECT item_id, item_id_right, weight, rk + (ties - 1) / 2.0 AS rank FROM r WHERE 2 * rk + ties - 1 < 100)
"""


def _top(spark, d):
    return sim.top_similar(fx.pairs(spark, d).select("user_id", "item_id"), 50)


@register("item_similarity_summary", "WITH " + SIM_SQL + """
SELECT item_id, count(*) AS n_neighbours, round(sum(weight), 6) AS weight_sum,
       round(max(CASE WHEN item_id_right <> item_id THEN weight END), 6) AS weight_max_other
FROM s GROUP BY item_id""")
def q_item_similarity_summary(spark, d):
    return round_floats(sim.similarity_summary(fx.pairs(spark, d).select("user_id", "item_id")))


@register("item_similarity_topk", "WITH " + SIM_SQL + """
SELECT item_id, item_id_right, round(weight, 6) AS weight, rank FROM top""")
def q_item_similarity_topk(spark, d):
    return round_floats(_top(spark, d))


@register("neighbour_stats", "WITH " + SIM_SQL + """,
t AS (SELECT user_id, item_id FROM pairs WHERE split = 'train'),
pi AS (SELECT item_id_right AS item_id, count(weight) AS weight_cnt, avg(weight) AS weight_mean, sum(weight) AS weight_sum,
              min(weight) AS weight_min, max(weight) AS weight_max FROM top GROUP BY item_id_right)
SELECT t.user_id, t.item_id, coalesce(pi.weight_cnt, 0) AS weight_cnt, round(pi.weight_mean, 6) AS weight_mean,
       round(pi.weight_sum, 6) AS weight_sum, round(pi.weight_min, 6) AS weight_min, round(pi.weight_max, 6) AS weight_max
FROM t LEFT JOIN pi ON pi.item_id = t.item_id""")
def q_neighbour_stats(spark, d):
    out, _ = sim.NeighbourStats(_top(spark, d)).fit_transform(_train(spark, d).select("user_id", "item_id"))
    return round_floats(out)


@register("neighbour_stats_profile", "WITH " + SIM_SQL + """,
t AS (SELECT user_id, item_id FROM pairs WHERE split = 'train'),
q AS (SELECT user_id, item_id FROM pairs WHERE split = 'test'),
cand AS (SELECT q.user_id, q.item_id, top.weight FROM q JOIN top ON top.item_id = q.item_id AND top.item_id_right <> top.item_id
         JOIN t ON t.user_id = q.user_id AND t.item_id = top.item_id_right),
g AS (SELECT user_id, item_id, count(weight) AS weight_cnt, avg(weight) AS weight_mean, sum(weight) AS weight_sum,
             min(weight) AS weight_min, max(weight) AS weight_max FROM cand GROUP BY user_id, item_id)
SELECT q.user_id, q.item_id, coalesce(g.weight_cnt, 0) AS weight_cnt, round(g.weight_mean, 6) AS weight_mean,
       round(g.weight_sum, 6) AS weight_sum, round(g.weight_min, 6) AS weight_min, round(g.weight_max, 6) AS weight_max
FROM q LEFT JOIN g ON g.user_id = q.user_id AND g.item_id = q.item_id""")
def q_neighbour_stats_profile(spark, d):
    train = _train(spark, d).select("user_id", "item_id")
    _, model = sim.NeighbourStats(_top(spark, d), mode="profile").fit_transform(train)
    return round_floats(model.transform(fx.split_frame(spark, d, "test").select("user_id", "item_id")))


# ---------------------------------------------------------------- baseline + kNN (KNN1)

from ..operators import knn  # noqa: E402


def _bias_sql(epochs: int = 10, reg_u: float = 15.0, reg_i: float = 10.0) -> str:
    parts = ["r AS (SELECT user_id, item_id, CAST(score AS DOUBLE) AS r FROM pairs WHERE split = 'train')",
             "g AS (SELECT avg(r) AS mu FROM r)",
             "bu0 AS (SELECT DISTINCT user_id, CAST(0.0 AS DOUBLE) AS b_u FROM r)"]
    for e in range(1, epochs + 1):
        parts.append(f"bi{e} AS (SELECT r.item_id, sum(r.r - g.mu - b.b_u) / ({reg_i} + count(*)) AS b_i "
                     f"FROM r JOIN bu{e - 1} b ON b.user_id = r.user_id, g GROUP BY r.item_id)")
        parts.append(f"bu{e} AS (SELECT r.user_id, sum(r.r - g.mu - b.b_i) / ({reg_u} + count(*)) AS b_u "
                     f"FROM r JOIN bi{e} b ON b.item_id = r.item_id, g GROUP BY r.user_id)")
    parts.append(f"bu AS (SELECT * FROM bu{epochs})")
    parts.append(f"bi AS (SELECT * FROM bi{epochs})")
    return ",\n".join(parts)


@register("baseline_bias", "WITH " + _bias_sql() + """
SELECT 'user' AS kind, user_id AS id, round(b_u, 6) AS bias FROM bu
UNION ALL SELECT 'item' AS kind, item_id AS id, round(b_i, 6) AS bias FROM bi""")
def q_baseline_bias(spark, d):
    m = knn.fit_baselines(_train(spark, d))
    users = m.user_bias.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("b_u").alias("bias"))
    items = m.item_bias.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("b_i").alias("bias"))
    return round_floats(users.unionByName(items))


KNN_CTES = _bias_sql() + """,
t AS (SELECT user_id, item_id FROM pairs WHERE split = 'test'),
tb AS (SELECT t.user_id, t.item_id, bu.b_u, bi.b_i, g.mu + coalesce(bu.b_u, 0.0) + coalesce(bi.b_i, 0.0) AS base
       FROM t LEFT JOIN bu ON bu.user_id = t.user_id LEFT JOIN bi ON bi.item_id = t.item_id, g),
kn AS (SELECT * FROM tb WHERE b_u IS NOT NULL AND b_i IS NOT NULL),
s AS (SELECT a.user_id AS u, b.user_id AS v, 1.0 / (sum((a.r - b.r) * (a.r - b.r)) / count(*) + 1.0) AS sim
      FROM r a JOIN r b ON a.item_id = b.item_id WHERE a.user_id IN (SELECT user_id FROM kn) GROUP BY 1, 2),
cand AS (SELECT kn.user_id, kn.item_id, kn.b_i, r.user_id AS v, r.r AS rv, bu.b_u AS bv, coalesce(s.sim, 0.0) AS sim
         FROM kn JOIN r ON r.item_id = kn.item_id JOIN bu ON bu.user_id = r.user_id
         LEFT JOIN s ON s.u = kn.user_id AND s.v = r.user_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, v) AS rn FROM cand)
        WHERE rn <= 40 AND sim > 0),
agg AS (SELECT user_id, item_id, sum(sim) AS ss, sum(sim * (rv - (g.mu + bv + b_i))) AS sr, count(*) AS k FROM top, g
        GROUP BY user_id, item_id),
kp AS (SELECT tb.user_id, tb.item_id,
       greatest(least(tb.base + CASE WHEN agg.k >= 1 AND agg.ss <> 0 THEN agg.sr / agg.ss ELSE 0.0 END, 10.0), 1.0) AS est
       FROM tb LEFT JOIN agg ON agg.user_id = tb.user_id AND agg.item_id = tb.item_id)"""


@register("knn_predict", "WITH " + KNN_CTES + " SELECT user_id, item_id, round(est, 6) AS est FROM kp")
def q_knn_predict(spark, d):
    model = knn.BaselineKnn().fit(_train(spark, d))
    test = fx.split_frame(spark, d, "test").select("user_id", "item_id")
    return round_floats(model.predict(test))


# ---------------------------------------------------------------- fuzzy title clusters (F15, F16, FZ1, J8)

from ..operators import fuzzy  # noqa: E402


@register("title_clusters")
def q_title_clusters(spark, d):
    items = fx.items(spark, d).select("item_id", "name")
    return fuzzy.cluster_names(items, "name", 0.2, order_col="item_id")


@register("title_edges")
def q_title_edges(spark, d):
    names = fx.items(spark, d).select("name").distinct()
    return round_floats(fuzzy.name_edges(names, "name", 0.2))


# ---------------------------------------------------------------- evaluation on out-of-fold predictions (EV4-EV8, M4)

from ..operators import evaluate as ev  # noqa: E402


def _oof_preds(spark, d):
    return flagship.oof_severity_predictions(_train(spark, d)).select("user_id", "item_id", "fold", "score", "pred")


@register("residual_stats", flagship.PRED_CTES + """
SELECT user_id, round(stddev_samp(pred - score), 6) AS diff_std, round(avg(pred - score), 6) AS diff_mean, count(*) AS cnt
FROM p GROUP BY user_id""")
def q_residual_stats(spark, d):
    return round_floats(ev.residual_stats(ev.residuals(_oof_preds(spark, d), "score", "pred"), "user_id"))


@register("error_by_user", flagship.PRED_CTES + """
SELECT user_id, round(sum((score - pred) * (score - pred)), 6) AS sum, count(*) AS count,
       round(avg((score - pred) * (score - pred)), 6) AS mean, round(stddev_samp(score), 6) AS score_std
FROM p GROUP BY user_id""")
def q_error_by_user(spark, d):
    return round_floats(ev.error_by_user(_oof_preds(spark, d), "user_id", "score", "pred"))


@register("worst_users", flagship.PRED_CTES + """,
w AS (SELECT user_id FROM p GROUP BY user_id ORDER BY sum((score - pred) * (score - pred)) DESC, user_id LIMIT 3)
SELECT p.user_id, p.item_id, p.fold, p.score, round(p.pred, 6) AS pred, items.name, items.genres
FROM p JOIN w ON w.user_id = p.user_id LEFT JOIN items ON items.item_id = p.item_id""")
def q_worst_users(spark, d):
    cat = fx.items(spark, d).select("item_id", "name", "genres")
    return round_floats(ev.worst_users(_oof_preds(spark, d), cat, 3, "user_id", "item_id", "score", "pred"))


def _hist_sql(expr: str, bins: int) -> str:
    b = f"CAST(least(greatest(floor((({expr}) - lo) / width), 0), {bins - 1}) AS INT)"
    return f""",
hb AS (SELECT CAST(min({expr}) AS DOUBLE) AS lo, CAST(max({expr}) AS DOUBLE) AS hi FROM p),
hw AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1.0 END AS width FROM hb)
SELECT {b} AS bin, count(*) AS count, round(min(lo) + {b} * min(width), 6) AS bin_lo,
       round(min(lo) + ({b} + 1) * min(width), 6) AS bin_hi
FROM p, hw GROUP BY 1"""


@register("residual_histogram", flagship.PRED_CTES + _hist_sql("pred - score", 100))
def q_residual_histogram(spark, d):
    return round_floats(ev.histogram(ev.residuals(_oof_preds(spark, d), "score", "pred"), "diff", 100))


@register("residual_density", flagship.PRED_CTES + """,
bx AS (SELECT CAST(min(score) AS DOUBLE) AS xlo, CAST(max(score) AS DOUBLE) AS xhi,
              CAST(min(pred) AS DOUBLE) AS ylo, CAST(max(pred) AS DOUBLE) AS yhi FROM p),
bw AS (SELECT xlo, ylo, CASE WHEN xhi > xlo THEN (xhi - xlo) / 20 ELSE 1.0 END AS xw,
              CASE WHEN yhi > ylo THEN (yhi - ylo) / 20 ELSE 1.0 END AS yw FROM bx)
SELECT CAST(least(greatest(floor((CAST(score AS DOUBLE) - xlo) / xw), 0), 19) AS INT) AS x_bin,
       CAST(least(greatest(floor((pred - ylo) / yw), 0), 19) AS INT) AS y_bin, count(*) AS count
FROM p, bw GROUP BY 1, 2""")
def q_residual_density(spark, d):
    return ev.density_2d(_oof_preds(spark, d), "score", "pred", 20)


@register("blend_seen_unseen", "WITH " + KNN_CTES + """,
tr AS (SELECT user_id, item_id, score FROM pairs WHERE split = 'train'),
e AS (SELECT * FROM tr WHERE user_id IN (SELECT user_id FROM tr GROUP BY user_id HAVING count(*) >= 5)),
u AS (SELECT user_id, avg(score) AS um FROM e GROUP BY user_id), i AS (SELECT item_id, avg(score) AS im FROM e GROUP BY item_id),
te AS (SELECT t.user_id, t.item_id, u.um, i.im FROM t LEFT JOIN u ON u.user_id = t.user_id LEFT JOIN i ON i.item_id = t.item_id),
mm AS (SELECT avg(im) AS mm FROM te),
mu AS (SELECT avg(score) AS mu FROM tr),
seen AS (SELECT DISTINCT user_id FROM tr)
SELECT te.user_id, te.item_id, CASE WHEN seen.user_id IS NULL THEN 0 ELSE 1 END AS is_train_user,
       round(CASE WHEN seen.user_id IS NOT NULL
                  THEN greatest(least(coalesce(te.im + (te.um - mm.mm), te.im, te.um, mu.mu), 10.0), 1.0)
                  ELSE kp.est END, 6) AS score
FROM te CROSS JOIN mm CROSS JOIN mu LEFT JOIN seen ON seen.user_id = te.user_id
LEFT JOIN kp ON kp.user_id = te.user_id AND kp.item_id = te.item_id""")
def q_blend_seen_unseen(spark, d):
    train = _train(spark, d)
    test = fx.split_frame(spark, d, "test").select("user_id", "item_id")
    spec = {("user_id", "score"): ["mean"], ("item_id", "score"): ["mean"]}
    enc = stats.TargetEncoder(spec, 5).fit(train).transform(test)
    sev = stats.severity_scale(enc, "te_item_id_mean_score", "te_user_id_mean_score")
    mu = stats.global_mean(train, "score")
    seen_pred = F.coalesce("calibrated_anime_mean_score", "te_item_id_mean_score", "te_user_id_mean_score", F.lit(mu))
    sev = sev.withColumn("seen_pred", F.least(F.greatest(seen_pred, F.lit(1.0)), F.lit(10.0)))
    knn_est = knn.BaselineKnn().fit(train).predict(test)
    both = sev.select("user_id", "item_id", "seen_pred").join(knn_est, ["user_id", "item_id"])
    out = ev.blend_seen(both, train, "user_id", "seen_pred", "est")
    return round_floats(out.select("user_id", "item_id", "is_train_user", "score"))


# ---------------------------------------------------------------- SVD, embeddings, factor models, GBT (rows-only)

from ..operators import embed, factor, linalg  # noqa: E402
from ..operators import model as gbm  # noqa: E402


@register("svd_similarity")
def q_svd_similarity(spark, d):
    """SVD1: 10-dim item embedding from the long-form similarity matrix (``cf_svd_0..9``), taken as the product of
    its factors: its pairs are many more than the ratings, and the SVD only multiplies by it."""
    s = sim.item_similarity(fx.pairs(spark, d).select("user_id", "item_id"), factored=True)
    us, _ = linalg.truncated_svd(s, "user_id", "item_id", "value", k=10, gram_of=True)
    return linalg.widen(us, "item_id", "vec", 10, "cf_svd_")


@register("svd_multilabel")
def q_svd_multilabel(spark, d):
    """SVD2: multi-label one-hot of ``producers`` / ``studios`` (split on ``","``) -> 10 dims each."""
    items = fx.items(spark, d)
    out = items.select("item_id")
    for c in ("producers", "studios"):
        onehot = (catalog.tokens(items, "item_id", c, ",").select("item_id", "token")
                  .withColumn("one", F.lit(1.0)))
        us, _ = linalg.truncated_svd(onehot, "item_id", "token", "one", k=10)
        out = out.join(linalg.widen(us, "item_id", "vec", 10, f"svd_{c}_"), "item_id", "left")
    return out


@register("user_sentence_lengths", """
SELECT user_id, c.copy, CAST(sum(score) AS BIGINT) AS n_words
FROM pairs, (SELECT range AS copy FROM range(2)) c WHERE split = 'train' GROUP BY user_id, c.copy""")
def q_user_sentence_lengths(spark, d):
    s = embed.user_sentences(_train(spark, d))
    return s.groupBy("user_id", F.col("copy").cast("bigint").alias("copy")).agg(
        F.sum(F.size("sentence")).cast("bigint").alias("n_words"))


@register("user_sentences")
def q_user_sentences(spark, d):
    return embed.user_sentences(_train(spark, d))


@register("w2v_features")
def q_w2v_features(spark, d):
    model = embed.Word2VecFeatures().fit(_train(spark, d))
    return model.transform(fx.split_frame(spark, d, "test").select("user_id", "item_id"))


@register("als_features")
def q_als_features(spark, d):
    pairs = fx.pairs(spark, d).select("user_id", "item_id")
    model = factor.fit_als(pairs, rank=64, reg=0.05, alpha=2.0, max_iter=15)
    return model.transform(pairs, wide=True)


@register("bpr_features")
def q_bpr_features(spark, d):
    pairs = fx.pairs(spark, d).select("user_id", "item_id")
    model = factor.fit_bpr(pairs, factors=100, epochs=100)
    return model.transform(pairs, wide=True)


# the final run's encodings: 52 columns
_GBT_ENCODINGS = {(key, target): aggs for key in ("user_id", "item_id") for target, aggs in (
    ("score", ["mean", "sum", "count", "std", "min", "max"]),
    *((c, ["mean", "sum", "count", "std"]) for c in ("members", "watching", "completed", "on_hold", "dropped")))}


def _gbt_features(tr, va, te):
    """Per-fold features: target encodings and Word2Vec, both fitted on the fold's train part."""
    enc = stats.TargetEncoder(_GBT_ENCODINGS, 5).fit(tr)
    w2v = embed.Word2VecFeatures().fit(tr)
    return tuple(w2v.transform(enc.transform(x)) for x in (tr, va, te))


def _final_catalogue(spark, d):
    """The catalogue of the final run: numbers, ratios, token flags, list embeddings, category and work codes."""
    items = fx.items(spark, d)
    cat = catalog.catalogue_features(items)
    for c in ("type", "source"):
        cat = catalog.category_code(cat, c, "item_id")
    work = fuzzy.cluster_names(items.select("item_id", "name"), "name", 0.2, "item_id")
    work = catalog.category_code(work, "original_work_name", "item_id").select("item_id", "original_work_name_code")
    cat = cut_lineage(cat).select(
        "item_id", "members", "watching", "completed", "on_hold", "dropped", "plan_to_watch",
        "watching_rate", "completed_rate", "on_hold_rate", "dropped_rate", "episodes", "duration_min",
        "aired_days", "start_year", "end_year", "rating_cd", "has_genres_cnt", "has_licensors_cnt", "type_code",
        "source_code")
    for c in ("genres", "licensors"):
        flags = catalog.indicators(items, "item_id", [c], mode="regex").groupBy("item_id").agg(
            F.collect_set("token").alias("_tokens"))
        # a column a token, as many as the catalogue has; numbered, as tokens may differ in case alone
        vocab = sorted(r[0] for r in catalog.vocabulary(items, c).where("token IS NOT NULL").collect())
        cat = cat.join(cut_lineage(flags), "item_id", "left").select(*cat.columns, *(
            F.coalesce(F.array_contains("_tokens", t), F.lit(False)).alias(f"has_{c}_{n}_{t}")
            for n, t in enumerate(vocab)))
    return cut_lineage(cat.join(work, "item_id", "left").join(q_svd_multilabel(spark, d), "item_id", "left"))


def _gbt_run(spark, d, max_iter=10_000, patience=100):
    """The final run: factors, encodings, Word2Vec, the catalogue's columns, five folds to the stopping rule.

    The factor models see all pairs and no labels, the same matrix in every fold, so each is fitted once.
    """
    cat = _final_catalogue(spark, d)
    pairs = fx.pairs(spark, d).select("user_id", "item_id")
    als = factor.fit_als(pairs, rank=64, reg=0.05, alpha=2.0, max_iter=15)
    bpr = factor.fit_bpr(pairs, factors=100, epochs=100)

    def widened(df):
        return cut_lineage(bpr.transform(als.transform(df.join(cat, "item_id", "left"))))
    folded = widened(folds.stratified_kfold(_train(spark, d), ["user_id", "item_id"], "score", 5, 42))
    test = widened(fx.split_frame(spark, d, "test").select("user_id", "item_id"))
    return gbm.cross_validate(folded, test, 5, _gbt_features, drop=[], max_iter=max_iter, patience=patience)


def _final_run(spark, d):
    """Out-of-fold predictions, test predictions and importances of the final run: one stored run for all.

    The run lies in the shared folder under a key of the input files and their times; whichever query comes
    first makes it, the others read it.  ``_done`` is written last, so half a run is never read.
    """
    files = [fx.table(spark, d, t).select("_metadata.file_path", "_metadata.file_modification_time",
                                          "_metadata.file_size").distinct() for t in ("lineitem", "orders", "part")]
    key = files[0].unionByName(files[1]).unionByName(files[2]).agg(F.sha2(F.concat_ws(",", F.sort_array(
        F.collect_list(F.concat_ws(":", *files[0].columns)))), 256)).first()[0]
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/final-run-{key[:24]}"
    names = ("oof", "test", "importance")
    try:
        spark.read.schema("ok int").parquet(f"{base}/_done").limit(1).collect()
    except AnalysisException:
        oof, test, imps = _gbt_run(spark, d)
        table = spark.createDataFrame(imps, "fold int, column string, importance double")
        for name, df in zip(names, (oof, test, table)):
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        spark.range(1).selectExpr("CAST(id AS INT) AS ok").write.mode("overwrite").parquet(f"{base}/_done")
    return tuple(spark.read.parquet(f"{base}/{n}") for n in names)


@register("gbt_oof")
def q_gbt_oof(spark, d):
    return ev.rmse_by_fold(_final_run(spark, d)[0], "fold", "score", "pred")


@register("gbt_test")
def q_gbt_test(spark, d):
    """M3: the test prediction, the mean over the folds' models."""
    return round_floats(_final_run(spark, d)[1])


@register("importance")
def q_importance(spark, d):
    return ev.importance_table(_final_run(spark, d)[2], 50)


# ---------------------------------------------------------------- P13 column check, P11 + IO6 submission frame

from ..sources import io as rio  # noqa: E402


@register("column_check", """
WITH tr AS (SELECT user_id, item_id, score FROM pairs WHERE split = 'train'),
te AS (SELECT user_id, item_id FROM pairs WHERE split = 'test')
SELECT 'train' AS side, 'item_id' AS "column", true AS present, count(*) - count(item_id) AS nulls, count(DISTINCT item_id) AS n_distinct,
       CAST(min(item_id) AS VARCHAR) AS min_value, CAST(max(item_id) AS VARCHAR) AS max_value FROM tr
UNION ALL SELECT 'train', 'score', true, count(*) - count(score), count(DISTINCT score), CAST(min(score) AS VARCHAR), CAST(max(score) AS VARCHAR) FROM tr
UNION ALL SELECT 'train', 'user_id', true, count(*) - count(user_id), count(DISTINCT user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR) FROM tr
UNION ALL SELECT 'test', 'item_id', true, count(*) - count(item_id), count(DISTINCT item_id), CAST(min(item_id) AS VARCHAR), CAST(max(item_id) AS VARCHAR) FROM te
UNION ALL SELECT 'test', 'score', false, NULL, NULL, NULL, NULL
UNION ALL SELECT 'test', 'user_id', true, count(*) - count(user_id), count(DISTINCT user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR) FROM te""")
def q_column_check(spark, d):
    test = fx.split_frame(spark, d, "test").select("user_id", "item_id")
    return catalog.column_check(_train(spark, d), test)


@register("submission_frame", "WITH " + KNN_CTES + """,
q AS (SELECT user_id, item_id, row_number() OVER (ORDER BY user_id, item_id) - 1 AS row_nr FROM pairs WHERE split = 'test')
SELECT q.row_nr, round(kp.est, 6) AS score FROM q JOIN kp ON kp.user_id = q.user_id AND kp.item_id = q.item_id""")
def q_submission_frame(spark, d):
    test = folds.row_index(fx.split_frame(spark, d, "test").select("user_id", "item_id"), ["user_id", "item_id"])
    preds = knn.BaselineKnn().fit(_train(spark, d)).predict(test).withColumnRenamed("est", "score")
    return round_floats(rio.submission_frame(preds))


@register("template_by_place", """
WITH tr AS (SELECT item_id, avg(score) AS m FROM pairs WHERE split = 'train' GROUP BY item_id),
t AS (SELECT item_id, row_number() OVER (ORDER BY user_id, item_id) - 1 AS row_nr FROM pairs WHERE split = 'test')
SELECT t.row_nr, round(tr.m, 6) AS score FROM t LEFT JOIN tr ON tr.item_id = t.item_id""")
def q_template_by_place(spark, d):
    """IO4: a template of scores alone, filled by the rows' places with the item's mean."""
    test = folds.row_index(fx.split_frame(spark, d, "test").select("user_id", "item_id"), ["user_id", "item_id"])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/template-{uuid.uuid4().hex}"
    rio.write_submission(test.withColumn("score", F.lit(0.0)), path)
    means = _train(spark, d).groupBy("item_id").agg(F.avg("score").alias("score"))
    preds = test.join(means, "item_id")
    return round_floats(rio.fill_template(rio.read_template(spark, path, fmt="csv"), preds).select("row_nr", "score"))


# ---------------------------------------------------------------- embeddings table (F10, F11, SVD3) and binned strata (SP6)

from ..functions import vectors as vx  # noqa: E402


def _centroids(emb: DataFrame) -> DataFrame:
    """Per-label mean vector: position-wise averages (one small array per label)."""
    long = emb.select("label", F.posexplode(vx.as_double_array("embedding")).alias("_i", "_x"))
    per = long.groupBy("label", "_i").agg(F.avg("_x").alias("_m"))
    return per.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_s")).select(
        "label", F.col("_s._m").alias("centroid"))


@register("embedding_label_cosine", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS val, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT label, i, avg(val) AS m FROM x GROUP BY label, i),
d AS (SELECT x.vec_id, sum(x.val * c.m) AS dot, sum(x.val * x.val) AS nx, sum(c.m * c.m) AS nc
      FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY x.vec_id)
SELECT e.vec_id, e.label, round(CASE WHEN sqrt(nx) * sqrt(nc) > 0 THEN dot / (sqrt(nx) * sqrt(nc)) END, 6) AS cosine,
       round(e.v[1], 6) AS emb_0, round(e.v[2], 6) AS emb_1
FROM e LEFT JOIN d ON d.vec_id = e.vec_id""")
def q_embedding_label_cosine(spark, d):
    emb = fx.table(spark, d, "embeddings")
    out = emb.join(_centroids(emb), "label", "left").select(
        "vec_id", "label", vx.cosine(vx.as_double_array("embedding"), "centroid").alias("cosine"),
        *[vx.as_double_array("embedding")[i].alias(f"emb_{i}") for i in range(2)])
    return round_floats(out)


@register("embedding_projection")
def q_embedding_projection(spark, d):
    """SVD3 on the embeddings table: basis fitted on all rows and applied to them."""
    emb = fx.table(spark, d, "embeddings").select("vec_id", "label", vx.as_double_array("embedding").alias("vec"))
    basis = linalg.fit_projection(emb.select("vec_id", "vec"), 8)
    return linalg.widen(linalg.project(emb.select("vec_id", "vec"), basis), "vec_id", "vec", 8, "svd_")


@register("binned_stratified_kfold", """
SELECT event_id, CAST(floor(value / 10) AS BIGINT) AS stratum,
  CAST((row_number() OVER (PARTITION BY floor(value / 10) ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))), event_id) - 1) % 5 AS INT) AS fold
FROM events""")
def q_binned_stratified_kfold(spark, d):
    ev_ = fx.table(spark, d, "events").select("event_id", folds.binned_stratum("value", 10.0))
    return folds.stratified_kfold(ev_, ["event_id"], "stratum", 5, 42).select("event_id", "stratum", "fold")


# ---------------------------------------------------------------- A2 with the full reference configuration (52 columns, 2 aggregations)

COUNT_COLS = ["members", "watching", "completed", "on_hold", "dropped"]
FULL_SPEC = {("user_id", "score"): TE_AGGS, ("item_id", "score"): TE_AGGS,
             **{(k, c): ["mean", "sum", "count", "std"] for k in ("user_id", "item_id") for c in COUNT_COLS}}


def _full_te_sql() -> str:
    def aggs(key: str) -> str:
        out = [f"round(avg(score), 6) AS te_{key}_mean_score", f"CAST(sum(score) AS BIGINT) AS te_{key}_sum_score",
               f"count(score) AS te_{key}_count_score", f"round(stddev_samp(score), 6) AS te_{key}_std_score",
               f"min(score) AS te_{key}_min_score", f"max(score) AS te_{key}_max_score"]
        for c in COUNT_COLS:
            out += [f"round(avg({c}), 6) AS te_{key}_mean_{c}", f"CAST(sum({c}) AS BIGINT) AS te_{key}_sum_{c}",
                    f"count({c}) AS te_{key}_count_{c}", f"round(stddev_samp({c}), 6) AS te_{key}_std_{c}"]
        return ", ".join(out)
    cols = ", ".join(COUNT_COLS)
    return f"""
WITH t AS (SELECT p.user_id, p.item_id, p.score, {cols} FROM pairs p LEFT JOIN items USING (item_id) WHERE p.split = 'train'),
e AS (SELECT * FROM t WHERE user_id IN (SELECT user_id FROM t GROUP BY user_id HAVING count(*) >= 5)),
u AS (SELECT user_id, {aggs('user_id')} FROM e GROUP BY user_id),
i AS (SELECT item_id, {aggs('item_id')} FROM e GROUP BY item_id)
SELECT p.user_id, p.item_id, u.* EXCLUDE (user_id), i.* EXCLUDE (item_id)
FROM pairs p LEFT JOIN u ON u.user_id = p.user_id LEFT JOIN i ON i.item_id = p.item_id WHERE p.split = 'test'"""


@register("target_encoding_full", _full_te_sql())
def q_target_encoding_full(spark, d):
    cat = fx.items(spark, d).select("item_id", *COUNT_COLS)
    model = stats.TargetEncoder(FULL_SPEC, min_count=5).fit(_train(spark, d).join(cat, "item_id", "left"))
    test = fx.split_frame(spark, d, "test").select("user_id", "item_id")
    return round_floats(model.transform(test))


# ---------------------------------------------------------------- SEV1 fitted constant, EV8 by count, A11 and SP8 contents

@register("severity_fitted", """
WITH t AS (SELECT user_id, item_id, score FROM pairs WHERE split = 'train'),
e AS (SELECT * FROM t WHERE user_id IN (SELECT user_id FROM t GROUP BY user_id HAVING count(*) >= 5)),
u AS (SELECT user_id, avg(score) AS um FROM e GROUP BY user_id), i AS (SELECT item_id, avg(score) AS im FROM e GROUP BY item_id),
g AS (SELECT avg(i.im) AS mm FROM t LEFT JOIN i ON i.item_id = t.item_id)
SELECT p.user_id, p.item_id, round(g.mm, 6) AS item_mean_mean, round(u.um - g.mm, 6) AS severity_scale,
       round(i.im + (u.um - g.mm), 6) AS calibrated_item_mean
FROM pairs p CROSS JOIN g LEFT JOIN u ON u.user_id = p.user_id LEFT JOIN i ON i.item_id = p.item_id WHERE p.split = 'test'""")
def q_severity_fitted(spark, d):
    spec = {("user_id", "score"): ["mean"], ("item_id", "score"): ["mean"]}
    train = _train(spark, d)
    enc = stats.TargetEncoder(spec, 5).fit(train)
    scale = stats.SeverityScale("te_item_id_mean_score", "te_user_id_mean_score").fit(enc.transform(train))
    test = enc.transform(fx.split_frame(spark, d, "test").select("user_id", "item_id"))
    return round_floats(scale.transform(test).drop("te_item_id_mean_score", "te_user_id_mean_score"))


@register("residual_density_by_count", flagship.PRED_CTES + """,
s AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS cnt, round(avg(pred - score), 6) AS dm FROM p GROUP BY user_id),
bx AS (SELECT min(cnt) AS xlo, max(cnt) AS xhi, min(dm) AS ylo, max(dm) AS yhi FROM s),
bw AS (SELECT xlo, ylo, CASE WHEN xhi > xlo THEN (xhi - xlo) / 20 ELSE 1.0 END AS xw,
              CASE WHEN yhi > ylo THEN (yhi - ylo) / 20 ELSE 1.0 END AS yw FROM bx)
SELECT CAST(least(greatest(floor((cnt - xlo) / xw), 0), 19) AS INT) AS x_bin,
       CAST(least(greatest(floor((dm - ylo) / yw), 0), 19) AS INT) AS y_bin, count(*) AS count
FROM s, bw WHERE dm IS NOT NULL GROUP BY 1, 2""")
def q_residual_density_by_count(spark, d):
    return ev.residual_density_by_count(ev.residuals(_oof_preds(spark, d), "score", "pred"))


@register("user_sentence_words", """
WITH w AS (SELECT user_id, CAST(item_id AS VARCHAR) AS it, unnest(range(1, score + 1)) AS rep FROM pairs WHERE split = 'train')
SELECT user_id, 0::BIGINT AS copy, count(*) AS n_words, md5(string_agg(it, ' ' ORDER BY it, rep)) AS words_md5 FROM w GROUP BY user_id
UNION ALL
SELECT user_id, 1::BIGINT, count(*), md5(string_agg(it, ' ' ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), it, CAST(rep AS VARCHAR))), it))
FROM w GROUP BY user_id""")
def q_user_sentence_words(spark, d):
    s = embed.user_sentences(_train(spark, d))
    return s.select("user_id", F.col("copy").cast("bigint").alias("copy"), F.size("sentence").cast("bigint").alias("n_words"),
                    F.md5(F.array_join("sentence", " ")).alias("words_md5"))


@register("oof_table", flagship.PRED_CTES + """
SELECT row_number() OVER (ORDER BY user_id, item_id) - 1 AS idx, round(pred, 6) AS preds, score FROM p""")
def q_oof_table(spark, d):
    return round_floats(rio.oof_table(_oof_preds(spark, d), ["user_id", "item_id"]))
