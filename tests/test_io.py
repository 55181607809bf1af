import tempfile

from pyspark.sql import functions as F

from ratingkit.operators import catalog
from ratingkit.sources import io


def test_submission_roundtrip_in_key_order(spark):
    out = tempfile.mkdtemp(prefix="ratingkit-io-")
    preds = spark.createDataFrame([(i, float(i) / 10) for i in range(200)], "row_nr long, score double").repartition(5)
    io.write_submission(preds, f"{out}/sub", keep_key=True)
    back = io.read_prediction(spark, f"{out}/sub", fmt="csv")
    assert [r.row_nr for r in back.orderBy("row_nr").collect()] == list(range(200))
    joined = preds.join(back, "row_nr")
    assert joined.where(F.abs(F.col("score") - F.col("other_score")) > 1e-12).count() == 0


def test_read_interactions_csv_schema(spark):
    out = tempfile.mkdtemp(prefix="ratingkit-io-")
    df = spark.createDataFrame([(1, 2, 3)], "user_id long, item_id long, score int")
    io.write_table(df, f"{out}/train.csv", fmt="csv")
    back = io.read_interactions(spark, f"{out}/train.csv")
    assert back.schema == io.INTERACTIONS and back.first().score == 3


def test_fill_template_and_column_check(spark):
    tmpl = spark.createDataFrame([(1, 5, 0.0), (2, 6, 0.0)], "user_id long, item_id long, score double")
    preds = spark.createDataFrame([(1, 5, 7.5)], "user_id long, item_id long, score double")
    got = {r.user_id: r.score for r in io.fill_template(tmpl, preds, ["user_id", "item_id"]).collect()}
    assert got == {1: 7.5, 2: None}
    chk = {(r.side, r.column): r.present for r in catalog.column_check(tmpl, tmpl.drop("score")).collect()}
    assert chk[("train", "score")] and not chk[("test", "score")]


def test_scores_alone_read_back_by_place(spark):
    out = tempfile.mkdtemp(prefix="ratingkit-io-")
    preds = spark.createDataFrame([(i, float(i) / 7) for i in range(500)], "row_nr long, score double").repartition(5)
    io.write_submission(preds, f"{out}/sub")
    back = io.read_prediction(spark, f"{out}/sub", fmt="csv")
    got = {r.row_nr: r.other_score for r in back.collect()}
    assert got == {i: float(i) / 7 for i in range(500)}


def test_template_of_scores_alone_is_filled_by_place(spark):
    out = tempfile.mkdtemp(prefix="ratingkit-io-")
    rows = spark.createDataFrame([(i, 0.0) for i in range(300)], "row_nr long, score double").repartition(4)
    io.write_submission(rows, f"{out}/template")
    template = io.read_template(spark, f"{out}/template", fmt="csv")
    preds = spark.createDataFrame([(i, i / 3) for i in range(299, -1, -1) if i != 7], "row_nr long, score double")
    got = {r.row_nr: r.score for r in io.fill_template(template, preds).collect()}
    assert got == {i: None if i == 7 else i / 3 for i in range(300)}
    keyed = io.read_template(spark, io_keyed(spark, out), fmt="csv")
    assert sorted(r.row_nr for r in keyed.collect()) == [3, 9] and keyed.schema["row_nr"].dataType.simpleString() == "bigint"


def io_keyed(spark, out):
    io.write_table(spark.createDataFrame([(9, 0.0), (3, 0.0)], "row_nr long, score double"), f"{out}/keyed", fmt="csv")
    return f"{out}/keyed"


def test_missing_score_column_is_an_error(spark):
    import pytest
    out = tempfile.mkdtemp(prefix="ratingkit-io-")
    spark.range(3).write.option("header", True).csv(f"{out}/x")
    with pytest.raises(ValueError, match="score"):
        io.read_prediction(spark, f"{out}/x", fmt="csv")


def test_oof_table(spark):
    df = spark.createDataFrame([(2, 1, 5, 4.5), (1, 1, 3, 3.5)], "user_id long, item_id long, score int, pred double")
    assert [tuple(r) for r in io.oof_table(df, ["user_id", "item_id"]).orderBy("idx").collect()] == [(0, 3.5, 3), (1, 4.5, 5)]
