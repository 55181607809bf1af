import __spark_entry__ as entry

from tests.conftest import SF


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["fold", "n_rows", "rmse"] and len(rows) == 6


def test_fixture_views(spark):
    from ratingkit.sources import fixtures as fx
    r = fx.ratings(spark, SF)
    assert r.count() == r.select("user_id", "item_id").distinct().count()
    assert set(fx.pairs(spark, SF).select("split").distinct().toPandas().split) == {"train", "test"}
