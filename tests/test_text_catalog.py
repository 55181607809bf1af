import random

import pytest
from pyspark.sql import functions as F

from ratingkit.functions import text
from ratingkit.operators import catalog


def test_parsers(spark):
    rows = [("1 hr. 24 min.", "Apr 3, 1998 to Apr 24, 1999", "Unknown", "R+ - Mild Nudity"),
            ("24 min. per ep.", "Oct 20, 1999", "12", "not in map"),
            ("2 hr.", "Jan 1, 2001 to ?", "x", "Unknown"),
            ("Unknown", "1995", "Unknown", None),
            ("1 hr.", "Unknown", "3", "G - All Ages"),
            ("1 hr", "Unknown", "3", "G - All Ages")]
    df = spark.createDataFrame(rows, "duration string, aired string, episodes string, rating string")
    s, e = text.aired_years("aired")
    sc, ec = text.aired_years("aired", compat=True)
    out = df.select(text.duration_minutes("duration").alias("m"), s.alias("s"), e.alias("e"), ec.alias("ec"),
                    text.aired_days("aired").alias("days"), text.unknown_to_int("episodes").alias("ep"),
                    text.rating_code("rating").alias("rc")).collect()
    assert [r.m for r in out] == [84, 24, 120, 0, 60, 0]       # "hr." needs one character after "hr"
    assert [r.s for r in out] == [1998, 1999, 2001, None, None, None]
    assert [r.e for r in out] == [1999, 1999, None, None, None, None]
    assert out[0].ec == 1998                                  # compat: end year repeats the start
    assert [r.days for r in out] == [387, 1, -1, -1, -1, -1]
    assert [r.ep for r in out] == [-1, 12, None, -1, 3, 3]
    assert [r.rc for r in out] == [2, None, -1, None, 0, 0]


def test_indicator_modes(spark):
    df = spark.createDataFrame([(1, "Brand#10, Lic (0)"), (2, "Brand#1")], "id long, p string")
    exact = {(r.id, r.token) for r in catalog.indicators(df, "id", ["p"], mode="exact").collect()}
    regex = {(r.id, r.token) for r in catalog.indicators(df, "id", ["p"], mode="regex").collect()}
    assert (1, "Brand#1") not in exact and (1, "Brand#1") in regex   # substring regex trap
    assert (1, "Lic (0)") in exact and (1, "Lic (0)") not in regex   # token read as a pattern
    wide = catalog.indicators_wide(catalog.indicators(df, "id", ["p"]), "id", ["Brand#1", "Brand#10"]).collect()
    got = {r.id: (r["has_Brand#1"], r["has_Brand#10"]) for r in wide}
    assert got == {1: (False, True), 2: (True, False)}


def test_regex_index_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(catalog, "REGEX_CHUNK", 2)
    rng = random.Random(5)
    words = ["Ab", "b+c", "a?bc", "x(yz)?b", "(ab)+c", "a.c", "...", "A|bc", "[ab]c", "a{2}b", "c*", "b$", "^ab", "C++",
             "ab*?c", "a+?b", "\\d", "Lic (0)", "((a)b)c", "\u00e9\U0001f600x", "z", "(?i)AB", "abc", "a\nb", "bc (ab)"]
    rows = [(k, ", ".join(rng.sample(words, rng.randint(1, 4))) + rng.choice(["", "aab", "abcabc", "x", "AB1"]))
            for k in range(60)] + [(7, "abc"), (7, "abc"), (61, None), (62, ""), (None, "abcabc")]
    df = spark.createDataFrame(rows, "id long, p string")
    vocab = [r.token for r in catalog.vocabulary(df, "p").collect()]
    want = []
    for t in vocab:
        want += [(r.id, t) for r in df.where(F.col("p").rlike(t)).collect()]
    got = catalog.indicators(df, "id", ["p"], mode="regex").collect()
    assert len(vocab) > 30 and sorted(((r.id, r.token) for r in got), key=str) == sorted(want, key=str)
    assert catalog.indicators(df.limit(0), "id", ["p"], mode="regex").collect() == []


def test_literal_runs_are_in_every_match(spark):
    runs = {"abc": ["abc"], "Lic (0)": ["Lic "], "a?bc": ["bc"], "C++": ["C"], "ab*?c": ["a", "c"], "a|b": [], "[ab]c": [],
            "((a)b)c": [], "x(yz)?b": ["x", "b"], "...": [], "a{2}b": [], "^ab$": ["ab"]}
    df = spark.createDataFrame([(t,) for t in runs], "t string")
    assert {r.t: r.runs for r in df.select("t", catalog._literal_runs(F.col("t")).alias("runs")).collect()} == runs


def test_category_code_orders(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, "a"), (5, None)], "id long, t string")
    first = {r.t: r.t_code for r in catalog.category_code(df, "t", "id").collect()}
    assert first == {"c": 0, "b": 1, "a": 2, None: None}
    alpha = {r.t: r.t_code for r in catalog.category_code(df, "t", "id", how="alphabetical").collect()}
    assert alpha["a"] == 0 and alpha["c"] == 2
    freq = {r.t: r.t_code for r in catalog.category_code(df, "t", "id", how="frequency").collect()}
    assert freq["b"] == 0


def test_catalogue_features_zero_members(spark):
    df = spark.createDataFrame([("a, b", "x", "Unknown", "Unknown", "Unknown", "Unknown", 0, 0, 0, 0, 0)],
                               "genres string, licensors string, rating string, episodes string, duration string, "
                               "aired string, members long, watching long, completed long, on_hold long, dropped long")
    r = catalog.catalogue_features(df).first()
    assert r.watching_rate is None and r.has_genres_cnt == 2 and r.aired_days == -1
