"""Catalogue preparation (F3, F12, U2, P1, P14, J1, SVD2 input).

Multi-valued text becomes long form ``(item, column, token)``: the number of indicator
columns depends on the data, so the table grows in rows, never in columns.  ``pivot`` to a wide
table is offered only for a vocabulary that is explicitly bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from .folds import row_index

REGEX_CHUNK = 512           # patterns without a literal that are tried on a text at once
REGEX_SALTS = 16            # parts of the texts that share a gram


def tokens(df: DataFrame, id_col: str, col: str, sep: str = ", ") -> DataFrame:
    """``(id, column, token)`` for every token of ``col`` (exploded, distinct per item)."""
    return (df.select(id_col, F.explode(text.split_list(col, sep)).alias("token"))
              .distinct().withColumn("column", F.lit(col)).select(id_col, "column", "token"))


def vocabulary(df: DataFrame, col: str, sep: str = ", ") -> DataFrame:
    """Distinct tokens of ``col`` across all rows (U2)."""
    return df.select(F.explode(text.split_list(col, sep)).alias("token")).distinct()


def indicators(df: DataFrame, id_col: str, columns: Sequence[str], sep: str = ", ", mode: str = "exact") -> DataFrame:
    """Indicator ``has_{token}`` in long form ``(id, column, token)``: one row per true flag (F3).

    ``exact``: the item's list contains the token.  ``regex``: the reference's test, a regex
    *search* of each vocabulary token in the raw text, so ``Brand#1`` also flags ``Brand#10``
    and ``Lic (0)`` is read as a pattern (Q1).  Flags are keyed by ``(column, token)`` so equal
    tokens of two columns do not overwrite each other (Q2).
    """
    parts = []
    for col in columns:
        if mode == "exact":
            parts.append(tokens(df, id_col, col, sep))
        elif mode == "regex":
            parts.append(_regex_indicators(df, id_col, col, sep))
        else:
            raise ValueError(f"mode must be 'exact' or 'regex', not {mode!r}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _grams(value: Column, q: Column) -> Column:
    """Substrings of ``q`` characters of ``value``, one per place."""
    places = F.when(F.length(value) >= q, F.sequence(F.lit(1), F.length(value) - q + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(value, i, q))


def _literal_runs(pattern: Column) -> Column:
    """Plain strings that every match of the regex ``pattern`` holds; none where its syntax (alternatives,
    classes, escapes, counted repeats, nested or special groups) leaves that open."""
    gap = F.lit("\0")
    flat = F.regexp_replace(pattern, F.lit(r"\([^()]*\)"), gap)
    unclear = pattern.rlike(r"[|\\\[\]{}]|\(\?") | flat.rlike("[()]")
    flat = F.regexp_replace(flat, F.lit("(?s).[?*]"), gap)           # what may be absent
    flat = F.regexp_replace(flat, F.lit("[.+^$?*]"), gap)
    runs = F.filter(F.split(flat, "\0"), lambda r: r != F.lit(""))
    return F.when(unclear, F.array().cast("array<string>")).otherwise(runs)


def _regex_pairs(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(_text, token)`` where the regex ``token`` is found in ``_text``; both columns are distinct.

    Every match of a pattern holds the pattern's literal runs, so it holds each of their grams (3 characters,
    fewer where no run is that long).  The rarest of these meets the texts' grams in an equi-join, salted
    against frequent grams, and the regex runs on what is left.  Patterns without a literal go to the
    texts in blocks of ``REGEX_CHUNK``.
    """
    runs = vocab.select("token", _literal_runs(F.col("token")).alias("_runs")).withColumn(
        "_q", F.when(F.size("_runs") > 0, F.least(F.lit(3), F.array_max(F.transform("_runs", F.length)))))
    plain, open_ = runs.where("_q IS NOT NULL"), runs.where("_q IS NULL")
    sizes = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_text"), F.lit(q)) for q in (1, 2, 3)])))
    grams = texts.select("_text", F.explode(sizes).alias("_gram"))
    frequency = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = plain.select("token", F.explode(F.array_distinct(F.flatten(F.transform(
        "_runs", lambda r: _grams(r, F.col("_q")))))).alias("_gram"))
    rarest = own.join(frequency, "_gram", "left").groupBy("token").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g")))["g"].alias("_gram"))
    salt = F.pmod(F.xxhash64("_text"), F.lit(REGEX_SALTS)).cast("int").alias("_salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(REGEX_SALTS - 1))).alias("_salt")
    found = grams.select("*", salt).join(rarest.select("*", every), ["_gram", "_salt"]).where(
        F.rlike("_text", F.col("token"))).select("_text", "token")
    n_open = open_.count()
    if not n_open:
        return found
    n = -(-n_open // REGEX_CHUNK)
    blocks = open_.groupBy(F.pmod(F.xxhash64("token"), F.lit(n)).cast("int").alias("_block")).agg(
        F.collect_list("token").alias("_tokens")).select("_block", "_tokens", every)
    tried = texts.select("_text", salt, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_block")).join(
        blocks, ["_block", "_salt"])
    hits = F.filter("_tokens", lambda t: F.rlike("_text", t))
    return found.unionByName(tried.select("_text", F.explode(hits).alias("token")))


def _regex_indicators(df: DataFrame, id_col: str, col: str, sep: str) -> DataFrame:
    base = df.select(id_col, F.col(col).alias("_text")).where(F.col("_text").isNotNull())
    pairs = _regex_pairs(base.select("_text").distinct(), cut_lineage(vocabulary(df, col, sep)))
    return base.join(pairs, "_text").withColumn("column", F.lit(col)).select(id_col, "column", "token")


def indicators_wide(long: DataFrame, id_col: str, vocab: Sequence[str], prefix: str = "has_") -> DataFrame:
    """Pivot long indicators to ``has_{token}`` booleans for a bounded, explicit vocabulary."""
    wide = long.groupBy(id_col).pivot("token", list(vocab)).agg(F.count(F.lit(1)) > 0)
    return wide.select(id_col, *[F.coalesce(F.col(f"`{t}`"), F.lit(False)).alias(f"{prefix}{t}") for t in vocab])


def category_code(df: DataFrame, col: str, order_col: str, out: str | None = None, how: str = "first") -> DataFrame:
    """Category -> int code (F12).

    ``first``: 0, 1, ... by first appearance in ``order_col`` order (what a categorical cast
    does on file order).  ``alphabetical`` and ``frequency`` (most frequent first) are the
    ``StringIndexer`` orders.  The code table has one row per distinct value.
    """
    out = out or f"{col}_code"
    vals = df.groupBy(col).agg(F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("_freq"))
    order = {"first": ["_first", col], "alphabetical": [col], "frequency": ["_less", col]}[how]
    vals = vals.where(F.col(col).isNotNull()).select(col, "_first", (-F.col("_freq")).alias("_less"))
    # a range sort, not one window over all values
    codes = row_index(vals, order, "_code").select(col, F.col("_code").cast("int").alias(out))
    return df.join(codes, col, "left")


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Choose columns by name prefix (P14)."""
    return [c for c in df.columns if c.startswith(prefix)]


def catalogue_features(items: DataFrame, compat_years: bool = False) -> DataFrame:
    """Entry B row features in one projection (P1): counts, codes, parsed numbers, ratios."""
    start_year, end_year = text.aired_years("aired", compat=compat_years)
    return items.withColumns({
        "has_genres_cnt": text.token_count("genres"),
        "has_licensors_cnt": text.token_count("licensors"),
        "rating_cd": text.rating_code("rating"),
        "episodes": text.unknown_to_int("episodes"),
        "duration_min": text.duration_minutes("duration"),
        "start_year": start_year,
        "end_year": end_year,
        "aired_days": text.aired_days("aired"),
        **{f"{c}_rate": F.try_divide(F.col(c).cast("double"), F.col("members"))
           for c in ("watching", "completed", "on_hold", "dropped")},
    })


def column_check(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Train/test column comparison as a data job (P13): for every column of either side, its
    presence, null count, distinct count and min/max (as text) on both sides.  One aggregate per
    side, unpivoted with ``stack``; columns missing on a side show ``present = false``."""
    cols = sorted(set(left.columns) | set(right.columns))
    parts = []
    for side, df in zip(names, (left, right)):
        have = [c for c in cols if c in df.columns]
        aggs = []
        for c in have:
            aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__nulls"),
                     F.countDistinct(c).alias(f"{c}__distinct"),
                     F.min(c).cast("string").alias(f"{c}__min"), F.max(c).cast("string").alias(f"{c}__max")]
        row = df.agg(*aggs)
        stack = ", ".join(f"'{c}', `{c}__nulls`, `{c}__distinct`, `{c}__min`, `{c}__max`" for c in have)
        long = row.selectExpr(f"stack({len(have)}, {stack}) AS (column, nulls, n_distinct, min_value, max_value)")
        full = df.sparkSession.createDataFrame([(c,) for c in cols], "column string").join(long, "column", "left")
        parts.append(full.select(F.lit(side).alias("side"), "column", F.col("nulls").isNotNull().alias("present"),
                                 "nulls", "n_distinct", "min_value", "max_value"))
    return parts[0].unionByName(parts[1])
