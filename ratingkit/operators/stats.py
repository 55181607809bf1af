"""Per-key statistics and target encodings (A1-A5, A10, W1, W3, SEV1, F9, X1, X3).

Shape rule: one ``groupBy`` per key (not per output column), then a left join back.  Per-key
tables are one row per key; a hot key costs one partial-aggregate row per map task, and the
join back is a plain equi-join that AQE may split on the fact side when it is skewed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import agg_expr
from ..session import cut_lineage

Spec = Mapping[tuple[str, str], Sequence[str]]


def te_name(key: str, agg: str, target: str, prefix: str = "te") -> str:
    return f"{prefix}_{key}_{agg}_{target}"


def _by_key(spec: Spec) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for (key, target), aggs in spec.items():
        for a in aggs:
            out[key].append((a, target))
    return out


def key_stats(df: DataFrame, key: str, value: str,
              aggs: Sequence[str] = ("mean", "count", "std", "max", "min"),
              prefix: str | None = None) -> DataFrame:
    """Per-key statistics of ``value`` (A1): columns ``{prefix}_{value}_{agg}``."""
    prefix = prefix or key
    return df.groupBy(key).agg(*[agg_expr(a, value).alias(f"{prefix}_{value}_{a}") for a in aggs])


def window_stats(df: DataFrame, keys: Sequence[str], value: str,
                 aggs: Sequence[str] = ("mean", "min", "max", "std", "count"),
                 prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """Per-key statistics kept on every row (W1, W3).

    Same result as ``agg().over(partitionBy(key))``, but computed as aggregate + join: a
    window puts all rows of a key in one task, the aggregate combines map-side first.
    """
    prefixes = prefixes or {}
    for key in keys:
        df = df.join(key_stats(df, key, value, aggs, prefixes.get(key, key)), key, "left")
    return df


class TargetEncoderModel:
    """Fitted encodings: one small table per key (key + its encoded columns)."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    @property
    def columns(self) -> list[str]:
        return [c for key, t in self.tables.items() for c in t.columns if c != key]

    def transform(self, df: DataFrame) -> DataFrame:
        """Unseen keys get nulls (left join)."""
        for key, table in self.tables.items():
            df = df.join(table, key, "left")
        return df


class TargetEncoder:
    """Target encoding (A2): ``{(key, target): [aggs]}`` -> ``te_{key}_{agg}_{target}``.

    Rows of users with fewer than ``min_count`` rows are left out of every encoding, as in the
    reference.  ``fit`` returns a model; ``fit_transform`` also encodes the fitted frame with
    its own statistics (the in-sample behaviour, Q9; prefer :func:`oof_target_encode`).
    """

    def __init__(self, spec: Spec, min_count: int = 5, count_col: str = "user_id", prefix: str = "te"):
        self.spec, self.min_count, self.count_col, self.prefix = spec, min_count, count_col, prefix

    def eligible_rows(self, df: DataFrame) -> DataFrame:
        if self.min_count <= 1:
            return df
        keep = (df.groupBy(self.count_col).agg(F.count(F.lit(1)).alias("_cnt"))
                  .where(F.col("_cnt") >= self.min_count).select(self.count_col))
        return df.join(keep, self.count_col, "left_semi")

    def fit(self, df: DataFrame) -> TargetEncoderModel:
        base = self.eligible_rows(df)
        tables = {}
        for key, items in _by_key(self.spec).items():
            tables[key] = base.groupBy(key).agg(
                *[agg_expr(a, t).alias(te_name(key, a, t, self.prefix)) for a, t in items])
        return TargetEncoderModel(tables)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def oof_target_encode(df: DataFrame, spec: Spec, fold_col: str = "fold", k: int = 5,
                      min_count: int = 5, count_col: str = "user_id", prefix: str = "te",
                      global_target: str | None = None, materialize: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Out-of-fold target encoding (A3) in one pass over the data.

    Row ``r`` of fold ``f`` is encoded with what :class:`TargetEncoder` would fit on the other
    folds.  Instead of k separate fits, every row is sent to the fits it belongs to (the folds
    ``j != f`` where its user still has ``min_count`` rows outside ``j``) and each key is
    aggregated once over ``(key, fit fold)``; map-side partial aggregation keeps the shuffle at
    one row per key and fold per task.  Returns the encoded frame and the per-key tables
    (``key, fold, te_*``) for encoding unseen rows fold by fold (M3).

    ``global_target`` adds ``{prefix}_global_mean_{target}`` per fit fold (fallback prediction).
    ``materialize`` writes the expanded fit rows once (worth it when ``df`` itself is expensive
    to recompute; with a checkpointed ``df`` re-deriving them per key is cheaper).
    """
    counts = df.groupBy(count_col).agg(
        F.count(F.lit(1)).alias("_tot"),
        F.array(*[F.count(F.when(F.col(fold_col) == j, 1)) for j in range(k)]).alias("_fc"))
    fits = F.filter(F.sequence(F.lit(0), F.lit(k - 1)),
                    lambda j: (j != F.col(fold_col)) &
                              (F.col("_tot") - F.element_at("_fc", j + 1) >= F.lit(min_count)))
    exploded = (df.join(counts, count_col)
                  .select("*", F.explode(fits).alias("_fit"))
                  .drop("_tot", "_fc"))
    if materialize and len(_by_key(spec)) + (1 if global_target else 0) > 1:
        needed = {count_col, "_fit", *[k for k, _ in spec], *[t for _, t in spec]} | ({global_target} - {None})
        exploded = cut_lineage(exploded.select(*[c for c in exploded.columns if c in needed]))
    tables: dict[str, DataFrame] = {}
    for key, items in _by_key(spec).items():
        tables[key] = (exploded.groupBy(key, F.col("_fit").alias(fold_col))
                       .agg(*[agg_expr(a, t).alias(te_name(key, a, t, prefix)) for a, t in items]))
    if global_target:
        tables["__global__"] = (exploded.groupBy(F.col("_fit").alias(fold_col))
                                .agg(F.avg(global_target).alias(f"{prefix}_global_mean_{global_target}")))
    out = df
    for key, table in tables.items():
        on = [fold_col] if key == "__global__" else [key, fold_col]
        out = out.join(table, on, "left")
    return out, tables


def encode_by_fold(df: DataFrame, tables: dict[str, DataFrame], k: int, fold_col: str = "fold") -> DataFrame:
    """Encode unseen rows once per fold's fit: ``k`` copies of each row tagged with ``fold``."""
    out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold_col))
    for key, table in tables.items():
        on = [fold_col] if key == "__global__" else [key, fold_col]
        out = out.join(table, on, "left")
    return out


def oof_mean_by_key(encoded: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Average the out-of-fold encodings per key (A4), ready to left-join onto test rows."""
    return encoded.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


class MeanEncoder:
    """Replace each listed column by the mean target of its value (A5); unseen -> null."""

    def __init__(self, columns: Sequence[str], target: str):
        self.columns, self.target = list(columns), target

    def fit(self, df: DataFrame) -> TargetEncoderModel:
        return TargetEncoderModel({c: df.groupBy(c).agg(F.avg(self.target).alias(f"_me_{c}"))
                                   for c in self.columns})

    def transform_with(self, model: TargetEncoderModel, df: DataFrame) -> DataFrame:
        out = model.transform(df)
        for c in self.columns:
            out = out.withColumn(c, F.col(f"_me_{c}")).drop(f"_me_{c}")
        return out


def global_mean(df: DataFrame, col: str) -> float | None:
    """One aggregate row to the driver (A10); callers turn it into a literal column."""
    return df.agg(F.avg(col)).first()[0]


def severity_scale(df: DataFrame, item_mean: str, user_mean: str, by: Sequence[str] = (),
                   mean_col: str = "user_anime_mean_mean", severity_col: str = "severity_scale",
                   calibrated_col: str = "calibrated_anime_mean_score") -> DataFrame:
    """Severity scale (SEV1): how generous a user is relative to the items they rate.

    ``mean_col`` is the mean of ``item_mean`` over the frame (``by`` = groups of the frame such
    as folds, each group a separate frame), ``severity = user_mean - mean_col`` and
    ``calibrated = item_mean + severity``.
    """
    if by:
        means = df.groupBy(*by).agg(F.avg(item_mean).alias(mean_col))
        df = df.join(means, list(by), "left")
    else:
        df = df.withColumn(mean_col, F.lit(global_mean(df, item_mean)).cast("double"))
    return (df.withColumn(severity_col, F.col(user_mean) - F.col(mean_col))
              .withColumn(calibrated_col, F.col(item_mean) + F.col(severity_col)))


class SeverityScale:
    """SEV1 as fit and transform: the mean of item means is taken once from the fitted frame.

    ``scope="global"`` keeps one constant, ``"user"`` one per user; ``compat=True`` takes it anew from
    every frame given to ``transform``.  A user the fit has not seen gets nulls under ``"user"``.
    """

    def __init__(self, item_mean: str, user_mean: str, scope: str = "global", user_col: str = "user_id",
                 compat: bool = False, mean_col: str = "item_mean_mean", severity_col: str = "severity_scale",
                 calibrated_col: str = "calibrated_item_mean"):
        if scope not in ("global", "user"):
            raise ValueError(f"scope must be 'global' or 'user', not {scope!r}")
        self.item_mean, self.user_mean, self.scope, self.user_col, self.compat = item_mean, user_mean, scope, user_col, compat
        self.names = (mean_col, severity_col, calibrated_col)
        self.constant: float | DataFrame | None = None

    def fit(self, df: DataFrame) -> SeverityScale:
        if self.scope == "global":
            self.constant = global_mean(df, self.item_mean)
        else:
            self.constant = df.groupBy(self.user_col).agg(F.avg(self.item_mean).alias(self.names[0]))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.compat:
            self.fit(df)
        mean_col, severity_col, calibrated_col = self.names
        if self.scope == "global":
            df = df.withColumn(mean_col, F.lit(self.constant).cast("double"))
        else:
            df = df.join(self.constant, self.user_col, "left")
        return (df.withColumn(severity_col, F.col(self.user_mean) - F.col(mean_col))
                  .withColumn(calibrated_col, F.col(self.item_mean) + F.col(severity_col)))


def ratios(df: DataFrame, numerators: Sequence[str], denominator: str, suffix: str = "_rate") -> DataFrame:
    """``num / den`` per column (F9); a zero denominator gives null instead of an ANSI error."""
    return df.withColumns({f"{n}{suffix}": F.try_divide(F.col(n).cast("double"), F.col(denominator))
                           for n in numerators})


def count_over(df: DataFrame, key: str, out: str = "cnt") -> DataFrame:
    """Per-key row count kept on every row (W3), as aggregate + join."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(out)), key, "left")
