"""Sources and sinks (IO1-IO8).

Reads take an explicit schema (no inference pass over the data); CSV and Parquet are both
accepted.  Predictions are always matched by key (``row_nr``): a submission is written in ``row_nr`` order
with a range sort, so part files concatenate in order; another run's predictions are read back with
their ``row_nr``, which for a file of scores alone is the row's place in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.folds import row_index

INTERACTIONS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()),
                             T.StructField("score", T.IntegerType())])
SIMILARITY = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_id_right", T.LongType()),
                           T.StructField("weight", T.DoubleType())])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Read CSV (header, explicit schema) or Parquet by extension or ``fmt`` (IO1-IO3)."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def read_interactions(spark: SparkSession, path: str, with_score: bool = True, fmt: str | None = None) -> DataFrame:
    """``user_id, item_id[, score]`` (IO1)."""
    schema = INTERACTIONS if with_score else T.StructType(INTERACTIONS.fields[:2])
    return read_table(spark, path, schema, fmt)


def read_similarity(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """``item_id, item_id_right, weight`` (IO3)."""
    return read_table(spark, path, SIMILARITY, fmt)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write any frame (IO7 out-of-fold table, IO8 preprocessed catalogue)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def submission_frame(preds: DataFrame, order_col: str = "row_nr", score_col: str = "score") -> DataFrame:
    """Predictions in template order, ``row_nr`` kept as the key (IO6)."""
    return preds.select(order_col, score_col).orderBy(order_col)


def write_submission(preds: DataFrame, path: str, order_col: str = "row_nr", score_col: str = "score",
                     fmt: str = "csv", keep_key: bool = False) -> None:
    """One ``score`` column in template row order (IO6).  ``orderBy`` is a range sort, so the
    part files, read in name order, are in ``row_nr`` order; no single-task coalesce."""
    out = submission_frame(preds, order_col, score_col)
    write_table(out if keep_key else out.select(score_col), path, fmt)


def fill_template(template: DataFrame, preds: DataFrame, key: Sequence[str] = ("row_nr",),
                  score_col: str = "score") -> DataFrame:
    """Template rows with their predicted ``score`` (IO4), matched on ``key``: the row's place for a template
    of scores alone (``read_template``), or columns that both have.  Rows without a prediction get null."""
    return template.drop(score_col).join(preds.select(*key, score_col), list(key), "left")


def by_place(read: DataFrame, order_col: str = "row_nr") -> DataFrame:
    """A file's rows with their place in it, ``order_col`` from 0: part files by their number, then the
    position inside the file.  ``read`` is a plain read of the file, as its metadata are needed."""
    columns, name = read.columns, F.col("_metadata.file_name")
    placed = read.select(
        *columns, name.alias("_name"),
        F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"^part-(\d+)", 1), F.lit("")), F.lit("9" * 18)),
                   F.lit(0)).cast("long").alias("_part"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    return row_index(placed, ["_part", "_name", "_block", "_place"], order_col).select(order_col, *columns)


def read_template(spark: SparkSession, path: str, order_col: str = "row_nr", fmt: str | None = None) -> DataFrame:
    """A submission template with the place of each row as its key (IO4); it may hold a score column alone."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    read = spark.read.format(fmt).option("header", True).load(path)
    if order_col in read.columns:
        return read.withColumn(order_col, F.col(order_col).cast("long"))
    return by_place(read, order_col)


def read_prediction(spark: SparkSession, path: str, order_col: str = "row_nr", score_col: str = "score",
                    out: str = "other_score", fmt: str | None = None) -> DataFrame:
    """Another run's predictions as ``(row_nr, out)`` for a key join (IO5).

    A file with the key column keeps its keys.  For scores alone the row number is the row's place:
    part files by their number, then the position inside the file.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    header = spark.read.format(fmt).option("header", True).load(path).columns
    if score_col not in header:
        raise ValueError(f"{path} has no column {score_col!r}, only {header}")
    kinds = {order_col: T.LongType(), score_col: T.DoubleType()}
    fields = [T.StructField(c, kinds.get(c, T.StringType())) for c in header]
    schema = T.StructType(fields) if fmt == "csv" else None
    df = read_table(spark, path, schema, fmt)
    if order_col in header:
        return df.select(order_col, F.col(score_col).cast("double").alias(out))
    return by_place(df, order_col).select(order_col, F.col(score_col).cast("double").alias(out))


def oof_table(preds: DataFrame, key: Sequence[str], pred_col: str = "pred", score_col: str = "score",
              index_col: str = "idx") -> DataFrame:
    """Out-of-fold table ``idx, preds, score`` (IO7): ``idx`` is the row's place in key order."""
    return row_index(preds.select(*key, F.col(pred_col).alias("preds"), score_col), list(key), index_col).select(
        index_col, "preds", score_col)
