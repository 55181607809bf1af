"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one file per bucket and append.  New data are
reduced to one row per digest, anti-joined with the index by a sort-merge join that reads the index
without a shuffle, and what is new is appended.

Digest: sha256 of the text without the characters ``[\\x20\\x09-\\x0D]``, in UTF-8.  Of equal texts the
row with the most code points stays, then the smallest id (null ids last).

Defined cases: null counts as empty; texts of white space alone equal the empty text; of rows equal in
id and text one is kept, whichever was staged first; an empty table leaves the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, shared_path, staged

# Index rows that one bucket should hold at most; fixes the bucket count when an index is made.
ROWS_PER_BUCKET = 2_000_000
# A digest with more than this share of all rows is joined by broadcast: 1 / share of them at most.
HOT_SHARE = 1 / 1000


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, digest, n_points)`` per row; no text travels further.  ``row`` numbers the rows of a
    batch, to tell repeated ones apart; it is fixed once written."""
    n = narrow(docs, id_col, text_col)
    return n.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normalized(F.col("text")), 256)).alias("digest"),
                    F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"))


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest: which row stays and how many there are (partially aggregated)."""
    best = F.min(F.struct((-F.col("n_points")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id",
                          "row"))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("group_size")).select(
        "digest", F.col("b.doc_id").alias("keep_id"), F.col("b.row").alias("keep_row"), "group_size")


class DigestIndex:
    """Digest index stored at ``path`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int, id_type: str = "bigint"):
        self.spark, self.path, self.n_buckets, self.id_type = spark, path, n_buckets, id_type
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id {id_type}, keep_row BIGINT, "
            f"group_size BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n_buckets} BUCKETS LOCATION '{path}'")

    @classmethod
    def create(cls, spark: SparkSession, expected_rows: int, path: str | None = None,
               id_type: str = "bigint") -> DigestIndex:
        buckets = max(8, -(-expected_rows // ROWS_PER_BUCKET))
        return cls(spark, path or shared_path(spark, "digest_index"), buckets, id_type)

    @classmethod
    def open(cls, spark: SparkSession, path: str, n_buckets: int, id_type: str = "bigint") -> DigestIndex:
        """An index that an earlier session wrote."""
        return cls(spark, path, n_buckets, id_type)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def fresh(self, reps: DataFrame) -> DataFrame:
        """Representatives whose digest the index does not hold: sort-merge anti-join."""
        return reps.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, reps: DataFrame, batch: str) -> None:
        # one task, hence one sorted file, per bucket
        (reps.select("digest", F.col("keep_id").cast(self.id_type), "keep_row", "group_size", F.lit(batch))
         .repartition(self.n_buckets, "digest").write.insertInto(self.table))
        self.spark.catalog.refreshTable(self.table)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate ``docs`` against the index and itself, append what is new.

        Returns per row: doc_id, digest, n_points, ``keep_id`` and ``group_size`` as the index has them
        (a digest of an earlier batch keeps that batch's entry), and ``kept``: this batch brought the
        digest and this row stands for it, one row a digest.
        """
        batch = uuid.uuid4().hex
        mine = staged(digests(docs, id_col, text_col), "digests")
        self.append(self.fresh(representatives(mine)), batch)
        return self.lookup(mine, batch)

    def lookup(self, mine: DataFrame, batch: str) -> DataFrame:
        """Index entry of every row of ``mine``.

        A digest with over ``HOT_SHARE`` of the rows would fill one task: at most ``1 / HOT_SHARE`` of
        these can exist, so their entries are broadcast.  The others join on the digest.
        """
        limit = max(1, int(mine.count() * HOT_SHARE))
        sizes = mine.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        hot = staged(self.rows().join(sizes.select("digest"), "digest"), "hot_digests")
        joined = mine.join(F.broadcast(hot), "digest").unionByName(
            mine.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(self.rows(), "digest"))
        return joined.select(
            "doc_id", "digest", "n_points", "keep_id", "group_size",
            ((F.col("row") == F.col("keep_row")) & (F.col("batch") == batch)).alias("kept"))
