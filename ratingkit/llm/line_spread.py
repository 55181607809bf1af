"""Removal of lines that many sites share.

Lines are those of the distinct texts: a text in several rows counts once, for one of its sites (the one
whose md5 is smallest), so copies alone spread no line.  A line is known by a 96-bit hash of its trimmed
text, and so is a text.  (1) One aggregation over all lines drops those of a single site.  (2) For the
others HyperLogLog sketches of the sites are built per line and merged by the aggregation.  (3) Lines
whose estimate lies near the threshold get an exact count of distinct sites.  (4) Lines on at least
``min_sites`` sites are boilerplate and cut from every document, whatever its share of them.

Defined cases: lines of fewer than ``min_chars`` code points are never cut, in any script; a null site is
a site of its own; null and empty texts have no lines and stay as they are; a text of shared lines alone
becomes empty; equal texts are cut alike, null ids among them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

MIN_SITES = 8
MIN_CHARS = 10
LG_K = 12
# Estimates this near to the threshold are counted exactly: six standard errors of a sketch, and one.
NEAR = 6 * 1.04 / 2 ** (LG_K / 2)
# Rows of one text meet its cuts in this many places, so that a text of many copies is spread.
SALTS = 8

_LINE, _TEXT = ["h1", "h2"], ["k1", "k2"]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _site(site: Column) -> Column:
    """A site as 60 bits of its md5."""
    name = F.coalesce(F.concat(F.lit("1"), site.cast("string")), F.lit(""))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def line_rows(docs: DataFrame, min_chars: int, text_col: str, site_col: str) -> DataFrame:
    """``(k1, k2, at, h1, h2, size, site)`` of every line long enough of every distinct text."""
    own = docs.select(docs[text_col].alias("text"), _site(docs[site_col]).alias("site"))
    lines = own.where(F.length("text") > 0).select(
        F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), "site",
        F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    line = _trimmed(F.col("raw"))
    sized = lines.where(F.length(line) >= min_chars).select(
        *_TEXT, "at", "site", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), F.length("raw").alias("size"))
    return sized.groupBy(*_TEXT, "at", *_LINE, "size").agg(F.min("site").alias("site"))


def shared_lines(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(h1, h2)`` of the lines on ``min_sites`` or more sites."""
    spread = staged(rows.select(*_LINE, "site").distinct(), "line_sites")      # a hot line: one row a site
    several = spread.groupBy(*_LINE).agg(F.min("site").alias("lo"), F.max("site").alias("hi")).where("lo <> hi")
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    sized = staged(spread.join(several.select(*_LINE), _LINE, "left_semi").groupBy(*_LINE).agg(
        estimate.alias("sites")), "line_sketches")
    band = min_sites * NEAR + 1
    sure = sized.where(F.col("sites") > min_sites + band).select(*_LINE)
    near = sized.where(F.abs(F.col("sites") - F.lit(min_sites)) <= band).select(*_LINE)
    exact = spread.join(near, _LINE, "left_semi").groupBy(*_LINE).agg(
        F.count("*").alias("n")).where(F.col("n") >= min_sites).select(*_LINE)
    return staged(sure.unionByName(exact), "shared_lines")


def cut_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS,
                     id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with the shared lines cut from ``text_col``; adds ``__lines_cut`` and ``__chars_cut``."""
    rows = staged(line_rows(docs, min_chars, text_col, site_col), "text_lines")
    cuts = rows.join(shared_lines(rows, min_sites), _LINE).groupBy(*_TEXT).agg(
        F.collect_list("at").alias("__cut"), F.sum("size").alias("__size"))
    cuts = cuts.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__cut", "__size",
                       F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    text = docs[text_col]
    both = docs.join(cuts, (F.xxhash64(text) == cuts["__k1"]) & (F.hash(text) == cuts["__k2"]) & (
        F.pmod(F.xxhash64(docs[id_col]), F.lit(SALTS)).cast("int") == cuts["__salt"]), "left")
    cut = F.col("__cut").isNotNull()
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains("__cut", k)), "\n")
    others = [docs[c] for c in docs.columns if c != text_col]
    out = both.select(*others, F.when(cut, kept).otherwise(text).alias(text_col),
                      F.when(cut, F.size("__cut")).otherwise(F.lit(0)).alias("__lines_cut"),
                      F.when(cut, F.col("__size")).otherwise(F.lit(0)).alias("__chars_cut"))
    return out.select(*docs.columns, "__lines_cut", "__chars_cut")
