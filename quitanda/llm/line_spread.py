"""Cross-site boilerplate lines by distinct-site spread.

Every line is hashed; a HyperLogLog sketch of the sites it occurs on is kept per line hash, built
inside each task and merged by aggregation. A line whose estimate is far from the threshold is
decided by it; near the threshold the distinct sites are counted exactly. Lines spread over enough
sites are removed from the documents. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quitanda.session import materialize

MIN_SITES = 10
SKETCH_BITS = 6  # 64 registers: about 13 % standard error
BAND = 0.5  # estimates within this share of the threshold are counted exactly


def normal_line(line: Column) -> Column:
    """A line without ASCII white space at its ends."""
    return F.trim(line, F.lit(" \t\r\x0b\f"))


def line_hashes(text: Column) -> Column:
    """Hashes of the lines of a text in order; 0 stands for an empty line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                       lambda x: F.when(normal_line(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(normal_line(x))))


def _key(id_col: str, text_col: str) -> Column:
    """What a row's marks are found by: its id, or its text where it has none. Equal keys do no harm,
    for a spread line is spread wherever it stands."""
    return F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col).cast("string")))


def _lines(docs: DataFrame, key: Column, text_col: str, site_col: str) -> DataFrame:
    """(key, site, lines): distinct line hashes of each document; a null site stays null."""
    site = F.col(site_col).cast("string")
    lines = F.array_distinct(line_hashes(F.col(text_col).cast("string")))
    return docs.select(key.alias("key"), F.when(site.isNotNull(), F.xxhash64(site)).alias("site"),
                       F.filter(lines, lambda x: x != 0).alias("lines"))


def _spread(hashed: DataFrame, min_sites: int) -> DataFrame:
    lines = hashed.filter("site is not null").select("site", F.explode("lines").alias("line"))
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    # A task hands on one sketch per line, however often it met the line.
    counted = materialize(lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites")).filter(F.col("sites") >= low), "spread-sites")
    near = counted.filter(F.col("sites") <= high).select("line")
    # Distinct pairs first: in the join a line then weighs its sites, not its occurrences.
    exact = (lines.distinct().join(near, "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites"))
             .filter(F.col("sites") >= min_sites).select("line", "sites", F.lit(True).alias("exact")))
    return counted.filter(F.col("sites") > high).select("line", "sites", F.lit(False).alias("exact")).union(exact)


def spread_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites, exact): hashes of the lines found on ``min_sites`` distinct sites or more.

    ``sites`` is the exact count where ``exact``, else the estimate. Null sites are no site.
    """
    return _spread(_lines(docs, F.lit(0), text_col, site_col), min_sites)


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
               min_sites: int = MIN_SITES) -> DataFrame:
    """(key, lines): per document that has any, the hashes of its widely spread lines."""
    hashed = materialize(_lines(docs, _key(id_col, text_col), text_col, site_col), "spread-hashes")
    spread = materialize(_spread(hashed, min_sites), "spread-found")
    return (hashed.select("key", F.explode("lines").alias("line")).join(spread.select("line"), "line")
            .groupBy("key").agg(F.collect_set("line").alias("lines")))


def clean_text(text: Column, lines: Column) -> Column:
    """The text without the given lines, or as it was if nothing but blank lines would be left."""
    def kept(x):
        return F.when(normal_line(x) == "", True).otherwise(~F.array_contains(lines, F.xxhash64(normal_line(x))))

    left = F.array_join(F.filter(F.split(text, "\n", -1), kept), "\n")
    whole = F.translate(left, " \t\r\x0b\f\n", "") == ""
    return F.when(lines.isNull() | whole, text).otherwise(left)


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                     min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the lines that occur on ``min_sites`` or more sites taken out of the texts.

    Lines are compared without white space at their ends; blank lines stay. A text of which nothing of
    its own would be left stays as it is. All rows and columns are kept. Null texts stay null. Rows with
    a null id lose their lines like all others; repeated ids share their lines' marks, which changes
    nothing, for a spread line is spread wherever it stands. Ties cannot occur: the threshold itself
    counts as spread. An empty table gives an empty result.
    """
    marked = mark_lines(docs, id_col, text_col, site_col, min_sites).select(
        F.col("key").alias("_marked"), F.col("lines").alias("_lines"))
    joined = docs.join(marked, _key(id_col, text_col) == F.col("_marked"), "left")
    return joined.withColumn(text_col, clean_text(F.col(text_col), F.col("_lines"))).drop("_marked", "_lines")
