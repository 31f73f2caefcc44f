"""Removal of repeated lines by overlapping three-line windows, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Lines of a window.
LINES = 3
#: Characters of blank lines.
SPACES = " \t\n\x0b\x0c\r"


def _windows(lines: Column) -> Column:
    """An array of (h1, h2, pos), one for each window that isn't all blank.

    Two 64-bit hashes make a window's 128-bit name.
    """

    def name(i: Column) -> Column:
        parts = [F.element_at(lines, (i + k).cast("int")) for k in range(1, LINES + 1)]
        blank = F.trim(F.concat(*parts), F.lit(SPACES)) == ""
        return F.when(~blank, F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("h2"), i.cast("int").alias("pos")))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - LINES), name), lambda w: w.isNotNull())


def later_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos`` of each window that stands earlier too: in a smaller doc_id, or above in the same text."""
    lines = F.split(F.col(text_col), "\n", -1)
    source = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines")).where(F.col("doc_id").isNotNull() & (F.size("lines") >= LINES))
    windows = source.select("doc_id", F.explode(_windows(F.col("lines"))).alias("w")).select("doc_id", "w.h1", "w.h2", "w.pos")
    here = F.struct("doc_id", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(F.col("first") < F.col("last")).select("h1", "h2", "first")
    return windows.join(first, ["h1", "h2"]).where(here > F.col("first")).select("doc_id", "pos")


def remove_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "lines_removed") -> DataFrame:
    """The rows of docs with ``lines_removed`` (int), their texts without repeated lines.

    Windows of three consecutive lines (cut at ``\\n``) are compared over all
    documents, in the order of doc_id and position.  Every line that a later
    occurrence covers goes; windows that overlap are merged.  The first
    occurrence stays, and so does a text of fewer than three lines, a row
    without doc_id, and a null text (0 lines removed).  Windows of three blank
    lines (spaces, tabs, carriage returns and the like) don't count.  A text of which all lines go is empty; the row stays.
    Rows that share a doc_id stand at the same place: they aren't earlier than
    each other, and each loses the lines found in either.  An empty table gives
    no rows.  Other columns stay; one named ``removed_col`` is replaced.
    """
    mark, covered, cut, left = (unused(f"_tidemark_{name}", docs) for name in ("id", "covered", "lines", "kept"))
    starts = later_windows(docs, id_col=id_col, text_col=text_col)
    per_doc = starts.groupBy(F.col("doc_id").alias(mark)).agg(F.collect_set("pos").alias(covered))
    found = F.col(covered).isNotNull() & F.col(text_col).isNotNull()
    # Lines and kept positions are columns of their own, made once a row; each is read several times below.
    lines = F.when(found, F.split(F.col(text_col), "\n", -1))
    positions = F.array_distinct(F.flatten(F.transform(F.col(covered), lambda p: F.sequence(p, p + LINES - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), positions)
    out = docs.join(per_doc, F.col(id_col) == F.col(mark), "left").withColumn(cut, lines).withColumn(left, kept)
    text = F.array_join(F.transform(F.col(left), lambda i: F.get(F.col(cut), i)), "\n")
    removed = F.size(cut) - F.size(left)
    columns = [F.when(found, text).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns if c != removed_col]
    return out.select(*columns, F.when(found, removed).otherwise(0).alias(removed_col))
