"""Merging ordered abbreviation tables: the last writer of an abbreviation wins, its place is that of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(rows: DataFrame, *, amendments: str = "unabbr-amendments.csv") -> DataFrame:
    """abbr, full, source, pos from (full, abbr, source, load_ord, row_ord).

    Rows without either name, and those whose abbreviation begins with #, are left out. A row of the amendments
    with '. ' in its abbreviation also enters without stops, right after itself. One shuffle on abbr, whose partial
    step keeps one row per key and task.
    """
    kept = rows.where((F.length("full") > 0) & (F.length("abbr") > 0) & ~F.col("abbr").startswith("#"))
    bare = F.replace(F.regexp_replace("abbr", r"\.$", ""), F.lit(". "), F.lit(" "))
    also = (F.col("source") == amendments) & F.col("abbr").contains(". ")
    both = F.when(also, F.array(F.col("abbr"), bare)).otherwise(F.array("abbr"))
    each = kept.select("full", "source", "load_ord", "row_ord", F.posexplode(both).alias("sub", "abbr"))
    at = F.struct("load_ord", "row_ord", "sub")
    return each.groupBy("abbr").agg(F.max_by(F.struct("full", "source"), at).alias("last"), F.min(at).alias("pos")).select("abbr", "last.full", "last.source", "pos")
