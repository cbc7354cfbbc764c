"""Section paths from an outline, and their as-of attachment to pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Between the titles of a path; the title that never counts. Fixed values.
SEPARATOR, SKIPPED = " › ", "table of contents"


def section_paths(outline: DataFrame, by: str = "source") -> DataFrame:
    """With ``n`` and ``path``: the titles open at each entry of ``(by, ord, level, title, page)``, outermost first.

    Entries go by page and level; blank titles and the contents' own are left out before that, and close nothing. An entry
    closes those of its level and deeper, so a level is open if its last entry is later than any of a lower level. That takes
    one sort and a running maximum for each level that occurs (their numbers, few by nature, are read first), and no growing state.
    A source's entries are sorted in one task, as each path depends on all entries before it. Ties of page and level go by ``ord``;
    a null title or level is left out, an empty table gives no rows.
    """
    rows = outline.withColumn("title", F.regexp_replace("title", r"(?U)^\s+|\s+$", "")).where((F.col("title") != "") & (F.lower("title") != SKIPPED) & F.col("level").isNotNull())
    levels = sorted(r.level for r in rows.select("level").distinct().collect())
    order = Window.partitionBy(by).orderBy("page", "level", "ord")
    numbered = rows.withColumn("n", F.row_number().over(order))
    run = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("level") == k, F.struct("n", "title"))).over(run) for k in levels]
    numbered = numbered.select("*", *(c.alias(f"_l{k}") for k, c in enumerate(last)))
    titles, lower = [], F.lit(0)
    for k in range(len(levels)):
        at = F.coalesce(F.col(f"_l{k}.n"), F.lit(0))
        titles.append(F.when(at > lower, F.col(f"_l{k}.title")))
        lower = F.greatest(lower, at)
    return numbered.withColumn("path", F.concat_ws(SEPARATOR, *titles)).drop(*(f"_l{k}" for k in range(len(levels))))


def attach_sections(pages: DataFrame, paths: DataFrame, by: str = "source", page: str = "page") -> DataFrame:
    """``pages`` with ``section``: the last outline state at or before each page; null before the first."""
    last = paths.groupBy(by, F.col("page").alias(page)).agg(F.max_by("path", "n").alias("_path"))
    both = pages.withColumn("_kind", F.lit(1)).unionByName(last.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    run = Window.partitionBy(by).orderBy(page, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section", F.last("_path", ignorenulls=True).over(run)).where("_kind = 1").drop("_kind", "_path")
