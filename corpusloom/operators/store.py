"""Content-addressed maintenance of a chunk store: diffs by id, upsert, refresh, delete, and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNSECTIONED = "(unsectioned)"


def existing_ids(store: DataFrame, source: str) -> DataFrame:
    """The ids of a source; only the two columns are read."""
    return store.where(F.col("source") == source).select("id")


def new_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    return chunks.join(store.select("id"), "id", "left_anti")


def orphans(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Stored rows that the new chunks no longer have."""
    return store.join(chunks.select("id"), "id", "left_anti")


def unchanged_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """New chunks that are stored already; repeated ones stay repeated."""
    return chunks.join(store.select("id"), "id", "left_semi")


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row for each id: the one that sorts first by all its columns."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace the stored ones of their id; of rows with one id, one counts."""
    fresh = one_per_id(rows)
    return store.join(fresh.select("id"), "id", "left_anti").select(*store.columns).unionByName(fresh)


def refresh_metadata(store: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Stored rows take these columns from the new chunk of their id, where there is one."""
    new = one_per_id(chunks.select("id", *columns)).select(F.col("id"), *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = store.join(new, "id", "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in store.columns))


def delete_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti").select(*store.columns)


def diff_stats(chunks: DataFrame, store: DataFrame, by: str | None = None) -> DataFrame:
    """``total, added, removed, unchanged`` in one row, or in one for each value of ``by``; repeated new chunks count each, removed ids once."""
    key = [by] if by else []
    new = chunks.groupBy(*key, "id").agg(F.count("*").alias("k"))
    old = store.select(*key, "id").distinct().withColumn("stored", F.lit(True))
    both = new.join(old, [*key, "id"], "full")
    return both.groupBy(*key).agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("stored").isNull(), F.col("k"))), F.lit(0)).alias("added"),
        F.count(F.when(F.col("k").isNull(), 1)).alias("removed"),
        F.coalesce(F.sum(F.when(F.col("stored"), F.col("k"))), F.lit(0)).alias("unchanged"),
    )


def diff_summary(added: DataFrame, removed: DataFrame, by: str | None = None) -> DataFrame:
    """By section, or by ``by`` and section: chunks added and removed and the pages they span, most changed first."""
    key = [by] if by else []
    rows = added.select(*key, "section", "page_start", "page_end", F.lit(1).alias("a")).unionByName(removed.select(*key, "section", "page_start", "page_end", F.lit(0).alias("a")))
    section = F.when(F.coalesce("section", F.lit("")) == "", UNSECTIONED).otherwise(F.col("section"))
    return (
        rows.groupBy(*key, section.alias("section"))
        .agg(F.sum("a").alias("added"), F.sum(1 - F.col("a")).alias("removed"), F.min("page_start").alias("page_lo"), F.max("page_end").alias("page_hi"))
        .orderBy(*key, F.desc(F.col("added") + F.col("removed")), "section")
    )


def changed_sources(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Fetched ``(name, sha256)`` whose hash differs from the known one; unknown names count as changed."""
    before = known.select("name", F.col("sha256").alias("_before"))
    return fetched.join(before, "name", "left").where(F.coalesce("_before", F.lit("")) != F.col("sha256")).drop("_before")
