"""The update log: JSON lines, appended to and read back strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import grouped

# The fields of an entry, and those that each entry has.
FIELDS = {
    "ts": "string", "source": "string", "broadcom_last_modified": "string", "sha256": "string", "bytes": "bigint", "chunks_before": "bigint", "chunks_after": "bigint",
    "duration_sec": "double", "chunks_added": "bigint", "chunks_removed": "bigint", "diff_sections": "array<struct<section:string,added:int,removed:int,pages:array<int>>>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
REQUIRED = ("ts", "source", "broadcom_last_modified", "sha256", "bytes", "chunks_before", "chunks_after", "duration_sec")


def append_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_entries(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries of ``(line)``, latest first. Blank and malformed lines, and those with unknown or without required fields, are dropped."""
    keys = F.json_object_keys(F.col("line"))
    ok = keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) == 0) & (F.size(F.array_intersect(keys, F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED))
    rows = lines.where(F.trim("line") != "").where(F.coalesce(ok, F.lit(False))).select(F.from_json("line", SCHEMA).alias("e")).select("e.*").orderBy(F.desc("ts"), "source", "sha256")
    return rows.limit(limit) if limit else rows


def delta_label() -> Column:
    """What an entry changed: the breakdown if it has one, else the net difference."""
    a, r = F.col("chunks_added"), F.col("chunks_removed")
    seconds = F.when(F.coalesce("duration_sec", F.lit(0.0)) != 0, F.concat(F.floor(F.col("duration_sec") + 0.5).cast("string"), F.lit("s"))).otherwise("")
    parts = F.concat_ws(", ", F.when(a > 0, F.concat(F.lit("+"), grouped(a), F.lit(" new"))), F.when(r > 0, F.concat(F.lit("-"), grouped(r), F.lit(" removed"))))
    d = F.col("chunks_after") - F.col("chunks_before")
    net = F.when(d == 0, "±0").when(d > 0, F.concat(F.lit("+"), d.cast("string"))).otherwise(d.cast("string"))
    what = F.when(a.isNotNull() & r.isNotNull(), F.when((a == 0) & (r == 0), "no diff").otherwise(parts)).otherwise(net)
    return F.concat(what, F.lit(", "), seconds)
