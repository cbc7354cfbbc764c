"""The registry of sources: a small dimension of names, addresses and versions, templated from one version string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_registry(templates: DataFrame) -> DataFrame:
    """``(name, url, web_url, product, version, kind)`` from templates of these columns.

    ``{version}`` becomes the version and ``{slug}`` the version with dashes for dots.
    """
    slug = F.replace("version", F.lit("."), F.lit("-"))
    fill = lambda c: F.replace(F.replace(c, F.lit("{version}"), F.col("version")), F.lit("{slug}"), slug)
    return templates.select(*(fill(F.col(c)).alias(c) for c in ("name", "url", "web_url")), "product", "version", "kind")


def sources_by_name(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") == name)


def scan_files(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """``(name, path, bytes, sha256, content)`` of the documents and sheets below a folder, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.(?:pdf|xlsx)$", 1)
    found = files.where(F.lower("path").rlike(r"\.(pdf|xlsx)$")).select(stem.alias("name"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
    return (found.where(F.col("name") == only) if only else found).orderBy("path")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """The metadata written beside each fetched file; malformed ones are dropped."""
    schema = "name string, url string, product string, version string, last_modified string, sha256 string, bytes bigint, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").json(path)
    return rows.where("name is not null and _bad is null").drop("_bad")
