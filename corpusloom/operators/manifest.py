"""Component names that the section paths of a corpus imply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_phrase

#: The endings that mark a path segment as a component's. Fixed values.
ENDING = r"^(.*?)\s+(?:Detailed Design|Model)$"


def manifest_counts(chunks: DataFrame, section: str = "section") -> DataFrame:
    """``(name, n)``: how many chunks' path segments name each component; segments count as often as they occur."""
    segment = F.explode(F.split(F.col(section), "›")).alias("segment")
    names = chunks.select(segment).select(F.regexp_extract(F.trim("segment"), ENDING, 1).alias("name"))
    return names.where((F.length("name") > 2) & (F.length("name") < 40)).groupBy("name").agg(F.count("*").alias("n"))


def fold_names(counts: DataFrame, min_count: int = 5) -> DataFrame:
    """Names of at least ``min_count`` that contain no other such name as whole words.

    Containment is transitive and implies greater length, so this is the same as keeping shorter names first.
    The names are a vocabulary, small beside the corpus; a names' join on shared words keeps it from being a cross join.
    """
    names = counts.where(F.col("n") >= min_count)
    word = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: w != "")))
    # a contained name's first word is a word of the containing name
    long = names.select(F.col("name").alias("long"), word(F.col("name")).alias("w"))
    short = names.select(F.col("name").alias("short"), F.lower(F.element_at(F.filter(F.split("name", r"(?U)\W+"), lambda w: w != ""), 1)).alias("w"))
    holds = long.join(short, "w").where((F.col("long") != F.col("short")) & contains_phrase(F.col("long"), F.col("short"))).select(F.col("long").alias("name")).distinct()
    return names.join(holds, "name", "left_anti")


def component_manifest(chunks: DataFrame, section: str = "section", min_count: int = 5, cap: int = 60) -> DataFrame:
    """The ``cap`` most frequent folded names, ``(name, n)``; ties go to the shorter, then the alphabetically first."""
    return fold_names(manifest_counts(chunks, section), min_count).orderBy(F.desc("n"), F.length("name"), "name").limit(cap)
