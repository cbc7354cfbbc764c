"""Keeping a chunk store up to date: full index, incremental index by source, and the update job with its log."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import store as ops

METADATA = ["source", "page_start", "page_end", "section"]


def part_of(source: Column, parts: int) -> Column:
    """The part of a store in which a source's rows lie."""
    return F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(parts)).cast("int")


@dataclass
class StoreTable:
    """A store of rows with a ``source``, kept as Parquet below ``path`` in parts of whole sources.

    A write makes new folders for the parts that it replaces and then a new manifest, a small file that names each part's folder. The
    manifest appears by one rename, so a job that dies before it leaves the store as it was. Parts that don't change
    aren't rewritten. Folders that neither the current nor the last manifest names are removed.
    """

    spark: SparkSession
    path: str
    parts: int = 64

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        p, fs = self._file("manifests")
        return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json")) if fs.exists(p) else []

    def _load(self, name: str) -> dict[int, str]:
        p, fs = self._file(f"manifests/{name}")
        raw = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(raw, "UTF-8")
        finally:
            raw.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def folders(self) -> dict[int, str]:
        """The current folder of each part that has one."""
        names = self._manifests()
        return self._load(names[-1]) if names else {}

    def read(self, schema: str, sources: DataFrame | None = None) -> DataFrame:
        """All rows, or those of ``sources(source)``: only their parts are read."""
        now = self.folders()
        if sources is not None:
            wanted = {r.part for r in sources.select(part_of(F.col("source"), self.parts).alias("part")).distinct().collect()}
            now = {k: v for k, v in now.items() if k in wanted}
        if not now:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{v}" for _, v in sorted(now.items())))

    def write(self, df: DataFrame, sources: DataFrame | None = None) -> None:
        """Replaces the whole store by ``df``, or the parts in which ``sources`` lie by the rows that ``df`` has for them."""
        names = self._manifests()
        old = self._load(names[-1]) if names else {}
        number = int(names[-1].split(".")[0]) + 1 if names else 0
        folder = f"data/{number:012d}"
        df.withColumn("_part", part_of(F.col("source"), self.parts)).write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/{folder}")
        p, fs = self._file(folder)
        fresh = {int(n.split("=")[1]): f"{folder}/{n}" for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("_part=")}
        gone = set(old) if sources is None else {r.part for r in sources.select(part_of(F.col("source"), self.parts).alias("part")).distinct().collect()}
        now = {k: v for k, v in old.items() if k not in gone} | fresh
        temporary, fs = self._file(f"manifests/{number:012d}.part")
        out = fs.create(temporary, True)
        try:
            out.write(bytearray(json.dumps(now).encode()))
        finally:
            out.close()
        final, _ = self._file(f"manifests/{number:012d}.json")
        if not fs.rename(temporary, final):
            raise OSError(f"another job has written {final}")
        self._clean([*names, f"{number:012d}.json"])

    def _clean(self, names: list[str]) -> None:
        kept = {v for n in names[-2:] for v in self._load(n).values()}
        for n in names[:-2]:
            for v in self._load(n).values():
                if v not in kept:
                    p, fs = self._file(v)
                    fs.delete(p, True)
            p, fs = self._file(f"manifests/{n}")
            fs.delete(p, False)

    def reset(self) -> None:
        """An empty store, by a manifest that names no folder."""
        self.write(self.spark.createDataFrame([], "source string"))


def index_full(chunks: DataFrame) -> DataFrame:
    """The store's rows from nothing: one for each id."""
    return ops.one_per_id(chunks)


def index_incremental(store: DataFrame, chunks: DataFrame, sources: DataFrame | None = None, keep_when_empty: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(new store, stats, summary)`` of an update of some sources: unchanged rows get new metadata, new ones are added, orphans deleted.

    Only stored rows of ``sources(source)``, by default those that ``chunks`` has, are compared, and only they can be orphans. A source
    without new chunks stays as it is, as its extraction may have failed, unless ``keep_when_empty`` is off. ``stats`` has a row for each
    source (``source, total, added, removed, unchanged``), ``summary`` one for each source and section.
    """
    having = chunks.select("source").distinct()
    scope = having if sources is None else sources.select("source").distinct()
    if keep_when_empty and sources is not None:
        scope = scope.join(having, "source", "left_semi")
    chunks = chunks.join(scope, "source", "left_semi").select(*chunks.columns)
    own = store.join(scope, "source", "left_semi").select(*store.columns)
    rest = store.join(scope, "source", "left_anti").select(*store.columns)
    added, gone = ops.one_per_id(ops.new_chunks(chunks, own)).select(*store.columns), ops.orphans(chunks, own)
    kept = ops.refresh_metadata(ops.delete_ids(own, gone), chunks, [c for c in METADATA if c in store.columns])
    return rest.unionByName(kept).unionByName(added), ops.diff_stats(chunks, own, "source"), ops.diff_summary(added, gone, "source")


def update_job(table: StoreTable, chunks: DataFrame, schema: str, known: DataFrame, fetched: DataFrame, ts: str, force: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """Runs an update and returns its log entries, one for each changed source.

    Nothing runs if no source changed. As a run is one event, each entry bears the run's totals over all sources and the
    store's counts before and after; what changed by section is the source's own. With ``force`` the store starts empty. The store is
    committed first; the caller logs the entries and then saves the new hashes, so that a crash in between repeats the update and never skips it.
    """
    changed = fetched if force else ops.changed_sources(fetched, known)
    if changed.isEmpty():
        return changed.select(F.lit(ts).alias("ts"), F.col("name").alias("source")).limit(0)
    before = table.read(schema).count()
    touched = chunks.select("source").distinct() if sources is None else sources.select("source").distinct()
    if force:
        new = index_full(chunks)
        stats, summary = ops.diff_stats(chunks, new.limit(0), "source"), None
        rows = stats.agg(F.sum("added").alias("added"), F.sum("removed").alias("removed")).first()
        table.write(new)
    else:
        store = table.read(schema, touched)
        new, stats, summary = index_incremental(store, chunks, touched)
        rows = stats.agg(F.sum("added").alias("added"), F.sum("removed").alias("removed")).first()
        sections = summary.groupBy("source").agg(
            F.collect_list(F.struct("section", F.col("added").cast("int").alias("added"), F.col("removed").cast("int").alias("removed"), F.array("page_lo", "page_hi").cast("array<int>").alias("pages"))).alias("diff_sections")
        )
        sections = changed.sparkSession.createDataFrame(sections.collect(), sections.schema)  # a row for each source, read before the store changes
        table.write(new, touched)
    after = table.read(schema).count()
    entries = changed.select(
        F.lit(ts).alias("ts"), F.col("name").alias("source"), "sha256", F.lit(before).alias("chunks_before"), F.lit(after).alias("chunks_after"),
        F.lit(rows.added or 0).cast("long").alias("chunks_added"), F.lit(rows.removed or 0).cast("long").alias("chunks_removed"),
    )
    return entries if summary is None else entries.join(sections, "source", "left")
