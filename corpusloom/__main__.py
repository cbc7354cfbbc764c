"""Commands over a store: ``python -m corpusloom COMMAND``. Models, parsers, engines and transports are named as ``module:attribute``."""

from __future__ import annotations

import argparse
import importlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import now_iso
from corpusloom.operators import answers, chunking, embedding, sizing
from corpusloom.plans.ask import Models, ask
from corpusloom.plans.maintenance import StoreTable, index_full, update_job
from corpusloom.sources import changelog, fetch, pages, registry

STORE = "id string, source string, page_start int, page_end int, section string, text string"


def hook(name: str):
    """What ``module:attribute`` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def chunks_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Chunks of the files below a folder, with vectors if an encoder is named."""
    files = registry.scan_files(spark, a.files, a.only)
    parts = pages.extract_sources(files, hook(a.parser), hook(a.sheets) if a.sheets else lambda _: {}, hook(a.tables) if a.tables else None)
    chunks = chunking.chunk_pages(parts, a.target, a.overlap).select("id", "source", "page_start", "page_end", "section", "text")
    return embedding.embed(chunks, hook(a.encode), a.model) if a.encode else chunks


def schema_of(a: argparse.Namespace) -> str:
    return STORE + (", embedding array<float>" if a.encode else "")


def run_fetch(spark: SparkSession, a: argparse.Namespace) -> None:
    sources = registry.source_registry(spark.read.json(a.registry))
    fetch.fetch_sources(sources, a.files, hook(a.transport), a.force).show(truncate=False)


def run_index(spark: SparkSession, a: argparse.Namespace) -> None:
    StoreTable(spark, a.store).write(index_full(chunks_of(spark, a)))


def run_update(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fetches, and updates the store and its log if a source changed."""
    began = time.time()
    known = registry.read_sidecars(spark, f"{a.files}/*.meta.json") if not a.first else spark.createDataFrame([], "name string, sha256 string")
    known = spark.createDataFrame(known.select("name", "sha256").collect(), "name string, sha256 string")  # before the sidecars change
    got = fetch.fetch_sources(registry.source_registry(spark.read.json(a.registry)), a.files, hook(a.transport), a.force)
    chunks = chunks_of(spark, a)
    entries = update_job(StoreTable(spark, a.store), chunks, schema_of(a), known, got, now_iso(), a.force)
    if entries.isEmpty():
        return
    told = got.select(F.col("name").alias("source"), F.col("last_modified").alias("broadcom_last_modified"), "bytes")
    entries = entries.join(told, "source").withColumn("duration_sec", F.lit(round(time.time() - began, 1)))
    changelog.append_entries(entries.select(*(c for c in changelog.FIELDS if c in entries.columns)), a.log)


def run_status(spark: SparkSession, a: argparse.Namespace) -> None:
    store = StoreTable(spark, a.store).read(STORE)
    log = changelog.parse_entries(changelog.read_lines(spark, a.log)) if a.log else spark.createDataFrame([], "ts string, source string")
    print(json.dumps(answers.status(store, log).first().asDict()))


def run_changelog(spark: SparkSession, a: argparse.Namespace) -> None:
    for entry in changelog.parse_entries(changelog.read_lines(spark, a.log), a.limit).collect():  # at most the limit
        print(json.dumps(entry.asDict(recursive=True), ensure_ascii=False))


def run_ask(spark: SparkSession, a: argparse.Namespace) -> None:
    store = StoreTable(spark, a.store).read(STORE + ", embedding array<float>").withColumn("vec_id", F.xxhash64("id"))
    models = Models(hook(a.encode), hook(a.extract) if a.extract else None, hook(a.rerank) if a.rerank else None)
    hits = ask(a.question, store, models, key=a.store)
    for r in hits.join(store.drop("embedding"), "vec_id").orderBy("new_pos").collect():  # at most the settings' top-k
        print(f"[{r.source} p.{r.page_start}-{r.page_end}] {r.text[:200]}")


def run_plan(spark: SparkSession, a: argparse.Namespace) -> None:
    given = [(0, *x.split("=", 1)) for x in a.inputs] or [(0, "", "")]
    cells = sizing.compute(sizing.plan_overrides(spark.createDataFrame(given, "plan int, name string, value string"), "plan"), "plan", hook(a.engine)).cache()
    sizing.components(sizing.component_cells(cells, "plan")).show(truncate=False)
    sizing.totals_row(cells, "plan").show(truncate=False)
    sizing.host_summary(sizing.summary_cells(cells, "plan")).orderBy("ord").show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for option, how in options:
            p.add_argument(option, **how)

    need, may, flag = {"required": True}, {"default": None}, {"action": "store_true"}
    files = [("--files", need), ("--parser", need), ("--sheets", may), ("--tables", may), ("--encode", may), ("--model", {"default": ""}), ("--only", may), ("--target", {"type": int, "default": 800}), ("--overlap", {"type": int, "default": 100})]
    command("fetch", run_fetch, ("--registry", need), ("--files", need), ("--transport", need), ("--force", flag))
    command("index", run_index, ("--store", need), *files)
    command("update", run_update, ("--store", need), ("--log", need), ("--registry", need), ("--transport", need), ("--force", flag), ("--first", flag), *files)
    command("status", run_status, ("--store", need), ("--log", may))
    command("changelog", run_changelog, ("--log", need), ("--limit", {"type": int, "default": 50}))
    command("ask", run_ask, ("question", {}), ("--store", need), ("--encode", need), ("--extract", may), ("--rerank", may))
    command("plan", run_plan, ("inputs", {"nargs": "*", "metavar": "name=value"}), ("--engine", need))
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName("corpusloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
