"""Pages of documents: cleaning, tables as atomic pages, and the order in which they follow each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_text, strip
from corpusloom.operators.reftables import parse_tables as parse_reference_tables
from corpusloom.operators.reftables import sizing_sentences, table_text

PAGE_SCHEMA = "source string, ord long, page_num int, text string, section string, atomic boolean"


def parse_files(files: DataFrame, parser: Callable[[bytes], Iterable[tuple[int, str]]]) -> DataFrame:
    """``(source, page_num, text)`` of files ``(name, content)`` by an injected parser, file by file on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                pages = list(parser(bytes(content)))
                yield pd.DataFrame({"source": [name] * len(pages), "page_num": [p for p, _ in pages], "text": [t for _, t in pages]})

    return files.select("name", "content").mapInPandas(run, "source string, page_num int, text string")


def parse_page_tables(files: DataFrame, pages_of: Callable[[bytes], Iterable[tuple[int, Callable[[], Iterable[str]]]]], only_pages: Iterable[int] | None = None) -> DataFrame:
    """``(source, ord, page_num, markdown)`` of the tables in files ``(name, content)``, in order from 1.

    ``pages_of`` gives each page's number with a function that finds its tables. A page whose function fails is skipped; with ``only_pages``
    other pages aren't looked at.
    """
    only = None if only_pages is None else frozenset(only_pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                out = []
                for number, tables in pages_of(bytes(content)):
                    if only is not None and number not in only:
                        continue
                    try:
                        found = list(tables())
                    except Exception:  # noqa: BLE001, S112  whatever an injected table finder raises concerns its page only
                        continue
                    out += [(name, number, markdown) for markdown in found]
                yield pd.DataFrame([(n, k, p, m) for k, (n, p, m) in enumerate(out, 1)], columns=["source", "ord", "page_num", "markdown"])

    return files.select("name", "content").mapInPandas(run, "source string, ord long, page_num int, markdown string")


# The sheet of reference tables, and what its pages' section starts with.
SHEET, BOOK = "Static Reference Tables", "Planning and Preparation Workbook"


def parse_sheets(files: DataFrame, reader: Callable[[bytes], dict[str, Iterable[tuple]]], sheet: str = SHEET) -> DataFrame:
    """``(source, ord, b, c)``: columns B and C of the sheet of reference tables in workbooks ``(name, content)``, as stripped texts.

    ``reader`` gives each sheet's rows of (B, C) values. A workbook without the sheet has no rows; a missing value is an empty text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                rows = [(*r, None, None)[:2] for r in reader(bytes(content)).get(sheet, ())]
                told = [("" if b is None else str(b).strip(), "" if c is None else str(c).strip()) for b, c in rows]
                yield pd.DataFrame([(name, i, b, c) for i, (b, c) in enumerate(told, 1)], columns=["source", "ord", "b", "c"])

    return files.select("name", "content").mapInPandas(run, "source string, ord int, b string, c string")


def sheet_pages(cells: DataFrame, sheet: str = SHEET) -> DataFrame:
    """A page for each appliance of the reference tables in ``(source, ord, b, c)``."""
    section = F.lit(f"{BOOK} › {sheet}")
    said = sizing_sentences(parse_reference_tables(cells))
    return said.select("source", F.col("page_num").cast("long").alias("ord"), F.col("page_num").cast("int").alias("page_num"), "text", section.alias("section"), F.lit(True).alias("atomic"))


def extract_sources(files: DataFrame, parser, reader, tables=None, sections: DataFrame | None = None) -> DataFrame:
    """Pages of files ``(name, path, content)`` by suffix: workbooks by their reference tables, all others by ``parser``.

    With ``tables`` (see :func:`parse_page_tables`) the others' tables follow their prose as atomic pages. ``sections(source, page_num, section)`` names
    sections.
    """
    book = F.lower("path").endswith(".xlsx")
    prose = clean_pages(parse_files(files.where(~book), parser)).select("source", F.col("page_num").cast("long").alias("ord"), "page_num", "text")
    named = (lambda df: df.withColumn("section", F.lit(None).cast("string"))) if sections is None else (lambda df: df.join(sections, ["source", "page_num"], "left"))
    pages = named(prose).withColumn("atomic", F.lit(False))
    if tables is not None:
        pages = pages_then_tables(pages, table_pages(named(parse_page_tables(files.where(~book), tables))))
    columns = ["source", "ord", "page_num", "text", "section", "atomic"]
    return pages.select(*columns).unionByName(sheet_pages(parse_sheets(files.where(book), reader)).select(*columns)).where(strip(F.col("text")) != "")


def clean_pages(pages: DataFrame) -> DataFrame:
    """With cleaned text; empty pages are dropped."""
    return pages.withColumn("text", clean_text(F.col("text"))).where("text <> ''")


def table_pages(tables: DataFrame) -> DataFrame:
    """Atomic pages of tables ``(source, ord, page_num, markdown, section)``; tables with little in them are dropped."""
    text = table_text(F.col("markdown"), F.col("section"))
    return tables.select("source", "ord", "page_num", text.alias("text"), "section", F.lit(True).alias("atomic")).where("text <> ''")


def pages_then_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """A source's tables after all its prose, by an offset of their ordinals."""
    last = pages.groupBy("source").agg(F.max("ord").alias("_last"))
    moved = tables.join(last, "source", "left").withColumn("ord", F.col("ord") + F.coalesce("_last", F.lit(0)) + 1).drop("_last")
    columns = ["source", "ord", "page_num", "text", "section", "atomic"]
    return pages.select(*columns).unionByName(moved.select(*columns))
