"""Greedy paragraph packing into overlapping chunks, as a native fold over token counts.

With additive tokens (see :func:`corpusloom.functions.text.tokens`; another tokenizer can be injected, whose counts are taken as additive too)
chunk boundaries depend on integers only. One ``aggregate`` folds the pieces' counts into token intervals, and each chunk is rebuilt by
slicing the token array before chunks become rows, so no row carries more than its own text. A group (one document, or one atomic-free segment
of a source) is a row, so nothing shuffles beyond gathering a source's pages. As packing runs on over the pages of a segment, a segment is
packed in one task by nature; it holds one source's prose between two tables, not a corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import content_id, paragraphs, strip, token_arrays, token_count, tokens


Tokenizer = Callable[[str], list[str]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where a lambda would repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(t: Column, target: int) -> Column:
    """A paragraph's tokens as one piece, or as slices if there are over ``target``."""
    n = F.size(t)
    sliced = F.transform(F.sequence(F.lit(1), n, F.lit(target)), lambda i: F.struct(F.slice(t, i, F.lit(target)).alias("tok"), F.lit(True).alias("over")))
    return F.when(n <= target, F.array(F.struct(t.alias("tok"), F.lit(False).alias("over")))).otherwise(sliced)


def pieces(text: Column, target: int, delimiter: str = "\n\n", tokenizer: Tokenizer | None = None) -> Column:
    """``array<struct<tok, over>>``: paragraphs as token arrays, those of over ``target`` tokens cut into slices."""
    return F.flatten(F.transform(token_arrays(paragraphs(text, delimiter), tokenizer), lambda t: _cut(t, target)))


def hard_split(df: DataFrame, text: str, target: int, delimiter: str = "\n\n") -> DataFrame:
    """One row for each slice of the oversize paragraphs: ``par, slice, n_tokens, slice_text``."""
    par = df.select("*", F.posexplode(paragraphs(F.col(text), delimiter)).alias("par", "p")).withColumn("t", tokens(F.col("p"))).where(F.size("t") > target)
    sliced = par.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t"), F.lit(target)), lambda i: F.slice("t", i, F.lit(target)))).alias("slice", "s"))
    return sliced.withColumn("n_tokens", F.size("s")).withColumn("slice_text", F.array_join("s", "")).drop("p", "t", "s")


def fold_intervals(counts: Column, target: int, overlap: int) -> Column:
    """``array<struct<s, e>>`` of token numbers from 1, for ``counts: array<struct<n, over>>``.

    A piece that doesn't fit flushes first and is then always appended; a slice of an oversize paragraph also flushes
    once the buffer is full. A flush leaves the last ``overlap`` tokens as the next buffer, which may be flushed alone.
    """
    interval = "array<struct<s:int,e:int>>"

    def flush(st: Column) -> Column:
        kept = F.greatest(st["s"], st["e"] - F.lit(overlap - 1)) if overlap else st["e"] + 1
        return F.struct(F.concat(st["out"], F.array(F.struct(st["s"].alias("s"), st["e"].alias("e")))).alias("out"), kept.alias("s"), st["e"].alias("e"))

    def size(st: Column) -> Column:
        return st["e"] - st["s"] + 1

    def step(st: Column, p: Column) -> Column:
        before = F.when((size(st) > 0) & (size(st) + p["n"] > target), flush(st)).otherwise(st)
        added = let(before, lambda a: F.struct(a["out"].alias("out"), a["s"].alias("s"), (a["e"] + p["n"]).alias("e")))
        return let(added, lambda b: F.when(p["over"] & (size(b) >= target), flush(b)).otherwise(b))

    zero = F.struct(F.array().cast(interval).alias("out"), F.lit(1).alias("s"), F.lit(0).alias("e"))
    return F.aggregate(counts, zero, step, lambda st: F.when(size(st) > 0, flush(st)["out"]).otherwise(st["out"]))


def chunk_rows(df: DataFrame, parts: Column, target: int, overlap: int, source: Column, keep: list[str]) -> DataFrame:
    """``keep``, then ``id, chunk, tok_start, tok_end, n_tokens, page_start, page_end, section, text`` for each chunk of each row.

    ``parts`` is ``array<struct<page, section, tok, over>>`` in order. A chunk after a flush starts on the page of the last token
    of the chunk before it, and takes its section from the first piece appended since; a chunk of overlap alone has none.
    """
    d = df.withColumn("_parts", parts).withColumn("_parts", F.filter("_parts", lambda p: F.size(p["tok"]) > 0)).where(F.size("_parts") > 0)
    d = d.withColumn("_chunks", fold_intervals(F.transform("_parts", lambda p: F.struct(F.size(p["tok"]).alias("n"), p["over"].alias("over"))), target, overlap))
    # each token with what stands before it, and the piece it belongs to
    d = d.withColumn(
        "_tok", F.flatten(F.transform("_parts", lambda p: F.concat(F.array(F.concat(F.lit("\n\n"), F.element_at(p["tok"], 1))), F.slice(p["tok"], F.lit(2), F.size(p["tok"])))))
    ).withColumn("_of", F.flatten(F.transform("_parts", lambda p, i: F.array_repeat(i + 1, F.size(p["tok"])))))

    def built(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at("_chunks", i))["e"]
        piece = lambda token: F.element_at("_of", token)
        # the first piece appended since the flush: the one after the last token of the chunk before
        fresh = F.when(before.isNull(), F.element_at("_parts", piece(c["s"]))["section"]).when(before < c["e"], F.element_at("_parts", piece(before + 1))["section"])
        start = F.element_at("_parts", piece(F.when(before.isNull() | F.lit(overlap == 0), c["s"]).otherwise(before)))["page"]
        # the size is asked for so that the arrays are used twice, and so computed once for a row instead of in the lambda
        text = F.array_join(F.slice("_tok", c["s"], F.least(c["e"] - c["s"] + 1, F.size("_tok"))), "")
        return F.struct(
            c["s"].alias("tok_start"), c["e"].alias("tok_end"), start.alias("page_start"), F.element_at("_parts", piece(c["e"]))["page"].alias("page_end"),
            fresh.alias("section"), text.alias("text"),
        )

    d = d.select(*keep, source.alias("_source"), F.posexplode(F.transform("_chunks", built)).alias("chunk", "_c"))
    text = F.regexp_replace("_c.text", r"^\s+", "")
    return d.select(
        *keep, content_id(F.col("_source"), text).alias("id"), "chunk", "_c.tok_start", "_c.tok_end", (F.col("_c.tok_end") - F.col("_c.tok_start") + 1).alias("n_tokens"),
        "_c.page_start", "_c.page_end", "_c.section", text.alias("text"),
    )


def document_parts(text: Column, section: Column, target: int, tokenizer: Tokenizer | None = None) -> Column:
    """Parts of a document whose pages are its lines."""
    lines = token_arrays(F.transform(F.split(text, "\n"), strip), tokenizer)
    part = lambda i: lambda p: F.struct((i + 1).alias("page"), section.alias("section"), p["tok"].alias("tok"), p["over"].alias("over"))
    return F.flatten(F.transform(lines, lambda t, i: F.transform(_cut(t, target), part(i))))


def chunk_documents(docs: DataFrame, target: int = 800, overlap: int = 100, text: str = "text", source: str = "source", section: str | None = None, keep: tuple[str, ...] = ("doc_id",), tokenizer: Tokenizer | None = None) -> DataFrame:
    """Chunks of documents whose pages are their lines; each document is packed on its own, without any shuffle."""
    sec = F.col(section) if section else F.lit(None).cast("string")
    return chunk_rows(docs, document_parts(F.col(text), sec, target, tokenizer), target, overlap, F.col(source), list(keep))


def chunk_pages(pages: DataFrame, target: int = 800, overlap: int = 100, delimiter: str = "\n\n", tokenizer: Tokenizer | None = None) -> DataFrame:
    """``source, segment, id, chunk, …`` for pages ``(source, ord, page_num, text, section, atomic)``.

    Packing runs on over the pages of a source. An atomic page is a chunk of its own, and nothing is carried across it:
    the pages between two atomic ones are a segment.
    """
    run = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    p = pages.withColumn("segment", F.sum(F.col("atomic").cast("int")).over(run))
    prose = (
        p.where("not atomic")
        .select("source", "segment", F.struct("ord", "page_num", "section", pieces(F.col("text"), target, delimiter, tokenizer).alias("ps")).alias("r"))
        .groupBy("source", "segment")
        .agg(F.array_sort(F.collect_list("r")).alias("rs"))
    )
    parts = F.flatten(F.transform("rs", lambda r: F.transform(r["ps"], lambda x: F.struct(r["page_num"].alias("page"), r["section"].alias("section"), x["tok"].alias("tok"), x["over"].alias("over")))))
    packed = chunk_rows(prose, parts, target, overlap, F.col("source"), ["source", "segment"])
    n = F.size(F.element_at(token_arrays(F.array("text"), tokenizer), 1)) if tokenizer else token_count(F.col("text"))
    alone = p.where("atomic").select(
        "source", "segment", content_id(F.col("source"), F.col("text")).alias("id"), F.lit(-1).alias("chunk"), F.lit(1).alias("tok_start"), n.alias("tok_end"), n.alias("n_tokens"),
        F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"), "section", "text",
    )
    return packed.unionByName(alone)


def fixed_batches(df: DataFrame, size: int, partition: list[str], order: list[str]) -> DataFrame:
    """With ``batch``: rows of a partition in order, so many in each."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / size))


def token_batches(counts: Column, budget: int) -> Column:
    """The batch of each item, from 0, for an array of token counts.

    An item of the whole budget or more goes alone and closes the open batch; otherwise a batch is closed when the next item would
    take it over the budget.
    """
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("b"), F.lit(0).alias("sum"))

    def step(st: Column, n: Column) -> Column:
        opened = st["sum"] > 0
        alone = n >= budget
        full = opened & (st["sum"] + n > budget)
        own = st["b"] + F.when(opened & (alone | full), 1).otherwise(0)
        return F.struct(F.concat(st["out"], F.array(own)).alias("out"), (own + F.when(alone, 1).otherwise(0)).alias("b"), F.when(alone, 0).when(full, n).otherwise(st["sum"] + n).alias("sum"))

    return F.aggregate(counts, zero, step, lambda st: st["out"])
