"""The answer's side: enriched hits, context, messages, citations, checks, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ANY_CITATION, CITATION, cite_tag, page_key, page_label, says_not_found, strip


def enrich_hits(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """With ``pdf_url, web_url``: a sheet links to its file, a document to the page in it, an unknown source to nothing.

    The registry is a dimension of few rows; it isn't hinted, so Spark broadcasts it by its size only.
    """
    s = sources.select(F.col("name").alias("source"), "url", "web_url", "kind")
    link = F.when(F.col("kind") == "xlsx", F.col("url")).when(F.col("url").isNotNull(), F.concat("url", F.lit("#page="), F.col("page_start").cast("string")))
    return hits.join(s, "source", "left").withColumn("pdf_url", link).drop("url", "kind")


def context_header() -> Column:
    tag = cite_tag(F.col("source"), F.col("page_start"), F.col("page_end"))
    section = F.trim(F.coalesce("section", F.lit("")))
    return F.when(section != "", F.concat(tag, F.lit("  ("), section, F.lit(")"))).otherwise(tag)


def context_blocks(hits: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """``(by, context)``: the hits' headers and texts by rank. A question has as many hits as its top-k, so a group is small."""
    block = F.concat_ws("\n", context_header(), F.col("text"))
    grouped = hits.select(*by, F.struct(F.col(rank).alias("r"), block.alias("b")).alias("x")).groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(*by, F.array_join(F.transform("xs", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def history(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(by, n_messages, messages)``: turns of the two speakers with content, in order, as JSON."""
    kept = turns.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    m = kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content")))).alias("m"))
    return m.select(by, F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("messages"))


def split_system(turns: DataFrame, by: str = "conv_id", order: str = "turn", directive: str = "/nothink") -> DataFrame:
    """``(by, system, n_turns)``: system texts joined by empty lines, without a leading directive, and how many other turns there are."""
    g = turns.groupBy(by).agg(
        F.array_sort(F.collect_list(F.when((F.col("role") == "system") & (F.coalesce("text", F.lit("")) != ""), F.struct(F.col(order).alias("o"), "text")))).alias("s"),
        F.count(F.when(F.col("role") != "system", 1)).alias("n_turns"),
    )
    text = strip(F.array_join(F.transform("s", lambda x: x["text"]), "\n\n"))
    bare = F.when(text.startswith(directive), F.regexp_replace(F.expr(f"substring(t, {len(directive) + 1})"), r"^\s+", "")).otherwise(F.col("t"))
    return g.withColumn("t", text).select(by, bare.alias("system"), "n_turns")


def extract_citations(answers: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id_col, idx, source, page_start, page_end)`` of each citation, in order."""
    part = lambda k: F.regexp_extract_all(F.col(text), F.lit(CITATION), F.lit(k))
    z = F.arrays_zip(part(1).alias("s"), part(2).alias("a"), part(3).alias("b"))
    rows = answers.select(id_col, F.posexplode(z).alias("idx", "z"))
    end = F.when(F.col("z.b") != "", F.col("z.b")).otherwise(F.col("z.a"))
    return rows.select(id_col, "idx", F.col("z.s").alias("source"), F.col("z.a").cast("int").alias("page_start"), end.cast("int").alias("page_end"))


def resolve_citations(citations: DataFrame, cards: DataFrame, by: str) -> DataFrame:
    """Each citation ``(by, idx, page_start, page_end)`` with the ``pos`` of its card: equal pages first, else an equal first page, then card order."""
    c = cards.select(by, "pos", F.col("page_start").alias("_s"), F.col("page_end").alias("_e"))
    hit = citations.join(c, (citations[by] == c[by]) & (citations["page_start"] == c["_s"]), "left").drop(c[by])
    rank = F.when(page_key(F.col("page_start"), F.col("page_end")) == page_key(F.col("_s"), F.col("_e")), 0).otherwise(1)
    best = F.min(F.when(F.col("pos").isNotNull(), F.struct(rank.alias("k"), "pos"))).alias("best")
    return hit.groupBy(by, "idx", "page_start", "page_end").agg(best).select(by, "idx", "page_start", "page_end", F.col("best.pos").alias("pos"))


def under_optional(text: Column, component: Column) -> Column:
    """Whether the component's first mention is at or below a heading that says optional. Native: a fold over lines."""
    lines = F.split(text, "\n")

    def step(st: Column, line: Column) -> Column:
        s = strip(line)
        head = s.startswith("#") | (s.startswith("**") & s.endswith("**") & (F.length(s) < 60))
        now = F.when(head, F.lower(s).contains("optional")).otherwise(st["opt"])
        met = st["found"].isNotNull()
        return F.struct(now.alias("opt"), F.when(met, st["found"]).when(F.contains(F.lower(line), F.lower(component)), now).alias("found"))

    zero = F.struct(F.lit(False).alias("opt"), F.lit(None).cast("boolean").alias("found"))
    return F.aggregate(lines, zero, step, lambda st: F.coalesce(st["found"], F.lit(False)))


def check_answer(answer: Column, must_cite: Column, not_idk: Column, include: Column, not_optional: Column) -> Column:
    """The array of failures of an answer; empty if all checks pass."""
    low = F.lower(answer)
    missing = F.transform(F.filter(include, lambda t: ~F.contains(low, F.lower(t))), lambda t: F.concat(F.lit("missing expected term: '"), t, F.lit("'")))
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        one(must_cite & ~answer.rlike(ANY_CITATION), F.lit("no inline citation")),
        one(not_idk & says_not_found(answer), F.lit("said IDK on an answerable question")),
        F.coalesce(missing, F.array().cast("array<string>")),
        one(not_optional.isNotNull() & under_optional(answer, not_optional), F.concat(F.lit("REGRESSION: '"), not_optional, F.lit("' classified under an Optional heading"))),
        one(strip(answer) == "", F.lit("empty answer")),
    )


def excerpt(text: Column, lines: int = 6, chars: int = 480) -> Column:
    """The first non-blank lines of a text on one line, cut."""
    kept = F.slice(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""), 1, lines)
    return F.substring(F.array_join(kept, " "), 1, chars)


def export_entry() -> Column:
    """A source's entry in an exported session."""
    head = F.concat(F.col("pos").cast("string"), F.lit(". **"), F.col("source"), F.lit(" "), page_label(F.col("page_start"), F.col("page_end")), F.lit("** — d="), F.format_string("%.3f", F.col("distance")))
    return F.concat_ws("\n", head, F.concat(F.lit("   > "), excerpt(F.col("text")), F.lit("…")))


def salvage_names(raw: DataFrame, id_col: str, text: str, cap: int = 28) -> DataFrame:
    """``(id_col, pos, name)``: strings of the JSON array from the first bracket to the last, of 2 to 44 characters, once by case, in order."""
    items = F.from_json(F.regexp_extract(F.col(text), r"(?s)\[.*\]", 0), "array<variant>")
    name = F.when(F.expr("schema_of_variant(v) = 'STRING'"), F.trim(F.expr("variant_get(v, '$', 'string')")))
    rows = raw.select(id_col, F.posexplode(items).alias("at", "v")).select(id_col, "at", name.alias("name")).where("length(name) > 1 and length(name) < 45")
    first = rows.groupBy(id_col, F.lower("name").alias("_k")).agg(F.min(F.struct("at", "name")).alias("m"))
    order = Window.partitionBy(id_col).orderBy("m.at")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= cap).select(id_col, "pos", F.col("m.name").alias("name"))


def inventory_text(hits: DataFrame, by: list[str], rank: str = "rank", chars: int = 6500) -> DataFrame:
    """``(by, text)``: the hits' texts by rank on one line, cut; what a component list is extracted from."""
    grouped = hits.select(*by, F.struct(F.col(rank).alias("r"), F.col("text").alias("t")).alias("x")).groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(*by, F.substring(F.array_join(F.transform("xs", lambda x: x["t"]), " "), 1, chars).alias("text"))


def shown_sections(sections: Column, shown: int = 10) -> Column:
    """A diff's first sections as one text, and how many more there are."""
    pages = lambda s: F.when(F.size(s["pages"]) == 2, F.concat(F.lit(" "), F.when(s["pages"][0] == s["pages"][1], F.concat(F.lit("p."), s["pages"][0].cast("string"))).otherwise(F.concat(F.lit("pp."), s["pages"][0].cast("string"), F.lit("–"), s["pages"][1].cast("string"))))).otherwise("")
    counts = lambda s: F.concat_ws(" ", F.when(s["added"] > 0, F.concat(F.lit("+"), s["added"].cast("string"))), F.when(s["removed"] > 0, F.concat(F.lit("−"), s["removed"].cast("string"))))
    line = lambda s: F.concat(counts(s), F.lit(" "), F.coalesce(s["section"], F.lit("(unsectioned)")), pages(s))
    more = F.size(sections) - shown
    tail = F.when(more > 0, F.concat(F.lit("…and "), more.cast("string"), F.lit(" more section"), F.when(more == 1, "").otherwise("s")))
    return F.concat_ws("\n", F.array_join(F.transform(F.slice(sections, 1, shown), line), "\n"), tail)


def export_session(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(by, markdown)``: questions as quotes and answers, numbered, of each conversation."""
    n = lambda role: F.count(F.when(F.col("role") == role, 1)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("string")
    quoted = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    block = F.when(F.col("role") == "user", F.concat(F.lit("---\n\n## Q"), n("user"), F.lit("\n\n"), quoted, F.lit("\n"))).otherwise(F.concat(F.lit("### A"), n("assistant"), F.lit("\n\n"), strip(F.col("text")), F.lit("\n")))
    rows = turns.where("role in ('user', 'assistant')").select(by, F.struct(F.col(order).alias("o"), block.alias("b")).alias("x"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("xs")).select(by, F.array_join(F.transform("xs", lambda x: x["b"]), "\n").alias("markdown"))


# How a question is put to the chat model.
ASKED = "Context snippets (each prefixed with its citation marker):\n\n"


def user_message(context: Column, question: Column) -> Column:
    """The message that carries context and question."""
    return F.concat(F.lit(ASKED), context, F.lit("\n\nQuestion: "), question)


def messages(system: str, turns: DataFrame, asked: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(by, pos, role, content)``: the system prompt, the two speakers' turns with content in order, and the question of ``asked(by, context, question)`` with its context."""
    said = turns.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != "")).join(asked.select(by), by, "left_semi")
    rows = (
        asked.select(by, F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_o"), F.lit("system").alias("role"), F.lit(system).alias("content"))
        .unionByName(said.select(by, F.lit(1).alias("_part"), F.col(order).cast("long").alias("_o"), "role", F.col("text").alias("content")))
        .unionByName(asked.select(by, F.lit(2).alias("_part"), F.lit(0).cast("long").alias("_o"), F.lit("user").alias("role"), user_message(F.col("context"), F.col("question")).alias("content")))
    )
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("_part", "_o")) - 1).select(by, "pos", "role", "content")


def thinks_adaptively(model: Column) -> Column:
    """Whether a chat model takes the adaptive-thinking parameter. The names are fixed values."""
    low = F.lower(F.coalesce(model, F.lit("")))
    return F.contains(low, F.lit("opus")) | F.contains(low, F.lit("sonnet"))


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results ``(cat, q, ok, fails, sources, citations, answer)``, or ``(q, error)``, as JSON lines."""
    results.write.mode("overwrite").json(path)


def status(store: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: chunks, sources, and the last update's time and source; null without any."""
    count = store.agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"))
    last = entries.agg(F.max(F.struct("ts", "source")).alias("l")).select(F.col("l.ts").alias("last_update"), F.col("l.source").alias("last_source"))
    return count.crossJoin(F.broadcast(last))  # one row each
