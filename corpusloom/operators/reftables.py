"""Sizing facts from reference tables: ordered two-column cells, a header that lasts until the next, and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import is_number

# Metric names, the words that no header of the second kind may end in or hold, and the order of sizes.
METRICS = {"cpu": "cpu", "cpus": "cpu", "vcpu": "cpu", "ram": "ram", "memory": "ram", "disk": "disk", "storage": "disk"}
METRIC_ENDS, NOT_HEADERS = r"(cpu|ram|memory|disk|storage)$", ("size list", "storage si")
# What stands between the parts of a sentence.
SENTENCE_MANY = (" appliance deployment sizes and per-size resource requirements (from the VCF Planning & Preparation Workbook): ", ". The smallest available ", " size is ", ".")
SENTENCE_ONE = (" appliance resource requirements: ", ".")
SIZES = ("Extra Small", "Extra_Small", "Tiny", "Light", "Small", "Standard", "Medium", "Large", "Extra Large", "XLarge", "X-Large")


def _metric(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])[c]


def appliance_name(c: Column) -> Column:
    """Without a trailing kind of thing, in one spelling, with single blanks."""
    bare = F.trim(F.regexp_replace(c, r"(?i)\s+(appliance|size|node)s?$", ""))
    return F.regexp_replace(F.replace(bare, F.lit("NSX-T"), F.lit("NSX")), r"\s+", " ")


def size_name(appliance: Column, size: Column) -> Column:
    """Without the appliance's own name in front."""
    prefixed = F.lower(size).startswith(F.concat(F.lower(appliance), F.lit(" ")))
    rest = F.trim(F.when(prefixed, F.expr("substring(size_raw, length(appl) + 2)")).otherwise(size))
    return F.replace(rest, F.lit("Extra_Small"), F.lit("Extra Small"))


def parse_tables(cells: DataFrame, by: str = "source") -> DataFrame:
    """``(by, mode, appl, size, metric, value, first_ord)`` from ``(by, ord, b, c)``.

    Mode A: ``<appliance> <metric> | Value``, then ``<size> | number`` rows; B: ``<appliance> | Value``, then ``<metric> | number`` rows
    (size is empty). A header lasts until the next. Disk rows count only for sizes that a cpu or ram row named before. The last value wins.
    """
    bl = F.lower("b")
    head_a = bl.rlike(r"^.+?\s+(cpu|cpus|vcpu|ram|memory|disk|storage)$") & (F.lower("c") == "value")
    no_head = bl.rlike(METRIC_ENDS) | bl.isin(*METRICS)
    for part in NOT_HEADERS:
        no_head = no_head | bl.contains(part)
    head_b = (F.lower("c") == "value") & (F.col("b") != "") & ~no_head
    head = (
        F.when(head_a, F.struct(F.lit("A").alias("mode"), appliance_name(F.regexp_extract("b", r"(?i)^(.+?)\s+(cpu|cpus|vcpu|ram|memory|disk|storage)$", 1)).alias("appl"), _metric(F.regexp_extract(bl, r"\s(cpu|cpus|vcpu|ram|memory|disk|storage)$", 1)).alias("metric")))
        .when(head_b, F.struct(F.lit("B").alias("mode"), appliance_name(F.col("b")).alias("appl"), F.lit(None).cast("string").alias("metric")))
    )
    run = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        cells.withColumn("_h", head)
        .withColumn("_is", F.col("_h").isNotNull())
        .withColumn("_h", F.last("_h", ignorenulls=True).over(run))
        .where(~F.col("_is") & F.col("_h").isNotNull() & is_number(F.col("c")) & (F.col("_h.appl") != ""))
        .select(by, "ord", "b", "c", F.col("_h.mode").alias("mode"), F.col("_h.appl").alias("appl"), F.col("_h.metric").alias("head_metric"))
    )
    a = rows.where("mode = 'A' and b <> ''").withColumn("metric", F.col("head_metric"))
    a = a.withColumn("size_raw", F.when(F.col("metric") == "disk", F.trim(F.regexp_replace("b", "Default$", ""))).otherwise(F.col("b")))
    a = a.withColumn("size", size_name(F.col("appl"), F.col("size_raw")))
    before = Window.partitionBy(by, "appl", "size").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("_named", F.coalesce(F.max(F.col("metric") != "disk").over(before), F.lit(False))).where("metric <> 'disk' or _named")
    b = rows.where("mode = 'B'").withColumn("metric", _metric(F.lower("b"))).where("metric is not null").withColumn("size", F.lit(""))
    both = a.select(by, "ord", "mode", "appl", "size", "metric", "c").unionByName(b.select(by, "ord", "mode", "appl", "size", "metric", "c"))
    return both.groupBy(by, "mode", "appl", "size", "metric").agg(F.max_by("c", "ord").alias("value"), F.min("ord").alias("first_ord"))


def specs(parsed: DataFrame, by: str = "source") -> DataFrame:
    """``(by, mode, appl, size, spec, first_ord)``; absent metrics are left out of the text."""
    wide = parsed.groupBy(by, "mode", "appl", "size").agg(
        *(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("cpu", "ram", "disk")), F.min("first_ord").alias("first_ord")
    )
    spec = F.concat_ws(", ", F.concat("cpu", F.lit(" vCPU")), F.concat("ram", F.lit(" GB RAM")), F.concat("disk", F.lit(" GB storage")))
    return wide.select(by, "mode", "appl", "size", spec.alias("spec"), "first_ord")


def sizing_sentences(parsed: DataFrame, by: str = "source") -> DataFrame:
    """``(by, page_num, appl, text)``: one atomic page for each appliance, those of one size first, in order of appearance."""
    s = specs(parsed, by).where("spec <> ''")
    place = F.array_position(F.array(*map(F.lit, SIZES)), F.col("size"))
    item = F.struct(F.when(place > 0, place - 1).otherwise(99).alias("o"), "first_ord", "size", "spec")
    per = s.groupBy(by, "mode", "appl").agg(F.min("first_ord").alias("at"), F.array_sort(F.collect_list(item)).alias("items"))
    many = F.concat(
        F.col("appl"), F.lit(SENTENCE_MANY[0]), F.array_join(F.transform("items", lambda i: F.concat(i["size"], F.lit(" ("), i["spec"], F.lit(")"))), "; "),
        F.lit(SENTENCE_MANY[1]), F.col("appl"), F.lit(SENTENCE_MANY[2]), F.element_at("items", 1)["size"], F.lit(SENTENCE_MANY[3]),
    )
    one = F.concat(F.col("appl"), F.lit(SENTENCE_ONE[0]), F.element_at("items", 1)["spec"], F.lit(SENTENCE_ONE[1]))
    order = Window.partitionBy(by).orderBy(F.desc("mode"), "at", "appl")
    return per.select(by, F.row_number().over(order).alias("page_num"), "appl", F.when(F.col("mode") == "B", one).otherwise(many).alias("text"))


def table_text(markdown: Column, section: Column) -> Column:
    """A table's markdown as a self-describing block, or an empty text if there is little in it.

    Separator and empty rows go, line breaks in cells become blanks; under three lines or 60 characters it isn't worth keeping.
    """
    lines = F.filter(F.split(markdown, "\n"), lambda x: ~x.rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.replace(x, F.lit("<br>"), F.lit(" ")), r"[ \t]+", " ")))
    lines = F.filter(lines, lambda x: F.regexp_replace(x, r"[| ]", "") != "")
    body = F.array_join(lines, "\n")
    lead = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Table — "), section)).otherwise("Table")
    return F.when((F.size(lines) < 3) | (F.length(body) < 60), "").otherwise(F.concat_ws("\n", lead, body))
