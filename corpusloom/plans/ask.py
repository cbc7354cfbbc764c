"""Retrieval of a question's context: routing, fan-out, fusion, reranking, with injected models.

A question is one driver-side job over distributed tables: what reaches the driver is its own sub-queries and the final candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import embed_input
from corpusloom.operators import answers, manifest
from corpusloom.operators import retrieval as ops

Encoder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], list[tuple[int, float]]]
Extractor = Callable[[str], str]

# Probes that assemble the text of a corpus's inventory, and how many hits make it up.
INVENTORY_PROBES = (
    "First VCF Instance management components the management appliances deployed in management domain",
    "all management components including SDDC Manager vCenter NSX VCF Operations VCF Automation",
    "management appliances diagram License Server VCF Operations Collector",
    "License Server Overview licensing management appliance",
    "NSX Edge node appliance management domain edge cluster",
    "VCF Installer appliance resource requirements deploy",
    "management domain ESX hosts vSAN cluster minimum number",
)
INVENTORY_HITS = 18


@dataclass(frozen=True)
class AskSettings:
    """Defaults of the retrieval settings."""

    top_k: int = 6
    multi_query: bool = True
    multi_query_max: int = 8
    rerank_top_n: int = 100
    probes: tuple[str, ...] = INVENTORY_PROBES


@dataclass
class Models:
    """The models a question needs. Without ``extract`` a breadth question falls back to the manifest, without ``rerank`` the order stays."""

    encode: Encoder
    extract: Extractor | None = None
    rerank: Reranker | None = None


@dataclass
class LabelCache:
    """The manifest and its labels' vectors, kept as long as the store's number of chunks stays the same."""

    kept: dict[str, tuple[int, list[str], list[list[float]]]] = field(default_factory=dict)

    def of(self, key: str, store: DataFrame, encode: Encoder, model: str = "") -> tuple[list[str], list[list[float]]]:
        """Labels, most documented first, and their vectors, embedded as documents. A manifest has sixty names at most."""
        count = store.count()
        if key not in self.kept or self.kept[key][0] != count:
            names = [r["name"] for r in manifest.component_manifest(store.select("section")).orderBy(F.desc("n"), F.length("name"), "name").collect()]
            self.kept[key] = (count, names, label_vectors(store.sparkSession, names, encode, model))
        return self.kept[key][1:]


def label_vectors(spark: SparkSession, names: list[str], encode: Encoder, model: str = "") -> list[list[float]]:
    """The labels' vectors, with the prefix that documents have for this model."""
    if not names:
        return []
    rows = spark.createDataFrame(list(enumerate(names)), "i int, t string").select("i", embed_input(F.col("t"), F.lit(model)).alias("t")).orderBy("i").collect()
    return encode([r.t for r in rows])


def fused(vectors: DataFrame, queries: list[list[float]], k_total: int, id_col: str = "vec_id") -> DataFrame:
    """The fusion of several query vectors, ``(rank, qi, id, distance, pos)``."""
    spark = vectors.sparkSession
    q = spark.createDataFrame(list(enumerate(queries)), "qi int, q array<double>")
    return ops.round_robin(ops.top_k_batch(vectors, q, max(k_total, ops.MIN_PER_QUERY), id_col=id_col), k_total, id_col)


def specific(vectors: DataFrame, labels: DataFrame, question: str, encode: Encoder, settings: AskSettings, rerank_on: bool = False, id_col: str = "vec_id") -> DataFrame:
    """One query, or one for each component within the margin of the best."""
    q = encode([question])[0]
    k = ops.candidate_count(settings.top_k, rerank_on, settings.rerank_top_n)
    names = [r[0] for r in ops.within_margin(ops.select_components(labels, q, max(1, settings.multi_query_max - 1))).orderBy("label").collect()]
    if not settings.multi_query or len(names) <= 1:
        return fused(vectors, [q], k, id_col)
    return fused(vectors, [q, *encode([f"{n} — {question}" for n in names])], k, id_col)


def inventory(store: DataFrame, models: Models, settings: AskSettings, id_col: str = "vec_id") -> list[str]:
    """The components that the corpus's own inventory names, by an extractor that answers with a JSON array; none if anything fails."""
    if models.extract is None or not settings.probes:
        return []
    try:
        hits = fused(store, models.encode(list(settings.probes)), INVENTORY_HITS, id_col).join(store.select(id_col, "text"), id_col)
        text = answers.inventory_text(hits.withColumn("_q", F.lit(0)), ["_q"], "pos").collect()
        if not text or not text[0].text.strip():
            return []
        raw = store.sparkSession.createDataFrame([(0, models.extract(text[0].text))], "_q int, raw string")
        return [r["name"] for r in answers.salvage_names(raw, "_q", "raw", ops.BREADTH_CAP).orderBy("pos").collect()]
    except Exception:  # noqa: BLE001  whatever the extractor's service does, the manifest is there
        return []


def breadth(store: DataFrame, names: list[str], question: str, models: Models, settings: AskSettings, id_col: str = "vec_id") -> DataFrame:
    """A sub-query for each component and one for how it is classified, besides the question, fused."""
    spark = store.sparkSession
    asked = spark.createDataFrame([(question, names)], "question string, names array<string>")
    subs = ops.fan_out(asked, F.col("names"), settings.top_k).orderBy("si").collect()
    k = settings.rerank_top_n if models.rerank else subs[0].k_total
    return fused(store, models.encode([r.sub for r in subs]), k, id_col)


def finish(hits: DataFrame, store: DataFrame, question: str, rerank: Reranker | None, keep: int, id_col: str = "vec_id") -> DataFrame:
    """Hits by ``new_pos``: reranked and cut to ``keep``, or as they were without a reranker. One that fails leaves the order, cut."""
    if rerank is None:
        return ops.rerank(hits, None, keep)
    texts = hits.join(store.select(id_col, "text"), id_col).orderBy("pos").select("text").collect()  # a pool of candidates
    scores: list[tuple[int, float]] = []
    if len(texts) > 1:
        try:
            scores = [(int(i), float(x)) for i, x in rerank(question, [r.text for r in texts]) if 0 <= i < len(texts)]
        except Exception:  # noqa: BLE001  reranking must never break retrieval
            scores = []
    return ops.rerank(hits, hits.sparkSession.createDataFrame(scores, "index long, relevance double"), keep)


def ask(question: str, store: DataFrame, models: Models, settings: AskSettings | None = None, cache: LabelCache | None = None, key: str = "", id_col: str = "vec_id") -> DataFrame:
    """The hits of a question by ``new_pos``, from a store ``(id_col, embedding, text, section, …)``.

    A question for every component fans out over the corpus's inventory, or over its manifest if no inventory was found; any other
    goes to the components nearest to it, if there are several; else it is asked alone.
    """
    settings = settings or AskSettings()
    cache = cache or LabelCache()
    spark = store.sparkSession
    k = ops.candidate_count(settings.top_k, models.rerank is not None, settings.rerank_top_n)
    alone = lambda: fused(store, models.encode([question]), k, id_col)
    way = spark.range(1).select(ops.route(F.lit(question), settings.multi_query)).first()[0]
    keep = settings.top_k
    if way == "single":
        hits = alone()
    else:
        names = inventory(store, models, settings, id_col) if way == "breadth" else []
        labels, vectors = ([], []) if names else cache.of(key, store, models.encode)
        names = names or labels[: ops.BREADTH_CAP]
        if not names:
            hits = alone()
        elif way == "breadth":
            hits, keep = breadth(store, names, question, models, settings, id_col), ops.BREADTH_KEEP
        else:
            table = spark.createDataFrame(list(zip(labels, vectors, strict=True)), "label string, embedding array<double>")
            hits = specific(store, table, question, models.encode, settings, models.rerank is not None, id_col)
    return finish(hits, store, question, models.rerank, keep, id_col)
