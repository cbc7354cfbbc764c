"""Exact n-gram Jaccard self-join by universe partitioning and pigeonhole.

Method. Set sizes are cut into bands whose ends are at most the inverse threshold
apart, so partners lie in the same or in the next band. In a band, two linked sets
differ in at most H elements. The universe is hashed into m = H + 1 segments,
so linked sets agree in at least one segment. A document indexes, for its own
band and for the band below, a key of each segment's subset; for a few segments (D
of them) it also indexes the keys of the subset with one element deleted, which finds
segments that differ in one element and so counts for two in the pigeonhole sum.

Cost-based allocation: an empty segment equals every other empty one, so it is the dearest to
probe; next come segments of frequent shingles alone (of a passage that many documents share). Frequent
shingles are counted over all documents and kept as a bitmap of fixed size. A document gives its dear segments no
share as long as its deletion segments make up for them (sum of shares >= H + 1); the other documents still find
them, as they stay in the index. A key that is in the index alone, probed by none, links nobody.

Keys meet in buckets as packed arrays, not rows. A bucket is a range of a band's segments, and of their keys where a segment has too many.
It emits each distinct key group once, packed. A group's star (the smallest document that probes its key, with each other one) is pruned
by parity bitmaps, verified exactly, and joined into components. What a group may still hold are links of its other probing
documents with members of other components. Groups that hold several components are compared in cells (a block of probing documents with a block
of members, most groups being one cell), with the bitmaps as exact lower bounds of the difference, and what is left is verified. A cell with
plenty of such pairs first gives the closest of any two components, which merges nearly all that belong together, and after that every pair
that still lies in two. No link between different components is lost, members of one component are never compared, and no group is
expanded into all its pairs.

Which copy of a text names its keys depends on the order of rows, which may change between evaluations; so every row's
size and bitmaps are kept, and copies are linked with each other by the digest of their sets alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, connected_components, spread
from corpusloom.llm.shingles import differences_at_least, folded, mix, overlap, parity_bits, set_digest, shingle_set, shingle_sets

FULL, DELETED, INDEX = 0, 1, 2
#: Shingles whose keys fill a bucket, members of a block, shingles whose keys a task holds at once, entries of a row of groups.
BUCKET_KEYS, BLOCK, FLUSH, GROUPED = 1_500_000, 512, 300_000, 200_000
#: Bytes at most of the bitmap that cells compare, which is folded to half its size; pairs for each member of a cell beyond which the closest come first.
SKETCH, PLENTY = 1024, 16
#: A frequent shingle is in so many documents of a task and in so many of all; bits of its bitmap, and shingles in it at most.
LOCAL, FREQUENT, HOT_BITS, HOT_MAX = 3, 24, 1 << 23, 500_000
_NONE = np.iinfo(np.int64).max


class Bands:
    """Size bands for the threshold num / den, with segments and deletion segments of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        lo, ends = 1, []
        while lo < 1 << 40:
            hi = max(lo, lo * den // num)
            ends.append(hi)
            lo = hi + 1
        self.hi = np.array(ends, np.int64)
        most = np.array([self.allowed(h, h * den // num) for h in ends], np.int64)
        self.m = most + 1
        self.d = np.where(self.m > 1, 1 + self.m // 6, 0)

    def allowed(self, a, b):
        """The most elements in which linked sets of sizes a and b differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hi, n)


def _segment_keys(sets: list[np.ndarray], band: np.ndarray, bands: Bands, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of set, key, kind, segment) of all entries of the sets, each keyed for the band given for it."""
    size = np.array([len(s) for s in sets], np.int64)
    m, d = bands.m[band], bands.d[band]
    first = np.concatenate(([0], np.cumsum(m)))
    of = np.repeat(np.arange(len(sets)), size)
    h = np.concatenate(sets)
    salt = mix((band + 1).astype(np.uint64))
    where = mix(h ^ salt[of])
    seg = ((where >> np.uint64(32)) * m[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    at = first[of] + seg
    total = int(first[-1])
    count = np.bincount(at, minlength=total)
    part = mix(h + np.uint64(0x51ED270B))
    low = np.bincount(at, (part & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(at, (part >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    sums = low + (high << np.uint64(32))
    owner = np.repeat(np.arange(len(sets)), m)
    number = np.arange(total) - first[owner]
    place = mix(number.astype(np.uint64) * np.uint64(0x632BE5AB) + salt[owner])
    rare = np.bincount(at, ~_is_hot(h, hot), total).astype(np.int64)
    # shares: 1 for a segment, 2 for a deletion segment of two rare elements or more, 0 for a dear one that is left out
    doubled = (number < d[owner]) & (rare >= 2)
    spare = np.bincount(owner, doubled, len(sets)).astype(np.int64)
    kind = np.full(total, FULL)
    for dear in (count == 0, (count > 0) & (rare == 0)):  # the dearest first
        seen = np.cumsum(dear)
        nth = seen - np.concatenate(([0], seen))[first[:-1]][owner]
        out = dear & (nth <= spare[owner])
        kind[out] = INDEX
        spare -= np.bincount(owner, out, len(sets)).astype(np.int64)
    cut = np.nonzero(doubled[at])[0]
    less = mix(sums[at[cut]] - part[cut] + place[at[cut]])
    return (
        np.concatenate((owner, of[cut])),
        np.concatenate((mix(sums + place), less)),
        np.concatenate((kind, np.full(len(cut), DELETED))),
        np.concatenate((number, seg[cut])),
    )


def _is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = h % np.uint64(HOT_BITS)
    return (hot[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _frequent(sets: list[np.ndarray], least: int) -> tuple[bytes, bytes]:
    """Shingles of at least so many of the sets, and in how many they are."""
    h, many = np.unique(np.concatenate(sets), return_counts=True)
    keep = many >= least
    return h[keep].tobytes(), many[keep].astype("<i4").tobytes()


def _entries(sets: list[np.ndarray], bands: Bands, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the set, key, kind, band, segment) of all entries of under 65,536 sets, for their own band and for the one below."""
    n = np.array([len(s) for s in sets], np.int64)
    own = bands.of(n)
    below = [i for i in range(len(sets)) if own[i] > 0 and bands.num * n[i] <= bands.den * bands.hi[own[i] - 1]]
    which = np.concatenate((np.arange(len(sets)), np.array(below, np.int64)))
    band = np.concatenate((own, own[below] - 1 if below else np.empty(0, np.int64)))
    at, key, kind, segment = _segment_keys([sets[i] for i in which], band, bands, hot)
    return which[at].astype(np.uint16), key, kind, band[at], segment


class Buckets:
    """A band's keys lie in one bucket or more, each a range of segments, by how many shingles the band's documents have.

    Documents that share several keys so mostly share them in one bucket. Where a band needs more buckets than it has segments,
    a segment's keys are dealt to several by their hash.
    """

    def __init__(self, bands: Bands, shingles: dict[int, int]):
        many = np.zeros(len(bands.hi) + 1)
        for b, n in shingles.items():
            many[b] += n
        keyed = many[:-1] + many[1:]
        needed = np.where(keyed > 0, np.maximum(1, np.ceil(keyed / (2 * BUCKET_KEYS))), 0).astype(np.int64)
        self.ranges = np.minimum(needed, bands.m)
        self.deals = -(-needed // bands.m)
        parts = self.ranges * self.deals
        self.first = np.cumsum(parts) - parts
        self.m, self.total = bands.m, max(1, int(parts.sum()))

    def of(self, band: np.ndarray, segment: np.ndarray, key: np.ndarray) -> np.ndarray:
        deals = self.deals[band]
        dealt = ((key >> np.uint64(18)) % deals.astype(np.uint64)).astype(np.int64)
        return self.first[band] + segment * self.ranges[band] // self.m[band] * deals + dealt


def _pack(docs: np.ndarray, at: np.ndarray, key: np.ndarray, kind: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """One row for each bucket: documents, how many keys each has, and the keys in six bytes (46 bits and the kind)."""
    order = np.argsort(at, kind="stable")
    names, bucket = np.unique(bucket[order], return_inverse=True)
    again = np.argsort(bucket.astype(np.uint16) if len(names) < 1 << 16 else bucket, kind="stable")
    order, bucket = order[again], bucket[again]
    doc = docs[at[order]]
    six = ((key[order] >> np.uint64(18)) << np.uint64(2)) | kind[order].astype(np.uint64)
    six = six.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    edges = np.searchsorted(bucket, np.arange(len(names) + 1))
    for b, i, j in zip(names.tolist(), edges[:-1], edges[1:], strict=True):
        starts = np.concatenate(([0], np.flatnonzero(np.diff(doc[i:j])) + 1))
        yield b, doc[i:j][starts].tobytes(), np.diff(np.append(starts, j - i)).astype("<u4").tobytes(), six[i:j].tobytes()


def _bucket_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's distinct key groups of two documents or more of which one probes the key: documents, who probes, sizes."""
    docs = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, "<u4")) for d, c in zip(pdf["docs"], pdf["counts"], strict=True)])
    raw = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, 6)
    key = np.zeros((len(raw), 8), np.uint8)
    key[:, :6] = raw
    key = key.view("<u8").ravel()
    order = np.argsort(key >> np.uint64(2))
    key, docs = key[order], docs[order]
    core = (key & np.uint64(3)) == FULL
    key >>= np.uint64(2)
    names = ["first", "docs", "cores", "sizes"]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1)) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(starts, len(key)))
    keep = (size > 1) & (np.add.reduceat(core.astype(np.int64), starts) > 0) if len(starts) else size > 1
    inside = np.repeat(keep, size)
    docs, core, size = docs[inside], core[inside], size[keep]
    if not len(size):
        return pd.DataFrame([], columns=names).astype({"first": "int64"})
    # groups that agree in documents and in who probes are one; 128 bits tell them apart
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    member = docs.view(np.uint64) * np.uint64(2) + core
    one, two = (np.add.reduceat(mix(member + np.uint64(salt)), starts) for salt in (0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D))
    order = np.lexsort((two, one))
    fresh = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
    chosen = np.zeros(len(size), bool)
    chosen[order[fresh]] = True
    inside = np.repeat(chosen, size)
    docs, core, size = docs[inside], core[inside], size[chosen]
    number = int(pdf["bucket"].iloc[0]) << 32
    ends = np.cumsum(size)
    out, i = [], 0
    while i < len(size):
        from_ = ends[i] - size[i]
        j = max(i + 1, int(np.searchsorted(ends, from_ + GROUPED, "right")))
        out.append((number + i, docs[from_ : ends[j - 1]].tobytes(), core[from_ : ends[j - 1]].astype(np.uint8).tobytes(), size[i:j].astype("<i8").tobytes()))
        i = j
    return pd.DataFrame(out, columns=names)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row of packed groups: number of the first, documents, who probes, starts, sizes."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            size = np.frombuffer(r.sizes, "<i8")
            yield r.first, np.frombuffer(r.docs, np.int64), np.frombuffer(r.cores, np.uint8).astype(bool), np.cumsum(size) - size, size


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group's smallest probing document with each of its others, smaller first."""
    for _, docs, core, starts, size in _groups(batches):
        hub = np.repeat(np.minimum.reduceat(np.where(core, docs, _NONE), starts), size)
        far = hub != docs
        star = np.unique(np.stack((np.minimum(hub, docs)[far], np.maximum(hub, docs)[far])), axis=1)
        yield pd.DataFrame({"a": star[0], "b": star[1]})


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of groups that hold more candidate pairs than their star."""
    for first, docs, core, starts, size in _groups(batches):
        more = (size > 2) & (np.add.reduceat(core.astype(np.int64), starts) > 1)
        at = np.repeat(more, size)
        yield pd.DataFrame({"gid": np.repeat(first + np.arange(len(size)), size)[at], "doc": docs[at], "core": core[at]})


def _cell_pairs(bands: Bands, plenty: int | None):
    """Pairs of a cell that lie in different components and may link, by the bitmaps. A cell's documents come one after another.

    If there are over ``plenty`` for each member, one for any two components, with ``rest`` set; without ``plenty`` always all.
    """

    def of(cell: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, comp, doc = (cell[c].to_numpy() for c in ("n", "comp", "doc"))
        width = min(map(len, cell["sketch"]))
        bits = np.stack([folded(x, width) for x in cell["sketch"]])
        left, right = np.flatnonzero(cell["left"]), np.flatnonzero(cell["right"])
        step = max(1, (1 << 20) // (len(right) * bits.shape[1] + 1))
        found = [np.empty((3, 0), np.int64)]
        for k in range(0, len(left), step):
            x, y = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
            most, least = np.maximum(n[x], n[y]), np.minimum(n[x], n[y])
            ok = (comp[x] != comp[y]) & (least * bands.den >= most * bands.num)
            x, y = x[ok], y[ok]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            spare = bands.allowed(n[x], n[y]) - apart
            ok = spare >= 0
            found.append(np.stack((x[ok], y[ok], -spare[ok])))
        x, y, far = np.concatenate(found, axis=1)
        rest = plenty is not None and len(x) > plenty * len(doc)
        if rest:
            low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
            order = np.lexsort((doc[y], doc[x], far, high, low))
            first = np.concatenate(([True], (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)))
            x, y = x[order[first]], y[order[first]]
        return np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), np.full(len(x), rest)

    def pairs(pdf: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
        found = [of(pdf.iloc[i:j]) for i, j in itertools.pairwise(edges)]
        a, b, rest = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "rest": rest.astype(bool)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            cell = pdf[["gid", "i", "j"]].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist()]
            if len(edges) > 1:
                yield pairs(pdf, edges)
            held = pdf.iloc[edges[-1] :]
        if held is not None and len(held):
            yield pairs(held, [0, len(held)])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Two documents link when ``den * intersection >= num * union`` of their sets of
    distinct ``words``-word shingles; the component's id is the smallest id
    reachable by links, the document's own included.

    Null and empty texts, and texts without words, have no shingles and link with
    nothing. Rows that repeat an id are one node, with the links of all its texts.
    A null id gives a row with a null component. An empty table gives no
    rows. Columns besides the two named are ignored, whatever their names.
    """
    if not 0 < num <= den or words < 1:
        raise ValueError("the threshold must be over 0 and at most 1, with one word or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    bands = Bands(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[bytes, int] = {}
        held, size = [], 0
        for pdf in batches:
            out = []
            for doc, s in zip(pdf["doc"].astype(object), shingle_sets(pdf["text"], words), strict=True):
                if pd.isna(doc) or not len(s):
                    out.append((None if pd.isna(doc) else int(doc), len(s), None, None, None, None, None))
                    continue
                sig = set_digest(s)
                if len(first) > 2_000_000:
                    first.clear()
                one = first.setdefault(sig, int(doc))
                if one == doc:
                    held.append(s)
                    size += len(s)
                if size > 2_000_000:
                    out.append((None, -1, *_frequent(held, LOCAL), None, None, None))
                    held, size = [], 0
                bits = parity_bits(s)
                out.append((int(doc), len(s), sig, None, one, bits, folded(bits, max(8, min(len(bits) // 2, SKETCH))).tobytes()))
            yield frame(out)
        if held:
            yield frame([(None, -1, *_frequent(held, LOCAL), None, None, None)])

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["doc", "n", "sig", "many", "first", "bits", "sketch"]).astype({"doc": "Int64", "n": "int64", "first": "Int64"})

    told = scratch.save(rows.mapInPandas(describe, "doc long, n long, sig binary, many binary, first long, bits binary, sketch binary"), "described")
    described = told.where("n >= 0").drop("many")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, many in zip(pdf["sig"], pdf["many"], strict=True):
                yield pd.DataFrame({"h": np.frombuffer(h, np.int64), "many": np.frombuffer(many, "<i4")})

    frequent = told.where("n < 0").select("sig", "many").mapInPandas(counted, "h long, many int").groupBy("h").agg(F.sum("many").alias("many"))
    frequent = frequent.where(F.col("many") >= FREQUENT).orderBy(F.desc("many"), "h").limit(HOT_MAX).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    hot = np.zeros(HOT_BITS // 8, np.uint8)
    at = frequent % np.uint64(HOT_BITS)
    np.bitwise_or.at(hot, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    @F.pandas_udf("int")
    def band_of(n: pd.Series) -> pd.Series:
        return pd.Series(bands.of(n.to_numpy()).astype(np.int32))

    # a row for each band at most
    sizes = described.groupBy(band_of("n").alias("band")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    n_rows = sum(r.rows for r in sizes)
    buckets = Buckets(bands, {r.band: r.n for r in sizes if r.n})

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        names, sets, held = [], [], 0

        def flush():
            at, key, kind, band, segment = _entries(sets, bands, hot)
            rows = list(_pack(np.array(names, np.int64), at, key, kind, buckets.of(band, segment, key)))
            names.clear()
            sets.clear()
            return pd.DataFrame(rows, columns=["bucket", "docs", "counts", "keys"]).astype({"bucket": "int32"})

        for pdf in batches:
            for doc, s in zip(pdf["doc"], shingle_sets(pdf["text"], words), strict=True):
                if not len(s) or (sig := set_digest(s)) in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(sig)
                names.append(int(doc))
                sets.append(s)
                held += len(s)
                if held > FLUSH or len(sets) > 60_000:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    packed = rows.where("doc is not null").mapInPandas(keyed, "bucket int, docs binary, counts binary, keys binary")
    found = scratch.save(
        packed.repartition(buckets.total, "bucket").groupBy("bucket").applyInPandas(_bucket_groups, "first long, docs binary, cores binary, sizes binary"),
        "found",
    )
    scratch.release()
    stars = scratch.save(found.mapInPandas(_stars, "a long, b long").distinct(), "stars")
    members = scratch.save(found.mapInPandas(_members, "gid long, doc long, core boolean"), "members")
    scratch.drop("found")
    linkable = stars.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    once = scratch.save(
        described.where("bits is not null").join(linkable, "doc", "left_semi").groupBy("doc", "sig").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("sketch").alias("sketch"), F.count("*").alias("times")).drop("sig"),
        "once",
    )
    repeated = (once.agg(F.max("times")).first()[0] or 0) > 1

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            apart = differences_at_least(list(pdf["ba"]), list(pdf["bb"]))
            yield pdf.loc[apart <= bands.allowed(pdf["na"].to_numpy(), pdf["nb"].to_numpy()), ["a", "b"]]

    likely = scratch.save(
        stars.join(once.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
        .join(once.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
        .where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}")
        .mapInPandas(possible, "a long, b long")
        .distinct(),
        "likely",
    )
    scratch.drop("stars")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(members.select("doc")).distinct()
    texts = rows.join(wanted, "doc", "left_semi")
    texts = scratch.save(texts.dropDuplicates(["doc", "text"]) if repeated else texts, "texts")

    scratch.release()

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, last, left = [], None, None
            for a, x, y in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True):
                if left is None or (a, x) != last:
                    left, last = shingle_set(x, words), (a, x)
                right = shingle_set(y, words)
                both = overlap(left, right)
                keep.append(both > 0 and den * both >= num * (len(left) + len(right) - both))
            yield pdf.loc[keep, ["a", "b"]]

    def verified(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
            .mapInPandas(linked, "a long, b long")
        )

    firsts = described.where("doc = first and sig is not null").select("doc", "sig").distinct()
    lowest = firsts.groupBy("sig").agg(F.min("doc").alias("low"), F.count("*").alias("k")).where("k > 1").drop("k")
    same = (
        described.where("doc <> first")
        .select(F.col("doc").alias("a"), F.col("first").alias("b"))
        .unionByName(firsts.join(lowest, "sig").where("doc <> low").select(F.col("doc").alias("a"), F.col("low").alias("b")))
    )
    comps = scratch.save(connected_components(verified(likely).unionByName(same), scratch, "cc1"), "comps1")
    scratch.drop("likely")
    scratch.release()

    def cells(comps: DataFrame) -> DataFrame:
        """The groups that hold several components, each cell's documents one after another."""
        marked = members.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
        mixed = (
            marked.groupBy("gid")
            .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("k"), F.sum(F.col("core").cast("int")).alias("probing"))
            .where("low <> high")
            .select("gid", F.ceil(F.col("probing") / BLOCK).cast("int").alias("down"), F.ceil(F.col("k") / BLOCK).cast("int").alias("across"))
        )
        cell = """explode(array_distinct(concat(
            if(core, transform(sequence(0, across - 1), x -> struct(row as i, x as j)), array()),
            transform(sequence(0, down - 1), x -> struct(x as i, col as j)))))"""
        dealt = (
            marked.join(mixed, "gid")
            .withColumn("row", F.pmod(F.xxhash64("doc"), F.col("down")).cast("int"))
            .withColumn("col", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("across")).cast("int"))
            .withColumn("cell", F.expr(cell))
            .select("gid", "cell.i", "cell.j", "doc", "comp", F.expr("core and cell.i = row").alias("left"), F.expr("cell.j = col").alias("right"))
            .join(once.select("doc", "n", "sketch"), "doc")
        )
        return dealt.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j")

    for name, plenty in (("pairs", PLENTY), ("rest", None)):
        met = scratch.save(cells(comps).mapInPandas(_cell_pairs(bands, plenty), "a long, b long, rest boolean"), name)
        links = scratch.save(verified(met.select("a", "b").distinct()), f"{name}-linked")
        if not links.isEmpty():
            known = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comps = scratch.save(connected_components(links.unionByName(known), scratch, f"cc-{name}"), f"comps-{name}")
        if met.where("rest").isEmpty():
            break
    for name in ("members", "once", "texts"):
        scratch.drop(name)
    n_parts = spread(spark, n_rows, 2_000_000)
    return (
        described.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"))
        .repartition(n_parts, "doc_id")
        .join(comps.select(F.col("node").alias("doc_id"), F.col("component").alias("linked")), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("linked", "doc_id").alias("component_id"))
    )
