"""Shared helpers: durable intermediate tables, and connected components over link tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import shutil
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def _give_memory_back() -> None:
    """In a Python worker, lets freed arrays go back to the system at once.

    Workers are reused, and by default the C library and Arrow keep what large arrays have freed.
    """
    spec = getattr(sys.modules.get("__main__"), "__spec__", None)
    if spec is None or not spec.name.startswith("pyspark."):
        return
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: larger blocks are mapped on their own
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD


_give_memory_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name, read through Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session gets a temporary folder of its own;
    any other session is refused, as executors would not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return _local_dirs[app]


class Scratch:
    """Tables written to the shared folder so that later steps start from files.

    ``save`` cuts the lineage (a lost executor costs a reread, not a recompute).
    Folders are removed when the session ends, or at once by ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps whose results are written: it does so once the driver's garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows: as many as ``per_task`` asks for, never fewer than the session's own."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_task))


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps over DataFrames. The edge table
    never grows beyond its start, each step is two aggregations by minimum (which
    combine before the shuffle) and an equi-join that AQE can split, and
    each round is written to the shared folder. Rounds go on until the table no longer changes. Null ends and self links are ignored.
    """
    cur = scratch.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{label}-0",
    )

    def mark(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = mark(cur)
    for i in itertools.count(1):
        if not before[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = scratch.save(small, f"{label}-{i}")
        scratch.drop(f"{label}-{i - 1}")
        after = mark(nxt)
        cur = nxt
        if after == before:
            break
        before = after
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
