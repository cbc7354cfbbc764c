"""Fetching sources into a folder, conditionally: a driver step with an injected transport.

The files are few (a registry's sources), so this is no distributed job. Folder and sidecars lie on any Hadoop file system.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

RESULT = "name string, path string, bytes long, sha256 string, last_modified string, cached boolean"


@dataclass
class Response:
    """What a transport returns: status 304 for an unchanged file, else 200 with the content in parts."""

    status: int
    last_modified: str | None = None
    content: Iterable[bytes] = ()


#: ``transport(url, if_modified_since)``; it raises what the caller should see.
Transport = Callable[[str, str | None], Response]


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        top = self.at("")
        self.fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(top)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def meta(self, name: str) -> dict | None:
        """A sidecar's content; none if it is missing or malformed."""
        if not self.fs.exists(self.at(name)):
            return None
        raw = self.fs.open(self.at(name))
        try:
            got = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(raw, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            raw.close()
        return got if isinstance(got, dict) else None

    def write(self, name: str, parts: Iterable[bytes]) -> None:
        """The whole content under another name, then that name replaced by one rename."""
        out = self.fs.create(self.at(f"{name}.part"), True)
        try:
            for part in parts:
                out.write(bytearray(part))
        finally:
            out.close()
        self.fs.delete(self.at(name), False)
        if not self.fs.rename(self.at(f"{name}.part"), self.at(name)):
            raise OSError(f"cannot put {name} in place")


def fetch_sources(registry: DataFrame, path: str, transport: Transport, force: bool = False) -> DataFrame:
    """``(name, path, bytes, sha256, last_modified, cached)`` of each source of ``(name, url, product, version, kind)`` after it was fetched.

    A source whose file and sidecar are there is asked for only if it was modified since; an unchanged one is ``cached``. Others are written
    beside the old file, hashed on the way, put in place by a rename, and get a new sidecar. ``force`` asks for everything. A failing
    transport ends the run; what was fetched before stays.
    """
    spark = registry.sparkSession
    folder, found = _Folder(spark, path), []
    for source in registry.orderBy("name").collect():  # a registry is a table of few rows
        name = f"{source['name']}.{'xlsx' if source['kind'] == 'xlsx' else 'pdf'}"
        side = f"{source['name']}.meta.json"
        there = folder.fs.exists(folder.at(name))
        meta = None if force else folder.meta(side)
        since = meta.get("last_modified") if meta and there else None
        response = transport(source["url"], since)
        if response.status == 304 and there and meta:
            size = folder.fs.getFileStatus(folder.at(name)).getLen()
            found.append(Row(source["name"], f"{folder.path}/{name}", size, meta["sha256"], meta.get("last_modified"), True))
            continue
        if response.status != 200:
            raise OSError(f"{source['url']}: status {response.status}")
        digest, size = hashlib.sha256(), 0

        def hashed(parts: Iterable[bytes]):
            nonlocal size
            for part in parts:
                digest.update(part)  # noqa: B023
                size += len(part)
                yield part

        folder.write(name, hashed(response.content))
        told = {k: source[k] for k in ("name", "url", "product", "version")} | {"last_modified": response.last_modified, "sha256": digest.hexdigest(), "bytes": size}
        folder.write(side, [json.dumps(told, indent=2).encode()])
        found.append(Row(source["name"], f"{folder.path}/{name}", size, told["sha256"], response.last_modified, False))
    return spark.createDataFrame(found, RESULT)
