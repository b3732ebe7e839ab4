"""A versioned store of Parquet tables: a generation is a manifest that names its files.

Writers put new files beside the old ones and then rename a manifest into place, which is the commit.
Readers pin a manifest, so they keep seeing one generation whatever is committed meanwhile. All
paths go through Spark's file system layer.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: How folders are written.
WRITTEN = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"}
#: Of tables in order: pages are small, as a look-up in them reads whole pages.
PAGES = dict.fromkeys(("postings", "literals", "slices"), {"parquet.page.size": str(64 << 10)})
#: Spark's setting by which the shuffle files of an execution are deleted at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class StoreError(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.path}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.path}/{name}"), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        return json.loads(self._read(f"manifests/{version:012d}.json")) if version in known else None

    def table(self, name: str, manifest: dict) -> DataFrame:
        entry = manifest["tables"][name]
        schema = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(entry["schema"]).toDDL()
        if not entry["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in entry["files"]])

    def folder(self, *folders: str) -> DataFrame:
        """What put() wrote into folders of the same columns, or some of their files."""
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """Meanwhile a job's shuffle files go when it ends, not when the driver happens to collect its garbage."""
        conf = self.spark.conf
        before = conf.get(TIDY, None)
        conf.set(TIDY, "true")
        try:
            yield
        finally:
            conf.unset(TIDY) if before is None else conf.set(TIDY, before)

    def put(self, df: DataFrame, name: str, level: int = 0) -> dict:
        """Writes df as a new folder; it belongs to no generation until a manifest names it. level is how often its rows have been merged."""
        folder = f"data/{name}/{level}-{uuid.uuid4().hex}"
        df.write.options(**WRITTEN, **PAGES.get(name, {})).parquet(f"{self.path}/{folder}")
        return {"files": [folder], "schema": df.schema.json()}

    def extend(self, df: DataFrame, name: str, folder: str) -> None:
        """Writes df into a folder of put() that no manifest names yet, beside what is there."""
        df.write.mode("append").options(**WRITTEN, **PAGES.get(name, {})).parquet(f"{self.path}/{folder}")

    def files(self, folder: str) -> dict[str, int]:
        """The data files of a folder of put(), with their bytes."""
        found = {s.getPath().getName(): int(s.getLen()) for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))}
        return {name: size for name, size in found.items() if name[0] not in "._"}

    def commit(self, manifest: dict, expected: int | None) -> int:
        """Makes manifest the next version, if expected is still the last one."""
        known = self.versions()
        last = known[-1] if known else None
        if last != expected:
            raise StoreError("another writer has committed")
        version = (last or 0) + 1
        temporary = f"manifests/.{uuid.uuid4().hex}"
        self._write(temporary, json.dumps({**manifest, "version": version}, sort_keys=True))
        if not self._fs.rename(self._path(f"{self.path}/{temporary}"), self._path(f"{self.path}/manifests/{version:012d}.json")):
            raise StoreError("another writer has committed")
        return version

    def remove(self, folder: str) -> None:
        """Deletes a folder, or a file of one, that no manifest names."""
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    @staticmethod
    def level(folder: str) -> int:
        return int(folder.rsplit("/", 1)[-1].split("-")[0])

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all manifests but the last keep, and the folders that none of these names; how many. Readers of
        older generations lose them."""
        known = self.versions()
        named = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for f in t["files"]}
        for v in known[:-keep]:
            self.remove(f"manifests/{v:012d}.json")
        root, gone = self._path(f"{self.path}/data"), 0
        for table in self._fs.listStatus(root) if self._fs.exists(root) else []:
            for folder in self._fs.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in named:
                    self.remove(name)
                    gone += 1
        return gone

    def size(self, folder: str | None = None) -> int:
        """Bytes of the store, or of one of its folders."""
        return int(self._fs.getContentSummary(self._path(f"{self.path}/{folder}" if folder else self.path)).getLength())

    def free(self) -> int:
        return int(self._fs.getStatus().getRemaining())

    def lock(self, timeout: float = 5.0, stale: float = 60.0):
        return Lock(self, timeout, stale)


class Lock:
    """The writer's lock: a file that only one can create; waits up to timeout seconds. The holder touches the file;
    one that has not been touched for stale seconds was left by a dead writer and is taken over. Should a writer
    only have slept, its commit fails, as the manifest it expects is no longer the last."""

    NAME = "writer.lock"

    def __init__(self, store: Store, timeout: float, stale: float):
        self.store, self.timeout, self.stale = store, timeout, stale
        self.token, self.done = uuid.uuid4().hex, threading.Event()

    def _at(self, name: str):
        return self.store._path(f"{self.store.path}/{name}")

    def __enter__(self):
        end = time.monotonic() + self.timeout
        while True:
            try:
                self.store._write(self.NAME, self.token)
                break
            except Exception as error:  # the file system's own exception for an existing file
                if "lreadyExists" not in str(error):
                    raise
                if self._left():
                    continue
                if time.monotonic() > end:
                    raise StoreError("the writer's lock is held") from None
                time.sleep(0.01)
        threading.Thread(target=self._touch, daemon=True).start()
        return self

    def _left(self) -> bool:
        """Moves a stale lock away; of several writers only one's rename succeeds."""
        try:
            touched = self.store._fs.getFileStatus(self._at(self.NAME)).getModificationTime() / 1000
        except Exception:  # gone meanwhile
            return True
        if time.time() - touched <= self.stale:
            return False
        away = f"{self.NAME}.{uuid.uuid4().hex}"
        if self.store._fs.rename(self._at(self.NAME), self._at(away)):
            self.store._fs.delete(self._at(away), False)
        return True

    def _touch(self) -> None:
        while not self.done.wait(self.stale / 4):
            self.store._fs.setTimes(self._at(self.NAME), int(time.time() * 1000), -1)

    def __exit__(self, *_):
        self.done.set()
        if self.store._read(self.NAME) == self.token:
            self.store._fs.delete(self._at(self.NAME), False)
