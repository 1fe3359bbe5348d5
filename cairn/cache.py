"""Content-addressed tables: Parquet in the shared folder, keyed by content, name and parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from cairn.storage import shared_dir


def key(sha256: str, name: str, params: dict) -> str:
    digest = hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()
    return f"{sha256[:16]}.{name}.{digest[:12]}"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


class Cache:
    """A folder of cached tables; a table counts only once its writer has finished it."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/cairn-cache"

    def get_or_build(self, sha256: str, name: str, params: dict, build: Callable[[], DataFrame], enabled: bool = True) -> tuple[DataFrame, bool]:
        """The table and whether it was there; an unreadable one is built anew."""
        if not enabled:
            return build(), False
        path = f"{self.root}/{key(sha256, name, params)}"
        fs, done = _fs(self.spark, f"{path}/_SUCCESS")
        if fs.exists(done):
            try:
                found = self.spark.read.parquet(path)
                found.limit(1).collect()
                return found, True
            except Exception:  # noqa: BLE001  (whatever is wrong with it, it is rebuilt)
                self._delete(path)
        df = build()
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), False

    def _delete(self, path: str) -> bool:
        fs, jpath = _fs(self.spark, path)
        return fs.delete(jpath, True)

    def entries(self) -> list[str]:
        fs, jpath = _fs(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []

    def clear(self, sha256: str | None = None) -> int:
        """Delete all tables, or those of one content; returns how many."""
        gone = [e for e in self.entries() if sha256 is None or e.startswith(sha256[:16] + ".")]
        for e in gone:
            self._delete(f"{self.root}/{e}")
        return len(gone)

    def stats(self) -> dict:
        fs, jpath = _fs(self.spark, self.root)
        size = fs.getContentSummary(jpath).getLength() if fs.exists(jpath) else 0
        return {"entries": len(self.entries()), "bytes": int(size)}


class Snapshots:
    """A table kept in numbered versions behind a pointer; the last ``keep`` versions stay.

    A save writes version N + 1 beside the current one and then renames a new
    pointer into place, so readers see the old or the new state, never a part.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def version(self) -> int | None:
        fs, jpath = _fs(self.spark, self.root)
        found = [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
        marks = [int(n[8:]) for n in found if n.startswith("current-") and n[8:].isdigit()]
        return max(marks, default=None)

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.root}/v={v}")

    def save(self, df: DataFrame) -> int:
        v = (self.version() or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v={v}")
        fs, mark = _fs(self.spark, f"{self.root}/current-{v}")
        if not fs.createNewFile(mark):
            raise AnalysisException(f"version {v} was saved by another writer")
        for old in range(max(1, v - self.keep)):
            for part in (f"current-{old}", f"v={old}"):
                fs, jpath = _fs(self.spark, f"{self.root}/{part}")
                fs.delete(jpath, True)
        return v
