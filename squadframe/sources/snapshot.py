"""Several tables published together: a version is a folder with a manifest, and a pointer names the one that counts.

Tables are written once, and what the manifest says of them is observed while they are written. The pointer is a small
file of its own that is written last, under a name that sorts after all before it; readers take the last whole one, so
they see the old version or the new one and never some tables of each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import exists


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and moved to its place."""
    system, at = _system(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(aside, at):
        raise FileExistsError(path)  # another writer was first


def _get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published versions, in order."""
    if not exists(spark, f"{folder}/published"):
        return []
    system, at = _system(spark, f"{folder}/published")
    names = [f.getPath().getName() for f in system.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], measures: dict[str, dict[str, Column]] | None = None, about: dict[str, object] | None = None) -> int:
    """Writes the tables as the next version and publishes it; returns its number.

    The manifest holds each table's schema, its rows and the table's further measures (aggregates by name), all observed
    in the pass that writes it. A table that fails leaves the version unpublished and the one before in force; of two
    writers at a time one fails. The folder is one that all executors share.
    """
    number, at = max(versions(spark, folder), default=0) + 1, f"{folder}/versions/{uuid.uuid4().hex}"
    manifest: dict[str, object] = {"version": number, "at": at, **(about or {}), "tables": {}}
    for name, df in tables.items():
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        wanted = {"rows": F.count(F.lit(1)), **(measures or {}).get(name, {})}
        df.observe(seen, *[c.alias(k) for k, c in wanted.items()]).write.parquet(f"{at}/{name}")
        manifest["tables"][name] = {"schema": df.schema.simpleString(), **seen.get}
    _put(spark, f"{folder}/published/{number:012d}.json", json.dumps(manifest, default=str, sort_keys=True))
    return number


class Reader:
    """Tables of the version that is in force, by name; what is derived from them is made once for each version.

    `refresh` looks for a newer version. Tables that were handed out before stay readable, as a version's files are never
    changed; what was derived from them is given up (and no longer cached).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.manifest, self.made = spark, folder.rstrip("/"), None, {}
        self.refresh()

    def refresh(self) -> bool:
        """Whether there was a newer version."""
        known = versions(self.spark, self.folder)
        if not known or self.manifest and self.manifest["version"] == known[-1]:
            return False
        self.manifest = json.loads(_get(self.spark, f"{self.folder}/published/{known[-1]:012d}.json"))
        for df in self.made.values():
            df.unpersist()
        self.made = {}
        return True

    def table(self, name: str) -> DataFrame:
        if self.manifest is None:
            raise ValueError(f"nothing is published in {self.folder}")
        return self.spark.read.parquet(f"{self.manifest['at']}/{name}")

    def derived(self, name: str, make: Callable[[Reader], DataFrame], keep: bool = False) -> DataFrame:
        """A table made of the version's tables, once for each version; kept in memory and on disk if wanted."""
        if name not in self.made:
            self.made[name] = make(self).persist() if keep else make(self)
        return self.made[name]


def withdraw(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Deletes all published versions but the last `keep`."""
    for number in versions(spark, folder)[:-keep]:
        pointer = f"{folder}/published/{number:012d}.json"
        at = json.loads(_get(spark, pointer))["at"]
        for path in (pointer, at):
            system, p = _system(spark, path)
            system.delete(p, True)
