"""Tables of immutable files behind a manifest.

Below the table's path lie ``data/commit=<id>/<key>=<value>/`` folders, which are written once and
never changed, and ``manifests/v<number>.json``. A manifest names the folders that make up the
table at its version, and whatever the table's owner keeps beside them. A change writes its files
first and then the next manifest, in one step. So a reader that resolved a version keeps its rows
while others write; a crash leaves the version before; files that no manifest names do not count.

Manifests are small: a line for each key value and commit not yet merged. One writer at a time: a
second one finds the next version taken and gets an error.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sugarline.session import exists, list_files, list_folders, read_text, remove, write_text


@dataclass
class Manifest:
    """``folders`` has the commits of each key value; ``notes`` are the owner's."""

    version: int = 0
    written: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


class Table:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def versions(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p, _, _ in list_files(self.spark, f"{self.path}/manifests")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _file(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:020d}.json"

    def load(self, version: int | None = None) -> Manifest:
        """A version, by default the last; an empty one for a table that was never written."""
        if version is None:
            found = self.versions()
            if not found:
                return Manifest()
            version = found[-1]
        return Manifest(**json.loads(read_text(self.spark, self._file(version))))

    def commit(self, manifest: Manifest) -> Manifest:
        """Make the next version of what ``manifest`` holds now."""
        manifest.version += 1
        manifest.written = time.time_ns()
        write_text(self.spark, self._file(manifest.version), json.dumps(vars(manifest)))
        return manifest

    def write(self, frame: DataFrame) -> tuple[str, list[str]]:
        """Write files that no manifest names yet: the commit's id and the key values it holds.

        Rebalancing makes one or few files per key value and splits one that is too big.
        """
        commit = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.path}/data/commit={commit}"
        frame.hint("rebalance", self.key).write.partitionBy(self.key).parquet(folder)
        values = [p.rsplit("/", 1)[1].split("=", 1)[1] for p in list_folders(self.spark, folder) if f"/{self.key}=" in p]
        return commit, values

    def read(self, manifest: Manifest, values: list[str] | None = None) -> DataFrame:
        """Rows of the version, of some key values only if given; other folders are not listed."""
        wanted = manifest.folders if values is None else {v: manifest.folders.get(v, []) for v in values}
        paths = [f"{self.path}/data/commit={c}/{self.key}={v}" for v, commits in sorted(wanted.items()) for c in commits]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*paths).select(*self.schema.fieldNames())

    def vacuum(self, keep: int = 20) -> None:
        """Remove all manifests but the last ``keep``, and the files that only they named. Files of
        writes begun after the oldest kept version stay."""
        versions = self.versions()
        kept = [self.load(v) for v in versions[-keep:]]
        if not kept:
            return
        for version in versions[:-keep]:
            remove(self.spark, self._file(version))
        named = {f"commit={c}/{self.key}={v}" for m in kept for v, commits in m.folders.items() for c in commits}
        for commit in list_folders(self.spark, f"{self.path}/data"):
            if int(commit.rsplit("=", 1)[1].split("-")[0]) > kept[0].written:
                continue
            folders = list_folders(self.spark, commit)
            dead = [f for f in folders if "/".join(f.rsplit("/", 2)[1:]) not in named]
            for folder in [commit] if len(dead) == len(folders) else dead:
                remove(self.spark, folder)

    def was_written(self) -> bool:
        return exists(self.spark, f"{self.path}/manifests")
