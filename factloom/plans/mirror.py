"""The adjacency of a publication, kept beside it, so that walks need not rank edges anew."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.traverse import adjacency
from ..session import Folder


class MirrorError(Exception):
    """code: ``mirror.missing`` or ``mirror.stale``."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


class Mirror:
    """Adjacency of one version of the edges below a folder that all executors share.

    The rows are written first and named by a manifest last, so a mirror is that of one version
    as a whole; what an earlier or a broken build left behind is removed by the next one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, path)

    def version(self) -> str | None:
        """The version that is mirrored; None: none."""
        return json.loads(self.folder.read("manifest.json"))["version"] if self.folder.exists("manifest.json") else None

    def build(self, edges: DataFrame, version: str) -> None:
        """Mirrors edges as that version; a version that is mirrored already is left alone.

        Rows lie sorted by repository and node, so a walk's look-ups prune row groups.
        """
        if self.version() == version:
            return
        old = self.folder.names()
        name = f"adjacency-{uuid.uuid4().hex}"
        rows = adjacency(edges)
        rows.repartitionByRange("repo_id", "node", "a").sortWithinPartitions("repo_id", "node", "a").write.parquet(f"{self.path}/{name}")
        self.folder.write("manifest.json", json.dumps({"version": version, "rows": name}))
        for x in old:
            if x.startswith("adjacency-"):
                self.folder.delete(x)

    def adjacency(self, version: str) -> DataFrame:
        """The rows for ``traverse(adj=...)``; MirrorError unless they are of that version."""
        held = self.version()
        if held is None:
            raise MirrorError("mirror.missing")
        if held != version:
            raise MirrorError("mirror.stale")
        return self.spark.read.parquet(f"{self.path}/{json.loads(self.folder.read('manifest.json'))['rows']}")

    def drop(self) -> None:
        """Removes the mirror; the edges it was made of are untouched."""
        self.folder.delete("")
