"""Runs, staged units and atomic publications of a fact graph on a shared file system.

A publication is an immutable folder; a small pointer file names the present one of each
repository and is replaced by an atomic rename. Completing a run compares the pointer with the
one the run started from, so a run that was overtaken fails and leaves nothing behind. Nothing
that is staged is visible before that. Facts never pass through the driver; manifests do.

One driver at a time may complete runs of a repository: file systems have no compare-and-swap.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, planner
from ..schema import RUN_STATUSES

UNIT = ["repo_id", "plugin_id", "unit_id"]
TABLES = ("units", "nodes", "declarations", "edges")
#: Bounds of an exported snapshot.
EXPORT_UNITS, EXPORT_NODES, EXPORT_EDGES, EXPORT_BYTES = 4_096, 100_000, 200_000, 64 << 20


class StoreError(ValueError):
    """A rule of the store was broken; code names it, found holds the first violations."""

    def __init__(self, code: str, text: str = "", found: list | None = None) -> None:
        super().__init__(f"{code}: {text}" if text else code)
        self.code, self.found = code, found or []


class GraphStore:
    """A store below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jpath = jvm.org.apache.hadoop.fs.Path

    # Small files.

    def _exists(self, at: str) -> bool:
        return self._fs.exists(self._jpath(at))

    def _read(self, at: str) -> dict | None:
        if not self._exists(at):
            return None
        stream = self._fs.open(self._jpath(at))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, at: str, value: dict) -> None:
        """Replaces a file: written beside it first, then renamed over it."""
        new = f"{at}.{uuid.uuid4().hex}"
        out = self._fs.create(self._jpath(new), True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._jpath(new), self._jpath(at), options)

    @staticmethod
    def _name(*parts: str) -> str:
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]

    # Repositories and runs.

    def upsert_repository(self, repo: str, manifest: dict | None = None) -> None:
        self._write(f"{self.path}/repositories/{self._name(repo)}.json", {"repo_id": repo, **(manifest or {})})

    def repository(self, repo: str) -> dict | None:
        return self._read(f"{self.path}/repositories/{self._name(repo)}.json")

    def _run_at(self, repo: str, run: str) -> str:
        return f"{self.path}/runs/{self._name(repo, run)}.json"

    def run(self, repo: str, run: str) -> dict | None:
        return self._read(self._run_at(repo, run))

    def store_run(self, repo: str, run: str, status: str = "Running", plugins: tuple[str, ...] = ()) -> dict:
        """Registers a run or ends it. The same call again changes nothing; ended runs stay as they are."""
        if status not in RUN_STATUSES:
            raise StoreError("run.status.unknown", status)
        if self.repository(repo) is None:
            raise StoreError("run.repository.missing", repo)
        had = self.run(repo, run)
        if had is None:
            publication = self.publication(repo)
            had = {"repo_id": repo, "run_id": run, "status": "Running", "plugins": sorted(set(plugins)), "baseline": publication and publication["id"], "started_at": time.time()}
            if status == "Completed":  # only complete() ends a run so
                raise StoreError("run.transition.invalid", f"none to {status}")
            if status != "Running":
                had |= {"status": status, "completed_at": time.time()}
        elif had["status"] == status:
            return had
        elif had["status"] != "Running" or status == "Completed":
            raise StoreError("run.transition.invalid", f"{had['status']} to {status}")
        else:
            had |= {"status": status, "completed_at": time.time()}
        self._write(self._run_at(repo, run), had)
        if status in ("Failed", "Cancelled"):
            self._fs.delete(self._jpath(self._staging(repo, run)), True)
        return had

    def _staging(self, repo: str, run: str) -> str:
        return f"{self.path}/staging/{self._name(repo, run)}"

    def _running(self, repo: str, run: str, code: str) -> dict:
        had = self.run(repo, run)
        if had is None or had["status"] != "Running":
            raise StoreError(f"{code}.run.not-running", run)
        return had

    # Staging.

    def stage(self, repo: str, run: str, units: DataFrame, nodes: DataFrame, declarations: DataFrame, edges: DataFrame) -> None:
        """Replacements of whole units: all their facts. A later one of the same unit takes its place.

        Units of another repository or of a plugin that is not of the run (null counts as such), and
        facts that break a rule of their own (evidence, limits of properties, one id twice in a
        unit), are rejected here; rules between facts are checked when the run is completed.
        """
        had = self._running(repo, run, "replacement")
        mine = F.col("repo_id").eqNullSafe(F.lit(repo)) & F.coalesce(F.col("plugin_id").isin(*had["plugins"]), F.lit(False))
        if not units.where(~mine).isEmpty():
            raise StoreError("replacement.plugin.not-in-run", run)
        own = [merge.duplicates(df, fact) for df, fact in ((nodes, "node"), (declarations, "declaration"), (edges, "edge"))] + [merge.property_limits(df, fact) for df, fact in ((nodes, "node"), (declarations, "declaration")) if "properties" in df.columns]
        if "ev_quality" in edges.columns:
            own.append(merge.evidence_rules(edges))
        found = [tuple(r) for r in merge.first_violations(reduce(DataFrame.unionByName, own)).collect()]
        if found:
            raise StoreError(found[0][2], run, found)
        at = f"{self._staging(repo, run)}/{time.time_ns():020d}-set"
        for name, df in zip(TABLES, (units, nodes, declarations, edges)):
            df.write.parquet(f"{at}/{name}")

    def stage_deletion(self, repo: str, run: str, units: DataFrame) -> None:
        """Deletions of units."""
        self._running(repo, run, "deletion")
        units.select(*UNIT).write.parquet(f"{self._staging(repo, run)}/{time.time_ns():020d}-del/units")

    def _steps(self, repo: str, run: str) -> list[str]:
        at = self._staging(repo, run)
        return sorted(str(x.getPath().toString()) for x in self._fs.listStatus(self._jpath(at))) if self._exists(at) else []

    # Publications.

    def publication(self, repo: str) -> dict | None:
        """What is published: id, run, identity, folder."""
        return self._read(f"{self.path}/current/{self._name(repo)}.json")

    def read(self, publication: dict) -> dict[str, DataFrame]:
        """The tables of a publication; they do not change, whatever is published later."""
        return {t: self.spark.read.parquet(f"{publication['folder']}/{t}") for t in TABLES}

    def pinned(self, publication: dict) -> dict[str, DataFrame]:
        """The tables of a publication for a view that must be of the latest one; an error if another has been published since."""
        latest = self.publication(publication["repo_id"])
        if (latest and latest["id"]) != publication["id"]:
            raise StoreError("publication.moved", publication["id"])
        return self.read(publication)

    def complete(self, repo: str, run: str, snapshot: str | None = None, consistent: bool = True, incomplete: DataFrame | None = None) -> dict:
        """Publishes what the run staged on top of its baseline, if that is still the latest and the graph is whole.

        incomplete: units of the run that ingestion still holds (:func:`streaming.ingest.incomplete`);
        with any, the run is not completed.
        """
        had = self._running(repo, run, "completion")
        held = incomplete and incomplete.orderBy(*incomplete.columns).first()
        if held:
            raise StoreError(held["code"], run, [tuple(held)])
        latest = self.publication(repo)
        if (latest and latest["id"]) != had["baseline"]:
            raise StoreError("completion.baseline.superseded", run)
        tables: dict[str, DataFrame | None] = dict(self.read(latest)) if latest else dict.fromkeys(TABLES)
        for step in self._steps(repo, run):
            gone = self.spark.read.parquet(f"{step}/units").select(*UNIT).distinct()
            for t in TABLES:
                kept = tables[t] and tables[t].join(gone, UNIT, "left_anti")
                if step.endswith("-set"):
                    new = self.spark.read.parquet(f"{step}/{t}")
                    kept = kept.unionByName(new, allowMissingColumns=True) if kept is not None else new
                tables[t] = kept
        if any(tables[t] is None for t in TABLES):
            raise StoreError("completion.nothing-staged", run)
        id_ = self._name(repo, run, uuid.uuid4().hex)
        folder = f"{self.path}/publications/{id_}"
        for t in TABLES:
            tables[t].write.parquet(f"{folder}/{t}")
        now = self.read({"folder": folder})
        found = [tuple(r) for r in merge.first_violations(self._rules(now)).collect()]
        if found:
            self._fs.delete(self._jpath(folder), True)
            raise StoreError(found[0][2], run, found)
        published = {"id": id_, "repo_id": repo, "run_id": run, "folder": folder, "snapshot": snapshot, "consistent": consistent, "identity": self._identity(repo, now["units"], snapshot, consistent)}
        self._write(f"{self.path}/current/{self._name(repo)}.json", published)
        self._write(self._run_at(repo, run), had | {"status": "Completed", "completed_at": time.time(), "publication": id_})
        self._fs.delete(self._jpath(self._staging(repo, run)), True)
        return published

    def _rules(self, t: dict[str, DataFrame]) -> DataFrame:
        return merge.violations(t["nodes"], t["declarations"], t["edges"])

    def _identity(self, repo: str, units: DataFrame, snapshot: str | None, consistent: bool) -> str:
        src = F.struct("plugin_id", "plugin_version", F.col("source_path").alias("path"), F.col("source_hash").alias("hash"))
        rows = units.where("source_path is not null").agg(F.collect_set(src).alias("s"))
        return rows.select(planner.index_identity(F.lit(repo), F.lit(consistent), F.lit(snapshot), F.col("s"))).first()[0]

    def health(self) -> DataFrame:
        """Distinct facts of everything that is published."""
        at = f"{self.path}/current"
        files = [str(x.getPath().toString()) for x in self._fs.listStatus(self._jpath(at))] if self._exists(at) else []
        if not files:
            return self.spark.createDataFrame([], "repo_id string, units bigint, nodes bigint, declarations bigint, edges bigint")
        tables = [self.read(self._read(f)) for f in files]
        return planner.health(*[reduce(DataFrame.unionByName, (x[t] for x in tables)) for t in ("nodes", "declarations", "edges", "units")])

    # Snapshots.

    def export(self, repo: str) -> str:
        """A publication as JSON text with the digest of its payload; refuses what exceeds the bounds."""
        publication = self.publication(repo)
        if publication is None:
            raise StoreError("snapshot.publication.missing", repo)
        if not publication["consistent"]:
            raise StoreError("snapshot.publication.inconsistent", repo)
        tables = self.read(publication)
        for t, most in (("units", EXPORT_UNITS), ("nodes", EXPORT_NODES), ("edges", EXPORT_EDGES), ("declarations", EXPORT_NODES)):
            if tables[t].limit(most + 1).count() > most:
                raise StoreError(f"snapshot.{t}.limit", repo)
        payload = {"schema": 1, "hash": "", "repo_id": repo, "snapshot": publication["snapshot"], "identity": publication["identity"], "schemas": {t: json.loads(tables[t].schema.json()) for t in TABLES}, "tables": {t: sorted(r[0] for r in tables[t].select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"})).collect()) for t in TABLES}}
        payload["hash"] = self._digest(payload)
        text = json.dumps(payload, sort_keys=True)
        if len(text.encode()) > EXPORT_BYTES:
            raise StoreError("snapshot.bytes.limit", repo)
        return text

    @staticmethod
    def _digest(payload: dict) -> str:
        return hashlib.sha256(json.dumps(payload | {"hash": ""}, sort_keys=True).encode()).hexdigest()

    def import_(self, text: str, run: str) -> dict:
        """Publishes an exported snapshot by the ordinary way of staging."""
        if len(text.encode()) > EXPORT_BYTES:
            raise StoreError("snapshot.bytes.limit")
        payload = json.loads(text)
        if payload.get("schema") != 1 or self._digest(payload) != payload.get("hash"):
            raise StoreError("snapshot.hash.mismatch")
        from pyspark.sql.types import StructType

        repo, frames = payload["repo_id"], []
        for t in TABLES:
            schema = StructType.fromJson(payload["schemas"][t])
            rows = self.spark.createDataFrame([(x,) for x in payload["tables"][t]], "j string")
            frames.append(rows.select(F.from_json("j", schema).alias("x")).select("x.*"))
        if self.repository(repo) is None:
            self.upsert_repository(repo)
        plugins = tuple(r[0] for r in frames[0].select("plugin_id").distinct().collect())
        self.store_run(repo, run, plugins=plugins)
        self.stage(repo, run, *frames)
        return self.complete(repo, run, payload["snapshot"])
