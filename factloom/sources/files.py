"""Repositories of files as sources: inventory, routing to plugins, content with re-verified hashes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import SOURCE_BYTES, TOTAL_BYTES

# What an inventory leaves out, and its bounds.
EXCLUDED = (".git", "bin", "obj", "node_modules", "dist", "packages", "vendor")
MAX_DEPTH, MAX_ENTRIES = 64, 1_000_000


class SourceError(ValueError):
    """A source cannot be used; code says why."""

    def __init__(self, code: str, text: str = "") -> None:
        super().__init__(f"{code}: {text}" if text else code)
        self.code = code


def inventory(spark: SparkSession, root: str, repo_id: str, excluded: tuple[str, ...] = EXCLUDED, max_depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(repo_id, path, length, modified_at, content): files below a root, listed by Spark's own reader.

    Excluded directory names are compared without regard to case; deeper files are an error,
    as are more files than allowed. Symbolic links are not followed by the file system's listing.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    start = spark._jvm.org.apache.hadoop.fs.Path(base)
    prefix = start.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(start).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:(//[^/]*)?", "")
    rel = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(path)
    rows = files.select(F.lit(repo_id).alias("repo_id"), rel.alias("path"), "length", F.col("modificationTime").alias("modified_at"), "content")
    dirs = F.transform(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.lower)
    kept = rows.where(~F.arrays_overlap(dirs, F.array(*[F.lit(x.lower()) for x in excluded])) if excluded else F.lit(True))
    paths = kept.select("path")
    if not paths.where(F.size(F.split("path", "/")) > max_depth).isEmpty():
        raise SourceError("source.depth.limit", str(max_depth))
    if paths.limit(max_entries + 1).count() > max_entries:
        raise SourceError("source.entries.limit", str(max_entries))
    return kept


def hashed(files: DataFrame) -> DataFrame:
    """files with ``hash`` in place of their content."""
    return files.withColumn("hash", X.content_hash(F.col("content"))).drop("content")


@dataclass(frozen=True)
class Plugin:
    """A plugin: its id, version, language, and the extensions it claims."""

    plugin_id: str
    version: str
    language: str
    extensions: tuple[str, ...]


def route(files: DataFrame, plugins: list[Plugin], preferred: dict[str, list[str]] | None = None) -> DataFrame:
    """files with plugin_id and plugin_version; null where no plugin claims the extension.

    Of several claimants the first one in the language's order of preference is taken; a
    claimant that the order does not name, or several without an order, is an error.
    """
    claims: dict[str, list[Plugin]] = {}
    for p in plugins:
        for e in p.extensions:
            claims.setdefault(e.lower(), []).append(p)
    winner, version = F.lit(None).cast("string"), F.lit(None).cast("string")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    for e, claimants in sorted(claims.items()):
        chosen = claimants[0]
        if len(claimants) > 1:
            order = (preferred or {}).get(claimants[0].language)
            if not order or any(c.plugin_id not in order for c in claimants):
                raise SourceError("routing.ambiguous", e)
            chosen = min(claimants, key=lambda c: order.index(c.plugin_id))
        winner = F.when(extension == e, chosen.plugin_id).otherwise(winner)
        version = F.when(extension == e, chosen.version).otherwise(version)
    return files.withColumns({"plugin_id": winner, "plugin_version": version})


def resolve_provider(providers: dict[str, Callable[[str], bool]], descriptor: str) -> str:
    """The one provider that can open a descriptor; none or several are errors, whatever their order."""
    able = sorted(name for name, can in providers.items() if can(descriptor))
    if len(able) != 1:
        raise SourceError("provider.missing" if not able else "provider.ambiguous", descriptor)
    return able[0]


def materialise(files: DataFrame, plan: DataFrame, per_source: int = SOURCE_BYTES, in_total: int = TOTAL_BYTES) -> DataFrame:
    """Content of the planned sources (path, hash), each read once, with ``problem``.

    ``source.changed`` where the bytes no longer have the planned hash, ``source.missing``
    where the file is gone, ``source.too-large`` beyond the size of one source. More bytes in
    total than allowed are an error.
    """
    joined = plan.select("path", "hash").distinct().join(files.select("path", "content"), "path", "left")
    size = F.length("content")
    problem = F.when(F.col("content").isNull(), "source.missing").when(size > per_source, "source.too-large").when(X.content_hash(F.col("content")) != F.col("hash"), "source.changed")
    total = joined.agg(F.sum(F.length("content"))).first()[0] or 0
    if total > in_total:
        raise SourceError("source.total.limit", str(total))
    return joined.withColumn("problem", problem)
