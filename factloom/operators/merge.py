"""Unit contributions merged into one graph, provenance, and rules that a graph must keep.

Facts are merged by id inside a repository: the first contribution in the order (plugin, unit)
wins, and later ones that differ from it are conflicts. Contributions that were deleted take
no part. All merges are aggregates that reduce before the shuffle, so a fact that occurs in
every unit is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

NODE = ["kind", "name", "qualified_name", "symbol_id", "language", "access", "properties"]
EDGE = ["source_id", "target_id", "kind", "ev_quality", "ev_provider", "ev_provider_version", "ev_location", "ev_confidence"]
DECLARATION = ["symbol_id", "symbol_node_id", "path", "start_line", "start_col", "end_line", "end_col", "properties"]
FACTS = {"node": ("node_id", NODE), "edge": ("edge_id", EDGE), "declaration": ("declaration_id", DECLARATION)}


def live(df: DataFrame) -> DataFrame:
    """Contributions that have not been deleted."""
    return df.where("deleted_at is null") if "deleted_at" in df.columns else df


def _fact(fields: list[str], columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in fields if c in columns])


def merge(df: DataFrame, fact: str) -> DataFrame:
    """One row per (repo_id, id): the first contribution's fields, the number of contributors, whether others differ."""
    key, fields = FACTS[fact]
    fields = [f for f in fields if f in df.columns]
    rows = live(df).where(F.col(key).isNotNull()).select("repo_id", key, "plugin_id", "unit_id", _fact(fields, df.columns).alias("f"))
    one = rows.groupBy("repo_id", key, "plugin_id", "unit_id").agg(F.min("f").alias("f"), F.max("f").alias("g"))
    got = one.groupBy("repo_id", key).agg(F.min(F.struct("plugin_id", "unit_id", "f")).alias("first"), F.min("f").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("contributors"))
    return got.select("repo_id", key, *[F.col(f"first.f.{c}").alias(c) for c in fields], "contributors", (~F.col("lo").eqNullSafe(F.col("hi"))).alias("conflict"))


def provenance(df: DataFrame, fact: str, units: DataFrame | None = None) -> DataFrame:
    """(repo_id, fact_kind, fact_id, plugin_id, unit_id[, run_id, plugin_version, source_path]): contributors, distinct."""
    key, _ = FACTS[fact]
    rows = live(df).select("repo_id", F.lit(fact).alias("fact_kind"), F.col(key).alias("fact_id"), "plugin_id", "unit_id").distinct()
    if units is None:
        return rows
    origin = units.groupBy("repo_id", "plugin_id", "unit_id").agg(F.max(F.struct("recorded_at", "run_id", "plugin_version", "source_path")).alias("o"))
    return rows.join(origin, ["repo_id", "plugin_id", "unit_id"], "left").select(*rows.columns, "o.run_id", "o.plugin_version", "o.source_path")


def union_provenance(*parts: DataFrame) -> DataFrame:
    """Contributors of several results per fact, distinct."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct()


# --- rules --------------------------------------------------------------------------------


def _found(df: DataFrame, kind: str, code: str, fact: Column) -> DataFrame:
    return df.select("repo_id", F.lit(kind).alias("kind"), F.lit(code).alias("code"), fact.alias("fact_id"))


def duplicates(df: DataFrame, fact: str) -> DataFrame:
    """Ids that one unit contributes more than once with different content."""
    key, fields = FACTS[fact]
    rows = live(df).groupBy("repo_id", "plugin_id", "unit_id", key).agg(F.min(_fact(fields, df.columns)).alias("lo"), F.max(_fact(fields, df.columns)).alias("hi"))
    return _found(rows.where(~F.col("lo").eqNullSafe(F.col("hi"))), fact, f"replacement.{fact}.duplicate", F.col(key)).distinct()


def conflicts(df: DataFrame, fact: str) -> DataFrame:
    """Facts to which units contribute differing content."""
    return _found(merge(df, fact).where("conflict"), fact, f"graph.{fact}.conflict", F.col(FACTS[fact][0]))


def duplicate_symbols(nodes: DataFrame) -> DataFrame:
    """Symbols that more than one node claims."""
    claims = live(nodes).where("symbol_id is not null").groupBy("repo_id", "symbol_id").agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    return _found(claims.where("a != b"), "node", "graph.symbol.duplicate", F.col("symbol_id"))


def missing_symbols(declarations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declarations whose node does not exist with the same symbol."""
    have = live(nodes).where("symbol_id is not null").select("repo_id", F.col("node_id").alias("symbol_node_id"), "symbol_id").distinct()
    return _found(declarations.join(have, ["repo_id", "symbol_node_id", "symbol_id"], "left_anti"), "declaration", "graph.declaration.symbol-missing", F.col("declaration_id")).distinct()


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node; the ends are reduced to distinct ids before they are looked up."""
    ids = live(nodes).select("repo_id", F.col("node_id").alias("end")).distinct()
    ends = edges.select("repo_id", F.explode(F.array("source_id", "target_id")).alias("end")).where("end is not null").distinct().join(ids, ["repo_id", "end"], "left_anti")
    broken = [edges.join(ends.withColumnRenamed("end", c), ["repo_id", c], "left_semi").select("repo_id", "edge_id") for c in ("source_id", "target_id")]
    null = edges.where("source_id is null or target_id is null").select("repo_id", "edge_id")
    return _found(broken[0].unionByName(broken[1]).unionByName(null).distinct(), "edge", "graph.edge.endpoint-missing", F.col("edge_id"))


def evidence_rules(edges: DataFrame) -> DataFrame:
    """Edges with impossible evidence, and calls that are not resolved."""
    wrong = edges.where(~S.valid_evidence(F.col("ev_quality"), F.col("ev_confidence")))
    calls = edges.where((F.col("kind") == "calls") & (F.col("ev_quality") != "Resolved"))
    return _found(wrong, "edge", "edge.evidence.invalid", F.col("edge_id")).unionByName(_found(calls, "edge", "edge.evidence.calls-requires-resolved", F.col("edge_id"))).distinct()


def batch_limits(nodes: DataFrame, declarations: DataFrame, edges: DataFrame, batch: list[str]) -> DataFrame:
    """(batch..., code, n): batches that hold more facts than allowed."""
    out = None
    for df, name, most in ((nodes, "nodes", S.BATCH_NODES), (declarations, "declarations", S.BATCH_DECLARATIONS), (edges, "edges", S.BATCH_EDGES)):
        part = df.groupBy(*batch).agg(F.count("*").alias("n")).where(F.col("n") > most).withColumn("code", F.lit(f"batch.{name}.limit"))
        out = part if out is None else out.unionByName(part)
    return out


def property_limits(df: DataFrame, fact: str) -> DataFrame:
    """Facts whose properties (a JSON object) exceed the limits on number, text length or list items."""
    key, _ = FACTS[fact]
    rows = df.where("properties is not null").select("repo_id", F.col(key).alias("fact_id"), F.from_json("properties", "map<string,string>").alias("p"))
    values = F.map_values("p")
    rules = (
        ("batch.properties.limit", F.size("p") > S.MAX_PROPERTIES),
        ("batch.property.text-length", F.exists(values, lambda v: (F.length(F.encode(v, "UTF-16BE")) / 2) > S.MAX_TEXT)),
        ("batch.property.list-items", F.exists(values, lambda v: F.coalesce(F.json_array_length(F.when(v.startswith("["), v)), F.lit(0)) > S.MAX_LIST)),
    )
    found = rows.select("repo_id", F.lit(fact).alias("kind"), F.explode(F.array(*[F.when(test, F.lit(code)) for code, test in rules])).alias("code"), "fact_id")
    return found.where("code is not null").distinct()


def violations(nodes: DataFrame, declarations: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, kind, code, fact_id): all rules of a graph at once."""
    parts = [duplicates(nodes, "node"), duplicates(edges, "edge"), duplicates(declarations, "declaration"), conflicts(nodes, "node"), conflicts(edges, "edge"), conflicts(declarations, "declaration"), duplicate_symbols(nodes), missing_symbols(declarations, nodes), missing_endpoints(edges, nodes), evidence_rules(edges)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_violations(found: DataFrame, most: int = S.MAX_ERRORS) -> DataFrame:
    """The first violations in the order (kind, code, fact): what an error reports."""
    return found.orderBy("kind", "code", "fact_id", "repo_id").limit(most)
