"""Resolution of references to targets, and facts that are derived from other facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Suffixes tried after a relative specifier, in order, by language.
SUFFIXES = {"typescript": (".ts", ".tsx", ".mts", ".cts", ".d.ts"), "javascript": (".js", ".jsx", ".mjs", ".cjs")}


def resolve_modules(references: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """references (repo_id, path, specifier) with state and target.

    A relative specifier is tried as it stands, with each suffix, and as a directory's index
    with each suffix; the first file that exists is the target (``internal``). One that leaves
    the repository or has empty segments is ``unsupported``, one without any file
    ``unresolved``, any other specifier ``external``; without a specifier it is ``dynamic``.
    """
    rel = F.col("specifier").rlike(r"^\.\.?(/|$)")
    base = X.combine_path(X.directory_of(F.col("path")), F.col("specifier"))
    asked = references.select("repo_id", "path", "specifier").distinct().withColumn("base", F.when(rel, base))
    tried = ("", *SUFFIXES[language], *[f"/index{s}" for s in SUFFIXES[language]])
    options = asked.where("base is not null").select("repo_id", "path", "specifier", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in tried])).alias("rank", "candidate"))
    have = files.select("repo_id", F.col("path").alias("candidate")).distinct()
    best = options.join(have, ["repo_id", "candidate"]).groupBy("repo_id", "path", "specifier").agg(F.min_by("candidate", "rank").alias("target"))
    both = asked.alias("a").join(best.alias("b"), (F.col("a.repo_id") == F.col("b.repo_id")) & (F.col("a.path") == F.col("b.path")) & (F.col("a.specifier") == F.col("b.specifier")), "left").select("a.*", "b.target")
    state = F.when(F.col("specifier").isNull(), "dynamic").when(~rel, "external").when(F.col("base").isNull(), "unsupported").when(F.col("target").isNull(), "unresolved").otherwise("internal")
    return both.select("repo_id", "path", "specifier", state.alias("state"), "target")


def resolve_symbols(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """wanted (ref_id, repo_id, assembly, identity, fingerprint, path) against offered (repo_id, node_id, same columns).

    Four keys are tried in turn: exact assembly with identity, identity, fingerprint, declaring
    path. The first under which anything is offered decides: one node is Found, several are
    Ambiguous; under none it is External.
    """
    keys = (["repo_id", "assembly", "identity"], ["repo_id", "identity"], ["repo_id", "fingerprint"], ["repo_id", "path"])
    out, rest = None, wanted
    for n, key in enumerate(keys):
        one = offered.groupBy(*key).agg(F.min("node_id").alias("node_id"), F.count_distinct("node_id").alias("candidates"))
        hit = rest.join(one, key).select("ref_id", F.when(F.col("candidates") == 1, "Found").otherwise("Ambiguous").alias("state"), F.when(F.col("candidates") == 1, F.col("node_id")).alias("node_id"), "candidates", F.lit(n).alias("stage"))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(hit.select("ref_id"), "ref_id", "left_anti")
    left = rest.select("ref_id", F.lit("External").alias("state"), F.lit(None).cast("string").alias("node_id"), F.lit(0).cast("bigint").alias("candidates"), F.lit(len(keys)).alias("stage"))
    return out.unionByName(left)


def exercised_by(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, source_id, target_id): for every call made by a marked test, the callee is exercised by the test."""
    tests = nodes.where(F.get_json_object("properties", "$['test-method']") == "true").select("repo_id", F.col("node_id").alias("source_id")).distinct()
    calls = edges.where("kind = 'calls' and target_id is not null").join(tests, ["repo_id", "source_id"], "left_semi")
    return calls.select("repo_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")).distinct()


def merged_documentation(nodes: DataFrame, most: int = 2048) -> DataFrame:
    """(repo_id, symbol_id, doc): distinct summaries of a symbol in order, joined by blank lines, cut to a length."""
    doc = F.get_json_object("properties", "$['doc-summary']")
    rows = nodes.where("symbol_id is not null").select("repo_id", "symbol_id", doc.alias("doc")).where("doc is not null and trim(doc) != ''")
    return rows.groupBy("repo_id", "symbol_id").agg(F.left(F.array_join(F.sort_array(F.collect_set("doc")), "\n\n"), F.lit(most)).alias("doc"))


def common_modifiers(rows: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, modifiers): modifiers that all declarations of a symbol have (rows: modifiers as an array)."""
    n = rows.groupBy("repo_id", "symbol_id").agg(F.count("*").alias("n"))
    each = rows.select("repo_id", "symbol_id", F.explode(F.array_distinct("modifiers")).alias("m")).groupBy("repo_id", "symbol_id", "m").agg(F.count("*").alias("k"))
    common = each.join(n, ["repo_id", "symbol_id"]).where("k = n").groupBy("repo_id", "symbol_id").agg(F.sort_array(F.collect_set("m")).alias("modifiers"))
    return n.select("repo_id", "symbol_id").join(common, ["repo_id", "symbol_id"], "left").withColumn("modifiers", F.coalesce("modifiers", F.array().cast("array<string>")))


def glob_matches(globs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, project, path): files that a project's globs include and none of its exclusions name.

    globs: (repo_id, project, glob, include). The join is on the repository and the glob's
    fixed leading directory, so a glob meets the files below it only.
    """
    @F.udf("string")
    def pattern(g: str | None) -> str | None:
        return None if g is None else X.glob_regex(g)

    rules = globs.withColumn("rx", pattern("glob")).withColumn("top", F.regexp_extract(F.translate("glob", "\\", "/"), r"^([^/*?]+)/", 1))
    f = files.select("repo_id", "path", F.explode(F.array_distinct(F.array(F.lit(""), F.substring_index("path", "/", 1)))).alias("top"))
    hit = f.join(rules, ["repo_id", "top"]).where(F.expr("path rlike rx"))
    return hit.groupBy("repo_id", "project", "path").agg(F.bool_and("include").alias("ok")).where("ok").drop("ok")
