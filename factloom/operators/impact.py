"""Interface impact: which classes provably implement an interface, who imports it, what stays open and why.

All targets are answered in one plan of equi-joins; nothing is confirmed by name alone. Inputs
are typed tables, one row per fact:

==============  =============================================================================
targets         target, repo_id, name, file_id, record_id
imports         repo_id, id, file_id, imported, local, form, scope, status, target_file, relevance_file, rule
reexports       repo_id, id, file_id, form, clauses (array of imported, exported), status, target_file
contexts        repo_id, id, owner_id, owner_name, file_id, place, written_name, written_form, terminal, clause_status, owner_ambient, module_context, owner_scope, heritage_kind, type_params
locals          repo_id, file_id, name, module_scope, eligible, record_id
exports         repo_id, file_id, entry_id, name
attributions    repo_id, id, entry_id, exported_name, status, record_id
heritage        repo_id, id, kind, owner_id, file_id, place, name
==============  =============================================================================

``place`` is a string that names path and position. Imports and re-exports come resolved (see
:func:`with_resolution`). Null names match nothing; repeated facts count once by their id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

POLICY = "local-v1"
#: Forms of imports that bind one name, and of references that may hide an export.
NAMED = ("named", "named-aliased")
BARRIERS = ("export-from", "export-type-from", "export-star", "export-namespace-from")
#: Most rows of each kind that a result keeps.
MAX_CONFIRMED, MAX_OCCURRENCES, MAX_UNKNOWNS = 1_000, 10_000, 10_000


@dataclass(frozen=True)
class Impact:
    """confirmed, consumers, unknowns: one row per finding; coverage: one row per target."""

    confirmed: DataFrame
    consumers: DataFrame
    unknowns: DataFrame
    coverage: DataFrame


def with_resolution(occurrences: DataFrame, resolutions: DataFrame) -> DataFrame:
    """occurrences with status, target_file, relevance_file and rule of their resolver record, joined by ``resolver_key``.

    ``contradiction`` is true where the record is missing, not unique, or differs in file, place,
    specifier or form; such occurrences prove nothing and are an error of the index.
    """
    r = resolutions.groupBy("repo_id", "resolver_key").agg(F.min(F.struct("file_id", "place", "specifier", "reference_form", "status", "target_file", "relevance_file", "rule")).alias("r"), F.count_distinct("id").alias("n"))
    j = occurrences.join(r, ["repo_id", "resolver_key"], "left")
    same = F.lit(True)
    for c in ("file_id", "place", "specifier", "reference_form"):
        same = same & F.col(c).eqNullSafe(F.col(f"r.{c}"))
    return j.select(occurrences["*"], "r.status", "r.target_file", "r.relevance_file", "r.rule", (F.col("n").isNull() | (F.col("n") > 1) | ~same).alias("contradiction"))


def associated_names(targets: DataFrame, attributions: DataFrame, reexports: DataFrame) -> DataFrame:
    """(target, repo_id, name, origin): the target's name, names its declaration is exported by, and one hop of re-exports."""
    own = targets.select("target", "repo_id", "name", F.concat(F.lit("target:"), "target").alias("origin"))
    by = attributions.where("status = 'attributed'").join(targets.select("target", "repo_id", "record_id"), ["repo_id", "record_id"]).select("target", "repo_id", F.col("exported_name").alias("name"), F.col("id").alias("origin"))
    first = own.unionByName(by)
    clause = reexports.where(F.col("form").isin("export-from", "export-type-from")).select("repo_id", "id", F.explode("clauses").alias("c")).select("repo_id", "id", F.col("c.imported").alias("name"), F.col("c.exported").alias("exported"))
    hop = clause.join(first.select("target", "repo_id", "name").distinct(), ["repo_id", "name"]).where("exported is not null").select("target", "repo_id", F.col("exported").alias("name"), F.concat_ws(":", "id", F.col("name"), "exported").alias("origin"))
    return first.unionByName(hop).distinct()


def _import_route(imports: DataFrame, exports: DataFrame, attributions: DataFrame, reexports: DataFrame) -> DataFrame:
    """imports with route_reason (null: proven), entry_id, attribution_id, record_id."""
    slots = exports.groupBy("repo_id", F.col("file_id").alias("target_file"), F.col("name").alias("imported")).agg(F.min("entry_id").alias("entry_id"))
    att = attributions.groupBy("repo_id", "entry_id").agg(F.min(F.struct("id", "status", "record_id")).alias("a"))
    barred = reexports.where(F.col("form").isin(*BARRIERS)).select("repo_id", F.col("file_id").alias("target_file")).distinct().withColumn("barred", F.lit(True))
    j = imports.join(slots, ["repo_id", "target_file", "imported"], "left").join(att, ["repo_id", "entry_id"], "left").join(barred, ["repo_id", "target_file"], "left")
    reason = (
        F.when(F.col("status") == "unresolved", "unresolved-module")
        .when(F.col("status") == "external", "external-module")
        .when(~F.col("status").eqNullSafe(F.lit("resolved")), "unsupported-import-form")
        .when(F.col("entry_id").isNull() & F.col("barred").isNotNull(), "re-export-barrier")
        .when(F.col("entry_id").isNull(), "missing-export")
        .when(F.col("a").isNull() | (F.col("a.status") == "missing-declaration"), "unattributed-export")
        .when(F.col("a.status") == "ambiguous-declarations", "ambiguous-export")
        .when(F.col("a.status") == "ineligible-declaration-context", "ineligible-declaration")
    )
    return j.select(imports["*"], reason.alias("route_reason"), "entry_id", F.col("a.id").alias("attribution_id"), F.col("a.record_id").alias("record_id"))


def _gate(named: Column, odd: Column, local: Column) -> Column:
    """The first reason, in a fixed order, for which a heritage clause cannot be bound; null: it can."""
    simple = F.col("written_form") == "simple"
    return (
        F.when(F.col("clause_status") == "recovered", "recovered-heritage-syntax")
        .when(F.coalesce("owner_ambient", F.lit(False)) | ~F.col("module_context").eqNullSafe(F.lit("module")), "ambient-or-global-context")
        .when(F.col("owner_scope") == "nested", "nested-scope-heritage")
        .when((F.col("heritage_kind") != "class-implements") & simple, "heritage-kind-not-supported")
        .when(F.col("written_form") == "qualified", "qualified-heritage-unresolved")
        .when(F.col("written_form") == "expression", "unsupported-heritage-form")
        .when(F.array_contains(F.coalesce("type_params", F.array().cast("array<string>")), F.col("written_name")), "type-parameter-shadowing")
        .when(odd > 0, "unsupported-import-form")
        .when(named > 1, "duplicate-local-name")
        .when((named == 1) & (local > 0), "conflicting-local-binding")
    )


def natural(place: Column) -> Column:
    """The order of places: by path, then by line and column as numbers."""
    parts = F.split(place, ":")
    return F.struct(F.get(parts, F.lit(0)).alias("path"), F.get(parts, F.lit(1)).try_cast("bigint").alias("line"), F.get(parts, F.lit(2)).try_cast("bigint").alias("col"), place.alias("text"))


def _capped(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows of each target in a canonical order, with ``over``: whether the target has more."""
    w = Window.partitionBy("target").orderBy(*[natural(F.col(c)) if c == "place" else F.col(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1).withColumn("over", F.max(F.col("_n") > most).over(Window.partitionBy("target"))).where(F.col("_n") <= most).drop("_n")


def interface_impact(targets: DataFrame, imports: DataFrame, reexports: DataFrame, contexts: DataFrame, locals_: DataFrame, exports: DataFrame, attributions: DataFrame, heritage: DataFrame) -> Impact:
    """The impact of each target."""
    def once(df: DataFrame) -> DataFrame:
        """One row per id: of several the least."""
        rest = [c for c in df.columns if c not in ("repo_id", "id")]
        return df.groupBy("repo_id", "id").agg(F.min(F.struct(*rest)).alias("_x")).select("repo_id", "id", *[F.col(f"_x.{c}").alias(c) for c in rest])

    imports, reexports, contexts, attributions, heritage = map(once, (imports, reexports, contexts, attributions, heritage))
    names = cut(associated_names(targets, attributions, reexports))
    known = names.select("target", "repo_id", "name").distinct()
    is_named = F.col("form").isin(*NAMED)
    files = targets.select("target", "repo_id", F.col("file_id").alias("tfile"))

    # Local names under which a file knows the target, and files that import it.
    by_name = imports.where(is_named).join(known.withColumnRenamed("name", "imported"), ["repo_id", "imported"]).select("target", "repo_id", "file_id", F.col("local").alias("name"), "id")
    by_file = imports.where(~is_named).join(files, (imports["repo_id"] == files["repo_id"]) & (imports["relevance_file"] == files["tfile"])).select("target", imports["repo_id"], "file_id", F.col("local").alias("name"), "id")
    aliases = cut(by_name.unionByName(by_file).where("name is not null").distinct())
    visible = imports.where("scope = 'module'")
    j = visible.where(is_named & (F.col("status") == "resolved")).join(files, (visible["repo_id"] == files["repo_id"]) & (visible["target_file"] == files["tfile"])).where("file_id != tfile")
    consumers = _capped(j.select("target", visible["repo_id"], "file_id", F.col("id").alias("occurrence_id"), "imported", "local", "form", "rule"), ["file_id", "occurrence_id"], MAX_OCCURRENCES)

    # Heritage clauses that may name the target, with where the name leads.
    called = F.when(F.col("written_form") == "simple", F.col("written_name")).otherwise(F.col("terminal"))
    ctx = contexts.withColumn("name", called)
    hit_name = ctx.join(names, ["repo_id", "name"]).select("target", "repo_id", "id", F.concat_ws(":", F.lit("associated-name"), "name", "origin").alias("origin"))
    a = aliases.withColumnRenamed("id", "import_id")
    hit_alias = ctx.where("written_form = 'simple'").join(a, ["repo_id", "file_id", "name"]).select("target", "repo_id", "id", F.concat_ws(":", F.lit("import-local-name"), "name", "import_id").alias("origin"))
    candidates = hit_name.unionByName(hit_alias).groupBy("target", "repo_id", "id").agg(F.sort_array(F.collect_set("origin")).alias("origins"))
    bound = visible.groupBy("repo_id", "file_id", F.col("local").alias("written_name")).agg(F.count_if(is_named).alias("named"), F.count_if(F.col("form").isin("default", "namespace", "import-equals", "dynamic")).alias("odd"), F.min(F.when(is_named, F.col("id"))).alias("import_id"))
    own = locals_.where("module_scope").groupBy("repo_id", "file_id", F.col("name").alias("written_name")).agg(F.count("*").alias("n_local"), F.min(F.struct("record_id", "eligible")).alias("own"))
    route = _import_route(visible, exports, attributions, reexports).select("repo_id", F.col("id").alias("import_id"), "route_reason", "entry_id", "attribution_id", F.col("record_id").alias("route_record"))
    zero = F.lit(0).cast("bigint")
    b = candidates.join(ctx.drop("name"), ["repo_id", "id"]).join(bound, ["repo_id", "file_id", "written_name"], "left").join(own, ["repo_id", "file_id", "written_name"], "left")
    b = b.withColumns({"named": F.coalesce("named", zero), "odd": F.coalesce("odd", zero), "n_local": F.coalesce("n_local", zero)}).join(route, ["repo_id", "import_id"], "left")
    gate = _gate(F.col("named"), F.col("odd"), F.col("n_local"))
    same_file = F.when(F.col("n_local") == 0, "unresolved-heritage-name").when(F.col("n_local") > 1, "ambiguous-local-declaration").when(~F.coalesce("own.eligible", F.lit(False)), "ineligible-declaration")
    via_import = F.col("named") == 1
    b = cut(b.withColumns({"reason": F.coalesce(gate, F.when(via_import, F.col("route_reason")).otherwise(same_file)), "route": F.when(via_import, "import").otherwise("same-file"), "found_record": F.when(via_import, F.col("route_record")).otherwise(F.col("own.record_id"))}))

    # Confirmed: the name leads to the target's own declaration, and the index holds the clause.
    stored = heritage.where("kind = 'implements'").groupBy("repo_id", "owner_id", "place").agg(F.min("id").alias("heritage_id"), F.count("*").alias("n_stored"))
    sure = b.where("reason is null").join(targets.select("target", "repo_id", "record_id"), ["target", "repo_id"]).where("found_record = record_id").join(stored.where("n_stored = 1"), ["repo_id", "owner_id", "place"])
    steps = F.array_compact(F.array("heritage_id", "id", F.when(via_import, F.col("import_id")), F.when(via_import, F.col("entry_id")), F.when(via_import, F.col("attribution_id")), "record_id"))
    witness = F.concat(F.lit(f"{POLICY}:"), F.sha2(F.to_json(F.concat(steps, F.array("target", F.lit(POLICY)))), 256))
    each = sure.select("target", "repo_id", "owner_id", "owner_name", "record_id", "route", "place", "origins", steps.alias("steps"), witness.alias("witness"))
    first = F.min(F.struct(natural(F.col("place")).alias("n"), "place", "route", "witness", "steps", "owner_name")).alias("f")
    grouped = each.groupBy("target", "repo_id", "owner_id", "record_id").agg(first, F.sort_array(F.collect_set("witness")).alias("witnesses"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("origins")))).alias("origins"))
    confirmed = _capped(grouped.select("target", "repo_id", "owner_id", "f.owner_name", "record_id", "f.place", "f.route", "f.steps", "witnesses", "origins"), ["place", "owner_name", "owner_id", "record_id"], MAX_CONFIRMED)

    # Open: clauses that could not be bound, stored clauses without context, imports nobody used.
    open_ = b.where("reason is not null").select("target", "repo_id", F.lit("heritage").alias("subject_kind"), F.col("id").alias("subject_id"), "owner_id", "file_id", "place", "reason")
    bare = heritage.where("kind in ('implements', 'inherits')").join(contexts.select("repo_id", "owner_id", "place").distinct(), ["repo_id", "owner_id", "place"], "left_anti")
    reach = known.join(bare, ["repo_id", "name"]).select("target", "repo_id", "id", "owner_id", "file_id", "place").unionByName(bare.join(aliases.drop("id"), ["repo_id", "file_id", "name"]).select("target", "repo_id", "id", "owner_id", "file_id", "place"))
    legacy = reach.distinct().select("target", "repo_id", F.lit("heritage").alias("subject_kind"), F.col("id").alias("subject_id"), "owner_id", "file_id", "place", F.lit("binding-context-unavailable").alias("reason"))
    used = b.select("target", "repo_id", "file_id", F.col("written_name").alias("local")).distinct()
    stars = reexports.where("form = 'export-star'").join(files, (reexports["repo_id"] == files["repo_id"]) & (reexports["target_file"] == files["tfile"])).select("target", reexports["repo_id"], F.col("file_id").alias("target_file")).distinct()
    some = visible.where(is_named & ~F.col("status").eqNullSafe(F.lit("unsupported")))
    rest = some.join(known.withColumnRenamed("name", "imported"), ["repo_id", "imported"]).select("target", "repo_id", "id").unionByName(some.join(stars, ["repo_id", "target_file"]).select("target", "repo_id", "id")).distinct()
    loose = rest.join(visible, ["repo_id", "id"]).join(used, ["target", "repo_id", "file_id", "local"], "left_anti").join(route.select("repo_id", F.col("import_id").alias("id"), "route_reason"), ["repo_id", "id"])
    loose = loose.where(F.col("route_reason").isin("unresolved-module", "external-module", "missing-export", "re-export-barrier")).select("target", "repo_id", F.lit("occurrence").alias("subject_kind"), F.col("id").alias("subject_id"), F.lit(None).cast("string").alias("owner_id"), "file_id", F.lit(None).cast("string").alias("place"), F.col("route_reason").alias("reason"))
    unknowns = _capped(open_.unionByName(legacy).unionByName(loose).dropDuplicates(["target", "subject_id", "reason"]), ["subject_kind", "place", "subject_id", "reason"], MAX_UNKNOWNS)

    counts = lambda df, name: df.groupBy("target").agg(F.count("*").alias(name), F.max("over").alias(f"{name}_over"))
    coverage = targets.select("target", "repo_id").distinct().join(counts(confirmed, "confirmed"), "target", "left").join(counts(consumers, "occurrences"), "target", "left").join(counts(unknowns, "unknown"), "target", "left")
    coverage = coverage.join(b.groupBy("target").agg(F.count("*").alias("heritage_evaluated")), "target", "left")
    over = F.coalesce("confirmed_over", F.lit(False)) | F.coalesce("occurrences_over", F.lit(False)) | F.coalesce("unknown_over", F.lit(False))
    coverage = coverage.select("target", "repo_id", *[F.coalesce(c, zero).alias(c) for c in ("heritage_evaluated", "confirmed", "occurrences", "unknown")], over.alias("truncated"))
    return Impact(confirmed.drop("over"), consumers.drop("over"), unknowns.drop("over"), coverage)


def qualification(snapshot: Column, consistent: Column) -> Column:
    """``consistent`` only if the publication names its snapshot and is consistent, else ``qualified``."""
    return F.when(consistent & snapshot.isNotNull() & (F.trim(snapshot) != ""), "consistent").otherwise("qualified")
