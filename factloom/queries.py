"""The core's registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, hierarchy, lookup, merge, orphans, planner, replay, resolve, traverse
from .plans.mirror import Mirror
from .schema import IMPACT
from .session import cut, scratch, table
from .sources import extract


def _orphan_state(spark: SparkSession, d: str) -> orphans.OrphanState:
    """The state after the tables, applied quarter by quarter."""
    edges, decl = table(spark, d, "edges"), table(spark, d, "declarations")
    nodes, units, runs = (table(spark, d, t) for t in ("nodes", "units", "runs"))
    refs = (
        orphans.references(edges, "edges", "node", "edge_id", "written_at", "source_id", "target_id")
        .unionByName(orphans.references(decl, "declarations", "node", "declaration_id", "written_at", "symbol_node_id"))
        .unionByName(orphans.references(units, "units", "run", "unit_id", "recorded_at", "run_id"))
    )
    events = orphans.parent_events(nodes, "node", "node_id", "written_at", "deleted_at", ("plugin_id", "unit_id")).unionByName(orphans.parent_events(runs, "run", "run_id", "started_at"))
    state = orphans.OrphanState(spark, scratch(spark, "orphans"))
    first = events.agg(F.min(orphans.quarter(F.col("at"), 1 << 30))).first()[0]
    state.append(refs, events, orphans.quarter(F.col("at"), first or 0))
    return state.replay()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """References with no live record."""
    return _orphan_state(spark, d).orphans()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per table, column and month."""
    state = _orphan_state(spark, d)
    return orphans.orphan_counts(state.refs(), state.pending())


def p1_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Open references after every quarter, per table, column and month of the reference."""
    return _orphan_state(spark, d).snapshots()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Units published after the command log took effect."""
    return replay.published_units(table(spark, d, "command_log"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return cut(hierarchy.hierarchy_links(table(spark, d, "edges")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on a cycle of contains and declares edges."""
    return hierarchy.cycle_nodes(_links(spark, d))


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Parent, root, depth, path (a JSON array), cycle mark and number of descendants of each node."""
    return hierarchy.hierarchy(_links(spark, d)).withColumn("path", F.to_json("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each node with each of its descendants over all links."""
    return hierarchy.descendants(_links(spark, d))


def p6_split(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p6_hierarchy, from fragments so small that most repositories are split."""
    return hierarchy.hierarchy(_links(spark, d), 100).withColumn("path", F.to_json("path"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Current sources that are new or changed since the last successful run: the next batch of the change log."""
    sources, runs, states = (table(spark, d, t) for t in ("source_files", "runs", "index_states"))
    log = changes.ChangeLog(spark, scratch(spark, "changes"))
    log.start(changes.committed_sources(runs, states))
    return log.sink(log.run(sources)).select("repo_id", "plugin_id", "path").distinct()


def p7_batches(spark: SparkSession, d: str) -> DataFrame:
    """Records that each of two batches delivers, the first over the observations of the first half year, and what is left after them."""
    sources, runs, states = (table(spark, d, t) for t in ("source_files", "runs", "index_states"))
    log = changes.ChangeLog(spark, scratch(spark, "changes"))
    log.start(changes.committed_sources(runs, states))
    early = log.run(sources.where("observed_at < timestamp_ntz'2025-07-01'"))
    late = log.run(sources)
    return log.sink().groupBy("repo_id", F.when(F.col("batch") == early, "first").when(F.col("batch") == late, "second").alias("batch"), "change").agg(F.count("*").alias("n"))


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """All sources of the plan with their change, removed ones included."""
    plan = changes.plan_changes(*(table(spark, d, t) for t in ("source_files", "runs", "index_states")), keep_all=True)
    return plan.groupBy("repo_id", "change").count().withColumnRenamed("count", "n")


# --- the graph ------------------------------------------------------------------------------


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge(table(spark, d, "nodes"), "node")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge(table(spark, d, "edges"), "edge")


def _declarations(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge(table(spark, d, "declarations"), "declaration")


def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes merged from their contributions."""
    return _nodes(spark, d).select("repo_id", "node_id", "kind", "name", "qualified_name", "symbol_id", "contributors", "conflict")


def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges merged from their contributions."""
    return _edges(spark, d).select("repo_id", "edge_id", "source_id", "target_id", "kind", "ev_quality", "contributors", "conflict")


def merge_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Declarations merged from their contributions."""
    return _declarations(spark, d).select("repo_id", "declaration_id", "symbol_id", "path", "start_line", "contributors", "conflict")


def provenance_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Contributors of every node."""
    return merge.provenance(table(spark, d, "nodes"), "node")


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the graph, per code and repository."""
    found = merge.violations(table(spark, d, "nodes"), table(spark, d, "declarations"), table(spark, d, "edges"))
    return found.groupBy("repo_id", "code").agg(F.count_distinct("fact_id").alias("n"))


def violations_first(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred broken endpoint rules, as an error reports them."""
    return merge.first_violations(merge.missing_endpoints(table(spark, d, "edges"), merge.live(table(spark, d, "nodes")))).select("repo_id", "fact_id")


def symbol_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every qualified name with its candidates."""
    nodes = _nodes(spark, d)
    return lookup.symbols_by_name(nodes, nodes.select(F.col("qualified_name").alias("name")).where("name is not null")).select("name", "repo_id", "node_id", "candidates")


def symbol_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The node of every symbol."""
    return lookup.symbol_by_id(_nodes(spark, d))


def name_pattern_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty nodes whose name holds a text."""
    return lookup.by_pattern(_nodes(spark, d), "LEDGER")[0].select("repo_id", "node_id", "qualified_name", "name")


def name_pattern_total(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes' names hold it."""
    return lookup.by_pattern(_nodes(spark, d), "LEDGER")[1]


def discovery_unscoped(spark: SparkSession, d: str) -> DataFrame:
    """Callables in two languages among the first matches of a text."""
    return lookup.discover(_nodes(spark, d), "Meter", ("callable",), ("csharp", "typescript"), 200)[0].select("repo_id", "node_id", "qualified_name")


def discovery_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches, rows and truncation of the same."""
    return lookup.discover(_nodes(spark, d), "Meter", ("callable",), ("csharp", "typescript"), 200)[1]


def discovery_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The first ten symbols of every project whose name holds a text."""
    nodes = _nodes(spark, d)
    return lookup.discover_within(nodes, _edges(spark, d), nodes.where("kind = 'project'"), "er", limit=10)


def symbols_in_file(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that every file declares."""
    return lookup.symbols_in_files(_nodes(spark, d), _edges(spark, d))


def declarations_in_project(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of the symbols of every project, in order."""
    nodes = _nodes(spark, d)
    return lookup.declarations_in(nodes, _edges(spark, d), _declarations(spark, d), nodes.where("kind = 'project'"))


def node_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The node at the source of every edge, if there is one."""
    return lookup.node_by_id(_nodes(spark, d), table(spark, d, "edges").select("repo_id", F.col("source_id").alias("node_id"))).select("repo_id", "node_id", "kind", "name")


def declarations_of_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of every symbol, in order."""
    decl = _declarations(spark, d)
    return lookup.declarations_of(decl.select("repo_id", "symbol_id"), decl).select("repo_id", "symbol_id", "declaration_id", "ord")


def declarations_in_file(spark: SparkSession, d: str) -> DataFrame:
    """Declarations in every file, in order."""
    return lookup.declarations_in_files(_nodes(spark, d), _edges(spark, d), _declarations(spark, d))


def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The declaration around every place that an edge gives as its evidence."""
    loc = F.col("ev_location")
    points = table(spark, d, "edges").where(loc.isNotNull()).select("repo_id", loc["path"].alias("path"), loc["start_line"].alias("line"), loc["start_col"].alias("col"))
    return lookup.enclosing(points, _declarations(spark, d))


def _preset(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        kinds, incoming = lookup.PRESETS[name]
        return lookup.neighbours(_edges(spark, d), kinds, incoming)

    query.__name__ = name
    return query


def neighborhood(spark: SparkSession, d: str) -> DataFrame:
    """Edges in and out of every node."""
    e = _edges(spark, d).where("source_id is not null and target_id is not null")
    out = e.select("repo_id", F.col("source_id").alias("node_id"), "edge_id")
    return out.unionByName(e.select("repo_id", F.col("target_id").alias("node_id"), "edge_id")).groupBy("repo_id", "node_id").agg(F.count_distinct("edge_id").alias("n_edges"))


def _seeds(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind).select(F.concat_ws("|", "repo_id", "node_id").alias("seed"), "repo_id", "node_id")


def impact_d2(spark: SparkSession, d: str) -> DataFrame:
    """What a change of each package may affect within two steps, without budgets."""
    t = lookup.impact(_edges(spark, d), _seeds(_nodes(spark, d), "package"), 2, 1_000_000, 10_000_000)
    return t.nodes.select("seed", "node_id", "depth")


def impact_mirrored(spark: SparkSession, d: str) -> DataFrame:
    """The same as impact_d2, walked over the mirrored adjacency."""
    mirror = Mirror(spark, scratch(spark, "mirror"))
    mirror.build(_edges(spark, d), "1")
    t = traverse.traverse(None, _seeds(_nodes(spark, d), "package"), "Incoming", IMPACT, (), 2, 1_000_000, 10_000_000, adj=mirror.adjacency("1"))
    return t.nodes.select("seed", "node_id", "depth")


def impact_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the impact of every type at depth two under the default budgets."""
    return lookup.impact(_edges(spark, d), _seeds(_nodes(spark, d), "type"), 2).stats


def affected_tests(spark: SparkSession, d: str) -> DataFrame:
    """Marked tests that a change of each type may affect, within two steps and default budgets."""
    nodes = _nodes(spark, d)
    return lookup.affected_tests(nodes, _edges(spark, d), _seeds(nodes, "type"), 2)


def symbols_in_project(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of every project."""
    nodes = _nodes(spark, d)
    return lookup.symbols_in(nodes, _edges(spark, d), nodes.where("kind = 'project'"))


def public_surface(spark: SparkSession, d: str) -> DataFrame:
    """Public symbols of every project."""
    nodes = _nodes(spark, d)
    return lookup.public_surface(nodes, _edges(spark, d), nodes.where("kind = 'project'"))


def exercised_by(spark: SparkSession, d: str) -> DataFrame:
    """Which callables tests exercise."""
    return resolve.exercised_by(_edges(spark, d), _nodes(spark, d))


def documentation_merge(spark: SparkSession, d: str) -> DataFrame:
    """Documentation of every symbol, merged."""
    return resolve.merged_documentation(merge.live(table(spark, d, "nodes")))


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Edges by repository, plugin and kind, with totals."""
    return planner.coverage(table(spark, d, "edges"), table(spark, d, "nodes"))


def source_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Whether each repository's published state is up to date."""
    src, runs, states = (table(spark, d, t) for t in ("source_files", "runs", "index_states"))
    plan = planner.plan_changes(src, runs, states, keep_all=True).withColumnRenamed("change", "status")
    return planner.freshness(plan, planner.last_successful(runs))


def index_identities(spark: SparkSession, d: str) -> DataFrame:
    """The content address of every recorded state."""
    s = table(spark, d, "index_states")
    return s.select("repo_id", "run_id", planner.index_identity(F.col("repo_id"), F.col("is_consistent"), F.col("snapshot_identity"), F.col("sources")).alias("identity")).distinct()


def log_fold(spark: SparkSession, d: str) -> DataFrame:
    """The last command of every slot of the log."""
    log = table(spark, d, "command_log").where("kind in ('run', 'complete')")
    return planner.log_fold(log, ["repo_id", "run_id"], "seq", ["kind", "run_status"])


def unit_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Units that stay when the units of failed runs are taken away."""
    units, runs = table(spark, d, "units"), table(spark, d, "runs")
    bad = units.join(runs.where("status in ('Failed', 'Cancelled')").select("repo_id", "run_id").distinct(), ["repo_id", "run_id"], "left_semi")
    return planner.overlay(units, units.limit(0), bad).select("repo_id", "plugin_id", "unit_id").distinct()


def obsolete_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of the log's publication that the table of units no longer has."""
    return planner.obsolete_units(replay.published_units(table(spark, d, "command_log")), table(spark, d, "units"))


def run_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Counters and warnings of every repository's runs."""
    return planner.run_diagnostics(table(spark, d, "runs"))


def health(spark: SparkSession, d: str) -> DataFrame:
    """Distinct facts of every repository."""
    return planner.health(*(table(spark, d, t) for t in ("nodes", "declarations", "edges", "units")))


def module_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every relative module reference of TypeScript and JavaScript sources, resolved."""
    src = table(spark, d, "source_files").where("content is not null")
    rows = extract.facts(src.where("path like '%.ts' or path like '%.js'")).where("fact = 'module'")
    refs = cut(rows.where("name like './%' or name like '../%' or name in ('.', '..')").select("repo_id", "path", F.col("name").alias("specifier")).distinct())
    out = [resolve.resolve_modules(refs.where(F.col("path").endswith(end)), src, language) for end, language in ((".ts", "typescript"), (".js", "javascript"))]
    return out[0].unionByName(out[1])


def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts read from all sources, counted by repository, fact and kind."""
    rows = extract.facts(table(spark, d, "source_files").where("content is not null"))
    return rows.groupBy("repo_id", "fact", "kind").agg(F.count("*").alias("n"))


OWN = (merge_nodes, merge_edges, merge_declarations, provenance_nodes, violations, violations_first, symbol_batch, symbol_by_id, name_pattern_topk, name_pattern_total, discovery_unscoped, discovery_counts, discovery_scoped, symbols_in_file, declarations_in_project, node_by_id, declarations_of_symbol, declarations_in_file, enclosing_symbol, *map(_preset, lookup.PRESETS), neighborhood, impact_d2, impact_mirrored, impact_budgeted, affected_tests, symbols_in_project, public_surface, exercised_by, documentation_merge, coverage_rollup, source_freshness, index_identities, log_fold, unit_overlay, obsolete_units, run_diagnostics, health, module_resolution, extract_facts)
QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_snapshots, p2_found, p6_found, p6_hierarchy, p6_descendants, p6_split, p7_found, p7_plan, p7_batches, *OWN)}
