"""Look-ups of symbols and declarations, scoped discovery, and the presets of the traversal.

All functions take merged facts (:func:`factloom.operators.merge.merge`) and work on every
repository in them; requests come as DataFrames, so one job answers any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from .traverse import Traversal, traverse


def limited(requests: DataFrame, most: int, code: str) -> DataFrame:
    """requests, which a caller may make so many of at most; ValueError with the code beyond that.

    For interactive requests (:data:`schema.BATCH_NAMES`, :data:`schema.BATCH_SEEDS`); jobs over a
    whole corpus do not ask for it.
    """
    if requests.distinct().limit(most + 1).count() > most:
        raise ValueError(code)
    return requests


def node_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes with one of the ids (repo_id, node_id)."""
    return nodes.join(ids.select("repo_id", "node_id").distinct(), ["repo_id", "node_id"], "left_semi")


def symbols_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, repo_id, node_id, candidates): nodes with exactly that qualified name; a name without any keeps a null row."""
    asked = names.select("name").where(F.trim("name") != "").distinct()
    hit = asked.join(nodes.select("repo_id", "node_id", F.col("qualified_name").alias("name")), "name", "left")
    n = hit.groupBy("name").agg(F.count("node_id").alias("candidates"))
    return hit.join(n, "name")


def symbol_by_id(nodes: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, node_id): the least node of each symbol."""
    return nodes.where("symbol_id is not null").groupBy("repo_id", "symbol_id").agg(F.min("node_id").alias("node_id"))


def by_pattern(nodes: DataFrame, pattern: str, limit: int = S.PATTERN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Nodes whose qualified name or name holds a text, in order, and (total, returned, truncated)."""
    if not pattern.strip():
        raise ValueError("a pattern must not be blank")
    if not 1 <= limit <= S.PATTERN_LIMIT_MAX:
        raise ValueError(f"a limit lies between 1 and {S.PATTERN_LIMIT_MAX}")
    hit = matching(nodes, pattern)
    top = hit.orderBy(X.ordinal(F.col("qualified_name")).asc_nulls_first(), "node_id", "repo_id").limit(limit)
    total = hit.agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(limit)).alias("returned"), (F.col("total") > limit).alias("truncated"))
    return top, total


def matching(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose qualified name or name holds a text, whatever the letter case."""
    return nodes.where(X.contains_ignoring_case(F.col("qualified_name"), pattern) | X.contains_ignoring_case(F.col("name"), pattern))


def discoverable(nodes: DataFrame, kinds: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of the kinds asked for (else those with a symbol) in the languages asked for (else any)."""
    out = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes.where("symbol_id is not null")
    return out.where(F.col("language").isin(*languages)) if languages else out


def in_discovery_order(nodes: DataFrame) -> DataFrame:
    """By qualified name, those without one last, then by id."""
    return nodes.orderBy(F.col("qualified_name").asc_nulls_last(), "node_id", "repo_id")


def declarations_of(symbols: DataFrame, declarations: DataFrame) -> DataFrame:
    """Declarations of each symbol (repo_id, symbol_id) with their order ``ord`` by path, place and id."""
    d = declarations.join(symbols.select("repo_id", "symbol_id").distinct(), ["repo_id", "symbol_id"], "left_semi")
    w = Window.partitionBy("repo_id", "symbol_id").orderBy("path", "start_line", "start_col", "declaration_id")
    return d.withColumn("ord", F.row_number().over(w))


def span(d: Column | None = None) -> Column:
    """Size of a declaration's span: lines weigh a million columns each."""
    return (F.col("end_line") - F.col("start_line")).cast("bigint") * 1_000_000 + (F.col("end_col") - F.col("start_col"))


#: Sizes of the blocks of lines, by the span of what they hold.
LEVELS = (1 << 6, 1 << 10, 1 << 14, 1 << 19, 1 << 24, 1 << 29)


def enclosing(points: DataFrame, declarations: DataFrame) -> DataFrame:
    """(repo_id, path, line, col, declaration_id, symbol_id, symbol_node_id): the tightest declaration around each point.

    Ends are exclusive. Ties: the later start, then the least id. Points without any keep
    nulls. Lines of declarations are cut into blocks, and a point only meets declarations
    that touch its block, so a file with many declarations is no cross product.
    """
    d = declarations.where("end_line >= start_line").withColumn("lines", F.col("end_line").cast("bigint") - F.col("start_line"))
    # A declaration lies in blocks of a size that grows with its span, in some dozens at most.
    size = F.lit(64).cast("bigint")
    for level in LEVELS[1:]:
        size = F.when(F.col("lines") >= level, F.lit(level).cast("bigint")).otherwise(size)
    d = d.withColumn("size", size).withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / F.col("size")), F.floor(F.col("end_line") / F.col("size")))))
    p = points.select("repo_id", "path", "line", "col").distinct().withColumn("size", F.explode(F.array(*[F.lit(x).cast("bigint") for x in LEVELS]))).withColumn("block", F.floor(F.col("line") / F.col("size")))
    place = F.struct(F.col("line").alias("l"), F.col("col").alias("c"))
    inside = (place >= F.struct(F.col("start_line").alias("l"), F.col("start_col").alias("c"))) & (place < F.struct(F.col("end_line").alias("l"), F.col("end_col").alias("c")))
    tight = F.struct(span().alias("s"), (-F.col("start_line")).alias("l"), (-F.col("start_col")).alias("c"), "declaration_id", "symbol_id", "symbol_node_id")
    best = p.join(d, ["repo_id", "path", "size", "block"]).where(inside).groupBy("repo_id", "path", "line", "col").agg(F.min(tight).alias("t"))
    return p.select("repo_id", "path", "line", "col").distinct().join(best, ["repo_id", "path", "line", "col"], "left").select("repo_id", "path", "line", "col", "t.declaration_id", "t.symbol_id", "t.symbol_node_id")


def files_by_path(nodes: DataFrame) -> DataFrame:
    """(repo_id, path, node_id): the least file node of each path."""
    return nodes.where("kind = 'file' and qualified_name is not null").groupBy("repo_id", F.col("qualified_name").alias("path")).agg(F.min("node_id").alias("node_id"))


def discover(nodes: DataFrame, pattern: str, kinds: tuple[str, ...] = (), languages: tuple[str, ...] = (), limit: int = S.PATTERN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Unscoped discovery: rows and (total, returned, truncated).

    The limit is one on matches of the pattern, in their order, and applies before the filters on
    kinds and languages; the result is truncated if the pattern matched more. Rows come by
    qualified name, those without one last.
    """
    top, stats = by_pattern(nodes, pattern, limit)
    rows = discoverable(top, kinds, languages)
    counts = stats.select("total", F.lit(0).cast("bigint").alias("returned")).unionByName(rows.agg(F.lit(0).cast("bigint").alias("total"), F.count("*").alias("returned")))
    return in_discovery_order(rows), counts.agg(F.sum("total").alias("total"), F.sum("returned").alias("returned")).withColumn("truncated", F.col("total") > limit)


def discover_within(nodes: DataFrame, edges: DataFrame, roots: DataFrame, pattern: str | None = None, kinds: tuple[str, ...] = (), languages: tuple[str, ...] = (), limit: int = S.PATTERN_LIMIT, depth: int = 3, max_nodes: int = 2000, max_edges: int = 4000) -> DataFrame:
    """Scoped discovery: (root_id, repo_id, node_id, ord, total, truncated) per root (repo_id, node_id).

    All filters apply before the limit, which counts per root in the order of discovery; a result is
    truncated if more match, or if the walk below the root was. A root that is no project or file
    of its repository has no rows.
    """
    if not 1 <= limit <= S.PATTERN_LIMIT_MAX:
        raise ValueError(f"a limit lies between 1 and {S.PATTERN_LIMIT_MAX}")
    real = roots.join(nodes.where("kind in ('project', 'file')").select("repo_id", "node_id"), ["repo_id", "node_id"], "left_semi")
    walk = _within(edges, real, depth, max_nodes, max_edges)
    found = discoverable(nodes if pattern is None else matching(nodes, pattern), kinds, languages).select("repo_id", "node_id", "qualified_name")
    reached = _root(walk.nodes.join(walk.stats.select("seed", "truncated"), "seed")).where("node_id != root_id").join(found, ["repo_id", "node_id"])
    w = Window.partitionBy("repo_id", "root_id").orderBy(F.col("qualified_name").asc_nulls_last(), "node_id")
    total = reached.groupBy("repo_id", "root_id").agg(F.count("*").alias("total"))
    first = reached.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= limit)
    return first.join(total, ["repo_id", "root_id"]).select("root_id", "repo_id", "node_id", "ord", "total", (F.col("truncated") | (F.col("total") > limit)).alias("truncated"))


def symbols_in_files(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """(repo_id, path, node_id, ord): symbols that each file declares, by qualified name."""
    files = files_by_path(nodes).withColumnRenamed("node_id", "source_id")
    declared = edges.where("kind = 'declares'").join(files, ["repo_id", "source_id"]).select("repo_id", "path", F.col("target_id").alias("node_id")).distinct()
    symbols = discoverable(nodes, kinds, languages).where("symbol_id is not null").select("repo_id", "node_id", "qualified_name")
    w = Window.partitionBy("repo_id", "path").orderBy(F.col("qualified_name").asc_nulls_last(), "node_id")
    return declared.join(symbols, ["repo_id", "node_id"]).withColumn("ord", F.row_number().over(w)).select("repo_id", "path", "node_id", "ord")


def declarations_in(nodes: DataFrame, edges: DataFrame, declarations: DataFrame, roots: DataFrame, depth: int = 3, max_nodes: int = 2000, max_edges: int = 4000) -> DataFrame:
    """(root_id, repo_id, declaration_id, ord): declarations of the symbols in each root, by path and place."""
    inside = symbols_in(nodes, edges, roots, depth, max_nodes, max_edges).select("root_id", "repo_id", "node_id")
    symbols = inside.join(nodes.where("symbol_id is not null").select("repo_id", "node_id", "symbol_id"), ["repo_id", "node_id"]).select("root_id", "repo_id", "symbol_id").distinct()
    w = Window.partitionBy("root_id", "repo_id").orderBy("path", "start_line", "start_col", "declaration_id")
    return declarations.join(symbols, ["repo_id", "symbol_id"]).withColumn("ord", F.row_number().over(w)).select("root_id", "repo_id", "declaration_id", "ord")


def _within(edges: DataFrame, roots: DataFrame, depth: int, nodes: int, links: int, kinds: tuple[str, ...] = S.CONTAINMENT) -> Traversal:
    seeds = roots.select(F.concat_ws("\x1f", "repo_id", "node_id").alias("seed"), "repo_id", "node_id")
    return traverse(edges, seeds, "Outgoing", kinds, (), depth, nodes, links)


def _root(df: DataFrame) -> DataFrame:
    return df.withColumn("root_id", F.substring_index("seed", "\x1f", -1)).drop("seed")


def symbols_in(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 3, max_nodes: int = 2000, max_edges: int = 4000, kinds: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """(root_id, repo_id, node_id, depth): symbols that each root (repo_id, node_id) contains, the root excepted."""
    reached = _root(_within(edges, roots, depth, max_nodes, max_edges).nodes).where("node_id != root_id")
    return reached.join(discoverable(nodes, kinds, languages).select("repo_id", "node_id"), ["repo_id", "node_id"], "left_semi").select("root_id", "repo_id", "node_id", "depth")


def public_surface(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, repo_id, node_id, ord): public nodes within each root, no projects or files, by name."""
    reached = _root(_within(edges, roots, 10, 2000, 5000).nodes)
    public = nodes.where("access = 'public' and kind not in ('project', 'file')").select("repo_id", "node_id", F.coalesce("qualified_name", "name").alias("label"))
    w = Window.partitionBy("repo_id", "root_id").orderBy("label", "node_id")
    return reached.join(public, ["repo_id", "node_id"]).withColumn("ord", F.row_number().over(w)).select("root_id", "repo_id", "node_id", "ord")


def declarations_in_files(nodes: DataFrame, edges: DataFrame, declarations: DataFrame) -> DataFrame:
    """(repo_id, path, declaration_id, symbol_id, ord): declarations in each file of symbols that the file declares."""
    files = files_by_path(nodes)
    declared = edges.where("kind = 'declares'").join(files.withColumnRenamed("node_id", "source_id"), ["repo_id", "source_id"]).select("repo_id", "path", F.col("target_id").alias("node_id")).distinct()
    symbols = declared.join(nodes.where("symbol_id is not null").select("repo_id", "node_id", "symbol_id"), ["repo_id", "node_id"]).select("repo_id", "path", "symbol_id").distinct()
    w = Window.partitionBy("repo_id", "path").orderBy("start_line", "start_col", "declaration_id")
    return declarations.join(symbols, ["repo_id", "path", "symbol_id"], "left_semi").withColumn("ord", F.row_number().over(w)).select("repo_id", "path", "declaration_id", "symbol_id", "ord")


def neighbours(edges: DataFrame, kinds: tuple[str, ...], incoming: bool) -> DataFrame:
    """(repo_id, node_id, neighbour_id, kind, edge_id) at depth one for every node: callers, callees, implementations, ..."""
    a, b = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    e = edges.where(F.col("kind").isin(*kinds) & F.col(a).isNotNull() & F.col(b).isNotNull())
    return e.select("repo_id", F.col(a).alias("node_id"), F.col(b).alias("neighbour_id"), "kind", "edge_id").distinct()


#: The presets at depth one: edge kinds and whether edges are followed against their direction.
PRESETS = {
    "callers": (("calls",), True),
    "callees": (("calls",), False),
    "references": (("references",), True),
    "implementations": (("implements", "inherits"), True),
    "dependencies": (("depends-on",), False),
    "dependents": (("depends-on",), True),
}


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 100, max_edges: int = 250, qualities: tuple[str, ...] = ()) -> Traversal:
    """What may be affected by a change of each seed: incoming references, calls, heritage and dependencies."""
    return traverse(edges, seeds, "Incoming", S.IMPACT, qualities, depth, max_nodes, max_edges)


def affected_tests(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 100, max_edges: int = 250) -> DataFrame:
    """(seed, repo_id, node_id): marked tests in the impact of each seed, the seed itself included."""
    tests = nodes.where(F.get_json_object("properties", "$['test-method']") == "true").select("repo_id", "node_id")
    return impact(edges, seeds, depth, max_nodes, max_edges).nodes.join(tests, ["repo_id", "node_id"], "left_semi").select("seed", "repo_id", "node_id")
