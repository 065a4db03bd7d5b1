"""Parent-child links of unknown depth: cycles, paths, depths, roots and descendants.

All operators work on fragments that one task can hold (about FRAGMENT links at most), never on
a whole repository of any size:

1. links are grouped into fragments by the unit that wrote them; a unit with more links than a
   fragment may hold is split by its parents, and a parent with more children by these,
2. each fragment is solved for itself and reduced to what its exits (the nodes it shares
   with other fragments) see of it: chains are contracted, dead ends dropped, local cycles
   shrunk to one node,
3. the reduced links form a smaller graph (the quotient), which is solved in the same way, with
   fragments of twice the size,
4. the quotient's answer is carried back into the fragments, which finish locally.

The same steps run at every size: a repository that fills one fragment has no exits, so its
quotient is empty. A quotient that no longer shrinks, though its fragments have grown to HOLD
links, is solved by joins, with the same result.

Defined results: rows with a null end or repository are no links; repeated links count
once; self-loops are cycles of length one; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Links that a fragment holds at most (its parts are hashed, so about).
FRAGMENT = 5_000
#: Links up to which fragments of later quotients grow, twofold each time.
HOLD = 1_000_000
#: A quotient has shrunk if it has so much of the links before at most.
SHRUNK = 0.9
KINDS = ("contains", "declares")
#: Starts the names of nodes that exist in a quotient only.
INNER = "\x01"


def hierarchy_links(edges: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(repo_id, parent, child, part): the distinct parent-child links.

    ``part`` is a hash of the unit that wrote the link (the least, if several did): links of
    one unit lie close together, so that fragments by unit share few nodes.
    """
    return (
        edges.where(F.col("kind").isin(*kinds) & F.col("repo_id").isNotNull() & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        .groupBy("repo_id", F.col("source_id").alias("parent"), F.col("target_id").alias("child"))
        .agg(F.min(F.xxhash64("plugin_id", "unit_id")).alias("part"))
    )


# --- cycles -------------------------------------------------------------------------------


def _components(n: int, out: list[list[int]]) -> list[int]:
    """Strongly connected components: the number of each node's component (iterative)."""
    order, low, comp, stack = [0] * n, [0] * n, [-1] * n, []
    clock = found = 0
    for first in range(n):
        if order[first]:
            continue
        clock += 1
        order[first] = low[first] = clock
        stack.append(first)
        work = [(first, iter(out[first]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if not order[w]:
                    clock += 1
                    order[w] = low[w] = clock
                    stack.append(w)
                    work.append((w, iter(out[w])))
                    break
                if comp[w] < 0 and order[w] < low[v]:
                    low[v] = order[w]
            else:
                work.pop()
                if work and low[v] < low[work[-1][0]]:
                    low[work[-1][0]] = low[v]
                if low[v] == order[v]:
                    while True:
                        w = stack.pop()
                        comp[w] = found
                        if w == v:
                            break
                    found += 1
    return comp


def _local(pdf: pd.DataFrame) -> tuple[list[str], list[list[int]], list[int], list[int]]:
    """The nodes of a fragment, their links by number, their components, the components' sizes."""
    ids = pd.unique(pd.concat([pdf["parent"], pdf["child"]], ignore_index=True))
    number = {x: i for i, x in enumerate(ids)}
    out: list[list[int]] = [[] for _ in ids]
    for a, b in zip(pdf["parent"], pdf["child"]):
        out[number[a]].append(number[b])
    comp = _components(len(ids), out)
    sizes = [0] * (max(comp, default=-1) + 1)
    for c in comp:
        sizes[c] += 1
    return list(ids), out, comp, sizes


CLASS = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("node", T.StringType()), T.StructField("class", T.StringType())])
LINK = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("child", T.StringType()), T.StructField("part", T.LongType())])


def _reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The links of a fragment as its exits see them: the same exits reach each other, over fewer nodes."""
    repo, frag = key
    ids, out, comp, _ = _local(pdf)
    exits = set(pdf.loc[pdf["pshare"], "parent"]) | set(pdf.loc[pdf["cshare"], "child"])
    doors: dict[int, list[str]] = {}
    inside: dict[int, str] = {}
    for i, c in enumerate(comp):
        if ids[i] in exits:
            doors.setdefault(c, []).append(ids[i])
        inside.setdefault(c, ids[i])
    succ: dict[int, set[int]] = {c: set() for c in inside}
    pred: dict[int, set[int]] = {c: set() for c in inside}
    for i, targets in enumerate(out):
        for j in targets:
            if comp[i] != comp[j]:
                succ[comp[i]].add(comp[j])
                pred[comp[j]].add(comp[i])
    # A node without exits that has one way in or one way out is bypassed, a dead end dropped.
    queue = [c for c in inside if c not in doors]
    while queue:
        c = queue.pop()
        if c not in succ or (len(succ[c]) > 1 and len(pred[c]) > 1):
            continue
        above, below = pred.pop(c), succ.pop(c)
        for a in above:
            succ[a].discard(c)
            succ[a] |= below
        for b in below:
            pred[b].discard(c)
            pred[b] |= above
        queue += [x for x in (*above, *below) if x not in doors]
    name = {c: doors[c][0] if c in doors else f"{INNER}{frag}{INNER}{inside[c]}" for c in succ}
    rows = [(repo, name[c], name[b], frag) for c, below in succ.items() for b in below]
    for own in doors.values():  # exits of one local cycle reach each other
        rows += [x for d in own[1:] for x in ((repo, own[0], d, frag), (repo, d, own[0], frag))]
    return pd.DataFrame(rows, columns=LINK.names)


def _finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The classes of a fragment's nodes, given those of its exits (pclass, cclass; null: none)."""
    known = set(pdf["pclass"].dropna()) | set(pdf["cclass"].dropna())
    a, b = pdf["pclass"].fillna(pdf["parent"]), pdf["cclass"].fillna(pdf["child"])
    ids, _, comp, sizes = _local(pd.DataFrame({"parent": a, "child": b}))
    name: dict[int, str] = {}
    for x, c in zip(ids, comp):
        if x in known:
            name[c] = x
    for x, c in zip(ids, comp):
        if sizes[c] > 1 and name.get(c) not in known:
            name[c] = min(name.get(c, x), x)
    of = {x: name[c] for x, c in zip(ids, comp) if c in name}
    rows = {(x, of[m]) for x, m in (*zip(pdf["parent"], a), *zip(pdf["child"], b)) if m in of}
    return pd.DataFrame([(key[0], x, c) for x, c in sorted(rows)], columns=CLASS.names)


def _bins(df: DataFrame, limit: int, by: tuple[str, ...]) -> DataFrame:
    """df with each frag of more than limit rows split by a hash of some columns (0 stays whole)."""
    full = df.where("frag != 0").groupBy("repo_id", "frag").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    full = cut(full.select(F.col("repo_id").alias("_r"), F.col("frag").alias("_f"), F.ceil(F.col("_n") * 2 / limit).alias("_m")))
    if full.isEmpty():
        return df
    joined = df.join(full, df["repo_id"].eqNullSafe(full["_r"]) & (df["frag"] == full["_f"]), "left")
    return joined.select(*[c for c in df.columns if c != "frag"], F.when(F.col("_m").isNull(), F.col("frag")).otherwise(F.xxhash64("frag", F.pmod(F.xxhash64(*by), "_m"))).alias("frag"))


def _fragments(links: DataFrame, limit: int, ends: tuple[str, str] = ("parent", "child")) -> DataFrame:
    """links with frag: 0 in repositories that fill one fragment, else by part, large parts by parent, large parents by child."""
    sizes = links.groupBy("repo_id").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(F.col("repo_id").alias("_r"), F.ceil(F.col("_n") * 2 / limit).alias("_k"))
    joined = links.join(sizes, links["repo_id"].eqNullSafe(sizes["_r"]), "left")
    frag = F.when(F.col("_k").isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod("part", F.col("_k")) + 1)
    out = joined.select(*links.columns, frag.alias("frag"))
    return _bins(_bins(out, limit, ends[:1]), limit, ends)


def _marked(split: DataFrame) -> DataFrame:
    """split with pshare and cshare: whether an end occurs in several fragments of its repository."""
    ends = split.select("repo_id", F.explode(F.array("parent", "child")).alias("node"), "frag")
    shared = ends.groupBy("repo_id", "node").agg(F.min("frag").alias("a"), F.max("frag").alias("b")).where("a < b").select(F.col("repo_id").alias("_r"), F.col("node").alias("_x"), F.lit(True).alias("_s"))
    for end, mark in (("parent", "pshare"), ("child", "cshare")):
        split = split.join(shared, split["repo_id"].eqNullSafe(shared["_r"]) & (split[end] == shared["_x"]), "left").withColumn(mark, F.coalesce("_s", F.lit(False))).drop("_r", "_x", "_s")
    return split


def _with_classes(links: DataFrame, classes: DataFrame) -> DataFrame:
    for end, name in (("parent", "pclass"), ("child", "cclass")):
        c = classes.select(F.col("repo_id").alias("_r"), F.col("node").alias("_x"), F.col("class").alias(name))
        links = links.join(c, links["repo_id"].eqNullSafe(c["_r"]) & (links[end] == c["_x"]), "left").drop("_r", "_x")
    return links


def _solved(links: DataFrame, limit: int, before: int | None, local: Callable[[DataFrame], DataFrame], by_joins: Callable[[DataFrame], DataFrame], carried: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The steps above. local answers for whole repositories, carried for split ones, given the quotient's answer."""
    frags = cut(_fragments(links, limit))
    whole, split = local(frags.where("frag = 0")), frags.where("frag != 0")
    left = split.count()
    if not left:
        return whole
    if before is not None and left > SHRUNK * before and limit >= HOLD:
        return whole.unionByName(by_joins(split.drop("frag")))
    marked = cut(_marked(split))
    reduced = cut(marked.groupBy("repo_id", "frag").applyInPandas(_reduce, LINK))
    quotient = reduced.withColumn("part", F.floor(F.col("part") / 4).cast("bigint")).dropDuplicates(["repo_id", "parent", "child"])
    upper = _solved(quotient, min(2 * limit, max(limit, HOLD)), left, local, by_joins, carried)
    return whole.unionByName(carried(marked, upper))


def _classes(links: DataFrame, limit: int) -> DataFrame:
    """(repo_id, node, class) of the nodes in components of more than one node; links without self-loops."""
    none = {"pclass": F.lit(None).cast("string"), "cclass": F.lit(None).cast("string")}

    def finished(df: DataFrame) -> DataFrame:
        return df.groupBy("repo_id", "frag").applyInPandas(_finish, CLASS)

    return _solved(links, limit, None, lambda df: finished(df.withColumns(none)), _classes_by_colour, lambda marked, upper: finished(_with_classes(marked, upper)))


def _classes_by_colour(links: DataFrame) -> DataFrame:
    """Strongly connected components by joins alone, for a quotient that does not shrink.

    Nodes without a way in or out are peeled off; then every node takes the greatest id that
    reaches it, and the nodes of one colour that reach its giver are one component.
    """
    left = links.select("repo_id", "parent", "child").distinct()
    found: list[DataFrame] = []
    key = ["repo_id", "node"]

    def ends(df: DataFrame, end: str) -> DataFrame:
        return df.select("repo_id", F.col(end).alias("node")).distinct()

    while True:
        before = -1
        while (count := (left := cut(left.join(ends(left, "child").withColumnRenamed("node", "parent"), ["repo_id", "parent"], "left_semi").join(ends(left, "parent").withColumnRenamed("node", "child"), ["repo_id", "child"], "left_semi").select("repo_id", "parent", "child"))).count()) != before:
            before = count
        if not before:
            break
        colour = ends(left, "parent").withColumn("colour", F.col("node"))
        changed = 1
        while changed:
            sent = left.join(colour.withColumnRenamed("node", "parent"), ["repo_id", "parent"]).groupBy("repo_id", F.col("child").alias("node")).agg(F.max("colour").alias("got"))
            colour = cut(colour.join(sent, key, "left").select(*key, F.greatest("colour", "got").alias("colour"), (F.col("got") > F.col("colour")).alias("moved")))
            changed = colour.where("moved").limit(1).count()
            colour = colour.drop("moved")
        inner = left.join(colour.withColumnRenamed("node", "parent").withColumnRenamed("colour", "c1"), ["repo_id", "parent"]).join(colour.withColumnRenamed("node", "child").withColumnRenamed("colour", "c2"), ["repo_id", "child"]).where("c1 = c2")
        inner = cut(inner.select("repo_id", "parent", "child", F.col("c1").alias("colour")))
        reached = cut(colour.where("node = colour"))
        wave = reached
        while True:
            wave = inner.join(wave.select("repo_id", F.col("node").alias("child"), "colour"), ["repo_id", "child", "colour"]).select("repo_id", F.col("parent").alias("node"), "colour").distinct()
            wave = cut(wave.join(reached, [*key, "colour"], "left_anti"))
            if wave.isEmpty():
                break
            reached = cut(reached.unionByName(wave))
        found.append(reached.select("repo_id", "node", F.col("colour").alias("class")))
        gone = reached.select("repo_id", F.col("node").alias("parent"))
        left = cut(inner.select("repo_id", "parent", "child").join(gone, ["repo_id", "parent"], "left_anti").join(gone.withColumnRenamed("parent", "child"), ["repo_id", "child"], "left_anti"))
    out = found[0] if found else links.select("repo_id", F.col("parent").alias("node"), F.col("child").alias("class")).limit(0)
    for df in found[1:]:
        out = out.unionByName(df)
    return out.withColumn("_n", F.count("*").over(Window.partitionBy("repo_id", "class"))).where("_n > 1").drop("_n")


def cycle_nodes(links: DataFrame, limit: int = FRAGMENT) -> DataFrame:
    """(repo_id, node_id): the nodes on a cycle of any length, distinct."""
    loops = links.where(F.col("parent") == F.col("child")).select("repo_id", F.col("parent").alias("node_id"))
    classes = _classes(links.where(F.col("parent") != F.col("child")).select(*LINK.names), limit)
    return loops.unionByName(classes.select("repo_id", F.col("node").alias("node_id"))).distinct()


# --- paths --------------------------------------------------------------------------------

STEP = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("up", T.StringType()), T.StructField("path", T.ArrayType(T.StringType()))])


def _climb(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Each node's way up to the fragment's exit: path (topmost first) and the parent beyond it. Ways have no loops."""
    parent = {n: (p if isinstance(p, str) else None) for n, p in zip(pdf["node_id"], pdf["parent_id"])}
    done: dict[str, tuple[str | None, list[str]]] = {}
    for x in parent:
        way = []
        while x is not None and x in parent and x not in done:
            way.append(x)
            x = parent[x]
        top = done[x] if x in done else (x, [])
        for y in reversed(way):
            top = done[y] = (top[0], [*top[1], y])
    return pd.DataFrame([(key[0], n, *top) for n, top in done.items()], columns=STEP.names)


def _tree(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(repo_id, node_id, parent_id, part, on_cycle): each node below the least parent that is on no cycle with it.

    The nodes of one cycle share the least parent that any of them has outside.
    """
    known = _with_classes(links, classes)
    pkey, ckey = F.coalesce("pclass", "parent"), F.coalesce("cclass", "child")
    ends = F.array(
        F.struct(F.col("parent").alias("node_id"), F.col("pclass").alias("class"), F.lit(None).cast("string").alias("up"), F.lit(False).alias("loop")),
        F.struct(F.col("child").alias("node_id"), F.col("cclass").alias("class"), F.when(pkey != ckey, F.col("parent")).alias("up"), (F.col("parent") == F.col("child")).alias("loop")),
    )
    rows = known.select("repo_id", F.explode(ends).alias("e"), "part").select("repo_id", "e.*", "part")
    nodes = cut(rows.groupBy("repo_id", "node_id").agg(F.max("class").alias("class"), F.min("up").alias("parent_id"), F.min("part").alias("part"), F.bool_or("loop").alias("loop")))
    shared = nodes.where("class is not null").groupBy("repo_id", "class").agg(F.min("parent_id").alias("parent_id"))
    single = nodes.where("class is null").select("repo_id", "node_id", "parent_id", "part", F.col("loop").alias("on_cycle"))
    return single.unionByName(nodes.where("class is not null").drop("parent_id").join(shared, ["repo_id", "class"]).select("repo_id", "node_id", "parent_id", "part", F.lit(True).alias("on_cycle")))


def paths(nodes: DataFrame, limit: int = FRAGMENT) -> DataFrame:
    """(repo_id, node_id, path) of a forest (repo_id, node_id, parent_id, part): the nodes from the root down to each."""
    steps = cut(_fragments(nodes, limit, ("parent_id", "node_id")).groupBy("repo_id", "frag").applyInPandas(_climb, STEP))
    # The quotient forest: only the nodes at which another fragment's way goes on. Ways double in each round.
    doors = steps.where("up is not null").select("repo_id", F.col("up").alias("node_id")).distinct()
    jump = cut(steps.join(doors, ["repo_id", "node_id"], "left_semi"))
    while not jump.where("up is not null").isEmpty():
        beyond = jump.select("repo_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        jump = cut(jump.join(beyond, ["repo_id", "up"], "left").select("repo_id", "node_id", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.array().cast("array<string>")), "path").alias("path")))
    over = jump.select("repo_id", F.col("node_id").alias("up"), F.col("path").alias("above"))
    return steps.join(over, ["repo_id", "up"], "left").select("repo_id", "node_id", F.concat(F.coalesce("above", F.array().cast("array<string>")), "path").alias("path"))


def hierarchy(links: DataFrame, limit: int = FRAGMENT) -> DataFrame:
    """(repo_id, node_id, parent_id, root_id, depth, path, on_cycle, n_descendants): one row per node.

    A node with several parents hangs below the least of those that are on no cycle with it, and
    the nodes of one cycle (on_cycle, exactly those of :func:`cycle_nodes`) all hang below the
    least parent that any of them has outside; so ways up never loop and every node has a root.
    Roots have depth 0; path is an array of ids, root first, node last. n_descendants counts the
    nodes that links lead to, by whatever parent, the node itself excepted.
    """
    links = links.select(*LINK.names)
    classes = cut(_classes(links.where("parent != child"), limit))
    nodes = cut(_tree(links, classes))
    below = descendant_counts(links, limit)
    out = nodes.drop("part").join(paths(nodes.drop("on_cycle"), limit), ["repo_id", "node_id"]).join(below, ["repo_id", "node_id"], "left")
    return out.select("repo_id", "node_id", "parent_id", F.element_at("path", 1).alias("root_id"), (F.size("path") - 1).cast("bigint").alias("depth"), "path", "on_cycle", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_descendants"))


# --- descendants --------------------------------------------------------------------------

PAIR = "repo_id string, ancestor string, descendant string"
COUNT = "repo_id string, node_id string, n bigint"
#: Pairs that a task holds at most before it hands them on.
BATCH = 50_000


def _reach(parents: list[str], children: list[str]) -> Iterator[tuple[str, set[str]]]:
    """Each parent with all that links lead to, itself excepted."""
    out: dict[str, list[str]] = {}
    for a, b in zip(parents, children):
        out.setdefault(a, []).append(b)
    for start in out:
        seen, todo = {start}, [start]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        seen.discard(start)
        yield start, seen


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of fragments (repo_id, parents, children)."""
    rows: list[tuple[str, str, str]] = []

    def taken() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 3
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["repo_id", "ancestor", "descendant"])

    for batch in batches:
        for i in range(batch.num_rows):
            repo, parents, children = (batch.column(c)[i].as_py() for c in range(3))
            for start, seen in _reach(parents, children):
                rows += [(repo, start, b) for b in seen]
                if len(rows) > BATCH:
                    yield taken()
    yield taken()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sizes of what :func:`_walk` lists."""
    for batch in batches:
        rows = [(batch.column(0)[i].as_py(), start, len(seen)) for i in range(batch.num_rows) for start, seen in _reach(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["repo_id", "node_id", "n"])


def _gathered(df: DataFrame) -> DataFrame:
    """One row per fragment, which holds its links (about FRAGMENT at most, HOLD in late quotients)."""
    return df.groupBy("repo_id", "frag").agg(F.collect_list(F.struct("parent", "child")).alias("links")).select("repo_id", "links.parent", "links.child")


def _pairs_inside(df: DataFrame) -> DataFrame:
    return _gathered(df).mapInArrow(_walk, PAIR)


def _pairs_by_joins(links: DataFrame) -> DataFrame:
    """The pairs by joins alone: each round doubles the length of the ways that are known."""
    pairs = cut(links.select("repo_id", F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct())
    fresh = pairs
    while not fresh.isEmpty():
        first = fresh.select("repo_id", "ancestor", F.col("descendant").alias("via"))
        then = pairs.select("repo_id", F.col("ancestor").alias("via"), "descendant")
        fresh = cut(first.join(then, ["repo_id", "via"]).where("ancestor != descendant").select(*pairs.columns).distinct().join(pairs, pairs.columns, "left_anti"))
        pairs = cut(pairs.unionByName(fresh))
    return pairs


def _pairs_across(marked: DataFrame, upper: DataFrame) -> DataFrame:
    """The pairs of split repositories: inside a fragment, or to one of its exits, on to another, and from there."""
    inside = cut(_pairs_inside(marked))
    doors = marked.where("pshare").select("repo_id", F.col("parent").alias("door")).unionByName(marked.where("cshare").select("repo_id", F.col("child").alias("door"))).distinct()
    doors = cut(doors)
    still = doors.select("repo_id", F.col("door").alias("ancestor"), F.col("door").alias("descendant"))
    into = inside.join(doors.withColumnRenamed("door", "descendant"), ["repo_id", "descendant"], "left_semi").unionByName(still)
    onward = inside.join(doors.withColumnRenamed("door", "ancestor"), ["repo_id", "ancestor"], "left_semi").unionByName(still)
    over = upper.where(~F.col("ancestor").startswith(INNER) & ~F.col("descendant").startswith(INNER)).select("repo_id", F.col("ancestor").alias("a"), F.col("descendant").alias("b"))
    over = over.unionByName(doors.select("repo_id", F.col("door").alias("a"), F.col("door").alias("b")))
    far = into.select("repo_id", "ancestor", F.col("descendant").alias("a")).join(over, ["repo_id", "a"]).select("repo_id", "ancestor", "b").distinct()
    far = far.join(onward.select("repo_id", F.col("ancestor").alias("b"), "descendant"), ["repo_id", "b"]).where("ancestor != descendant").select("repo_id", "ancestor", "descendant")
    return inside.unionByName(far).distinct()


def descendants(links: DataFrame, limit: int = FRAGMENT) -> DataFrame:
    """(repo_id, ancestor, descendant): each node with all nodes that links lead to; one row per pair.

    All parents of a node count, loops included. A node is not listed as its own descendant,
    though it may lie on a loop.
    """
    return _solved(links.where("parent != child").select(*LINK.names), limit, None, _pairs_inside, _pairs_by_joins, _pairs_across)


def descendant_counts(links: DataFrame, limit: int = FRAGMENT) -> DataFrame:
    """(repo_id, node_id, n): how many descendants each parent has; pairs are only made up in split repositories."""

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("repo_id", F.col("ancestor").alias("node_id")).agg(F.count("*").alias("n"))

    frags = cut(_fragments(links.where("parent != child").select(*LINK.names), limit))
    whole = _gathered(frags.where("frag = 0")).mapInArrow(_count, COUNT)
    split = frags.where("frag != 0").drop("frag")
    return whole if split.isEmpty() else whole.unionByName(counted(descendants(split, limit)))
