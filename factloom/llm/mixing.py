"""Mixing sources to target weights, sized in tokens.

Every document gets a hash-random key. Keys are cut into ranges; sums per source and range
give each range's offset, and a running sum inside the range completes the prefix sum, so
that a source that holds most of the corpus is spread over as many tasks as it has ranges.
A source's budget is first filled with whole epochs and then cut in the order of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Documents of a range, on average.
RANGE = 20_000


def _targets(targets: DataFrame) -> DataFrame:
    """(source, share, cap): names in lower case, shares that are none of a positive number left out."""
    ok = F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share") & (F.coalesce("max_repeats", F.lit(0)) > 0)
    return targets.where(ok).groupBy(F.lower("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").cast("bigint").alias("cap"))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share, cap, n_docs, available, budget, epochs, rest), one row per target.

    Shares are taken relative to those of the sources that have tokens at all. Without a
    total, the greatest one is used at which every such source reaches its share within its
    cap; with one, a source that cannot reach its share gives what its cap allows.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("available"))
    all_ = _targets(targets).join(have, "source", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    real = F.when(F.col("available") > 0, F.col("share"))
    whole = Window.partitionBy(F.lit(0))  # over the targets only
    share = F.coalesce(F.try_divide(real, F.sum(real).over(whole)), F.lit(0.0))
    shared = all_.select("source", "share", "cap", "n_docs", "available", share.alias("want"))
    most: Column = F.lit(total).cast("double") if total is not None else F.min(F.when(F.col("want") > 0, F.col("available") * F.col("cap") / F.col("want"))).over(whole)
    budget = F.least(F.floor(F.col("want") * most + 1e-6), F.col("available") * F.col("cap")).cast("bigint")
    out = shared.withColumn("budget", F.coalesce(budget, F.lit(0).cast("bigint")))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("bigint")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, copies): every document that is used, and how often.

    sizes: (doc_id, source, tokens). Of a source's last, partial epoch the documents are taken
    in the order of their keys as long as their sum stays within the budget, so a source falls
    short of it by less than one document. Documents of unlisted or null sources are not used;
    repeated rows of a doc_id count once; documents without tokens cost nothing and follow
    their neighbours. Ties of keys are broken by doc_id.
    """
    plan = budgets(sizes, targets, total).select("source", "epochs", "rest")
    n = sizes.count()
    bits = max(0, min(30, (max(1, n // RANGE)).bit_length()))
    keyed = sizes.join(plan, "source").withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    keyed = keyed.withColumn("range", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("s")).select("source", "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    # Ranges beyond the cut need no order among their documents.
    inside = Window.partitionBy("source", "range").orderBy(F.shiftrightunsigned("key", 1), "key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(offsets, ["source", "range"]).withColumn("prefix", F.col("offset") + F.sum("tokens").over(inside))
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("prefix") <= F.col("rest")), 1).otherwise(0)
    return placed.select("doc_id", "source", "tokens", copies.cast("bigint").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, want, reached, n_docs, available, budget, used, max_copies), one row per target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("max_copies"))
    plan = budgets(sizes, targets, total)
    whole = Window.partitionBy(F.lit(0))
    zero = F.lit(0).cast("bigint")
    out = plan.join(got, "source", "left").withColumns({"used": F.coalesce("used", zero), "max_copies": F.coalesce("max_copies", zero)})
    return out.select("source", F.col("share").alias("target_share"), "want", F.coalesce(F.try_divide(F.col("used"), F.sum("used").over(whole)), F.lit(0.0)).alias("reached"), "n_docs", "available", "budget", "used", "max_copies")


def sized(documents: DataFrame, count) -> DataFrame:
    """(doc_id, source, tokens) of documents, by count (a function of a DataFrame with text); cut, as it is read again."""
    counted = count(documents.select("doc_id", F.lower("source").alias("source"), "text"))
    once = counted.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("x"))
    return cut(once.select("doc_id", "x.source", "x.tokens"))
