"""The subpackage's registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import encoding, mixing, origin, sources, tokens
from .sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are generated, minified, vendored or data."""
    return sources.kinds_of(table(spark, d, "source_files")).select("file_id")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The same files with what they are."""
    return sources.kinds_of(table(spark, d, "source_files"))


#: Attribute files that p3_declared adds to every repository: (path, content).
ATTRIBUTES = ((".gitattributes", "*.ex linguist-generated\nweb/** linguist-vendored\n*Plan.* -linguist-vendored\n"), ("web/.gitattributes", "*View.js linguist-vendored\n*Store.js linguist-generated=false\n"))


def p3_declared(spark: SparkSession, d: str) -> DataFrame:
    """What two attribute files in every repository would declare of its files."""
    files = table(spark, d, "source_files").select("file_id", "repo_id", "path").distinct()
    attributes = files.select("repo_id").distinct().withColumn("a", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in ATTRIBUTES]))).select("repo_id", "a.*")
    said = origin.declared(files, attributes)
    return said.select("file_id", F.array_contains("yes", "generated").alias("generated"), F.array_contains("yes", "vendored").alias("vendored"), F.array_contains("no", "vendored").alias("not_vendored"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not valid in the language of their extension."""
    return sources.invalid_files(table(spark, d, "source_files")).where("invalid is not null").select("file_id").distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files per repository and language."""
    return sources.rates(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions with non-trivial documentation."""
    return sources.documented_functions(table(spark, d, "source_files")).select("file_id", "fn_line", "fn_name").distinct()


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same functions with their documentation."""
    return sources.documented_functions(table(spark, d, "source_files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document's text."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sized(table(spark, d, "documents"), lambda df: tokens.count_tokens(df, "text"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), sizes, targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold wrongly decoded characters."""
    return encoding.wrongly_decoded(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same documents with their text restored as far as possible, and the encoding pairs found."""
    return encoding.wrongly_decoded(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_kinds, p3_declared, p4_found, p4_rates, p5_found, p5_pairs, p8_ids, p9_mix, p9_shares, p10_found, p10_restored)}
