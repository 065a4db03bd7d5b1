"""One pass over source files: what they are, whether they parse, which functions they document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, importable
from . import docs, origin, validity
from ..functions.lexers import LEX, language_of

OUT = "file_id {id}, repo_id string, path string, language string, kinds array<string>, said array<array<string>>, invalid string, functions array<struct<fn_line:bigint,fn_name:string,doc:string>>, content string"
#: Interpreters named in a first line that are those of other languages.
_FOREIGN = re.compile(r"﻿?#![^\r\n]*\b(?:ba|z|k|da)?sh\b|﻿?#![^\r\n]*\b(?:python|perl|ruby|php|pwsh)[\d.]*\b")


def look(path: str | None, content: str | None, kinds: bool, functions: bool) -> tuple[str | None, list[str] | None, list[list[str]] | None, str | None, list]:
    """(language, kinds, phrases of remarks, why it is invalid, functions) of one file."""
    language = language_of(path)
    if not content or language is None:
        return language, None, None, None, []
    tokens = LEX[language](content)
    shown, said = origin.declared_kinds(content, language, tokens) if kinds else (None, None)
    wrong = validity.check(tokens, language) if not (kinds and not functions) else None
    if wrong is None and _FOREIGN.match(content):
        wrong = ("language", 0)
    invalid = f"{wrong[0]} at {tokens.start[wrong[1]] if 0 <= wrong[1] < len(tokens.start) else 'end'}" if wrong else None
    found = docs.documented(content, language, tokens) if functions and not invalid else []
    return language, shown, said, invalid, found


_PAIRS = pa.list_(pa.struct([("fn_line", pa.int64()), ("fn_name", pa.string()), ("doc", pa.string())]))


def examine(files: DataFrame, kinds: bool = True, functions: bool = True) -> DataFrame:
    """One row per input row: language, kinds shown and phrases of remarks (kinds), invalid, functions.

    files: (file_id, repo_id, path, content). With kinds only, files are not parsed; without
    kinds, none are sought. Null and empty contents and unknown extensions give nulls. Of the
    contents only those of attribute files are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = [look(p, c, kinds, functions) for p, c in zip(paths, contents)]
            pairs = [[{"fn_line": a, "fn_name": b, "doc": c} for a, b, c in r[4]] for r in rows]
            kept = [c if p is not None and re.split(r"[\\/]", p)[-1] == ".gitattributes" else None for p, c in zip(paths, contents)]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.string()))), pa.array([r[3] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array(pairs, _PAIRS), pa.array(kept, pa.string())], names=["file_id", "repo_id", "path", "language", "kinds", "said", "invalid", "functions", "content"])

    importable(files.sparkSession)
    return files.select("file_id", "repo_id", "path", "content").mapInArrow(run, OUT.format(id=files.schema["file_id"].dataType.simpleString()))


def kinds_of(files: DataFrame) -> DataFrame:
    """(file_id, kind) of the files that are not hand-written source."""
    return origin.not_handwritten(cut(examine(files, kinds=True, functions=False).drop("functions", "invalid", "language")))


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, invalid), one row per input row; invalid is null for valid files."""
    return examine(files, kinds=False, functions=False).where("language is not null").select("file_id", "repo_id", "language", "invalid")


def rates(files: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_invalid, rate) over distinct files; language is that of the extension."""
    once = invalid_files(files.where("content is not null and content != ''")).groupBy("file_id", "repo_id", "language").agg(F.max("invalid").alias("invalid"))
    n = once.groupBy("repo_id", "language").agg(F.count("*").alias("n_files"), F.count("invalid").alias("n_invalid"))
    return n.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, fn_line, fn_name, doc), distinct: pairs from valid, hand-written files."""
    seen = cut(examine(files))
    other = origin.not_handwritten(seen).select("file_id")
    pairs = seen.where("invalid is null and size(functions) > 0").join(other, "file_id", "left_anti")
    return pairs.select("file_id", "repo_id", "path", F.explode("functions").alias("f")).select("file_id", "repo_id", "path", "f.fn_line", "f.fn_name", "f.doc").distinct()
