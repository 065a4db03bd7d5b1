"""C# solutions and projects read as XML and text, without a build system."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import glob_matches

#: Packages of a project that are kept, in order of their names.
MAX_PACKAGES = 256
LOOSE = "@loose/csharp"
PARSED = "error string, sdk boolean, packages array<struct<name:string,version:string,condition:string>>, references array<string>, includes array<string>, removes array<string>"


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def parse_project(text: str | None) -> dict:
    """Packages, project references and compile globs of a project file."""
    out: dict = {"error": None, "sdk": False, "packages": [], "references": [], "includes": [], "removes": []}
    try:
        root = ElementTree.fromstring((text or "").lstrip("﻿"))
    except ElementTree.ParseError:
        return out | {"error": "project.load-failure"}
    out["sdk"] = root.get("Sdk") is not None
    parents = {c: p for p in root.iter() for c in p}
    for e in root.iter():
        what, include = _name(e), e.get("Include") or e.get("Update")
        if what == "PackageReference" and include:
            version = e.get("Version") or next((c.text or "" for c in e if _name(c) == "Version"), "")
            condition = e.get("Condition") or (parents[e].get("Condition") if e in parents else None)
            out["packages"].append({"name": include, "version": version.strip(), "condition": condition})
        elif what == "ProjectReference" and include:
            out["references"].append(include.replace("\\", "/"))
        elif what == "Compile":
            out["includes"] += [g.strip() for g in (e.get("Include") or "").split(";") if g.strip()]
            out["removes"] += [g.strip() for g in (e.get("Remove") or e.get("Exclude") or "").split(";") if g.strip()]
    out["packages"] = sorted(out["packages"], key=lambda p: (p["name"], p["version"]))[:MAX_PACKAGES]
    return out


def parse_solution(text: str | None) -> list[str]:
    """Project paths that a solution (either format) lists."""
    body = (text or "").lstrip("﻿")
    if body.lstrip().startswith("<"):
        try:
            return sorted({e.get("Path", "").replace("\\", "/") for e in ElementTree.fromstring(body).iter() if _name(e) == "Project" and e.get("Path")})
        except ElementTree.ParseError:
            return []
    return sorted({m.group(1).replace("\\", "/") for m in re.finditer(r'^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.\w*proj)"', body, re.M)})


def projects(files: DataFrame) -> DataFrame:
    """(repo_id, project, ...): the parsed project files of (repo_id, path, content as text)."""
    parse = F.udf(parse_project, PARSED)
    return files.where(F.col("path").endswith(".csproj")).select("repo_id", F.col("path").alias("project"), parse("content").alias("p")).select("repo_id", "project", "p.*")


def solution_findings(files: DataFrame) -> DataFrame:
    """(repo_id, project, finding): projects that a solution lists but that are missing, or that no solution lists."""
    listed = F.udf(parse_solution, "array<string>")
    sln = files.where(F.col("path").rlike(r"\.slnx?$")).select("repo_id", F.regexp_replace("path", r"[^/]*$", "").alias("base"), F.explode(listed("content")).alias("p"))
    want = sln.select("repo_id", F.concat("base", "p").alias("project")).distinct()
    have = files.where(F.col("path").endswith(".csproj")).select("repo_id", F.col("path").alias("project")).distinct()
    missing = want.join(have, ["repo_id", "project"], "left_anti").withColumn("finding", F.lit("solution.project-missing"))
    unlisted = have.join(want.select("repo_id").distinct(), "repo_id", "left_semi").join(want, ["repo_id", "project"], "left_anti").withColumn("finding", F.lit("solution.project-unlisted"))
    return missing.unionByName(unlisted)


def compile_items(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, project, path): sources of each project; those of none belong to the loose project."""
    base = F.regexp_replace("project", r"[^/]*$", "")
    default = F.when(F.col("sdk"), F.array(F.lit("**/*.cs"))).otherwise(F.array().cast("array<string>"))
    inc = parsed.select("repo_id", "project", F.explode(F.transform(F.concat(default, "includes"), lambda g: F.concat(base, g))).alias("glob"), F.lit(True).alias("include"))
    exc = parsed.select("repo_id", "project", F.explode(F.transform(F.concat("removes", F.array(F.lit("bin/**"), F.lit("obj/**"))), lambda g: F.concat(base, g))).alias("glob"), F.lit(False).alias("include"))
    cs = files.where(F.col("path").endswith(".cs")).select("repo_id", "path").distinct()
    owned = glob_matches(inc.unionByName(exc), cs)
    loose = cs.join(owned, ["repo_id", "path"], "left_anti").select("repo_id", F.lit(LOOSE).alias("project"), "path")
    return owned.unionByName(loose)


def package_facts(parsed: DataFrame) -> DataFrame:
    """(repo_id, project, package_id, name, version, condition): a structural dependency per package reference."""
    p = parsed.select("repo_id", "project", F.explode("packages").alias("p"))
    return p.select("repo_id", "project", F.concat(F.lit("graph:package:"), "p.name").alias("package_id"), "p.name", "p.version", "p.condition").distinct()


def build_order(references: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Projects with their dependencies first, in the order of their names, and those on a cycle."""
    order, cyclic, state = [], set(), {}
    for first in sorted(references):
        stack = [(first, iter(sorted(references.get(first, []))))] if first not in state else []
        if stack:
            state[first] = 1
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if nxt not in references:
                    continue
                if state.get(nxt) == 1:
                    cyclic.add(nxt)
                elif nxt not in state:
                    state[nxt] = 1
                    stack.append((nxt, iter(sorted(references[nxt]))))
                    break
            else:
                stack.pop()
                state[node] = 2
                order.append(node)
    return order, sorted(cyclic)
