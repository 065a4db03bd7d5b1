"""Generated, minified, vendored source files and data saved as code.

Three kinds of evidence:

1. what the repository itself declares (``linguist-generated``, ``linguist-vendored`` in its
   attribute files; in one file the last matching line counts, of several the one in the
   deepest directory). A negative attribute takes away its own kind only,
2. conventions of paths, and patterns *mined* from the corpus and applied to repositories that
   declare nothing: directory names and file suffixes nearly all of whose files are declared
   (counted where something is declared) or show evidence in their content; and phrases of
   comments that are far more frequent in files that are declared, or named by convention, than
   elsewhere. A comment most of whose phrases are such patterns is a banner wherever it stands,
3. the content: usual banners of tools in comments outside of functions, text without white
   space, token streams that consist of literals. A file that is no source of its language at
   all (a JSON document, say) is not judged here; it does not parse.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexers import LEX, Tokens, language_of
from ..session import cut, importable

# Conventions of paths, in lower case.
VENDORED_DIRECTORIES = ("node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "deps", "pods", "site-packages")
GENERATED_DIRECTORIES = ("generated", "__generated__", "gen", "autogen", "obj", "dist")
VENDORED_PATHS = ("wwwroot/lib/",)
GENERATED_NAMES = (r"\.(g|g\.i|designer|generated|gen|assemblyinfo|assemblyattributes|pb|grpc|min|bundle|chunk)\.\w+$", r"(_pb|_pb2|\.pb|_grpc_pb|_pb_service|_generated|\.generated)\.\w+$", r"[-.][0-9a-f]{8}([0-9a-f]{2,24})?\.js$")

# Usual banners of tools, matched in comments outside of functions.
GENERATED_BANNERS = (
    r"<auto-?generated",
    r"@generated\b",
    r"\bcode generated by\b.{1,100}\bdo not edit\b",
    r"\b(file|code|module|source|class) (was|is|has been) (auto(matically)?[ -]?|machine[ -]?)(generated|written|created|produced)\b",
    r"\b(file|code) (was|is|has been) generated by (a|the|an) (tool|generator|program|compiler|script)\b",
    r"^\W*auto-?generated\b",
    r"\bmachine[- ]generated (code|file)\b",
    r"^\W*(automatically )?generated (from|by|with|using|on) \S+",
    r"\bchanges (to this file )?will be (overwritten|lost)\b",
    r"\bautomatisch (erzeugt|generiert|erstellt)\b",
    r"\bautogenerad[oa]\b|\bgerad[oa] automaticamente\b|\bgenerad[oa] autom[aá]ticamente\b",
    r"\bg[ée]n[ée]r[ée]e? automatiquement\b|\bgenerato automaticamente\b",
    r"\bdo not (edit|modify)( (it|this file))?( (by hand|manually|directly))?\W*$",
)
VENDORED_BANNERS = (
    r"\bvendored (from|copy)\b",
    r"@license\b",
    r"@preserve\b",
    r"^\W*[\w.@/-]+ v?\d+\.\d+(\.\d+)?\W*\|\W*(\(c\)|mit|bsd|apache|isc|mpl)",
)
_GENERATED = re.compile("|".join(f"(?:{p})" for p in GENERATED_BANNERS), re.I | re.M)
_VENDORED = re.compile("|".join(f"(?:{p})" for p in VENDORED_BANNERS), re.I | re.M)
#: Minified: share of white space outside comments at most, characters of a line on average at least, tokens at least.
SPACE, LINE, TOKENS = 0.08, 150, 60
#: Data: share of literals among literals and words at least, in files without and with statements; literals at least.
DATA, DATA_BESIDE_CODE, LITERALS = 0.6, 0.93, 5
_LITERAL = frozenset(("num", "str", "tpl", "chr", "atom", "true", "false", "null", "nil"))
_STATEMENT = frozenset(("return", "if", "for", "while", "switch", "case", "function", "=>", "->", "foreach", "try", "fn", "import", "using"))
#: Mined path patterns: files at least, repositories at least, share of files with evidence at least.
MINED_FILES, MINED_REPOSITORIES, MINED_SHARE = 20, 3, 0.9
#: Mined phrases: words of one, declared files that hold it at least, share of declared files over that of
#: all files at least, and the log-likelihood ratio of the difference at least (a chance of one in a thousand).
WORDS, PHRASE_FILES, PHRASE_LIFT, PHRASE_RATIO = 3, 3, 2.5, 10.83
#: Share of a comment's phrases that must be mined ones, or else their number.
BANNER_SHARE, BANNER_PHRASES = 0.5, 5
#: Order of the kinds when a file is of several, and what a negative attribute takes away.
ORDER = ("generated", "vendored", "data", "minified")
DENIED = {"generated": ("generated", "minified"), "vendored": ("vendored",)}

_OPEN, _CLOSE = frozenset("{ ( [ call( at[ do fn << %{".split()), frozenset("} ) ] end >>".split())
#: Brackets outside of functions: the namespace or the module.
_OUTER = {"csharp": 1, "elixir": 1}


def remarks(content: str, language: str, tokens: Tokens) -> list[str]:
    """The comments that begin a line outside of functions; those of neighbouring lines count as one."""
    out: list[tuple[int, str]] = []
    changes = [i for i, k in enumerate(tokens.kind) if k in _OPEN or k in _CLOSE]
    places = [tokens.start[i] for i in changes]
    depth, at, most = 0, 0, _OUTER.get(language, 0)
    for a, b in tokens.comments:
        upto = bisect_left(places, a)
        for i in changes[at:upto]:
            depth += 1 if tokens.kind[i] in _OPEN else -1
        at = upto
        line = max(content.rfind("\n", 0, a), content.rfind("\r", 0, a)) + 1
        if depth > most or content[line:a].strip(" \t\ufeff"):
            continue
        if out and not content[out[-1][0] : a].strip() and not content.startswith("/*", a) and content[out[-1][0] : a].count("\n") < 2:
            out[-1] = (b, out[-1][1] + "\n" + content[a:b])
        else:
            out.append((b, content[a:b]))
    return [c for _, c in out]


_WORD = re.compile(r"[^\W\d_]+|\d[\d.]*|@")


def phrases(comment: str) -> list[str]:
    """The distinct phrases of WORDS words in the lines of a comment; numbers are alike, ends of lines are words."""
    out: dict[str, None] = {}
    for line in re.split(r"[\r\n]+", comment.lower()):
        words = ["0" if w[0].isdigit() else w for w in _WORD.findall(line)]
        if words:
            words = ["^", *words, "$"]
            for i in range(max(1, len(words) - WORDS + 1)):
                out[" ".join(words[i : i + WORDS])] = None
    return list(out)


def declared_kinds(content: str, language: str, tokens: Tokens | None = None) -> tuple[list[str], list[list[str]]]:
    """What the content shows (``generated``, ``vendored``, ``minified``, ``data``), and the phrases of its remarks.

    Comments in the form of documentation may be banners, but no phrases are mined from them.
    """
    tokens = tokens or LEX[language](content)
    kinds: set[str] = set()
    said: list[list[str]] = []
    for comment in remarks(content, language, tokens):
        if _GENERATED.search(comment):
            kinds.add("generated")
        if _VENDORED.search(comment):
            kinds.add("vendored")
        if not comment.startswith(("/**", "///")):
            said.append(phrases(comment))
    words = literals = statements = 0
    for k in tokens.kind:
        if k in _LITERAL:
            literals += 1
        elif k[0].isalpha() and k not in ("nl", "error", "regex", "tplhead", "tplmid", "tplend", "kw"):
            words += 1
            statements += k in _STATEMENT
        else:
            statements += k in _STATEMENT
    if words and literals >= LITERALS and literals >= (DATA_BESIDE_CODE if statements else DATA) * (literals + words) and not _document(content):
        kinds.add("data")
    if len(tokens.kind) >= TOKENS:
        parts, at = [], 0
        for a, b in tokens.comments:
            parts.append(content[at:a])
            at = b
        code = "".join([*parts, content[at:]])
        lines = [x for x in re.split(r"[\r\n]+", code) if x.strip()]
        space = sum(map(code.count, " \t\r\n"))
        if space <= SPACE * len(code) and sum(map(len, lines)) >= LINE * len(lines):
            kinds.add("minified")
    return [k for k in ORDER if k in kinds], said


def _document(content: str) -> bool:
    """Whether a text is a JSON document: no source at all."""
    return bool(re.match(r"[\ufeff\s]*[\[{]\s*([\]}]|\"[^\"\n]*\"\s*[:,\]])", content))


def content_kinds(path: str | None, content: str | None) -> list[str]:
    """Evidence in one file's content; none also for null and empty contents and unknown extensions."""
    language = language_of(path)
    return declared_kinds(content, language)[0] if content and language else []


def _norm(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def conventional(path: Column) -> Column:
    """``vendored`` or ``generated`` by the conventions of paths, else null."""
    p = F.concat(F.lit("/"), _norm(path))
    inside = F.array_distinct(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))))
    vendored = F.arrays_overlap(inside, F.array(*map(F.lit, VENDORED_DIRECTORIES)))
    for part in VENDORED_PATHS:
        vendored = vendored | p.contains("/" + part)
    generated = F.arrays_overlap(inside, F.array(*map(F.lit, GENERATED_DIRECTORIES)))
    for pattern in GENERATED_NAMES:
        generated = generated | p.rlike(pattern)
    return F.when(vendored, "vendored").when(generated, "generated")


def features(path: Column) -> Column:
    """What patterns may be mined from: directory names and the part of the file's name after its first stop."""
    parts = F.split(_norm(path), "/")
    name = F.element_at(parts, -1)
    dirs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.concat(F.lit("dir:"), d))
    suffix = F.concat(F.lit("name:"), F.regexp_extract(name, r"[^.]\.(.+\..+)$", 1))
    return F.array_distinct(F.concat(dirs, F.array(suffix)))


def mined_patterns(files: DataFrame) -> DataFrame:
    """(feature, kind): path patterns nearly all of whose files are declared or show evidence.

    files: (file_id, repo_id, path, kinds, said, kind): kinds shown by the content, whether the
    repository declares anything, and what it declares of this file. What is declared is counted
    over the files of such repositories, what is shown over all files.
    """
    rows = files.select("repo_id", F.get("kinds", F.lit(0)).alias("shown"), "said", "kind", F.explode(features(F.col("path"))).alias("feature")).where("feature != 'name:' and feature != 'dir:'")
    part = rows.groupBy("feature", "repo_id").agg(
        F.count("*").alias("n"), F.count("shown").alias("s"), *[F.count(F.when(F.col("shown") == k, 1)).alias(f"s_{k}") for k in ORDER],
        F.sum(F.col("said").cast("bigint")).alias("m"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"d_{k}") for k in DENIED], F.max("said").alias("says"),
    )
    sums = [F.sum(c).alias(c) for c in part.columns if c not in ("feature", "repo_id", "says")]
    got = part.groupBy("feature").agg(F.count("*").alias("repos"), F.sum(F.col("says").cast("bigint")).alias("sayers"), *sums)
    shown = (F.col("n") >= MINED_FILES) & (F.col("repos") >= MINED_REPOSITORIES) & (F.col("s") >= MINED_SHARE * F.col("n"))
    told = (F.col("m") >= MINED_FILES) & (F.col("sayers") >= MINED_REPOSITORIES)
    kind = F.lit(None).cast("string")
    for k in DENIED:
        kind = F.coalesce(kind, F.when(told & (F.col(f"d_{k}") >= MINED_SHARE * F.col("m")), F.lit(k)))
    best = F.greatest(*[F.struct(F.col(f"s_{k}").alias("n"), F.lit(k).alias("k")) for k in ORDER])["k"]
    return got.select("feature", F.coalesce(kind, F.when(shown, best)).alias("kind")).where("kind is not null")


def _ratio(n: Column, d: Column, all_n: Column, all_d: Column) -> Column:
    """Log-likelihood ratio of d declared files among n against all_d among all_n."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = all_d / all_n
    return 2 * (part(d, n * rate) + part(n - d, n * (1 - rate)))


def mined_phrases(files: DataFrame) -> DataFrame:
    """(phrase, kind): phrases of remarks that tell declared and conventionally named files from others.

    files: (file_id, repo_id, marked, said), marked being the kind declared or given by convention
    and said the phrases of each remark. A phrase must occur in MINED_REPOSITORIES of them.
    """
    totals = files.agg(F.count("*").alias("n"), F.count("marked").alias("d")).first()
    all_n, all_d = F.lit(totals["n"]), F.lit(totals["d"])
    once = files.select("repo_id", "marked", F.explode(F.array_distinct(F.flatten("said"))).alias("phrase"))
    part = once.groupBy("phrase", "repo_id").agg(F.count("*").alias("n"), F.count("marked").alias("d"), F.count(F.when(F.col("marked") == "vendored", 1)).alias("v"))
    got = part.groupBy("phrase").agg(F.count("*").alias("repos"), *[F.sum(c).alias(c) for c in ("n", "d", "v")])
    got = got.where((F.col("d") >= PHRASE_FILES) & (F.col("repos") >= MINED_REPOSITORIES))
    lift = F.col("d") * all_n >= PHRASE_LIFT * F.col("n") * all_d
    real = got.where(lift & (_ratio(F.col("n"), F.col("d"), all_n, all_d) >= PHRASE_RATIO))
    return real.select("phrase", F.when(2 * F.col("v") >= F.col("d"), "vendored").otherwise("generated").alias("kind"))


def banners(files: DataFrame, mined: DataFrame) -> DataFrame:
    """(file_id, kind): files with a remark of which BANNER_SHARE at least, or BANNER_PHRASES, are mined phrases."""
    each = files.where(F.size("said") > 0).select("file_id", F.posexplode("said").alias("at", "words")).select("file_id", "at", F.size("words").alias("size"), F.explode("words").alias("phrase"))
    hit = each.join(mined, "phrase").groupBy("file_id", "at", "size").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    return hit.where((F.col("n") >= BANNER_SHARE * F.col("size")) | (F.col("n") >= BANNER_PHRASES)).groupBy("file_id").agg(F.min("kind").alias("kind"))


# --- attribute files ----------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """The regular expression of an attribute pattern, for paths relative to its directory."""
    anchored = "/" in pattern.rstrip("/")
    p, out, i = pattern.strip("/") if pattern != "/" else "", "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            if c == "\\" and i + 1 < len(p):
                i += 1
                c = p[i]
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def attribute_rules(content: str) -> list[tuple[str, str, bool | None]]:
    """(pattern's expression, kind, declared) of an attribute file, in its order; None: no longer declared."""
    rules = []
    for line in content.lstrip("\ufeff").splitlines():
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for attribute in parts[1:]:
            m = re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\w+))?", attribute)
            if m:
                yes = None if m.group(1) == "!" else not m.group(1) and (m.group(3) or "true").lower() in ("true", "set", "1")
                rules.append((glob_regex(parts[0].strip('"')), m.group(2), yes))
    return rules


@lru_cache(256)
def _compiled(content: str) -> list[tuple[re.Pattern, str, bool | None]]:
    return [(re.compile(p), kind, yes) for p, kind, yes in reversed(attribute_rules(content))]


def _ruled(key: tuple, files: pd.DataFrame, attributes: pd.DataFrame) -> pd.DataFrame:
    """What one attribute file says of the files below its directory: its last matching line, per kind."""
    rows = []
    for content in attributes["content"]:
        rules = _compiled(content or "")
        for file_id, rest, depth in zip(files["file_id"], files["rest"], files["depth"]):
            open_ = set(DENIED)
            for pattern, kind, yes in rules:
                if kind in open_ and pattern.search(rest):
                    open_.discard(kind)
                    rows.append((file_id, kind, depth, yes))
                    if not open_:
                        break
    return pd.DataFrame(rows, columns=["file_id", "kind", "depth", "yes"])


#: Files that one task applies an attribute file to.
CHUNK = 20_000


def declared(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """(file_id, yes, no): the kinds that attribute files declare a file to be and not to be.

    attributes: (repo_id, path, content) of attribute files. A file meets only the attribute files
    of its own directories; one that holds for many files is applied to CHUNK of them at a time.
    """
    importable(files.sparkSession)
    base = F.regexp_replace(F.translate("path", "\\", "/"), r"[^/]*$", "")
    own = attributes.select("repo_id", base.alias("base"), "content").groupBy("repo_id", "base").agg(F.max("content").alias("content"))
    parts = F.split(F.translate("path", "\\", "/"), "/")
    ways = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n), F.when(n > 0, F.lit(""))))
    near = files.select("file_id", "repo_id", F.translate("path", "\\", "/").alias("p"), F.posexplode(ways).alias("depth", "base")).distinct()
    k = own.select(F.col("repo_id").alias("_r"), F.col("base").alias("_b"))
    near = near.join(k, near["repo_id"].eqNullSafe(k["_r"]) & (near["base"] == k["_b"]), "left_semi")
    sizes = near.groupBy("repo_id", "base").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_k")).select(F.col("repo_id").alias("_r"), F.col("base").alias("_b"), "_k")
    left = near.join(sizes, near["repo_id"].eqNullSafe(sizes["_r"]) & (near["base"] == sizes["_b"])).select("file_id", "repo_id", "base", "depth", F.expr("substring(p, length(base) + 1)").alias("rest"), F.pmod(F.xxhash64("p"), "_k").cast("int").alias("salt"))
    right = own.join(sizes, own["repo_id"].eqNullSafe(sizes["_r"]) & (own["base"] == sizes["_b"])).select(F.col("repo_id").alias("r"), F.col("base").alias("b"), "content", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("s"))
    kind = files.schema["file_id"].dataType.simpleString()
    said = left.groupBy("repo_id", "base", "salt").cogroup(right.groupBy("r", "b", "s")).applyInPandas(_ruled, f"file_id {kind}, kind string, depth int, yes boolean")
    last = said.groupBy("file_id", "kind").agg(F.max(F.struct("depth", "yes")).alias("r"))
    return last.groupBy("file_id").agg(F.collect_set(F.when(F.col("r.yes"), F.col("kind"))).alias("yes"), F.collect_set(F.when(~F.col("r.yes"), F.col("kind"))).alias("no"))


def _kept(kinds: Column) -> Column:
    """kinds without those that a negative attribute takes away."""
    for kind, gone in DENIED.items():
        kinds = F.when(F.array_contains("no", kind), F.filter(kinds, lambda k: ~k.isin(*gone))).otherwise(kinds)
    return kinds


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, kind), one row per file that is generated, vendored, minified or data.

    files: (file_id, repo_id, path, content, kinds, said), content of attribute files only, kinds
    and said being those of :func:`declared_kinds` (null: nothing). A file_id whose rows disagree
    is a case if one of them is; null ids and paths are kept apart from others; attribute files are
    no cases. A file of several kinds has the first that is declared, shown, conventional, mined.
    """
    base = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    attributes = files.where(base == ".gitattributes").select("repo_id", "path", "content")
    plain = files.where(F.coalesce(base != ".gitattributes", F.lit(True)))
    none = F.array().cast("array<string>")
    rows = plain.groupBy("file_id", "repo_id", "path").agg(F.max(F.struct(F.coalesce("kinds", none).alias("kinds"), F.coalesce("said", F.array().cast("array<array<string>>")).alias("said"))).alias("x"))
    rows = rows.select("file_id", "repo_id", "path", "x.kinds", "x.said", conventional(F.col("path")).alias("convention"))
    told = attributes.select(F.col("repo_id").alias("_r")).distinct()
    rows = rows.join(told, rows["repo_id"].eqNullSafe(told["_r"]), "left").withColumn("says", F.col("_r").isNotNull() | F.lit(False)).drop("_r")
    rows = rows.join(declared(plain, attributes).withColumnRenamed("file_id", "_f"), F.col("file_id") == F.col("_f"), "left").drop("_f").withColumns({"yes": F.coalesce("yes", none), "no": F.coalesce("no", none)})
    rows = cut(rows)
    told_kind = F.get(F.array_sort("yes"), F.lit(0))
    patterns = mined_patterns(rows.select("file_id", "repo_id", "path", "kinds", F.col("says").alias("said"), F.when(F.size("yes") > 0, told_kind).alias("kind")))
    marked = F.coalesce(F.when(F.size("yes") > 0, told_kind), F.col("convention"))
    told_by = banners(rows, mined_phrases(rows.select("file_id", "repo_id", marked.alias("marked"), "said"))).select(F.col("file_id").alias("_f"), F.col("kind").alias("banner"))
    mined = rows.where("not says").select("file_id", F.explode(features(F.col("path"))).alias("feature")).join(patterns, "feature").groupBy("file_id").agg(F.min("kind").alias("mined")).withColumnRenamed("file_id", "_g")
    all_ = rows.join(told_by, F.col("file_id") == F.col("_f"), "left").join(mined, F.col("file_id") == F.col("_g"), "left")
    found = F.filter(F.concat(F.col("kinds"), F.array("banner", "convention", "mined")), lambda k: k.isNotNull())
    kind = F.when(F.size("yes") > 0, told_kind).otherwise(F.get(_kept(found), F.lit(0)))
    return all_.select("file_id", kind.alias("kind")).where("kind is not null").groupBy("file_id").agg(F.max("kind").alias("kind"))
