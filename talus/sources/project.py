"""Source trees and document folders as tables: admission, languages, ignore rules, index build, staleness."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions.logs import chunk_text
from talus.functions.text import token_estimate
from talus.operators import symbols as S
from talus.sources import extract as X

MOST_BYTES, DOC_BYTES, DOC_FILES, CHUNK = 10 << 20, 2 << 20, 5000, 2000
# Languages by extension; '?' is decided by the content.
EXTENSIONS = {
    "go": "go", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "vue": "?", "svelte": "?", "astro": "typescript", "css": "css", "scss": "css", "less": "css", "html": "html", "htm": "html", "md": "markdown", "mdx": "markdown",
    "markdown": "markdown", "json": "json", "jsonc": "json", "yml": "yaml", "yaml": "yaml", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp",
    "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "java": "java", "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell", "dart": "dart",
}
# Interpreters of a first line, in order of trial.
SHEBANGS = (("python", "python"), ("bash", "shell"), ("sh", "shell"), ("node", "javascript"), ("ruby", "ruby"))
# Folders that hold no source, and those of documents' neighbours.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "out", "target", ".next", "__pycache__", ".venv", ".cache", ".idea", "bin", ".mvn", "coverage", "tmp")
DOC_ENDS = ("md", "txt", "rst", "adoc", "org")
# Names and banners of generated files.
GENERATED_NAMES = (
    r"\.pb\.go$", r"\.pulsar\.go$", r"_grpc\.pb\.go$", r"_mocks?\.go$", r"(^|/)mock_[^/]+\.go$", r"\.generated\.[jt]sx?$", r"\.gen\.[jt]sx?$", r"\.pb\.[jt]s$", r"_pb\.[jt]s$",
    r"_grpc_pb\.[jt]s$", r"\.min\.m?js$", r"_pb2(_grpc)?\.py$", r"_pb2\.pyi$", r"\.pb\.(cc|h)$", r"\.g\.cs$", r"Grpc\.cs$", r"OuterClass\.java$", r"Grpc\.java$", r"\.pb\.swift$",
    r"\.g\.dart$", r"\.freezed\.dart$", r"\.pb\.dart$", r"\.pbgrpc\.dart$", r"\.chopper\.dart$", r"\.generated\.rs$",
)
GENERATED_BANNERS = (
    r"(?i)\bcode generated\b.{0,200}?\bdo not edit\b", r"(?i)\b(?:automatically |auto[- ]?)?generated (?:by|from|with)\b.{0,200}?\bdo not (?:edit|modify|change)\b",
    r"(?:^|[^\p{L}\p{N}_@])@generated\b", r"(?i)<auto-?generated\s*/?>", r"(?i)\b(?:automatically generated|auto[- ]?generated|autogenerated) by\b",
    r"(?i)\bgenerated by\s+\S.{0,80}?\bby running\b", r"(?i)\bthis (?:file|class|code|module) (?:is|was) (?:auto[- ]?)?generated\b",
    r"(?i)\bdo not (?:edit|modify)\b.{0,120}?\b(?:auto[- ]?generated|generated file|generated code)\b",
)
COMMENT = r"^\s*(?://|/\*+|\*+|#+|--+|<!--|%+|;+|'|!|\(\*|\{-|\"\"\"|=begin|<#|@rem|rem\b)"
IGNORE_FILES = (".gitignore", ".ignore")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size, modified) of all files under ``root``, paths relative to it, and of its
    ignore files, which the reader passes over. Content is read only by what asks for it."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    # What follows the root in a full path; the reader prefixes the file system's name.
    path = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    files = files.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    depth = files.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    return files.unionByName(read_ignore_files(spark, base, depth))


def read_ignore_files(spark: SparkSession, base: str, depth: int) -> DataFrame:
    """The ignore files of a tree, by the file system itself: a few small ones."""
    jvm, rows = spark._jvm, []
    for k in range(depth):
        for name in IGNORE_FILES:
            pattern = jvm.org.apache.hadoop.fs.Path(base + "/*" * k + "/" + name)
            fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
            for status in fs.globStatus(pattern) or []:
                stream = fs.open(status.getPath())
                data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                stream.close()
                path = status.getPath().toUri().getPath()
                rows.append((path[path.index(base) + len(base) + 1 :], data, len(data), status.getModificationTime() / 1000))
    found = spark.createDataFrame(rows, "path string, content binary, size long, at double")
    return found.select("path", "content", "size", F.timestamp_seconds("at").alias("modified"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def skipped(path: Column) -> Column:
    """Whether a folder on the way holds no source."""
    return F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: d.isin(*SKIPPED))


def language(path: Column, text: Column) -> Column:
    """By extension; of components by their script tag, of files without a known extension by the interpreter in the first line."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    by_name = F.try_element_at(table, extension(path))
    tag = F.lower(F.regexp_extract(text, r"(<script[^>]*)>", 1))
    script = F.when(tag.rlike("lang=\"tsx?\""), "typescript").otherwise("javascript")
    first = F.lower(F.substring_index(text, "\n", 1))
    shebang = F.lit("")
    for word, lang in reversed(SHEBANGS):
        shebang = F.when(F.contains(first, F.lit(word)), lang).otherwise(shebang)
    return F.when(by_name == "?", script).when(by_name.isNotNull(), by_name).when(first.startswith("#!"), shebang).otherwise("")


def generated(path: Column, text: Column) -> Column:
    """By the path's form, or by a banner in a comment line of the first 60 lines and 8192 characters."""
    head = F.slice(F.split(F.left(text, F.lit(8192)), "\n"), 1, 60)
    return path.rlike("|".join(GENERATED_NAMES)) | F.exists(head, lambda x: x.rlike(COMMENT) & x.rlike("|".join(f"(?:{p})" for p in GENERATED_BANNERS)))


def minified(text: Column) -> Column:
    """Ten lines of over 500 bytes, or one of over 5000, in the first MiB."""
    sizes = F.transform(F.split(F.left(text, F.lit(1 << 20)), "\n"), F.octet_length)
    return (F.size(F.filter(sizes, lambda n: n > 500)) >= 10) | F.exists(sizes, lambda n: n > 5000)


def script_of(path: Column, text: Column) -> Column:
    """Of components the bodies of their script tags, and of some the block between dashes before them."""
    bodies = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    front = F.regexp_extract(text, r"(?s)\A---[^\n]*\n(.*?)\n---", 1)
    return F.when(extension(path).isin("vue", "svelte"), bodies).when(extension(path) == "astro", F.concat_ws("\n", front, bodies)).otherwise(text)


def glob_pattern(glob: str) -> str:
    """The body of a regular expression for an ignore rule's glob."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if c == "*":
            out += "[^/]*"
            while glob.startswith("*", k + 1):
                k += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            body = glob[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", end
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += re.escape(glob[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """(pattern, negated) of a line of an ignore file, or none."""
    line = line.rstrip("\r")
    if not line.strip() or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = (line[1:] if negated else line).removeprefix("\\") if line.startswith("\\#") or negated else line
    folder_only = line.endswith("/")
    body = line.strip("/") if line.startswith("/") or folder_only else line
    anchored = line.startswith("/") or "/" in body
    if not body:
        return None
    pattern = ("^" if anchored else "(?:^|.*/)") + glob_pattern(body) + ("(?:/|$)" if folder_only or not anchored else "(?:/|$)")
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern, negated


def ignore_rules(files: DataFrame) -> DataFrame:
    """(scope, pattern, negated, ord) of the ignore files among files (path, text), the outer ones first."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    rows = files.where(name.isin(*IGNORE_FILES)).select("path", S.folder(F.col("path")).alias("scope"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    order = F.struct(F.size(F.split("scope", "/")).alias("depth"), "scope", F.element_at(F.create_map(*(F.lit(x) for k, n in enumerate(IGNORE_FILES) for x in (n, k))), name).alias("which"), "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [(s, *r, o) for s, line, o in zip(part["scope"], part["line"], part["key"], strict=True) if (r := ignore_rule(line))]
            yield pd.DataFrame(out, columns=["scope", "pattern", "negated", "key"])

    keyed = rows.select("scope", "line", F.to_json(order).alias("key"), order.alias("o"))
    ranked = keyed.withColumn("key", F.row_number().over(Window.orderBy("o")).cast("string"))  # lines of ignore files: few
    return ranked.select("scope", "line", "key").mapInPandas(run, "scope string, pattern string, negated boolean, key string").select("scope", "pattern", "negated", F.col("key").cast("int").alias("ord"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) that rules exclude: the last rule that meets a path or a folder on its way decides, and
    nothing below an excluded folder comes back. Rules are those of ignore files, hundreds at most."""
    parts = F.split("path", "/")
    ways = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("way")))).alias("w"))
    ways = ways.select("path", "w.depth", "w.way")
    below = F.when(F.col("scope") == "", F.col("way")).when(F.col("way").startswith(F.concat("scope", F.lit("/"))), F.substr("way", F.length("scope") + 2))
    met = ways.join(F.broadcast(rules), below.isNotNull() & F.regexp(below, F.col("pattern")))
    last = met.groupBy("path", "depth").agg(F.max(F.struct("ord", "negated"))["negated"].alias("negated"))
    return last.where("not negated").select("path").distinct()


def admitted(tree: DataFrame) -> DataFrame:
    """(path, content, lang, hash, generated, tokens, modified) of the source files of a tree: not in
    skipped or ignored folders, of a known language, at most 10 MiB, neither binary nor minified."""
    named = tree.where(~skipped(F.col("path")) & (F.col("size") <= MOST_BYTES))
    known = extension(F.col("path")).isin(*EXTENSIONS)
    rules_text = named.where(F.regexp_extract("path", "[^/]*$", 0).isin(*IGNORE_FILES)).select("path", F.col("content").cast("string").alias("text"))
    rules = ignore_rules(rules_text)
    files = named.where(known | (~F.contains(F.regexp_extract("path", "[^/]*$", 0), F.lit("."))))
    files = files.join(ignored(files.select("path"), rules), "path", "left_anti")
    binary = F.instr(F.hex(F.substring("content", 1, 8192)), "00") > 0
    zero = F.regexp(F.hex(F.substring("content", 1, 8192)), F.lit("^(..)*00"))
    text = F.col("content").cast("string")
    rows = files.where(~(binary & zero)).select("path", text.alias("text"), F.sha2("content", 256).alias("hash"), "modified")
    rows = rows.where(~minified(F.col("text"))).withColumn("lang", language(F.col("path"), F.col("text"))).where("lang <> ''")
    return rows.select("path", script_of(F.col("path"), F.col("text")).alias("content"), "lang", "hash", generated(F.col("path"), F.col("text")).alias("generated"), token_estimate(F.col("text"), 3.5).alias("tokens"), "modified")


def build_index(files: DataFrame) -> dict[str, DataFrame]:
    """files, symbols (entries resolved), calls, callers (resolved and dispatched), inherits and imports
    of admitted files. Files are scanned once; the rest are joins."""
    from talus.shared import cut

    records = cut(X.extract(files))
    found = X.symbols(records)
    calls, inherits = X.calls(records), X.inherits(records)
    return {
        "files": files.drop("content"), "symbols": cut(S.resolve_entries(found)), "calls": calls, "inherits": inherits,
        "callers": cut(S.call_edges(found, calls, inherits)), "imports": X.imports(records),
    }


def save_index(index: dict[str, DataFrame], root: str, version: int = 1) -> None:
    """Each table under ``root``, and last the version, without which a folder is no index."""
    for name, table in index.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")
    next(iter(index.values())).sparkSession.createDataFrame([(version,)], "version int").write.mode("overwrite").parquet(f"{root}/version")


def load_index(spark: SparkSession, root: str, version: int = 1) -> dict[str, DataFrame] | None:
    """The saved tables, or none where the folder holds no index of this version."""
    try:
        found = spark.read.parquet(f"{root}/version").first()[0]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
            return None
        raise
    names = ("files", "symbols", "calls", "inherits", "callers", "imports")
    return {n: spark.read.parquet(f"{root}/{n}") for n in names} if found == version else None


def project_map(symbols: DataFrame, most: int = 200) -> DataFrame:
    """(file, n, outline): the first ``most`` symbols of each file, in order of lines."""
    nth = F.row_number().over(Window.partitionBy("file").orderBy("line", "full_name"))
    line = F.concat(F.col("line").cast("string"), F.lit(": "), "kind", F.lit(" "), "full_name")
    rows = symbols.withColumn("nth", nth)
    some = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", line.alias("t"))))), lambda s: s["t"]), "\n")
    return rows.groupBy("file").agg(F.count("*").alias("n"), some.alias("outline"))


def read_documents(tree: DataFrame) -> DataFrame:
    """(file, start, text): chunks of the text documents of a tree, at most 2 MiB each and 5000 by path,
    hidden and skipped folders aside."""
    hidden = F.exists(F.split("path", "/"), lambda d: d.startswith("."))
    docs = tree.where(extension(F.col("path")).isin(*DOC_ENDS) & ~skipped(F.col("path")) & ~hidden & (F.col("size") <= DOC_BYTES)).orderBy("path").limit(DOC_FILES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(p, s, t) for p, c in zip(part["path"], part["content"], strict=True) for s, t in chunk_text(bytes(c).decode("utf-8", "replace"), CHUNK)]
            yield pd.DataFrame(rows, columns=["file", "start", "text"])

    return docs.select("path", "content").mapInPandas(run, "file string, start int, text string")


def frameworks(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(framework, signals, files): files (path, content) that show marks of a catalogue (framework,
    how, mark, lang): a path's end or a name in it, a dependency in a manifest, or words in code of a language. The
    catalogue is a few hundred rows at most."""
    manifest = F.regexp_extract("path", "[^/]*$", 0).rlike(r"^(package\.json|go\.mod|requirements[^/]*\.txt|pyproject\.toml|pom\.xml|build\.gradle(\.kts)?|Gemfile|composer\.json|Cargo\.toml|.*\.csproj)$")
    rows = files.select("path", "content", manifest.alias("manifest"), language(F.col("path"), F.col("content")).alias("lang_"))
    by_path = (F.col("how") == "path") & F.contains(F.col("path"), F.col("mark"))
    by_dep = (F.col("how") == "dependency") & F.col("manifest") & F.contains(F.col("content"), F.col("mark"))
    by_code = (F.col("how") == "code") & ~F.col("manifest") & ((F.col("lang") == "") | (F.col("lang") == F.col("lang_"))) & F.contains(F.col("content"), F.col("mark"))
    hit = rows.join(F.broadcast(catalog), by_path | by_dep | by_code)
    return hit.groupBy("framework").agg(F.sort_array(F.collect_set(F.concat_ws(":", "how", "mark"))).alias("signals"), F.countDistinct("path").alias("files"))
