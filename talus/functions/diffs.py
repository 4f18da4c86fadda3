"""Diffs as text: unified form, summaries, commit messages; and claims about code checked in tables."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT, SUMMARY_LINES, STORED = 3, 60, 500
MOST_CELLS = 5_000_000  # of a comparison; beyond it the whole text is replaced
# Words of added lines by type of change.
CHANGE_WORDS = {
    "fix": "fix fixes fixed bug error crash panic regression broken incorrect wrong fails failed failure issue prevent avoid guard revert leak",
    "feat": "add adds added new support supports implement implements feature introduce introduces enable enables allow allows expose wire render",
    "refactor": "refactor refactors move moves rename renames extract restructure simplify simplifies clean cleanup split merge consolidate dedupe reduce improve",
}
WORDS = {k: frozenset(v.split()) for k, v in CHANGE_WORDS.items()}
# Folders that name no scope, ends of documents, source names that claims refer to.
CONTAINERS = ("src", "internal", "pkg", "cmd", "lib", "app")
DOC_ENDS = (".md", ".txt", ".rst", ".adoc", ".asciidoc")
FILE_LINE = r"\b([\w./-]+\.(?:go|py|js|ts|jsx|tsx|rs|rb|php|java|c|h|cpp|hpp|cs|kt|swift|vue|svelte|md|json|yaml|yml|toml|html|css):\d+)\b"
ROUTE = r"(/(?:[A-Za-z0-9_\-{}.]+/?){1,5})"
IDENTIFIER = r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\b"
DECLARED = re.compile(r"\b(?:func(?:\s+\([^)]*\))?|def|class|function|type|struct|interface|fn|const|var|let)\s+([A-Za-z_]\w*)")
TEST_PATH = re.compile(r"(_test\.|\.test\.|\.spec\.|_spec\.|(^|/)tests?/|(^|/)test_)")


def diff_text(old: str, new: str) -> str:
    """Unified diff by lines, three lines of context; texts too large to compare are replaced whole."""
    a, b = old.split("\n"), new.split("\n")
    if len(a) * len(b) > MOST_CELLS:
        return "\n".join(["--- old", "+++ new", f"@@ -1,{len(a)} +1,{len(b)} @@", *("-" + x for x in a), *("+" + x for x in b)]) if a != b else ""
    return "\n".join(difflib.unified_diff(a, b, "old", "new", n=CONTEXT, lineterm=""))


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([diff_text(a or "", b or "") for a, b in zip(old, new, strict=True)])


def diff_summary(diff: Column, most: int = SUMMARY_LINES) -> Column:
    """File headers, hunks and changed lines only, the first ``most``."""
    keep = F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^(diff --git|@@)") | (x.rlike("^[+-]") & ~x.rlike(r"^(\+\+\+|---)")))
    named = F.transform(keep, lambda x: F.when(x.startswith("diff --git"), F.concat(F.lit("## "), F.substr(x, F.lit(len("diff --git ") + 1)))).otherwise(x))
    tail = F.when(F.size(named) >= most, F.array(F.lit("… (diff truncated)"))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.concat(F.slice(named, 1, most), tail), "\n")


def harmless(text: Column, most: int = STORED) -> Column:
    """One line without control characters, cut, for what is kept of foreign text."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[\r\n]", " "), r"[\x00-\x1F\x7F]", "")
    return F.left(F.trim(F.regexp_replace(flat, r"\s+", " ")), F.lit(most))


def parse_diff(diff: str) -> list[dict]:
    out: list[dict] = []
    for line in diff.split("\n"):
        m = re.match(r"diff --git a/(\S+) b/(\S+)", line)
        if m:
            out.append({"path": m[2], "added": [], "removed": [], "renamed": m[1] != m[2]})
        elif out and line.startswith("rename to "):
            out[-1]["renamed"] = True
        elif out and line.startswith("+") and not line.startswith("+++"):
            out[-1]["added"].append(line[1:])
        elif out and line.startswith("-") and not line.startswith("---"):
            out[-1]["removed"].append(line[1:])
    return out


def change_type(files: list[dict]) -> str:
    """test or docs where nothing else changes, else the type with most of its words in added lines."""
    code = [f for f in files if not TEST_PATH.search(f["path"]) and not f["path"].lower().endswith(DOC_ENDS)]
    if not code:
        return "test" if any(TEST_PATH.search(f["path"]) for f in files) else "docs" if files else "chore"
    score = {k: sum(w in words for f in code for line in f["added"] for w in re.findall(r"[a-z]+", line.lower())) for k, words in WORDS.items()}
    best = max(score, key=lambda k: score[k])  # the first of the highest
    return best if score[best] else "chore"


def change_scope(files: list[dict]) -> str:
    """The common folder, without containers, its last two parts."""
    paths = [f["path"].split("/") for f in files]
    common = []
    for parts in zip(*paths, strict=False):
        if len(set(parts)) > 1:
            break
        common.append(parts[0])
    if common and "." in common[-1]:
        common.pop()
    bare = list(common)
    while bare and bare[0] in CONTAINERS:
        bare.pop(0)
    return "/".join((bare or common[-1:])[-2:])


def message_of(diff: str) -> str:
    """A commit message: 'type(scope): noun' and a line for each file."""
    files = parse_diff(diff)
    if not files:
        return "chore: update"
    names = (m[1] for f in files for line in f["added"] if (m := DECLARED.search(line)))
    words = (w for f in files for line in f["added"] for w in re.findall(r"[A-Za-z_]\w{2,}", line))
    noun = (next(names, None) or next(words, None) or "update").lower()
    scope = change_scope(files)
    head = f"{change_type(files)}{f'({scope})' if scope else ''}: {noun}"
    return "\n".join([head, "", *(f"- {f['path']}{' (renamed)' if f['renamed'] else ''} ({len(f['added'])}+,{len(f['removed'])}-)" for f in files)])


@F.pandas_udf(T.StringType())
def commit_message(diffs: pd.Series) -> pd.Series:
    return diffs.fillna("").map(message_of)


def check_claims(texts: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, kind, ref, found) of texts (id, text): file:line against files (path, lines), identifiers that
    are symbols, and routes against those registered; dates and file paths are no routes."""
    each = lambda p: F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1))))
    refs = texts.select("id", each(FILE_LINE).alias("ref")).withColumn("path", F.regexp_replace("ref", r":\d+$", "")).withColumn("line", F.regexp_extract("ref", r"(\d+)$", 1).cast("long"))
    by_line = refs.join(files.select("path", "lines"), "path", "left").select("id", F.lit("file").alias("kind"), "ref", (F.col("line").between(1, F.col("lines")) & F.col("lines").isNotNull()).alias("found"))
    keys = symbols.select(F.col("full_name").alias("ref")).unionByName(symbols.where(F.col("name").rlike("^[A-Z]")).select(F.col("name").alias("ref"))).distinct()
    by_name = texts.select("id", each(IDENTIFIER).alias("ref")).join(keys, "ref").select("id", F.lit("symbol").alias("kind"), "ref", F.lit(True).alias("found"))
    asked = texts.select("id", each(ROUTE).alias("ref")).withColumn("ref", F.regexp_replace("ref", r"[.,;:)!?\]}]+$", ""))
    asked = asked.where(F.col("ref") != "").where(~F.col("ref").rlike(r"^/?\d+/\d+/\d+/?$|[^/]\.[A-Za-z]{1,5}(/|$)|(^|/)(src|main|test|java|com|org)(/|$)"))
    routes = symbols.where("entry and route <> ''").select("route").distinct().withColumn("tail", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("route", "/")) - 1), lambda k: F.concat(F.lit("/"), F.call_function("substring_index", F.col("route"), F.lit("/"), -k)))))
    by_route = asked.join(routes.select(F.col("tail").alias("ref"), F.lit(True).alias("known")).distinct(), "ref", "left").select("id", F.lit("route").alias("kind"), "ref", F.coalesce("known", F.lit(False)).alias("found"))
    return by_line.unionByName(by_name).unionByName(by_route).distinct()


# Words that are no symbols when a change is described.
PLAIN_WORDS = frozenset("""the a an and or but not for with from into to of in on at by is are was were be been being has have had do does did will
would should could may might can this that these those it its they them their we you your our who which what when where why how refactor
remove change add delete update split move create introduce modify replace rewrite rename extract inline simplify clean fix break method function
file symbol code line lines class struct type interface module package variable constant field property parameter argument return returns value
values name names true false null none nil void new old all some any each every first last next previous use using used uses via through about
more less most least very much than then so if else end begin start test tests unit integration bug issue error feature task todo note get set put
post make run try call just here there directory folder path root source config service handler client server response request""".split())
SOURCE_ENDS = ("go", "py", "js", "ts", "tsx", "jsx", "rs", "java", "c", "cpp", "h", "md", "json", "yaml", "yml", "sh", "rb", "sql")


def symbols_in(text: str, most: int = 5) -> list[str]:
    """Names that a described change is about: quoted ones, then qualified, then bare ones, then files' stems."""
    text = text.strip()
    if not text or not re.search(r"\s", text):
        return [text] if text else []
    quoted = [a or b for a, b in re.findall(r'`([A-Za-z_][\w.]*)`|"([A-Za-z_][\w.]*)"', text)]
    dotted = [m[0] for m in re.finditer(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", text) if m[0].rsplit(".", 1)[1] not in SOURCE_ENDS]
    covered = set(quoted) | set(dotted) | {p for d in dotted for p in d.split(".")}
    bare = [w for w in re.findall(r"\b[A-Za-z_]\w{2,}\b", text) if w.lower() not in PLAIN_WORDS and w not in covered]
    stems = [m.rsplit("/", 1)[-1].rsplit(".", 1)[0] for m in re.findall(r"[\w./-]+\.go\b", text)]
    return list(dict.fromkeys(quoted + dotted + bare + [s for s in stems if re.search("[A-Za-z]", s)]))[:most]


@F.pandas_udf(T.ArrayType(T.StringType()))
def symbols_named(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(symbols_in)


def render(template: Column, values: dict[str, Column]) -> Column:
    """A template's {{name}} filled in; unknown names stay."""
    for name, value in values.items():
        template = F.regexp_replace(template, F.lit(r"\{\{\s*\.?" + re.escape(name) + r"\s*\}\}"), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\$])", r"\\$1"))
    return template
