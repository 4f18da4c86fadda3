"""Security scan of source and configuration files: rules, suppressors, findings by line."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.pii import RULES as SECRETS
from talus.functions.pii import exempt

# Rules of source files: id, severity, message, pattern.
SOURCE_RULES = (
    ("code-eval", "info", "dynamic code execution (eval, pickle, unsafe yaml)", r"(?i)\b(?:pickle\.loads?|yaml\.load|yaml\.unsafe_load|eval\s*\(|new\s+Function\s*\()"),
    ("command-injection", "error", "shell command built from variables", r"""(?i)(?:exec\.Command(?:Context)?|CmdContext|spawn)\s*\([^)]*["']?(?:sh|bash|zsh|cmd|powershell|pwsh)["']?\s*,\s*["']-c["']?[^)]*?\+|(?:system\(|popen\(|os\.system\(|exec\()\s*["'][^"']*["']\s*\+"""),
    ("insecure-random", "warning", "non-cryptographic randomness for security-relevant data", r"(?i)\b(?:rand\.(?:Intn|Int|Int31n|Uint32|Uint64|Float64)|Math\.random|Random\.randrange|numpy\.random\.rand)\s*\("),
    ("sql-injection", "error", "dynamic SQL built from variables", r"""(?i)(?:\.(?:Query|QueryRow|Exec|Prepare|Execute))\(\s*(?:fmt\.Sprintf|fmt\.Fprintf|fmt\.Errorf|strings\.Join|strings\.ReplaceAll|map\[|\[\]any\{|"(?:[^"\\]|\\.)*"\s*\+)"""),
    ("unsafe-deserialization", "warning", "untrusted input deserialized into untyped/weak types", r"(?is)\b(?:json\.Unmarshal|yaml\.Unmarshal)\s*\(\s*[^)]*?(?:\binterface\{\}|map\[string\](?:interface\{\}|any)\s*\{)[^)]*\)"),
    ("unsafe-reflection", "info", "unsafe memory access via reflect/unsafe", r"\b(?:unsafe\.Pointer|unsafe\.StringData|reflect\.UnsafePointer|unsafe\.Slice)\s*\("),
    ("weak-crypto", "warning", "deprecated or weak cryptographic primitive", r"(?i)\b(?:md5\.(?:New|Sum|NewHash)|sha1\.(?:New|Sum|NewHash)|DES\.(?:NewCipher)|RC4|digest\.MD5)\b"),
)
# Rules of configuration files.
CONFIG_RULES = (
    ("placeholder-bug", "warning", "property placeholder uses $VAR instead of ${VAR}", r"(?m)^[^#\s][^\n=]*=\s*.*\$([A-Z_][A-Z0-9_]*)"),
    ("hardcoded-config-cred", "warning", "hardcoded credential in config file (use ${ENV_VAR} instead)", r"(?i)^[^#=\s]*(?:password|passwd|secret|api[_-]?key|auth[_-]?token|access[_-]?key|private[_-]?key)\s*[=:]\s*([^\s${][^\s#]+)"),
    ("disabled-ssl-verify", "warning", "SSL/TLS verification disabled in config", r"(?im)^[^#=\s]*(?:ssl|tls|certificate)[^=]*(?:verify|verification|validation|enabled)\s*=\s*false\b"),
)
# Words near random numbers that matter, and operands of a schema query.
RISKY = re.compile(r"(?i)(?:token|password|passwd|secret|apikey|authtoken|sessionid|nonce|csrf|salt|otp|captcha|verify|challenge|bearer|jwt)")
BARE_OPERAND = re.compile(r"""\s*\+\s*[a-zA-Z_][a-zA-Z0-9_]*\s*(?:\)|"|'|\+|\s*$)""")
# Names of configuration and of test files.
CONFIG_ENDS = (".properties", ".conf", ".ini", ".cfg", ".env", ".yml", ".yaml")
TEST_PARTS = ("_test.", ".test.", ".spec.", "_spec.")
TEST_STEMS = ("Test", "Tests", "IT", "Spec", "Specs", "TestCase", "TestCases")
MINIFIED_LINE = 2000
COMPILED = [(rule, severity, message, re.compile(p, re.ASCII)) for rule, severity, message, p in SOURCE_RULES]
COMPILED_CONFIG = [(rule, severity, message, re.compile(p, re.ASCII)) for rule, severity, message, p in CONFIG_RULES]
FINDING = "file string, line int, rule string, severity string, message string, snippet string"


def config_file(path: str) -> bool:
    low = path.lower()
    return low.endswith(CONFIG_ENDS) or low.rsplit("/", 1)[-1].startswith("application")


def fixture_file(path: str) -> bool:
    """Test files by name or folder: their secrets are made up."""
    base = path.rsplit("/", 1)[-1]
    stem = base.rsplit(".", 1)[0] if "." in base else base
    low = path.lower()
    return any(p in base for p in TEST_PARTS) or stem.endswith(TEST_STEMS) or base.startswith("test_") or "/test/" in low or "/tests/" in low


def in_comment(text: str, at: int, opens: str, closes: str) -> bool:
    window = text[max(0, at - 512) : at]
    return window.rfind(opens) > window.rfind(closes)


def inert_address(text: str, at: int) -> bool:
    """A mail address in a placeholder attribute or a block comment."""
    before = text[max(0, at - 80) : at]
    if "placeholder" in before.lower() and "=" in before[-30:] and ("'" in before[-30:] or '"' in before[-30:]):
        return True
    return in_comment(text, at, "/*", "*/") or in_comment(text, at, "<!--", "-->")


def suppressed(rule: str, label: str, text: str, start: int, end: int) -> bool:
    """Whether a match is noise: in a pattern's definition, in a comment line, or harmless by its surroundings."""
    line_start = text.rfind("\n", 0, start) + 1
    line_end = text.find("\n", start)
    if "regexp.MustCompile" in text[line_start : line_end if line_end >= 0 else len(text)]:
        return True
    if text[line_start:start].lstrip(" \t").startswith(("//", "#")):
        return True
    if label:
        return label == "PHONE" or exempt(label, text, start, end) or (label == "EMAIL" and inert_address(text, start))
    if rule == "insecure-random":
        return not RISKY.search(text[max(0, start - 100) : start + 100])
    if rule == "sql-injection":
        return "PRAGMA table_info(" in text[max(0, start - 64) : start + 64] and bool(BARE_OPERAND.search(text[start : start + 64]))
    return False


def snippet(text: str, start: int, end: int) -> str:
    stop = text.find("\n", end)
    line = text[text.rfind("\n", 0, start) + 1 : stop if stop >= 0 else len(text)].strip()
    return line if len(line) <= 120 else line[:117] + "..."


def findings_of(path: str, text: str) -> list[tuple]:
    """Findings of one file, by line and rule; test files and minified scripts have none."""
    if fixture_file(path) or (path.lower().endswith(".js") and max(map(len, text.split("\n"))) >= MINIFIED_LINE):
        return []
    hits = [("hardcoded-secret", "error", f"hardcoded secret: {label}", m, label) for label, p in SECRETS for m in p.finditer(text)]
    hits += [(rule, severity, message, m, "") for rule, severity, message, p in COMPILED for m in p.finditer(text)]
    hits = [h for h in hits if not suppressed(h[0], h[4], text, h[3].start(), h[3].end())]
    if config_file(path):
        hits += [(rule, severity, message, m, "") for rule, severity, message, p in COMPILED_CONFIG for m in p.finditer(text)]
    rows = [(path, text.count("\n", 0, m.start()) + 1, rule, severity, message, snippet(text, m.start(), m.end())) for rule, severity, message, m, _ in hits]
    return sorted(rows, key=lambda r: (r[1], r[2], r[4]))


def scan_files(files: DataFrame) -> DataFrame:
    """Rows of FINDING for files (path, text)."""

    def run(batches):
        for part in batches:
            rows = [r for path, text in zip(part["path"], part["text"], strict=True) for r in findings_of(path, text or "")]
            yield pd.DataFrame(rows, columns=["file", "line", "rule", "severity", "message", "snippet"])

    return files.select("path", "text").mapInPandas(run, FINDING)


def by_severity(findings: DataFrame, allowed: list[str]) -> DataFrame:
    """The findings of the given severities; all where none is given."""
    names = [s.strip().lower() for s in allowed]
    return findings.where(F.col("severity").isin(names)) if names else findings


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))
