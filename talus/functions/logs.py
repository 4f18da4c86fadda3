"""Log and command output reduction as columns; budget fit and chunking, which are loops over a text's lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions.text import let, token_estimate

# Line patterns of log reduction.
TIMESTAMP = r"(?i)(^\s*\[?(([\d]{2,4}[-/:][\d]{2}[-/:][\d]{2,4}[ T])?[\d]{2}:[\d]{2}(:[\d]{2}([\.,]\d+)?)?(Z|[+-][\d:]{2,5})?)\]?\s*)"
CALM = r"(?i)(^\s*(INFO|DEBUG|TRACE|VERBOSE|NOTICE)\s*[:=#]?\s*)"
LOUD = r"(?i)(^\s*(WARN|WARNING|ERROR|ERR|FAIL|FATAL|CRITICAL|SEVERE|PANIC|EXCEPTION)\s*[:=#]?\s*)"
FRAME = r"^\s*(at |from |\.go:\d+|\.py:\d+|\.java:\d+|\d+\) )"
BROKEN = r"(?i)(error|failed|failure|undefined|unresolved|exception|cannot find|no such)"
RULER = r"^\s*([-=_#*]{3,}|\.{3,}|[<>]{3,})\s*$"
CHATTER = "heartbeat|keepalive|polling"
# Words and frames of lines that a budget keeps, and its sizes.
KEPT_WORDS = ("error", "fail", "panic", "exception", "traceback", "stack trace", "warning", "warn", "uncaught", "timeout", "denied", "not found")
CALL_FRAME = re.compile(r"[a-zA-Z_][\w./\-]*\([^)]*(?:\b[\w./\-]+\.go|\.py|\.js|\.ts|\.rb|\.java|\.c|\.cpp):0*[1-9]\d*")
HEAD, KEPT_MOST = 20, 60
KEPT_MARK = "… (kept important lines) …"
# Command output.
COMMAND_NOISE = r"^(\[info\]|\[debug\]|downloading|progress)"
COMMAND_WORDS = "error|fail|warn"
COMMAND_HEAD, COMMAND_MOST = 60, 120
#: Characters a token, by kind of text.
RATES = {"generic": 4.0, "code": 3.5, "log": 3.2}


def count_tokens(text: str, kind: str = "generic") -> int:
    """Bytes of the fields and their number, over the rate; at least 1; 0 for the empty text."""
    fields = text.split()
    return max(1, int((sum(len(f.encode()) for f in fields) + len(fields)) / RATES[kind])) if text else 0


def useful(line: Column) -> Column:
    """Lines that name files, modules or values, or are long; heartbeats are not."""
    size = F.octet_length(line)
    return (size > 200) | (~F.lower(line).rlike(CHATTER) & (line.rlike(r"[=:{}\[\]/]") | (size > 40)))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def compress_log(column: str | Column, most: int = 200) -> Column:
    """Timestamps off; rulers, calm levels, chatter and repeats out; one blank line where there were some. Null is empty.

    Repeats are neighbours once the lines are sorted by what they say; sorted by place again, a blank line counts
    where it stands before a line that stays. Both sorts are of one text's lines, in the row."""
    text = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    loud = lambda x: x.rlike(FRAME) | x.rlike(LOUD) | x.rlike(BROKEN)
    stays = lambda x: ~x.rlike(RULER) & ((useful(x) & ~x.rlike(CALM)) | loud(x))
    bare = F.transform(F.split(text, "\n"), lambda x, k: F.struct(F.regexp_replace(x, TIMESTAMP, "").alias("bare"), k.alias("at")))
    said = F.transform(bare, lambda x: F.struct(stripped(x["bare"]).alias("key"), x["at"].alias("at"), F.rtrim(x["bare"], F.lit(" \t")).alias("bare")))
    said = F.filter(said, lambda x: (x["key"] == "") | stays(x["key"]))
    first = let(F.array_sort(said), lambda s: F.filter(s, lambda x, k: (x["key"] == "") | (k == 0) | (s[F.greatest(k - 1, F.lit(0))]["key"] != x["key"])))
    placed = F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key"), x["bare"].alias("bare"))))
    gap = lambda s, k: (k > 0) & (s[F.greatest(k - 1, F.lit(0))]["key"] == "")
    parts = let(placed, lambda s: F.filter(F.transform(s, lambda x, k: F.when(x["key"] != "", F.concat(F.when(gap(s, k), "\n").otherwise(""), x["bare"]))), lambda x: x.isNotNull()))
    out = F.split(F.regexp_replace(F.array_join(parts, "\n"), r"\A\n", ""), "\n")
    # a blank line never ends the result
    return let(out, lambda o: F.array_join(F.slice(o, 1, F.when(F.get(o, F.lit(most - 1)) == "", most + 1).otherwise(most)), "\n"))


def compact_output(column: str | Column) -> Column:
    """Command output: the first lines, later ones only where they tell of trouble. Null is empty."""
    text = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    bare = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: (x != "") & ~F.lower(x).rlike(COMMAND_NOISE))
    told = F.filter(bare, lambda x, k: (k < COMMAND_HEAD) | F.lower(x).rlike(COMMAND_WORDS))
    return F.array_join(F.slice(told, 1, COMMAND_MOST), "\n")


def important(line: str) -> bool:
    low = line.lower()
    indented = line[:1] in ("\t", " ") and ("File " in line or "line " in line or CALL_FRAME.search(line))
    return len(low.encode()) > 120 or bool(indented) or any(w in low for w in KEPT_WORDS)


def fit_budget(text: str, tokens: int) -> str:
    """At most ``tokens`` tokens: repeats out, the head and important lines kept, then cut
    from the head's end, from the important lines' end, and at last inside the one line left."""
    if not text or tokens <= 0:
        return ""
    if count_tokens(text) <= tokens:
        return text
    kept: list[str] = []
    seen: set[str] = set()
    for line in text.split("\n"):
        key = line.strip()
        if (not key and not seen) or (key in seen and kept):
            continue
        seen.add(key)
        kept.append(line)
    core, rest = kept[:HEAD], [x for x in kept[HEAD:] if important(x)][:KEPT_MOST]
    whole = lambda: "\n".join(core + ([KEPT_MARK, *rest] if rest else []))
    while count_tokens(whole()) > tokens:
        if len(core) > 1:
            core.pop()
        elif rest:
            rest.pop()
        else:
            break
    out = whole().strip() or (kept[0].strip() if kept else "")
    while (n := count_tokens(out)) > tokens:
        data = out.encode()
        out = data[: min(len(data) * tokens // n, len(data) - 1)].decode("utf-8", "ignore")
    return out


def chunk_text(text: str, most: int = 2000, least: int = 40) -> list[tuple[int, str]]:
    """(first line, chunk): whole lines up to ``most`` bytes, blank lines between paragraphs kept
    as one; longer lines cut at ``most``; chunks under ``least`` bytes go."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    start, size = 1, 0

    def flush() -> None:
        nonlocal size
        if size >= least:
            out.append((start, "\n".join(held)))
        held.clear()
        size = 0

    for k, line in enumerate(text.split("\n"), 1):
        n, blank = len(line.encode()), not line.strip()
        if size and size + n + (2 if blank else 1) > most:
            flush()
            start = k
        if blank:
            if size:
                held.append("")
                size += 1
            else:
                start = k + 1
        elif n >= most:
            if size:
                flush()
            data = line.encode()
            pieces = (data[a : a + most] for a in range(0, n, most))
            out += [(k, p.decode("utf-8", "ignore")) for p in pieces if len(p) >= least]
            start = k
        else:
            held.append(line)
            size += n + 1
    flush()
    return out


def _text_udf(function):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(function)

    return run


def budget_fit(column: str | Column, tokens: int) -> Column:
    return _text_udf(lambda t: fit_budget(t, tokens))(column)


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("text", T.StringType())))
def chunks(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(chunk_text)


def ledger(before: Column, after: Column, kind: str = "generic") -> list[Column]:
    """before_tokens, after_tokens, saved_tokens, saved_percent of a reduction."""
    a, b = token_estimate(before, RATES[kind]), token_estimate(after, RATES[kind])
    percent = F.when(a > 0, 100.0 * (a - b) / a).otherwise(0.0)
    return [a.alias("before_tokens"), b.alias("after_tokens"), (a - b).alias("saved_tokens"), F.round(percent, 4).alias("saved_percent")]
