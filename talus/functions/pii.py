"""Masking of secrets and personal data, with a pass over encoded runs, and its inverse."""

from __future__ import annotations

import base64
import binascii
import ipaddress
import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels and their patterns, in order.
PATTERNS = (
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("AWS", r"\bAKIA[0-9A-Z]{16}\b"),
    ("AWS_SECRET", r"""\b(?:aws_)?secret(?:_access_key)?\s*[=:]\s*["']?[A-Za-z0-9/+=]{40}["']?"""),
    ("GITHUB", r"\bgh[pousr]_[A-Za-z0-9]{30,}\b"),
    ("GITHUB_PAT", r"\bgithub_pat_[A-Za-z0-9_]{60,}\b"),
    ("SLACK", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("STRIPE", r"\bsk_(?:live|test)_[A-Za-z0-9]{20,}\b"),
    ("OPENAI", r"\bsk-(?:proj-[A-Za-z0-9-]{20,}|[A-Za-z0-9]{20,})\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("BEARER", r"\bBearer\s+[A-Za-z0-9._~+/=-]{20,}\b"),
    ("KEY", r"""(?i)\b(?:api[_-]?key|apikey|auth[_-]?token|access[_-]?token|refresh[_-]?token|client[_-]?secret|private[_-]?key|app[_-]?secret|consumer[_-]?(?:key|secret))["']?\s*[=:]\s*["']?(?:[A-Za-z0-9_/\-+=]{12,}["']|[A-Za-z0-9_/\-+=]*[0-9][A-Za-z0-9_/\-+=]*)"""),
    ("PASSWORD", r"""(?i)\b(?:password|passwd|pwd)["']?\s*[=:]\s*["']?(?:[A-Za-z0-9_/\-+=@!]{6,}["']|[A-Za-z0-9_/\-+=@!]*[0-9][A-Za-z0-9_/\-+=@!]*)"""),
    ("TOKEN", r"""(?i)\b(?:token|secret)["']?\s*[=:]\s*["']?(?:[A-Za-z0-9_/\-+=]{16,}["']|[A-Za-z0-9_/\-+=]*[0-9][A-Za-z0-9_/\-+=]*)"""),
    ("URL_CRED", r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s:@]+:[^/\s@]+@"),
    ("IP", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("IPV6", r"(?i)\b(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6}::[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6}|::[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6}|[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){1,6}::)\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"),
    ("PHONE", r"(?:\+\d{1,3}[\s.-]?|\d{1,3}[\s.-])?\d{3}[\s.-]?\d{3}[\s.-]?\d{3,4}\b"),
    ("PHONE", r"\(\d{2,4}\)[\s.-]?\d{3}[\s.-]?\d{4}\b"),
    ("PHONE", r"(?:\+\d{1,3}[\s.-]?|\d{1,3}[\s.-])?\d{5}[\s.-]?\d{5}\b"),
    ("PHONE", r"\b0\d{2}\s\d{4}\s\d{4}\b"),
    ("PHONE", r"\b0\d{4}\s\d{6}\b"),
    ("PHONE", r"\+\d{1,3}\s?\d{2}\s\d{4}\s\d{4}\b"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
)
# Kinds of encoded runs and their patterns.
ENCODED = (
    ("B64", r"[A-Za-z0-9+/]{20,}={0,2}"),
    ("HEX", r"[0-9a-fA-F]{32,}"),
    ("PCT", r"(?:%[0-9a-fA-F]{2}){8,}"),
    ("UNI", r"(?:(?:\\u[0-9a-fA-F]{4}){4,}|(?:\\x[0-9a-fA-F]{2}){8,})"),
)
# Networks whose addresses are no secrets.
COMMON_NETS = [ipaddress.ip_network(n) for n in ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/32", "::1/128", "::/128", "fc00::/7", "fe80::/10", "ff00::/8")]
RULES = [(label, re.compile(p, re.ASCII)) for label, p in PATTERNS]
RUNS = [(kind, re.compile(p)) for kind, p in ENCODED]
LABELS = tuple(dict.fromkeys(label for label, _ in PATTERNS))


def version_like(text: str) -> bool:
    """Digits and dots, a digit first: what follows the sign in package@1.2.3."""
    return text[:1].isdigit() and text.isascii() and text.replace(".", "").isdigit()


def common_address(text: str) -> bool:
    """Not an address at all, or one of a loopback, private, link-local or multicast net."""
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return True
    return any(address in net for net in COMMON_NETS if net.version == address.version)


def exempt(label: str, text: str, start: int, end: int) -> bool:
    """Whether a match is none: a common address, a package version, or the rest of a number."""
    hit = text[start:end]
    if label in ("IP", "IPV6"):
        return common_address(hit)
    if label == "EMAIL":
        return version_like(hit[hit.index("@") + 1 :])
    return label == "PHONE" and start > 0 and text[start - 1] in "0123456789"


def decoded(kind: str, run: str) -> str | None:
    try:
        if kind == "B64":
            data = base64.b64decode(run, validate=True)
        elif kind == "HEX":
            data = bytes.fromhex(run)
        elif kind == "PCT":
            data = unquote_to_bytes(run)
        else:
            return re.sub(r"\\u(....)|\\x(..)", lambda m: chr(int(m[1] or m[2], 16)), run)
    except (ValueError, binascii.Error):
        return None
    return data.decode("utf-8", "replace")


def disjoint(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The leftmost, and of those the longest, without overlaps."""
    out, last = [], 0
    for start, end, label in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= last or not out:
            out.append((start, end, label))
            last = end
    return out


def replaced(text: str, hits: list[tuple[int, int, str]], names: dict[str, str]) -> str:
    """The text with numbered placeholders, which ``names`` learns."""
    count: dict[str, int] = {}
    parts, at = [], 0
    for start, end, label in hits:
        count[label] = count.get(label, 0) + 1
        name = f"[MASKED_{label}_{count[label]}]"
        names[name] = text[start:end]
        parts += [text[at:start], name]
        at = end
    return "".join([*parts, text[at:]])


def mask_text(text: str, people: tuple[str, ...] = ()) -> tuple[str, dict[str, str], dict[str, int]]:
    """(masked text, placeholder -> value, label -> count). Encoded runs that hold a secret go first,
    then all labels and the given names."""
    names: dict[str, str] = {}
    runs = []
    for kind, pattern in RUNS:
        for m in pattern.finditer(text):
            inner = decoded(kind, m[0])
            if inner is not None and any(p.search(inner) for _, p in RULES):
                runs.append((m.start(), m.end(), kind))
    text = replaced(text, disjoint(runs), names)
    hits = [(m.start(), m.end(), label) for label, p in RULES for m in p.finditer(text) if not exempt(label, text, m.start(), m.end())]
    for person in filter(None, people):
        hits += [(m.start(), m.end(), "NAME") for m in re.finditer(rf"(?i)\b{re.escape(person)}\b", text, re.ASCII)]
    out = replaced(text, disjoint(hits), names)
    count: dict[str, int] = {}
    for name in names:
        label = re.match(r"\[MASKED_(.+)_\d+\]$", name)[1]
        count[label] = count.get(label, 0) + 1
    return out, names, count


def unmask_text(text: str, names: dict[str, str]) -> str:
    return re.sub(r"\[MASKED_[A-Z0-9_]+_\d+\]", lambda m: names.get(m[0], m[0]), text)


MASKED = T.StructType().add("masked", "string").add("names", T.MapType(T.StringType(), T.StringType())).add("labels", T.MapType(T.StringType(), T.LongType()))


def mask(column: str | Column, people: tuple[str, ...] = ()) -> Column:
    """struct(masked, names, labels) of a text column."""

    @F.pandas_udf(MASKED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mask_text(t or "", people) for t in texts], columns=["masked", "names", "labels"])

    return run(column)


def unmask(column: Column, names: Column) -> Column:
    """The text with every placeholder's value put back; no Python runs in it."""
    return F.aggregate(F.map_entries(names), column, lambda text, e: F.replace(text, e["key"], e["value"]))
