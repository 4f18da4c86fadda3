"""Symbols, calls, inheritance, imports and entry points of source files (path, content, lang).

One scanner serves all languages: strings and comments are blanked out over the whole file, then
declarations are matched line by line and their bodies found by indentation or by braces. A
file is one unit of work, so scanning runs as Arrow batches; all that joins files is in
``talus.operators.symbols``. Go is read by the same kind of patterns, with the types of
receivers, parameters and plain literals standing for their variables in calls.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = (
    "rec string, file string, lang string, kind string, name string, receiver string, line int, end int, "
    "entry boolean, framework string, route string, params string, doc string"
)
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
NAME = r"[A-Za-z_$][\w$]*"
MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|readonly|virtual|override|async|synchronized|native|default|new|extern|export|inline|constexpr)\s+)*"
# Declarations by language: (kind, pattern with groups 'name' and perhaps 'recv').
SCRIPT = (
    ("class", rf"(?:^|[\s;])(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>{NAME})"),
    ("interface", rf"(?:^|[\s;])(?:export\s+)?interface\s+(?P<name>{NAME})"),
    ("enum", rf"(?:^|[\s;])(?:export\s+)?enum\s+(?P<name>{NAME})"),
    ("type", rf"(?:^|[\s;])(?:export\s+)?type\s+(?P<name>{NAME})\s*(?:<[^>]*>)?\s*="),
    ("func", rf"(?:^|[\s;])(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*=\s*(?:async\s+)?(?:\(|function\b|{NAME}\s*=>)"),
    ("func", rf"(?:^|[\s;])(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>{NAME})\s*(?:<[^>]*>)?\s*\("),
    ("method", rf"^\s*(?:(?:get|set|static|async|public|private|protected)\s+)*#?(?P<name>{NAME})\s*(?:<[^>]*>)?\s*\(.*\)\s*(?::[^{{}}]*)?\{{"),
    ("const", rf"(?:^|[\s;])(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*="),
)
FAMILY_C = (
    ("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>[A-Za-z_]\w*)"),
    ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>[A-Za-z_]\w*)"),
    ("union", r"^\s*(?:typedef\s+)?union\s+(?P<name>[A-Za-z_]\w*)"),
    ("class", r"^\s*class\s+(?P<name>[A-Za-z_]\w*)"),
    ("method", rf"^\s*{MODS}(?:[A-Za-z_][\w<>&*:\s]*[\s&*])?(?P<recv>[A-Za-z_]\w*)::(?P<name>~?[A-Za-z_]\w*)\s*\([^;]*$"),
    ("func", rf"^\s*{MODS}[A-Za-z_][\w<>&*:\s]*[\s&*](?P<name>[A-Za-z_]\w*)\s*\([^;]*$"),
)
DECLARATIONS = {
    "go": (
        ("method", r"^func\s+\(\s*(?P<var>\w*)\s*\*?(?P<recv>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)\s*[\[(]"),
        ("func", r"^func\s+(?P<name>\w+)\s*[\[(]"),
        ("struct", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("type", r"^type\s+(?P<name>\w+)\b"),
        ("const", r"^const\s+(?P<name>\w+)\b"),
        ("var", r"^var\s+(?P<name>\w+)\b"),
    ),
    "javascript": SCRIPT,
    "typescript": SCRIPT,
    "python": (("class", r"^\s*class\s+(?P<name>[A-Za-z_]\w*)"), ("func", r"^\s*(?:async\s+)?def\s+(?P<name>[A-Za-z_]\w*)\s*\(")),
    "rust": (
        ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>[A-Za-z_]\w*)"),
        ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>[A-Za-z_]\w*)"),
        ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>[A-Za-z_]\w*)"),
        ("impl", r"^\s*impl\s*(?:<[^>]*>\s*)?(?:[\w:<>]+\s+for\s+)?(?P<name>[A-Za-z_]\w*)"),
        ("type", r"^\s*(?:pub\s+)?type\s+(?P<name>[A-Za-z_]\w*)\s*="),
        ("const", r"^\s*(?:pub\s+)?const\s+(?P<name>[A-Za-z_]\w*)\s*:"),
        ("func", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>[A-Za-z_]\w*)\s*(?:<[^>]*>\s*)?\("),
    ),
    "c": FAMILY_C,
    "cpp": FAMILY_C,
    "java": (
        ("class", rf"^\s*{MODS}class\s+(?P<name>[A-Za-z_]\w*)"),
        ("interface", rf"^\s*{MODS}@?interface\s+(?P<name>[A-Za-z_]\w*)"),
        ("enum", rf"^\s*{MODS}enum\s+(?P<name>[A-Za-z_]\w*)"),
        ("record", rf"^\s*{MODS}record\s+(?P<name>[A-Za-z_]\w*)"),
        ("method", rf"^\s*{MODS}(?:<[^>]*>\s*)?[A-Za-z_][\w<>\[\].,?\s]*\s+(?P<name>[A-Za-z_]\w*)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?[{{;]?\s*$"),
        ("method", r"^\s*(?:public|private|protected)\s+(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{"),
    ),
    "csharp": (
        ("class", rf"^\s*{MODS}(?:class|interface|record|struct|enum)\s+(?P<name>[A-Za-z_]\w*)"),
        ("prop", rf"^\s*{MODS}[A-Za-z_][\w<>?\[\],.\s]*\s+(?P<name>[A-Za-z_]\w*)\s*\{{\s*(?:get|set|init)"),
        ("method", rf"^\s*{MODS}[A-Za-z_][\w<>?\[\],.\s]*\s+(?P<name>[A-Za-z_]\w*)\s*\([^;{{}}]*\)\s*\{{?\s*$"),
    ),
    "ruby": (
        ("class", r"^\s*class\s+(?P<name>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)"),
        ("module", r"^\s*module\s+(?P<name>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)"),
        ("func", r"^\s*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[!?=]?)"),
    ),
    "php": (
        ("class", rf"^\s*{MODS}class\s+(?P<name>[A-Za-z_]\w*)"),
        ("interface", r"^\s*interface\s+(?P<name>[A-Za-z_]\w*)"),
        ("trait", r"^\s*trait\s+(?P<name>[A-Za-z_]\w*)"),
        ("enum", r"^\s*enum\s+(?P<name>[A-Za-z_]\w*)"),
        ("func", rf"^\s*{MODS}function\s+&?(?P<name>[A-Za-z_]\w*)\s*\("),
        ("const", r"^\s*const\s+(?P<name>[A-Za-z_]\w*)\s*="),
    ),
    "shell": (("func", r"^\s*(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\)\s*\{"), ("func", r"^\s*function\s+(?P<name>[A-Za-z_][\w-]*)\s*\{")),
    "css": (("class", r"^\s*\.(?P<name>[A-Za-z_][\w-]*)"), ("const", r"^\s*#(?P<name>[A-Za-z_][\w-]*)"), ("func", r"^\s*@keyframes\s+(?P<name>[A-Za-z_][\w-]*)"), ("prop", r"(?P<name>--[A-Za-z_][\w-]*)\s*:")),
    "html": (("const", r'\bid="(?P<name>[A-Za-z_][\w-]*)"'),),
    "markdown": (("heading", r"^#{1,6}\s+(?P<name>.+?)\s*$"),),
    "json": (("prop", r'"(?P<name>[A-Za-z_$][\w$.-]*)"\s*:'),),
    "yaml": (("prop", r"^(?P<name>[A-Za-z_][\w-]*):"),),
}
TYPE_KINDS = {"class", "interface", "enum", "trait", "module", "impl", "union", "struct", "record"}
DEF_KINDS = {"func", "method"}
# Words before a parenthesis that call nothing, and those that name no declaration.
WORDS = frozenset("""if else for while switch case return catch try do new typeof instanceof sizeof def func function fn class struct
interface enum and or not in is lambda with elif except raise yield await async import from print defer go select range make
len cap append panic recover copy delete unless until begin end puts require include echo isset foreach
match let var const static public private protected super this self throw throws assert match loop where use mod impl
then fi done esac function local export""".split())
CONTROL = frozenset("if else for while switch case return catch typeof sizeof throw await with function".split())
BLOCKS = {"html": r"<!--.*?(?:-->|\Z)", "markdown": r"<!--.*?(?:-->|\Z)"}
LINE_COMMENTS = {
    "python": ("#",), "ruby": ("#",), "shell": ("#",), "yaml": ("#",), "php": ("//", "#"), "css": (), "html": (), "markdown": (),
}
INDENTED = {"python", "ruby", "yaml"}
CALL = re.compile(rf"(?<![\w$])(?P<whole>{NAME}(?:\.{NAME})*)\s*\(")
# Clauses that name bases, by language.
BASES = {
    "java": (("extends", r"\bextends\s+([\w.]+)"), ("implements", r"\bimplements\s+([\w.,<>\s]+?)\s*(?:\{|$)")),
    "typescript": (("extends", r"\bextends\s+([\w.]+)"), ("implements", r"\bimplements\s+([\w.,<>\s]+?)\s*(?:\{|$)")),
    "javascript": (("extends", r"\bextends\s+([\w.]+)"),),
    "python": (("extends", r"^\s*class\s+\w+\s*\(([^)]+)\)"),),
    "ruby": (("extends", r"^\s*class\s+[\w:]+\s*<\s*([\w:]+)"),),
    "csharp": (("extends", r":\s*([\w.,<>\s]+?)\s*(?:\{|$)"),),
    "php": (("extends", r"\bextends\s+([\w\\]+)"), ("implements", r"\bimplements\s+([\w,\\\s]+?)\s*(?:\{|$)")),
}
# Imports by language.
IMPORTS = {
    "go": r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$',
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "javascript": r"""(?:\bfrom\s+|\bimport\s+|\brequire\(\s*)["']([^"']+)["']""",
    "typescript": r"""(?:\bfrom\s+|\bimport\s+|\brequire\(\s*)["']([^"']+)["']""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "csharp": r"^\s*using\s+([\w.]+)\s*;",
    "rust": r"^\s*use\s+([\w:]+)",
    "php": r"^\s*use\s+([\w\\]+)",
    "ruby": r"""^\s*require(?:_relative)?\s+["']([^"']+)["']""",
}


@dataclass(frozen=True)
class Entry:
    """A framework's mark of an entry point. Groups: route, name (a route's last part), handler."""

    framework: str
    pattern: str
    files: str = ""
    base: bool = False  # before a type: a prefix of its routes
    mark: bool = False  # before a type: the type is an entry point
    default: str = ""
    paths: bool = False  # the route must look like a path


VERBS = "get|post|put|patch|delete|head|options|all|use"
SCRIPT_ENTRIES = (
    Entry("js-router", rf"""\.(?:{VERBS})\s*\(\s*["'](?P<route>[^"']*)["'](?:\s*,\s*(?P<handler>{NAME}(?:\.{NAME})*))?""", paths=True),
    Entry("nestjs", r"""@(?:Get|Post|Put|Patch|Delete|Options|Head|All)\s*\(\s*(?:["'](?P<route>[^"')]*)["'])?\s*\)"""),
    Entry("nestjs", r"""@Controller\s*\(\s*(?:["'](?P<route>[^"')]*)["'])?\s*\)""", base=True),
)
# Entry points by language.
ENTRIES = {
    "java": (
        Entry("spring-mvc", r'@(?:Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*"(?P<route>[^"]*)"', base=True),
        Entry("spring-mvc", r"@(?:Get|Post|Put|Delete|Patch)Mapping\b", base=True),
        Entry("spring-mvc", r"@(?:RestController|Controller)\b", mark=True),
        Entry("spring-boot", r"@SpringBootApplication\b", mark=True),
        Entry("spring-service", r"@Service\b", mark=True),
        Entry("spring-repository", r"@Repository\b", mark=True),
        Entry("spring-config", r"@Configuration\b", mark=True),
        Entry("spring-component", r"@Component\b", mark=True),
        Entry("jakarta-ee", r'@Path\s*\(\s*"(?P<route>[^"]*)"\s*\)', base=True),
        Entry("jakarta-ee", r"@(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"),
    ),
    "python": (
        Entry("python-http", r"""@(?:app|application|blueprint|bp)\s*\.\s*[a-z_]+\s*\(\s*["'](?P<route>[^"']+)["']"""),
        Entry("fastapi", r"""@(?:router|routers|api|auth|users|items)\s*\.\s*(?:get|post|put|patch|delete|websocket)\s*\(\s*["'](?P<route>[^"']+)["']"""),
        Entry("celery", r"@(?:app|shared_task)\s*\.?\s*task\b"),
        Entry("django", r"""\b(?:path|re_path|url)\s*\(\s*["'](?P<route>[^"']+)["']\s*,\s*(?P<handler>[A-Za-z_][\w.]*)""", files="urls.py"),
    ),
    "javascript": SCRIPT_ENTRIES,
    "typescript": SCRIPT_ENTRIES,
    "ruby": (
        Entry("rails", r"""\b(?:get|post|put|patch|delete|match)\s+["'](?P<route>[^"']+)["']\s*,\s*to:\s*["'](?P<handler>[A-Za-z_]\w*#[A-Za-z_]\w*)["']""", files="routes.rb"),
        Entry("rails", r"""\broot\s+["'](?P<handler>[A-Za-z_]\w*#[A-Za-z_]\w*)["']""", files="routes.rb", default="/"),
        Entry("rails", r"\b(?:resources|resource)\s+:(?P<name>[a-z_]\w*)", files="routes.rb"),
    ),
    "php": (Entry("laravel", r"""Route::(?:get|post|put|patch|delete|any|match)\s*\(\s*["'](?P<route>[^"']*)["']\s*,\s*(?P<handler>[^)]+)"""),),
    "go": (
        Entry("net-http", rf'\b\w+\.Handle(?:Func)?\(\s*"(?P<route>[^"]*)"(?:\s*,\s*(?P<handler>{NAME}(?:\.{NAME})*))?', paths=True),
        Entry("http-route", rf'\b\w+\.(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\(\s*"(?P<route>[^"]*)"(?:\s*,\s*(?P<handler>{NAME}(?:\.{NAME})*))?', paths=True),
    ),
}


@dataclass
class Spec:
    lang: str
    rules: list = field(default_factory=list)
    entries: list = field(default_factory=list)
    noise: re.Pattern | None = None


def spec_of(lang: str) -> Spec:
    text = lang not in ("markdown", "html")
    parts = ['(?:"""(?:.*?)(?:"""|\\Z))', "(?:'''(?:.*?)(?:'''|\\Z))"] if lang == "python" else []
    if lang == "ruby":
        parts.append(r"(?:(?<![\w)])<<[-~]?(?P<term>[A-Z_]\w*)[^\n]*\n.*?^\s*(?P=term)\s*$)")
    parts.append(BLOCKS.get(lang, r"/\*.*?(?:\*/|\Z)" if lang not in INDENTED | {"shell"} else r"(?!)"))
    parts += [re.escape(c) + r"[^\n]*" for c in LINE_COMMENTS.get(lang, ("//",))]
    if text:
        parts.append(r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)')
        parts.append(r"'(?:\\.|[^'\\\n])'" if lang == "rust" else r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)")
    if lang in ("javascript", "typescript", "go"):
        parts.append(r"`[^`]*(?:`|\Z)")
    rules = [(kind, re.compile(p)) for kind, p in DECLARATIONS.get(lang, ())]
    entries = [(e, re.compile(e.pattern)) for e in ENTRIES.get(lang, ())]
    return Spec(lang, rules, entries, re.compile("|".join(parts), re.S | re.M))


SPECS = {lang: spec_of(lang) for lang in DECLARATIONS}


def cleaned(text: str, spec: Spec) -> str:
    """The text with comments and strings blanked; line ends stay."""
    return spec.noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def body_ends(clean: list[str], raw: list[str], indented: bool) -> list[int]:
    """For each line the line behind the body that it may open (0-based, exclusive)."""
    n = len(clean)
    ends = [k + 1 for k in range(n)]
    if indented:
        open_: list[tuple[int, int]] = []
        last = 0
        for k, line in enumerate(clean):
            if not line.strip():
                continue
            depth = len(raw[k]) - len(raw[k].lstrip(" \t"))
            while open_ and open_[-1][1] >= depth:
                ends[open_.pop()[0]] = k
            open_.append((k, depth))
            last = k + 1
        for k, _ in open_:
            ends[k] = last
        return ends
    before, after, depth = [], [], 0
    for line in clean:
        before.append(depth)
        depth += line.count("{") - line.count("}")
        after.append(depth)
    for k in range(n):
        base, started = before[k], after[k] > before[k]
        if not started and "{" in clean[k]:
            continue  # opened and closed on the line
        for j in range(k + 1, min(n, k + 4) if not started else n):
            if not started:
                if ";" in clean[j - 1] or "}" in clean[j]:
                    break
                if after[j] > base:
                    started = True
                    break
        if started:
            ends[k] = next((j + 1 for j in range(k + 1, n) if after[j] <= base and j > k and (after[k] > base or any(after[i] > base for i in range(k, j)))), n)
    return ends


def routed(base: str, route: str) -> str:
    """Two parts of a route joined by single slashes; empty only when both are."""
    parts = [p.strip("/") for p in (base, route)]
    joined = "/".join(p for p in parts if p)
    return "/" + joined if joined or base or route else ""


def handler_name(text: str) -> str:
    """The bare method that a route's target names: Ctrl@index, [Ctrl::class, 'show'], views.index."""
    quoted = re.search(r"""['"]([^'"]*)['"]""", text)
    text = (quoted[1] if quoted else text).split("@")[-1].split("::class")[0]
    words = re.findall(NAME, text)
    return words[-1] if words else text.strip()


def go_types(line: str, known: dict[str, str]) -> None:
    """Learns variable -> type from parameters and plain literals."""
    for m in re.finditer(r"(?:^|[(,\s])(\w+)\s+\*?([A-Z]\w*)(?=[,)\s]|$)", line):
        known.setdefault(m[1], m[2])
    for m in re.finditer(r"(\w+)\s*:?=\s*&?([A-Z]\w*)\{", line):
        known[m[1]] = m[2]


def scan_file(path: str, content: str, lang: str) -> list[tuple]:
    """Rows of RECORD: symbols, calls (name -> receiver column holds the callee), inheritance
    (kind extends, implements or embeds; receiver is the base) and imports."""
    spec = SPECS.get(lang)
    if spec is None or not content.strip():
        return []
    raw = content.split("\n")
    clean = cleaned(content, spec).split("\n")
    ends = body_ends(clean, raw, lang in INDENTED)
    symbols: list[dict] = []
    types: list[tuple[str, int, int]] = []
    edges: dict[tuple, None] = {}

    def enclosing(k: int) -> str:
        return next((name for name, a, b in reversed(types) if a < k < b), "")

    def declared(k: int) -> tuple[str, re.Match] | None:
        line = raw[k] if lang in ("markdown", "json", "html", "yaml", "css") else (raw[k] if clean[k].strip() else "")
        for kind, p in spec.rules:
            m = p.search(line)
            if m and m["name"] not in CONTROL:
                return kind, m
        return None

    for k, line in enumerate(clean):
        if not line.strip():
            continue
        if lang in IMPORTS:
            for m in re.finditer(IMPORTS[lang], raw[k]):
                edges.setdefault(("import", "", next(filter(None, m.groups()), ""), k + 1))
        found = declared(k)
        if found is None:
            continue
        kind, m = found
        name, recv = m["name"], (m.groupdict().get("recv") or "")
        if kind in DEF_KINDS and not recv:
            recv = enclosing(k)
            kind = "method" if recv else "func"
        end = ends[k] if kind in DEF_KINDS | TYPE_KINDS else k + 1
        doc = []
        for j in range(k - 1, -1, -1):  # the comment right above
            if raw[j].strip() and not clean[j].strip():
                doc.append(raw[j].strip().lstrip("/#* ").rstrip("*/ "))
            else:
                break
        params = re.search(r"\(([^()]*)\)", raw[k][m.end("name") :] if kind in DEF_KINDS else "")
        symbols.append({"kind": kind, "name": name, "receiver": recv, "line": k + 1, "end": end, "params": params[1] if params else "", "doc": "\n".join(reversed([d for d in doc if d]))})
        if kind in TYPE_KINDS:
            types.append((name, k, max(end, k + 1)))
            header = " ".join(clean[k : min(end, k + 6)]).split("{")[0] + "{"
            for edge, p in BASES.get(lang, ()):
                b = re.search(p, header)
                for base in (re.sub(r"<[^>]*>", "", b[1]).split(",") if b else ()):
                    if base.strip() and base.strip() != "object":
                        edges.setdefault(("inherit:" + edge, name, re.split(r"[.\\]|::", base.strip())[-1], k + 1))
            if lang == "go":
                for j in range(k + 1, end):
                    e = re.match(r"^\s+\*?(?:\w+\.)?([A-Z]\w*)\s*$", clean[j])
                    if e:
                        edges.setdefault(("inherit:embeds", name, e[1], j + 1))
        elif kind in DEF_KINDS:
            owner = f"{recv}.{name}" if recv else name
            known: dict[str, str] = {}
            if lang == "go":
                if m.groupdict().get("var"):
                    known[m["var"]] = recv
                go_types(line[m.end("name") :], known)
            for j in range(k, max(end, k + 1)):
                if j > k and clean[j].lstrip().startswith("@"):
                    continue
                if lang == "go" and j > k:
                    go_types(clean[j], known) if ":=" in clean[j] or "=" in clean[j] else None
                part = clean[j][m.end("name") :] if j == k else clean[j]
                for c in CALL.finditer(part):
                    callee = c["whole"]
                    first, _, rest = callee.partition(".")
                    if first in ("self", "this", "super") and rest and recv:
                        callee = f"{recv}.{rest}" if "." not in rest else rest
                    elif first in known and rest and "." not in rest:
                        callee = f"{known[first]}.{rest}"
                    if callee not in WORDS and callee != owner and (first not in WORDS or first in ("self", "this", "super")):
                        edges.setdefault(("call", owner, callee[:80], j + 1))
    extra = entries_of(path, raw, clean, spec, symbols, enclosing, declared)
    blank = {"entry": False, "framework": "", "route": ""}
    rows = [("symbol", path, lang, s["kind"], s["name"], s["receiver"], s["line"], s["end"], s.get("entry", False), s.get("framework", ""), s.get("route", ""), s.get("params", ""), s.get("doc", "")) for s in [blank | s for s in symbols + extra]]
    seen: set[tuple] = set()
    for rec, a, b, line in edges:
        if (rec, a, b) not in seen:
            seen.add((rec, a, b))
            rows.append((rec.split(":")[0], path, lang, rec.partition(":")[2], a, b, line, line, False, "", "", "", ""))
    return rows


def entries_of(path: str, raw: list[str], clean: list[str], spec: Spec, symbols: list[dict], enclosing, declared) -> list[dict]:
    """Marks handlers that the file declares; entry symbols for the other routes."""
    bases: dict[str, str] = {}
    extra: list[dict] = []

    def mark(name: str, recv: str, framework: str, route: str, line: int) -> None:
        for s in symbols:
            if s["name"] == name and s["receiver"] == recv and s["kind"] in DEF_KINDS:
                s |= {"entry": True, "framework": framework, "route": route or s.get("route", "")}
                return
        extra.append({"kind": "entry", "name": name, "receiver": "", "line": line, "end": line, "entry": True, "framework": framework, "route": route})

    for k, line in enumerate(raw):
        if not clean[k].strip():
            continue
        for e, p in spec.entries:
            m = p.search(line) if not e.files or path.lower().endswith(e.files) else None
            if not m:
                continue
            g = m.groupdict()
            route = (g.get("route") or ("/" + g["name"] if g.get("name") else "")) or e.default
            if e.paths and "/" not in route and route != "*":
                break
            if g.get("handler"):
                mark(handler_name(g["handler"]) or route, "", e.framework, routed("", route), k + 1)
                break
            following = next((j for j in range(k + 1, min(k + 11, len(raw))) if clean[j].strip() and not raw[j].strip().startswith("@")), None)
            found = declared(following) if following is not None else None
            if found is None:
                if route:
                    extra.append({"kind": "entry", "name": route, "receiver": "", "line": k + 1, "end": k + 1, "entry": True, "framework": e.framework, "route": route})
                break
            kind, d = found
            if kind in TYPE_KINDS:
                if e.base and route:
                    bases[d["name"]] = route
                if e.mark:
                    extra.append({"kind": "entry", "name": d["name"], "receiver": "", "line": following + 1, "end": following + 1, "entry": True, "framework": e.framework, "route": route})
            else:
                recv = enclosing(following)
                mark(d["name"], recv, e.framework, routed(bases.get(recv, ""), route), following + 1)
            break
    return extra


def extract(files: DataFrame) -> DataFrame:
    """Rows of RECORD for files (path, lang, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [r for path, lang, content in zip(part["path"], part["lang"], part["content"], strict=True) for r in scan_file(path, content or "", lang or "")]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "lang", "content").mapInPandas(run, RECORD)


def symbols(records: DataFrame) -> DataFrame:
    full = F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "name")).otherwise(F.col("name"))
    return records.where("rec = 'symbol'").drop("rec").withColumn("full_name", full)


def calls(records: DataFrame) -> DataFrame:
    """Distinct (caller, callee)."""
    return records.where("rec = 'call'").select(F.col("name").alias("caller"), F.col("receiver").alias("callee")).distinct()


def inherits(records: DataFrame) -> DataFrame:
    """Distinct (subtype, edge_kind, base)."""
    return records.where("rec = 'inherit'").select(F.col("name").alias("subtype"), F.col("kind").alias("edge_kind"), F.col("receiver").alias("base")).distinct()


def imports(records: DataFrame) -> DataFrame:
    """Distinct (file, target)."""
    return records.where("rec = 'import'").select("file", F.col("receiver").alias("target")).distinct()
