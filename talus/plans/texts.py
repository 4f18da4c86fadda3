"""Text and retrieval operators bound to documents, pages, benchmark, part and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talus.functions import diffs as D
from talus.functions import logs as L
from talus.functions import pii as P
from talus.functions import prose as W
from talus.functions import scan as X
from talus.functions import text as T
from talus.operators import context as C
from talus.operators import retrieval as R
from talus.operators import symbols as S
from talus.operators import textindex as TI
from talus.operators import tokens as TK
from talus.operators import vectorindex as VI
from talus.shared import shared_dir
from talus.tables import table

#: The file of ranks that token counts go by; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A word boundary over ASCII words, whatever the engine's own is; and one before a word.
BOUND = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
BEFORE = "(?<![A-Za-z0-9_])"
#: What a label's match must hold, where that is a fixed text: other documents need no pattern.
HOLDS = {"PRIVATE_KEY": "PRIVATE KEY", "AWS": "AKIA", "GITHUB": "gh", "GITHUB_PAT": "github_pat_", "SLACK": "xox", "STRIPE": "sk_", "OPENAI": "sk-", "JWT": "eyJ", "BEARER": "Bearer", "URL_CRED": "://", "IPV6": "::", "EMAIL": "@"}


def label_count(label: str, pattern: str):
    """Matches of a label's pattern in the text. Patterns begin with a word, but for mail addresses."""
    head, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    if body.startswith(r"\b") and label not in ("EMAIL", "IPV6"):
        body = BEFORE + body[2:]
    n = F.regexp_count("text", F.lit(head + body.replace(r"\b", BOUND)))
    return F.when(F.contains("text", F.lit(HOLDS[label])), n).otherwise(0) if label in HOLDS else n


def docs(spark, sf):
    return table(spark, sf, "documents")


def turns(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


def token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def token_totals(spark, sf):
    """Tokens of each source's documents, at the rates of prose, code and logs."""
    total = lambda kind: F.sum(T.token_estimate(F.coalesce("text", F.lit("")), L.RATES[kind])).alias(kind)
    return docs(spark, sf).groupBy("source").agg(*map(total, L.RATES))


def fit_lossless(spark, sf):
    return docs(spark, sf).select("doc_id", T.fit_lossless(F.col("text")).alias("fitted"))


def compress_log(spark, sf):
    return docs(spark, sf).select("doc_id", L.compress_log("text").alias("log"))


def log_ledger(spark, sf):
    """What log reduction saves, document by document."""
    return docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), L.compress_log("text").alias("log")).select("doc_id", *L.ledger(F.col("text"), F.col("log"), "log"))


def compact_output(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(L.compact_output("text"), 256).alias("output_sha256"))


def compress_prompt(spark, sf):
    return turns(spark, sf).where("role = 'user'").select("id", W.compress_prompt("text").alias("prompt"))


def terse_replies(spark, sf):
    out = turns(spark, sf).where("role = 'assistant'").select("id", W.terse_reply("text").alias("t"))
    return out.select("id", F.col("t.text").alias("text"), F.col("t.dropped").alias("dropped"))


def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), T.html_to_text(F.col("html")).alias("body"))


def pii_label_counts(spark, sf):
    """Matches of each label's patterns, before exemptions and overlaps, by language."""
    n = [sum((F.coalesce(F.sum(label_count(label, p)), F.lit(0)) for l, p in P.PATTERNS if l == label), F.lit(0)).alias(label) for label in P.LABELS]
    return docs(spark, sf).groupBy("lang").agg(*n)


def mask_pii(spark, sf):
    """How many values are masked, and whether putting them back gives the text again."""
    out = docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), P.mask("text").alias("m"))
    return out.select("doc_id", F.size("m.names").alias("replaced"), F.sha2("m.masked", 256).alias("masked_sha256"), (P.unmask(F.col("m.masked"), F.col("m.names")) == F.col("text")).alias("restored"))


def security_findings(spark, sf):
    files = docs(spark, sf).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".yml")).alias("path"), "text")
    return X.scan_files(files)


def tool_result_summary(spark, sf):
    s = docs(spark, sf).select("doc_id", C.tool_summary(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", *(F.size(f"s.{c}").alias(c) for c in ("errors", "facts", "evidence", "refs")), "s.saved")


def first_failures(spark, sf):
    return docs(spark, sf).select("doc_id", T.first_failure(F.col("text")).alias("line")).where("line is not null")


def identifier_segments(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.identifier_segments(F.concat_ws("", F.regexp_replace(F.initcap("p_name"), " ", ""), F.col("p_brand"))), " ").alias("segments"))


def query_words(spark, sf):
    """The plain words of titles, and the singular forms of the first."""
    t = table(spark, sf, "pages").select("page_id", T.query_words(T.html_title(F.col("html"))).alias("w"))
    return t.select("page_id", F.array_join("w", " ").alias("words"), F.array_join(T.plural_variants(F.try_element_at("w", F.lit(1))), " ").alias("variants"))


def part_symbols(spark, sf):
    """Parts as functions: the name in camel case, the brand as the file, the type as the receiver."""
    p = table(spark, sf, "part")
    name = F.regexp_replace(F.initcap("p_name"), " ", "")
    return p.select(
        F.lit("func").alias("kind"), name.alias("name"), F.lower("p_type").alias("receiver"), F.concat_ws(".", F.lower("p_type"), name).alias("full_name"), F.regexp_replace("p_brand", "#", "/").alias("file"),
        F.col("p_partkey").alias("line"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.lit("").alias("route"), F.lit(False).alias("entry"),
    )


def pattern_search(spark, sf):
    return S.pattern_search(part_symbols(spark, sf), "func *Wid*", 50).select("full_name", "file", "line")


def ranked_search(spark, sf):
    q = spark.createDataFrame([(1, "largeWidgets economy"), (2, "red bolts brand")], "query long, text string")
    return S.ranked_search(part_symbols(spark, sf), q, limit=40).select("query", "full_name", "file", "line", "score", "rank")


def symbol_resolution(spark, sf):
    """Each name as asked for by folder and by its last part."""
    s = part_symbols(spark, sf)
    asked = s.select(F.concat_ws(".", F.lit("Brand"), "name").alias("ref")).unionByName(s.select(F.concat(F.lit("x/"), F.col("full_name")).alias("ref"))).distinct()
    return S.find(s, asked)


def bm25_topk(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return R.bm25(docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), q)


def corpus_statistics(spark, sf):
    return R.corpus_statistics(docs(spark, sf).select(F.col("doc_id").alias("id"), "text")).select("term", "df", "n", F.round("mean", 6).alias("mean"))


def full_text_search(spark, sf):
    """A question with a phrase, a column and a negation."""
    d = docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    return R.search_text(d, "doc_id", "license OR that NOT lang:de", {"text": "text", "lang": "lang"}, "text", 100)


#: With phrases, a column and alternatives; common words of the tables.
INDEX_QUESTIONS = {1: '"to thanedble the" NOT license', 2: 'license OR "er ntre in" lang:fr', 3: 'lang:de AND "Released under"'}


def indexed(spark, sf) -> str:
    """The folder of a new index of the documents' texts and languages."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    TI.build(docs(spark, sf).select("doc_id", "text", "lang"), "doc_id", ["text", "lang"], path)
    return path


def text_index_search(spark, sf):
    """Three questions to one saved index."""
    return TI.ask(spark, indexed(spark, sf), INDEX_QUESTIONS, ["text", "lang"], 50)


def text_index_phrases(spark, sf):
    """The first four words of every benchmark item as a phrase, asked of the saved index at once."""
    return TI.ask_all(spark, indexed(spark, sf), TI.phrases_of(table(spark, sf, "benchmark"), "item_id", "text", 4), 10)


def shingle_jaccard(spark, sf):
    c = turns(spark, sf)
    return R.jaccard_lookup(c.where("id % 20 = 0").select(F.col("id").alias("query"), "text"), c, 0.05)


def lesson_recall(spark, sf):
    c = turns(spark, sf)
    return R.recall(c.where("role = 'user' and id % 20 = 0").select(F.col("id").alias("query"), "text"), c.where("role = 'assistant'").select("id", "text"))


def dense_cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return R.dense_top(v, v.where("id % 20 = 0").withColumnRenamed("id", "query"))


def vector_index_topk(spark, sf):
    """The same question to a saved index of lists, with the lists that bounds cannot rule out."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    VI.build(v, path)
    return VI.search(spark, path, v.where("id % 20 = 0").withColumnRenamed("id", "query"), exact=True)


def bpe_token_count(spark, sf):
    """Of every document, by the ranks of a public vocabulary."""
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return TK.token_counts(d, VOCABULARY).withColumnRenamed("id", "doc_id")


def rrf_fusion(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    lists = R.bm25(d, q, 10).select("query", "id", "rank").unionByName(R.recall(q, d, 10).select("query", "id", "rank"))
    return R.fuse(lists, lists=2)


def hybrid_search(spark, sf):
    """User turns whose id is divisible by 20 among all replies, by words and by hashed parts of words."""
    c = turns(spark, sf)
    return R.hybrid(c.where("role = 'assistant'").select("id", "text"), c.where("role = 'user' and id % 20 = 0").select(F.col("id").alias("query"), "text"))


def chunks(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(L.chunks("text")).alias("at", "c")).select("doc_id", "at", "c.start", F.sha2("c.text", 256).alias("chunk_sha256"))


def unified_diff(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(D.unified_diff("text", T.fit_lossless(F.col("text"))), 256).alias("diff_sha256"))


def budget_fit(spark, sf):
    return docs(spark, sf).select("doc_id", L.budget_fit("text", 40).alias("fitted"))


def described_symbols(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(D.symbols_named(T.html_title(F.col("html"))), " ").alias("symbols"))


#: White space, as Unicode has it, and the pattern of pre-tokens without look-ahead: U+E000 stands before the last of a run.
_WS = r"\t-\r \x{85}\p{Z}"
_PIECES = "$$'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^" + _WS + "\\p{L}\\p{N}\\x{E000}]+|[" + _WS + "]+$$"
_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
_INDEX = f"""d AS (SELECT doc_id AS id, 'text' AS col, {_TOKENS.format('text')} AS a FROM documents UNION ALL SELECT doc_id, 'lang', {_TOKENS.format('lang')} FROM documents),
        sz AS (SELECT id, sum(len(a)) AS n FROM d GROUP BY id), st AS (SELECT count(*) AS n, avg(n) AS mean FROM sz)"""
_INDEX_RANK = """m AS (SELECT q, g, c, neg, id, sum(len(list_filter(range(1, len(a) - len(p) + 2), lambda i: a[i:i + len(p) - 1] = p))) AS f FROM d JOIN c ON list_contains(a, p[1]) AND (c.col IS NULL OR c.col = d.col) GROUP BY ALL HAVING f > 0),
        w AS (SELECT q, g, count(*) FILTER (WHERE NOT neg) AS wanted FROM c GROUP BY q, g),
        h AS (SELECT DISTINCT m.q, id FROM m JOIN w ON w.q = m.q AND w.g = m.g GROUP BY m.q, m.g, id, wanted HAVING count(*) FILTER (WHERE NOT neg) = wanted AND count(*) FILTER (WHERE neg) = 0),
        df AS (SELECT q, g, c, count(*) AS df FROM m GROUP BY 1, 2, 3),
        s AS (SELECT m.q AS query, m.id, round(sum(greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sz.n / mean))), 6) AS score
              FROM m JOIN h ON h.q = m.q AND h.id = m.id JOIN df ON df.q = m.q AND df.g = m.g AND df.c = m.c JOIN sz ON sz.id = m.id, st GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= {k}"""


def _index_sql(clauses: str, k: int) -> str:
    return f"WITH {_INDEX}, c AS (SELECT * FROM (VALUES {clauses}) AS v(q, g, c, neg, col, p)), {_INDEX_RANK.format(k=k)}"


QUERIES = {f.__name__: f for f in (token_estimate, token_totals, fit_lossless, compress_log, log_ledger, compact_output, compress_prompt, terse_replies, html_to_text, pii_label_counts, mask_pii, security_findings, tool_result_summary, first_failures, identifier_segments, query_words, pattern_search, ranked_search, symbol_resolution, bm25_topk, corpus_statistics, full_text_search, text_index_search, text_index_phrases, shingle_jaccard, lesson_recall, dense_cosine_topk, vector_index_topk, bpe_token_count, rrf_fusion, hybrid_search, chunks, unified_diff, budget_fit, described_symbols)}

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"
TERMS = """{n}w AS MATERIALIZED (SELECT {id} AS id, {w} AS w FROM {src}), {n} AS (SELECT id, term, count(*) AS tf, max(len) AS len FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM {n}w) GROUP BY 1, 2)"""
SPACE = r"[\t\n\x0B\f\r ]+"


def _words(text: str = "text") -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+')"


def _terms(name: str, ident: str, src: str) -> str:
    return TERMS.format(n=name, id=ident, src=src, w=_words())


def _bm25(k: int) -> str:
    return f"""{_terms('t', 'doc_id', 'documents')}, {_terms('q', 'item_id', 'benchmark')},
        st AS (SELECT count(*) AS n, avg(len({_words()})) AS mean FROM documents),
        df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        s AS (SELECT q.id AS query, t.id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.len / mean))), 6) AS score
              FROM t JOIN q ON t.term = q.term JOIN df ON df.term = t.term, st GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s), bm AS (SELECT * FROM r WHERE rank <= {k})"""


def _lessons(q_id: str, q_src: str, c_id: str, c_src: str, k: int) -> str:
    """Recall as SQL: words of three letters or more that are no stop words."""
    stop = ", ".join(f"'{w}'" for w in R.STOP)
    w = f"list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda x: length(x) >= 3 AND NOT list_contains([{stop}], x))"
    return f"""lqw AS MATERIALIZED (SELECT {q_id} AS id, {w} AS w FROM {q_src}), lcw AS MATERIALIZED (SELECT {c_id} AS id, {w} AS w FROM {c_src}),
        lq AS (SELECT id, term, count(*) AS m, max(n) AS nq FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM lqw) GROUP BY 1, 2),
        lc AS (SELECT DISTINCT id, term, n AS nc FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM lcw)),
        ls AS (SELECT lq.id AS query, lc.id, round(sum(m) / max(nq)::DOUBLE + 0.5::DOUBLE * sum(m) / max(nc), 6) AS score FROM lq JOIN lc ON lq.term = lc.term GROUP BY 1, 2),
        lr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ls), le AS (SELECT * FROM lr WHERE rank <= {k})"""


def _tokens(rate: float, text: str = "text") -> str:
    t = f"coalesce({text}, '')"
    return f"CASE WHEN {t} = '' THEN 0 ELSE greatest(trunc((octet_length(encode(regexp_replace({t}, '{SPACE}', '', 'g'))) + len(list_filter(regexp_split_to_array({t}, '{SPACE}'), lambda w: w <> ''))) * {1.0 / rate!r}::DOUBLE)::BIGINT, 1) END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_conv = "(SELECT conv_id * 1000 + turn AS id, role, text FROM conversations)"
_trim = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
LOG = f"""{LINES}, b AS (SELECT doc_id, pos, regexp_replace(line, {_quoted(L.TIMESTAMP)}, '') AS bare FROM lines), k AS (SELECT *, {_trim('bare')} AS key FROM b),
        m AS (SELECT *, sum(CASE WHEN key = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS blanks,
              key <> '' AND NOT regexp_matches(key, {_quoted(L.RULER)}) AND (regexp_matches(key, {_quoted(L.FRAME)}) OR regexp_matches(key, {_quoted(L.LOUD)}) OR regexp_matches(key, {_quoted(L.BROKEN)})
              OR (NOT regexp_matches(key, {_quoted(L.CALM)}) AND (octet_length(encode(key)) > 200 OR (NOT regexp_matches(lower(key), 'heartbeat|keepalive|polling') AND (regexp_matches(key, '[=:{{}}\\[\\]/]') OR octet_length(encode(key)) > 40))))) AS keep FROM k),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM m WHERE keep),
        e AS (SELECT *, CASE WHEN blanks > lag(blanks) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS gap FROM f WHERE nth = 1),
        c AS (SELECT *, coalesce(sum(1 + gap) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e),
        o AS (SELECT doc_id, string_agg(CASE WHEN gap = 1 THEN chr(10) ELSE '' END || rtrim(bare, ' ' || chr(9)), chr(10) ORDER BY pos) AS log FROM c WHERE used < 200 GROUP BY doc_id),
        logs AS (SELECT d.doc_id, coalesce(d.text, '') AS text, coalesce(o.log, '') AS log FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id)"""
_plain = f"translate(t, '{T.ACCENTED}', '{T.PLAIN}')"
_camel = lambda c: f"regexp_replace(regexp_replace({c}, '([\\p{{Ll}}\\p{{Nd}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
_once = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def _html() -> str:
    out = "html"
    steps = [(r"(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>", "' '"), (r"(?s)<!--.*?-->", "' '"), (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|title)[^>]*>", "chr(10)"), (r"<[^>]*>", "' '")]
    for p, to in steps:
        out = f"regexp_replace({out}, '{p}', {to}, 'g')"
    for name, char in T.ENTITIES:
        out = f"replace({out}, '{name}', {_quoted(char)})"
    out = f"regexp_replace({out}, '[ \\t\\r]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


_title = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_parts = """s AS (SELECT replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ''), ' ', '') AS name, lower(p_type) AS receiver, replace(p_brand, '#', '/') AS file, p_partkey AS line FROM part),
        p AS (SELECT *, receiver || '.' || name AS full_name FROM s)"""


def _tier(w: str, variants: str) -> str:
    seg = f"string_split(lower({_camel('name')}), ' ')"
    return f"""CASE WHEN n = '{w}' THEN 100 WHEN f = '{w}' THEN 95 WHEN list_contains({seg}, '{w}') THEN 90 WHEN starts_with(f, '{w}') THEN 80 WHEN starts_with(n, '{w}') THEN 70
        WHEN list_has_any({seg}, [{variants}]) THEN 66 WHEN contains(n, '{w}') THEN 60 WHEN contains(f, '{w}') THEN 45 WHEN contains(l, '{w}') THEN 20 ELSE 0 END"""


ORACLES = {
    "token_estimate": f"SELECT doc_id, {_tokens(4.0)} AS tokens FROM documents",
    "token_totals": "SELECT source, " + ", ".join(f"sum({_tokens(r)}) AS {k}" for k, r in L.RATES.items()) + " FROM documents GROUP BY source",
    "fit_lossless": f"WITH {LINES}, f AS (SELECT doc_id, line, min(pos) AS pos FROM lines GROUP BY 1, 2) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS fitted FROM f GROUP BY doc_id",
    "compress_log": f"WITH {LOG} SELECT doc_id, log FROM logs",
    "log_ledger": f"""WITH {LOG}, t AS (SELECT doc_id, {_tokens(3.2)} AS a, {_tokens(3.2, 'log')} AS b FROM logs)
        SELECT doc_id, a AS before_tokens, b AS after_tokens, a - b AS saved_tokens, round(CASE WHEN a > 0 THEN 100.0::DOUBLE * (a - b) / a ELSE 0 END, 4) AS saved_percent FROM t""",
    "compact_output": f"""WITH {LINES}, k AS (SELECT doc_id, pos, {_trim('line')} AS x FROM lines), n AS (SELECT *, lower(x) AS low FROM k WHERE x <> ''),
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM n WHERE NOT (starts_with(low, '[info]') OR starts_with(low, '[debug]') OR starts_with(low, 'downloading') OR starts_with(low, 'progress'))),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM c WHERE nth <= 60 OR regexp_matches(low, 'error|fail|warn')),
        o AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS t FROM r WHERE k <= 120 GROUP BY doc_id)
        SELECT d.doc_id, sha256(coalesce(t, '')) AS output_sha256 FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id""",
    "html_to_text": f"SELECT page_id, {_title} AS title, {_html()} AS body FROM pages",
    "pii_label_counts": "SELECT lang, " + ", ".join("CAST(" + " + ".join(f"sum(len(regexp_extract_all(text, {_quoted(p)})))" for l, p in P.PATTERNS if l == label) + f" AS BIGINT) AS {label}" for label in P.LABELS) + " FROM documents GROUP BY lang",
    "tool_result_summary": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: trim(y)), lambda y: y <> '') AS x FROM documents)
        SELECT doc_id, len(list_filter(x, lambda y: regexp_matches(lower(y), 'error|fail|panic|fatal'))) AS errors, len(list_filter(x, lambda y: regexp_matches(y, ' = |:=|type |func '))) AS facts, len(list_filter(x, lambda y: regexp_matches(y, '[^ :]:[0-9]'))) AS evidence,
               len(list_distinct(list_filter(list_transform(regexp_split_to_array(t, '\\s+'), lambda w: regexp_replace(w, '[,;:()\\[\\]{{}}"'']+$', '')), lambda w: regexp_matches(w, '{C.REFERENCES}')))) AS refs,
               greatest(octet_length(encode(t)) // 4 - octet_length(encode(array_to_string(x[1:5], chr(10)))) // 4, 0) AS saved FROM d""",
    "first_failures": f"WITH {LINES}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM lines WHERE regexp_matches(line, '{T.FAILURE}')) SELECT doc_id, line FROM h WHERE k = 1",
    "identifier_segments": f"""WITH s AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || p_brand AS t FROM part),
        w AS (SELECT p_partkey, regexp_split_to_array(lower(regexp_replace({_camel('t')}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), ' +') AS a FROM s)
        SELECT p_partkey, array_to_string(list_filter({_once('a')}, lambda x: length(x) BETWEEN 2 AND 32 AND NOT regexp_full_match(x, '[0-9]+'))[1:12], ' ') AS segments FROM w""",
    "query_words": f"""WITH s AS (SELECT page_id, regexp_replace({_camel(_title)}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g') AS t FROM pages), w AS (SELECT page_id, list_filter(regexp_split_to_array(lower({_plain}), ' +'), lambda x: x <> '') AS a FROM s),
        o AS (SELECT page_id, {_once('a')} AS u FROM w), f AS (SELECT page_id, array_to_string(u, ' ') AS words, u[1] AS x FROM o)
        SELECT page_id, words, CASE WHEN x IS NULL THEN NULL WHEN regexp_matches(x, '(xes|shes|sses|zzes)$') THEN x || CASE WHEN length(x) >= 6 THEN ' ' || x[:-3] ELSE '' END
               WHEN regexp_matches(x, '(ches|ses|zes|oes)$') THEN x || CASE WHEN length(x) >= 6 THEN ' ' || x[:-3] ELSE '' END || CASE WHEN length(x) >= 5 THEN ' ' || x[:-2] ELSE '' END
               WHEN regexp_matches(x, '[^s]s$') THEN x || CASE WHEN length(x) >= 5 THEN ' ' || x[:-2] ELSE '' END ELSE x END AS variants FROM f""",
    "pattern_search": f"WITH {_parts} SELECT full_name, file, line FROM p WHERE regexp_full_match(name, '.*Wid.*') OR regexp_full_match(full_name, '.*Wid.*') ORDER BY file, line, full_name LIMIT 50",
    "ranked_search": f"""WITH {_parts}, x AS (SELECT *, lower(name) AS n, lower(full_name) AS f, lower(file) AS l FROM p),
        t AS (SELECT 1 AS query, *, {_tier('large', "'large'")} AS a, {_tier('widgets', "'widgets', 'widget'")} AS b, {_tier('economy', "'economy'")} AS c FROM x
              UNION ALL SELECT 2, *, {_tier('red', "'red'")}, {_tier('bolts', "'bolts', 'bolt'")}, {_tier('brand', "'brand'")} FROM x),
        g AS (SELECT query, full_name, file, line, a + b + c + CASE WHEN a > 0 AND b > 0 AND c > 0 THEN 150 ELSE 0 END AS score FROM t WHERE a + b + c > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, full_name, file, line) AS rank FROM g) SELECT * FROM r WHERE rank <= 40""",
    "symbol_resolution": f"""WITH {_parts}, a AS (SELECT DISTINCT 'Brand.' || name AS ref, name AS tail, 'Brand' AS qualifier FROM p UNION SELECT DISTINCT 'x/' || full_name, name, receiver FROM p),
        h AS (SELECT ref, full_name, p.file, line, CASE WHEN qualifier = 'Brand' THEN 'folder' ELSE 'tail' END AS how FROM a JOIN p ON tail = name),
        r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY file, line, full_name) AS k FROM h) SELECT ref, full_name, file, line, how FROM r WHERE k = 1""",
    "bm25_topk": f"WITH {_bm25(5)} SELECT query, id, score, rank FROM bm",
    "corpus_statistics": f"WITH {_terms('t', 'doc_id', 'documents')} SELECT term, count(*) AS df, (SELECT count(*) FROM documents) AS n, (SELECT round(avg(len({_words()})), 6) FROM documents) AS mean FROM t GROUP BY term",
    "full_text_search": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents), {_terms('t', 'doc_id', 'd')},
        st AS (SELECT count(*) AS n, avg(len({_words()})) AS mean FROM d), q AS (SELECT unnest(['license', 'that', 'de']) AS term), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        s AS (SELECT t.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.len / mean))), 6) AS score FROM t JOIN q ON t.term = q.term JOIN df ON df.term = t.term, st GROUP BY 1),
        h AS (SELECT doc_id FROM d WHERE (regexp_matches(' ' || lower(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g')) || ' ', ' (license|that) ')) AND NOT coalesce(lang = 'de', false))
        SELECT h.doc_id, coalesce(score, 0.0::DOUBLE) AS score FROM h LEFT JOIN s ON s.id = h.doc_id ORDER BY score DESC, doc_id LIMIT 100""",
    "text_index_search": _index_sql("""(1, 0, 0, false, NULL, ['to', 'thanedble', 'the']), (1, 0, 1, true, NULL, ['license']), (2, 0, 0, false, NULL, ['license']), (2, 1, 1, false, NULL, ['er', 'ntre', 'in']),
        (2, 1, 2, false, 'lang', ['fr']), (3, 0, 0, false, 'lang', ['de']), (3, 0, 1, false, NULL, ['released', 'under'])""", 50),
    "text_index_phrases": f"""WITH {_INDEX}, c AS (SELECT item_id AS q, 0 AS g, 0 AS c, false AS neg, NULL AS col, {_TOKENS.format('text')}[1:4] AS p FROM benchmark WHERE len({_TOKENS.format('text')}) > 0), {_INDEX_RANK.format(k=10)}""",
    "shingle_jaccard": f"""WITH w AS (SELECT id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 2) AS a FROM {_conv}),
        s AS (SELECT DISTINCT id, unnest(CASE WHEN len(a) <= 2 THEN a ELSE list_concat(a, list_transform(a[1:len(a) - 1], lambda x, i: x || ' ' || a[i + 1])) END) AS t FROM w), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        m AS (SELECT a.id AS query, b.id, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2),
        j AS (SELECT query, m.id, round(k / (x.n + y.n - k)::DOUBLE, 6) AS similarity FROM m JOIN n x ON x.id = query JOIN n y ON y.id = m.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS k FROM j WHERE similarity >= 0.05) SELECT query, id, similarity FROM r WHERE k = 1""",
    "lesson_recall": f"""WITH c AS {_conv}, {_lessons('id', "(SELECT * FROM c WHERE role = 'user' AND id % 20 = 0)", 'id', "(SELECT * FROM c WHERE role = 'assistant')", 3)} SELECT * FROM le""",
    "dense_cosine_topk": """WITH v AS (SELECT vec_id AS id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS m FROM embeddings),
        s AS (SELECT a.id AS query, b.id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (a.m * b.m), 6) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
    "bpe_token_count": f"""WITH RECURSIVE ranks AS MATERIALIZED (SELECT hex(from_base64(t)) AS pair, r AS rank FROM read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'INT'}})),
        d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([{_WS}])([{_WS}][^{_WS}])', '\\1' || chr(57344) || '\\2', 'g') AS t FROM documents),
        e AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(t, {_PIECES})) AS word FROM d),
        m AS (SELECT word, regexp_extract_all(hex(encode(word)), '..') AS parts FROM (SELECT DISTINCT word FROM e)
              UNION ALL SELECT word, list_concat(parts[1:j - 1], [parts[j] || parts[j + 1]], parts[j + 2:]) FROM (
                  SELECT word, parts, arg_min(k, rank::BIGINT * 1000000 + k) AS j FROM (SELECT word, parts, unnest(range(1, len(parts))) AS k FROM m) JOIN ranks ON pair = parts[k] || parts[k + 1] GROUP BY word, parts)),
        n AS (SELECT word, min(len(parts)) AS n FROM m GROUP BY word),
        s AS (SELECT doc_id, sum(n)::BIGINT AS tokens, count(*) AS words, count(DISTINCT e.word) AS "distinct" FROM e JOIN n ON e.word = n.word GROUP BY doc_id)
        SELECT d.doc_id, coalesce(tokens, 0) AS tokens, coalesce(words, 0) AS words, coalesce("distinct", 0) AS "distinct" FROM d LEFT JOIN s ON s.doc_id = d.doc_id""",
    "rrf_fusion": f"""WITH {_bm25(10)}, {_lessons('item_id', 'benchmark', 'doc_id', 'documents', 10)},
        l AS (SELECT query, id, rank FROM bm UNION ALL SELECT query, id, rank FROM le)
        SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)) / (2.0::DOUBLE / 61), 6) AS score FROM l GROUP BY 1, 2""",
}
ORACLES["vector_index_topk"] = ORACLES["dense_cosine_topk"]
