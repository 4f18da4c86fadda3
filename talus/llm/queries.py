"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.llm import alignment, bpe, chaining, exact_dedup, line_dedup, merkle, mixing, ngram_join, quality, secrets, suffix_dedup, toxicity, vectors
from talus.llm.scratch import Scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(Scratch(spark, "op3"), read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(Scratch(spark, "op4"), read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_recurring(Scratch(spark, "op5"), read(spark, sf_dir, "documents")).drop("spans")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(Scratch(spark, "op8"), read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(Scratch(spark, "op9"), read(spark, sf_dir, "documents"))


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(Scratch(spark, "op1"), read(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(Scratch(spark, "op2"), read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(Scratch(spark, "op10"), read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(Scratch(spark, "op11"), read(spark, sf_dir, "documents"), merkle.every_fifth())


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    a = (known.path("byte_bpe_50k.json"), known.path("byte_bpe_50k.tiktoken"), known.PATTERN)
    return alignment.align(Scratch(spark, "op12"), read(spark, sf_dir, "documents"), a, (known.path("piece_bpe_32k.model"),))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(Scratch(spark, "op13"), read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_vectors": op1_vectors,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_chaining": op8_chaining,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_line_dedup": op13_line_dedup,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SECRET_RULES = [(k, name, pattern, group, least) for k, (name, pattern, group, least) in enumerate(secrets.RULES)]
_found = " UNION ALL ".join(
    f"SELECT doc_id, source, {k} AS k, '{name}' AS kind, {least} AS least, regexp_split_to_array(t, p) AS gap, regexp_extract_all(t, p) AS whole, regexp_extract_all(t, p, {group}) AS val FROM (SELECT *, {chr(39) + pattern.replace(chr(39), chr(39) * 2) + chr(39)} AS p FROM d)"
    for k, name, pattern, group, least in SECRET_RULES
)
#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""


def _FIELD(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_HEAD = " || ".join(_FIELD(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars"))
_RUN = "string_agg(h, '') OVER (PARTITION BY grp, lvl, idx // 16 ORDER BY idx ROWS BETWEEN"


def _TREE(name: str, start: str) -> str:
    """The levels of one tree a group, and what stands beside each node."""
    return f"""{name} AS (
              SELECT grp, 0 AS lvl, idx, h, count(*) OVER (PARTITION BY grp) AS n FROM {start}
              UNION ALL SELECT grp, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY grp, lvl, idx // 16, n),
        {name}_side AS (SELECT grp, lvl, idx, coalesce({_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce({_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name} WHERE n > 1)"""


def _WAY(name: str, side: str, start: str) -> str:
    """The way of each row (k, grp, idx, fold, sib) up."""
    return f"""{name} AS (
              SELECT k, grp, 0 AS lvl, idx, fold, sib FROM {start}
              UNION ALL SELECT k, w.grp, w.lvl + 1, w.idx // 16, sha256(b || fold || a), sib || b || a FROM {name} w JOIN {side} s ON w.grp = s.grp AND w.lvl = s.lvl AND w.idx = s.idx)"""


_WORDS = f"regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+')"

ORACLES = {
    "op11_merkle": f"""
        WITH RECURSIVE d AS (SELECT *, {LOWER} AS low, {_CRC} AS crc FROM documents),
        leaf AS (SELECT doc_id, coalesce('=' || source, '') AS grp, sha256({_HEAD} || {_FIELD("text")}) AS h,
                        CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN sha256({_HEAD} || {_FIELD("low")}) ELSE sha256({_HEAD} || {_FIELD("text")}) END AS seen,
                        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM d),
        {_TREE("inn", "leaf")},
        tops AS (SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS idx FROM inn WHERE n = 1),
        {_TREE("outr", "tops")},
        begun AS (SELECT doc_id AS k, grp, idx, seen AS fold, '' AS sib FROM leaf),
        {_WAY("way", "inn_side", "begun")},
        half AS (SELECT k, '' AS grp, t.idx, fold, sib FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lvl DESC) AS last FROM way) w JOIN tops t ON t.name = w.grp WHERE last = 1),
        {_WAY("upper", "outr_side", "half")},
        done AS (SELECT k, fold, sib FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lvl DESC) AS last FROM upper) WHERE last = 1),
        root AS (SELECT h AS root FROM outr WHERE n = 1)
        SELECT l.doc_id, l.h AS leaf, t.h AS subroot, root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = root AS verified
        FROM leaf l JOIN tops t ON t.name = l.grp JOIN done ON k = doc_id, root""",
    "op13_line_dedup": """
        WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM a),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        g AS (SELECT k.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
    "op3_secrets": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), m AS ({_found}),
        x AS (SELECT doc_id, source, k, kind, least, unnest(list_transform(range(1, len(whole) + 1), lambda i: {{'st': list_sum(list_transform(gap[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda y: length(y))), 0),
              'n': length(whole[i]), 'val': val[i]}})) AS s FROM m WHERE len(whole) > 0),
        s AS (SELECT doc_id, source, k, kind, CAST(s.st AS BIGINT) AS st, CAST(s.st + s.n AS BIGINT) AS en, s.val AS val FROM x WHERE length(s.val) >= least),
        b AS (SELECT * FROM s WHERE k < 3),
        o AS (SELECT * FROM s WHERE k = 3 AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.st < s.en AND s.st < b.en)),
        e AS (SELECT * FROM b UNION ALL SELECT * FROM o),
        h AS (SELECT val, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT (source, doc_id)) AS repositories FROM e GROUP BY val),
        j AS (SELECT e.*, owners <= 1 AND repositories <= 8 AS live FROM e JOIN h ON e.val = h.val)
        SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
               sha256(coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) FILTER (WHERE k < 3), '')) AS base_sha256,
               coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) FILTER (WHERE k < 3 OR live), '') AS spans,
               count(*) FILTER (WHERE k < 3 AND live) AS n_live, count(*) FILTER (WHERE k < 3 AND NOT live) AS n_copied, count(*) FILTER (WHERE k = 3 AND live) AS n_opaque
        FROM d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id""",
    "op10_ngram_join": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS a FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS t FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM m JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op1_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) >= 0.93 * a.norm * b.norm),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n ON c.vec_id = n.vec_id""",
}
