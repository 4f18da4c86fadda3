"""The pipeline's stages over the smallest tables, each against a plain version over its own input."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from talus.llm import toxicity
from talus.llm.scratch import BATCH, Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_clean(docs, labels):
    marks = {(r["doc_id"], r["toxic"]) for r in labels if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    texts = [({w for w in toxicity.words_of(d["text"] or "") if len(w) >= toxicity.ORDER}, t) for d in docs for i, t in sorted(marks) if i == d["doc_id"]]
    machine = toxicity.Machine(texts)
    return [d["doc_id"] for d in docs if machine.scores([d["text"] or ""])[0] < 0.5]


def plain_unrepeated(docs):
    keep = {}
    for d in docs:
        key = (d["text"] or "").translate(LOWER)
        keep[key] = max(keep.get(key, -1), d["doc_id"])
    return list(keep.values())


def plain_dissimilar(docs):
    sets = {}
    for d in docs:
        w = WORD.findall((d["text"] or "").translate(LOWER))
        sets[d["doc_id"]] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [d for d in ids if find(d) == d]


def check_mixed(before, after):
    """The mix takes each source's target, in whole texts and cuts of them, three times at most."""
    size, words, texts = Counter(), {}, {}
    for d in before:
        words[d["doc_id"]] = WORD.findall(d["text"] or "")
        texts[d["doc_id"]] = d["text"]
        size[d["source"]] += len(words[d["doc_id"]])
    order = [*sorted(s for s in size if s is not None), *([None] if None in size else [])]
    weight, target, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, sum(size.values())
    while True:
        left = [s for s in order if s not in target]
        rate = (total - sum(target.values())) / max(sum(weight[s] for s in left), 1)
        over = [s for s in left if weight[s] * rate > 3 * size[s]]
        target |= {s: 3 * size[s] for s in over}
        if not over:
            target |= {s: weight[s] * rate for s in left}
            break
    taken, times = Counter(), Counter()
    for d in after:
        w = WORD.findall(d["text"])
        taken[d["source"]] += len(w)
        times[d["doc_id"]] += len(w)
        assert d["text"] == texts[d["doc_id"]] or set(w) <= set(words[d["doc_id"]])
        assert d["n_chars"] == len(d["text"])
    assert all(abs(taken[s] - target[s]) <= 1 for s in size) and all(n <= 3 * len(words[d]) for d, n in times.items())


def test_stages(spark):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from talus.llm import bpe

    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    columns, before = docs.columns, docs.collect()
    plain = {"toxicity": lambda d: plain_clean(d, labels), "exact dedup": plain_unrepeated, "n-gram Jaccard join": plain_dissimilar}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF))
        after = docs.collect()
        if name in plain:
            assert sorted(r["doc_id"] for r in after) == sorted(plain[name](before)) and docs.columns == columns
            by = {r["doc_id"]: r for r in before}
            assert all(by[r["doc_id"]] == r for r in after)
        elif name.startswith("mixing"):
            check_mixed(before, after)
            assert docs.columns == columns
        before, last = after, before
    keys, ids = bpe.vocabulary(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=dict(zip(keys, ids, strict=True)), special_tokens={})
    want = Counter()
    for d in last:
        got = own.encode_ordinary(d["text"])
        want[d["doc_id"], len(got), hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in before) == want


def test_cuts(spark):
    """A cut text keeps its words and all between them; only where words are left out stands a line end."""
    from talus.llm.mixing import mixed_documents, stretches

    assert stretches([{"first": 0, "words": 4}, {"first": 4, "words": 4}, {"first": 8, "words": 1}, {"first": 12, "words": 4}]) == [(0, 9), (12, 16)]
    rows = [(k, "  ".join(f"w{n}" for n in range(9000)), "ab"[k % 2], 0) for k in range(6)]
    got = mixed_documents(Scratch(spark, "test"), spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), block_words=256).collect()
    cut = [r["text"] for r in got if r["text"] != rows[0][1]]
    joined = 0
    for text in cut:
        ends = []
        for piece in text.split("\n"):
            at = [int(w[1:]) for w in piece.split("  ")]
            assert at == list(range(at[0], at[-1] + 1)) and all(at[0] > e + 1 for e in ends)
            ends.append(at[-1])
            joined += len(at) > 256
    assert cut and joined


def test_odd_rows(spark):
    """Nulls, empty and repeated rows, and columns named like the stages' own, go through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity int, sha int, drop int, uid int, shard int"
    rows = [(1, "one two three four five six", "en", "a", 27, 1, 1, 1, 1, 1), (1, "one two three four five six", "en", "a", 27, 1, 1, 1, 1, 1), (2, None, None, None, None, 1, 1, 1, 1, 1), (3, "", "en", "b", 0, 1, 1, 1, 1, 1), (None, "x y", "en", None, 3, 1, 1, 1, 1, 1), (4, "z " * 30000, "en", "b", 60000, 1, 1, 1, 1, 1)]
    scratch = Scratch(spark, "test")
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, SF))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            if name == "exact dedup" and part:
                assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_first_stage_sets_small_batches(spark):
    """Also where a caller runs the stages one by one, no stage gets batches of the session's usual size."""
    for name, usual, _ in BATCH:
        spark.conf.set(name, usual)
    corpus_pipeline.clean(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF)
    assert [spark.conf.get(name) for name, *_ in BATCH] == [small for *_, small in BATCH]
