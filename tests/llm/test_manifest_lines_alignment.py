"""The Merkle manifest, line dedup and the alignment of tokenizers against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from talus.llm import alignment, line_dedup, merkle
from talus.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 long, keep string, grp string, idx long, pos int, pair long"
EXTRA = (1, "k", "g", 2, 3, 4)
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Merkle manifest


def up(nodes):
    """Levels of one tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def leaf(row, text):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, _, lang, source, n_chars = row[:5]
    return sha("".join(map(said, (doc_id, source, lang, n_chars, text))))


def plain_manifest(rows):
    by, out = {}, []
    for r in rows:
        seen = r[1]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and seen is not None:
            seen = seen.translate(LOWER)
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, seen)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(by[s])]) for s in sources}
    outer = up([trees[s][-1][0] for s in sources])
    root = outer[-1][0]
    for k, s in enumerate(sources):
        for at, (known, doc_id, mine, seen) in enumerate(sorted(by[s])):
            sides, fold = "", seen
            for levels, pos in ((trees[s], at), (outer, k)):
                for level in levels[:-1]:
                    run = level[pos // 16 * 16 : pos // 16 * 16 + 16]
                    before, after = "".join(run[: pos % 16]), "".join(run[pos % 16 + 1 :])
                    sides, fold, pos = sides + before + after, sha(before + fold + after), pos // 16
            out.append((doc_id if known else None, mine, trees[s][-1][0], root, sha(sides), fold, fold == root))
    return Counter(out)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.fixture(scope="module")
def leaves():
    rnd = random.Random(5)
    rows = [(k, rnd.choice([None, "", "Abc é", "plain", "X" * 3000, f"t{k}"]), rnd.choice(["en", None]), "hot" if k < 700 else f"s{k % 40}", rnd.choice([None, k]), *EXTRA) for k in range(900)]
    rows += [(None, "Null id", None, None, None, *EXTRA), (None, "Null id", None, "hot", None, *EXTRA), rows[10], rows[10], (10, "other text", "en", "hot", 1, *EXTRA), (7000, "one", "en", "ALONE", 3, *EXTRA), (7001, "t", None, "", 3, *EXTRA)]
    return rows


@pytest.mark.parametrize("full", [16, 256, merkle.BLOCK])
def test_manifest(spark, scratch, leaves, full):
    """Whatever the size of a block: several layers of blocks, or one."""
    got = merkle.manifest(scratch, spark.createDataFrame(leaves, DOCS).repartition(5), merkle.every_fifth(), full).select(*MANIFEST)
    assert Counter(map(tuple, got.collect())) == plain_manifest(leaves)


def test_manifest_of_nothing_and_one(spark, scratch, none, leaves):
    assert merkle.manifest(scratch, none, merkle.every_fifth()).count() == 0
    (one,) = merkle.manifest(scratch, spark.createDataFrame(leaves[3:4], DOCS)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")


def test_tampering_shows(spark, scratch, leaves):
    got = merkle.manifest(scratch, spark.createDataFrame(leaves, DOCS), merkle.every_fifth()).collect()
    upper = {r[0] for r in leaves if r[1] and r[0] is not None and r[1] != r[1].translate(LOWER) and zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert {r.doc_id for r in got if not r.verified} == upper and upper


# Line dedup


def plain_lines(rows, least, shared):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(r[0])
    gone = {k: max(d) for k, d in holders.items() if len(d) >= shared}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if key(x) not in gone or gone[key(x)] == r[0]]
        out.append((r[0], len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return Counter(out)


@pytest.fixture(scope="module")
def paged():
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abcdefghijklmnop é") for _ in range(rnd.randint(36, 60))) for _ in range(60)]
    dress = lambda x: rnd.choice([x, x.upper(), f"  {x}\t", f"\x0b{x}\r"])
    rows = []
    for k in range(120):
        lines = [dress(rnd.choice(pool[: rnd.choice([1, 8, 60])])) for _ in range(rnd.randint(0, 9))] + ["short"] * rnd.randint(0, 2) + [""] * rnd.randint(0, 2)
        rnd.shuffle(lines)
        rows.append((k * 3, "\n".join(lines), "en", "s", 1, *EXTRA))
    long = "\n".join(f"{'every line of this text is its own, number'} {k}" for k in range(3000))
    spaced = pool[0] + " " * 50_000 + "end"
    rows += [(900, None, None, None, None, *EXTRA), (901, "", None, None, None, *EXTRA), (902, "\n", None, None, None, *EXTRA), (903, long, "en", "s", 1, *EXTRA), (904, long, "en", "s", 1, *EXTRA), (905, spaced, "en", "s", 1, *EXTRA)]
    rows += [(None, pool[0] + "\n" + pool[1], None, None, None, *EXTRA), (None, pool[0], None, None, None, *EXTRA), rows[4], rows[4], (12, pool[0] + "\nother", "en", "s", 1, *EXTRA), (-5, "\n".join(pool), "en", "s", 1, *EXTRA)]
    return rows


@pytest.mark.parametrize(("batches", "fan", "shared", "hot"), [(1, 2, 5, 20_000), (4, 2, 5, 20_000), (6, 3, 2, 3), (5, 2, 1, 0)])
def test_lines(spark, scratch, paged, batches, fan, shared, hot):
    """Whatever the batches, the fan of the levels and the bar of hot keys; a bar of 0 broadcasts none."""
    docs = spark.createDataFrame(paged, DOCS).repartition(3)
    got = line_dedup.digests(scratch, docs, batches=batches, fan=fan, shared=shared, hot=hot).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == plain_lines(paged, 40, shared)


def test_lines_of_nothing(scratch, none):
    assert line_dedup.digests(scratch, none).count() == 0


def test_runs_hold_each_key_once(spark, scratch):
    """Levels after each batch, and runs that stay sorted by bucket and need no shuffle to be met."""
    runs = line_dedup.Runs(scratch, 4, 2)
    batch = lambda *keys: spark.createDataFrame([(k, k, 1, 1, k) for k in keys], "h1 long, h2 long, docs long, lines long, keep long")
    seen, levels = [], []
    for keys in ((1, 2, 3), (2, 3, 4, 5), (1, 6), (7, 8, 1), (5, 9)):
        seen.append(sorted(r.h1 for r in runs.add(batch(*keys)).collect()))
        levels.append([len(x) for x in runs.levels])
    assert seen == [[], [2, 3], [1], [1], [5]]
    assert levels == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    held = [sorted(r.h1 for r in x.collect()) for x in runs.all()]
    assert sorted(sum(held, [])) == list(range(1, 10))
    plan = runs.lacking(runs.all()[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    runs.forget(*runs.all())


# Alignment

A = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
B = (public_tokenizers.path("piece_bpe_32k.model"),)


def plain_alignment(rows):
    """Token by token, from the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A[0]), sentencepiece.SentencePieceProcessor(model_file=B[0])
    a.encode_special_tokens = True
    table = alignment.byte_letters()
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    docs, corpus = [], Counter()
    for r in rows:
        text, links, groups = r[1], [], []
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        pa = [bytes(table[c] for c in a.id_to_token(k)) for k in ia]
        pb = [piece(k) for k in ib]
        if text and b"".join(pa) == b"".join(pb) == b" " + text.encode():
            ends = lambda ps: [sum(map(len, ps[: k + 1])) for k in range(len(ps))]
            ea, eb = ends(pa), ends(pb)
            links = [(x, y) for x, e in zip(ia, ea, strict=True) for y, f in zip(ib, eb, strict=True) if e == f]
            last = 0
            for cut in sorted(set(ea) & set(eb)):
                side = lambda ids, es, last=last, cut=cut: ",".join(str(k) for k, e in zip(ids, es, strict=True) if last < e <= cut)
                groups.append(side(ia, ea) + "|" + side(ib, eb))
                last = cut
        else:
            ia = ib = []
        corpus.update(links)
        docs.append((r[0], len(ia), len(ib), groups, links))
    best = {}
    for (_, y), n in corpus.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((d, na, nb, len(g), len(li), sum(corpus[p] == best[p[1]] for p in li), sum(corpus[p] for p in li), sha(";".join(g)) if na else "") for d, na, nb, g, li in docs)


@pytest.fixture(scope="module")
def spoken():
    rnd = random.Random(7)
    words = ["the", "Tokenizer", "straße", "été", "naïve", "東京", "emoji😀", "x1y2", "don't", "  ", "\n\n", "<|endoftext|>", "<s>", "٣٤", "​", "a" * 40]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))), "en", "s", 1, *EXTRA) for k in range(80)]
    odd = [None, "", " ", "▁ is read as a space", "ﬁ ligature", "\x00 control", "a", " lead", "trail ", "\r\n", "🇫🇷", "é", "x" * 5000, ("word " * 4000)]
    return rows + [(1000 + k, t, None, None, None, *EXTRA) for k, t in enumerate(odd)] + [rows[3], (3, "again", None, None, None, *EXTRA), (None, "no id", None, None, None, *EXTRA)]


FIGURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot", [20_000, 4, 0])
def test_alignment(spark, scratch, spoken, hot):
    got = alignment.align(scratch, spark.createDataFrame(spoken, DOCS).repartition(3), A, B, hot).select(*FIGURES)
    want = plain_alignment(spoken)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(1 for r in want if r[1] == 0) >= 3  # null, empty, and texts that do not come back


def test_alignment_by_spans(spark, spoken, scratch, none):
    """The length of what is laid end to end changes nothing, nor does the form of A."""
    docs = spark.createDataFrame(spoken, DOCS)
    rows = lambda *a: Counter((r.doc_id, r.groups_sha256, tuple(r.pairs), tuple(r.times)) for r in alignment.encoded(docs, *a).collect())
    assert rows(A, B, 1) == rows(A, B) == rows(A[:1], B, 700)
    assert alignment.align(scratch, none, A, B).count() == 0


def test_long_white_space():
    """A run that the faster form of A has no stack for."""
    side = alignment.byte_level(*A)
    (ids,) = side.encode([" " * 1_500_000 + "x"])
    assert b"".join(side.pieces[k] for k in ids) == b" " * 1_500_000 + b"x"
