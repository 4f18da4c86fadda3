"""Parts of the operators against plain Python."""

import math

import numpy as np
import pytest

from talus.llm import bpe, chaining, exact_dedup, mixing, ngram_join, quality, shingles, suffix, suffix_dedup, toxicity, vectors


def test_bpe_equals_library():
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    keys, ids = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(keys, ids, P.PATTERN)
    assert (codec.hash.lookup(keys) == np.arange(len(keys))).all()  # perfect and minimal
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(zip(keys, ids, strict=True)), special_tokens={})
    texts = ["", " ", "a" * 3000, "!?" * 900, "Ünï cödé 漢字 🙂🙂", "x\r\n\n  y\t", "<|endoftext|>", "\x1c\x85\xa0", "it's we'll 12345 ½"]
    texts += ["".join(chr(c) for c in range(k, k + 400)) for k in range(0, 0xD000, 400)]
    for text, packed in zip(texts, codec.encode(texts, 500), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == own.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 60)), 0)
        plain = s.tolist()
        want = sorted(range(len(s)), key=lambda i: plain[i:])
        assert suffix.suffix_array(s).tolist() == want
        before, length = suffix.common_prefixes(s, np.array(want), 9)
        for i, j in zip(want[1:], want, strict=False):
            n = 0
            while max(i, j) + n < len(s) and plain[i + n] == plain[j + n]:
                n += 1
            assert before[i] == j and (length[i] == n if n < 9 else 9 <= length[i] <= n)


def test_suffix_array_recurses(monkeypatch):
    """Repetitive strings of many names, as digits and as they are."""
    rng = np.random.default_rng(2)
    for digits, small in ((2, 0), (8, 0), (512, 0), (512, 20), (512, 1 << 14)):
        monkeypatch.setattr(suffix, "DIGITS", digits)
        monkeypatch.setattr(suffix, "SMALL", small)
        for _ in range(60):
            part = rng.integers(1, rng.integers(3, 200), rng.integers(1, 40))
            s = np.concatenate([part, rng.integers(1, 200, rng.integers(0, 30)), part, np.tile(part[:7], 5), [0]])
            plain = s.tolist()
            assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: plain[i:])


def test_recurring_windows():
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 100, 90))
    segments = [base[a : a + 40] for a in (0, 7, 30, 50)] + [bytes(rng.integers(97, 99, 35)) for _ in range(5)]
    seen: dict[bytes, int] = {}
    for x in segments:
        for k in range(len(x) - 11):
            seen[x[k : k + 12]] = seen.get(x[k : k + 12], 0) + 1
    for x, got in zip(segments, suffix_dedup.recurring(segments, 12), strict=True):
        assert got.tolist() == [k for k in range(len(x) - 11) if seen[x[k : k + 12]] > 1]


def test_anchors_follow_content():
    rng = np.random.default_rng(3)
    part = bytes(rng.integers(97, 123, 500))
    texts = [b"x" * 37 + part, part + b"y" * 11, b"short", b""]
    owner, key, seg, first, last, at = suffix_dedup.anchors(texts, 200)
    spots = {k: {(int(f), int(g)) for o, f, g in zip(owner, at, key, strict=True) if o == k} for k in (0, 1)}
    assert {(f - 37, g) for f, g in spots[0] if f >= 37 + 136} & spots[1]
    for k, text in enumerate(texts):
        covered = sorted(s for o, a, b in zip(owner, first, last, strict=True) if o == k for s in range(a, b + 1))
        assert covered == list(range(max(0, len(text) - 199)))


def test_chunks_find_themselves():
    rng = np.random.default_rng(4)
    body = bytes(rng.integers(97, 123, 20000))

    def cut(d):
        ends = exact_dedup.cut_points(d, 256, 10, 8192)
        return [d[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    one, two = cut(body), cut(b"new start " + body)
    assert b"".join(one) == body and len(set(one) & set(two)) > len(one) // 2
    assert exact_dedup.cut_points(b"", 256, 10, 8192) == [] and max(map(len, cut(b"a" * 50000))) <= 8192


def test_shingles():
    texts = ["A b  c\td e f", "a B c d e F", "one two", "one  TWO", "", None, " \n", "x" * 50]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 0, 1]
    assert (sets[0] == sets[1]).all() and (sets[2] == sets[3]).all()
    h, bounds = shingles.word_hashes(["a b a", "b"])
    assert bounds.tolist() == [0, 3, 4] and h[0] == h[2] and h[1] == h[3] != h[0]
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab \t\n"), rng.integers(0, 300))) for _ in range(40)] + ["x" * 500, " " * 300, ""]
    want, ends = shingles.word_hashes(texts)
    assert np.diff(ends).tolist() == [len(t.split()) for t in texts]
    for piece in (1, 70, 333):
        got, same = shingles.word_hashes(texts, piece)
        assert (got == want).all() and (same == ends).all()
    one = ["a"]
    while len(one) < 2048:
        one += ["b" if c == "a" else "a" for c in one]
    word = "".join(one)  # Thue-Morse and its complement meet under sums of powers modulo 2**64
    h, _ = shingles.word_hashes([word, word.translate({97: 98, 98: 97})])
    assert h[0] != h[1]


def test_split_quota():
    words = np.array([5, 0, 100, 7, 3, 3, 0, 50])
    for quota in (0, 1, 84, 168):
        got = mixing.split_quota(words, quota, [1])
        assert got.sum() == quota and (got >= 0).all() and (got <= words).all()
    assert (mixing.split_quota(words, 84, [1]) == mixing.split_quota(words, 84, [1])).all()
    big = np.array([3 * 10**13, 10**13])
    drawn = np.array([mixing.split_quota(big, 4 * 10**9, [k])[0] for k in range(300)], float)
    assert abs(drawn.mean() - 3 * 10**9) < 4 * 27386 / 300**0.5 and 0.85 < drawn.std() / 27386 < 1.15  # mean and deviation of the law
    rng = np.random.default_rng(2)
    got = np.bincount([mixing.large_draw(7, 5, 6, rng) for _ in range(20000)], minlength=8) / 20000
    exact = [math.comb(7, k) * math.comb(5, 6 - k) / math.comb(12, 6) if k <= 6 and 6 - k <= 5 else 0 for k in range(8)]
    assert np.abs(got - exact).max() < 0.015
    assert abs(mixing.log_binomial(3, 10, 0.4) - math.log(math.comb(10, 3) * 0.4**3 * 0.6**7)) < 1e-12
    mean = np.mean([mixing.split_quota(words, 84, [k])[2] for k in range(300)])
    assert abs(mean - 50) < 1.5


def plain_kernel(s, t):
    """The subsequence kernel by its definition."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), toxicity.ORDER):
        for j in combinations(range(len(t)), toxicity.ORDER):
            if [s[k] for k in i] == [t[k] for k in j]:
                total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


@pytest.mark.parametrize(("s", "t"), [("clown", "cloown"), ("abcab", "bcabc"), ("abcdef", "xyz"), ("aaaaa", "aaaa")])
def test_kernel(s, t):
    a, b = toxicity.as_codes([s], 8), toxicity.as_codes([t], 8)
    assert np.isclose(toxicity.kernel(toxicity.equality(a, b))[0], plain_kernel(s, t), rtol=1e-4)


def test_machine_tolerates_gaps():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("etaoinshr"), 6))
    clean = [({word() for _ in range(30)}, 0) for _ in range(80)]
    toxic = [({word() for _ in range(30)} | {"grumblor"}, 1) for _ in range(60)]
    machine = toxicity.Machine(clean + toxic)
    good = machine.scores([" ".join(sorted(u)) for u, _ in clean])
    bad = machine.scores(["the sea grumblor is", "grum-blor here", "see g r u m b l o r now", "grumxblor"])
    assert max(good) < 0.5 < min(bad)
    assert machine.scores(["", "a"])[0] == machine.scores(["zzz"])[0]
    assert 0 < toxicity.Machine([({"a"}, 0)]).scores([""])[0] < 0.5


def test_discriminant():
    rng = np.random.default_rng(6)
    n, d = 400, quality.D
    x0, x1 = rng.normal(0, 1, (n, d)), rng.normal(0.8, 2, (n, d))
    one = lambda x: np.column_stack([np.ones(len(x)), x])
    sums = {c: (m := one(x).T @ one(x))[0, 0] and (m[0, 0], m[0, 1:], m[1:, 1:]) for c, x in ((0, x0), (1, x1))}
    model = quality.Discriminant(sums)
    assert (model.score(x1) >= 0.5).mean() > 0.9 and (model.score(x0) < 0.5).mean() > 0.9
    zero = (0.0, np.zeros(d), np.zeros((d, d)))
    assert quality.Discriminant({0: zero, 1: zero}).score(x0[:1])[0] == 0.5
    assert np.isfinite(quality.statistics(["", "a", "\n\n"])).all()


def test_links():
    rng = np.random.default_rng(7)
    a = vectors.unit(np.repeat(rng.normal(size=(12, 48)), 5, axis=0) + rng.normal(scale=0.2, size=(60, 48)))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if a[i] @ a[j] >= 0.93}
    assert want and set(zip(*map(list, vectors.links(a, a, 0.93, True)), strict=True)) == want
    low = vectors.forest(np.array([0, 3]), np.array([1, 1]), 5)
    assert low.tolist() == [0, 0, 2, 0, 4]


def test_chain():
    runs = [(0, 0, 10), (12, 13, 10), (30, 5, 9), (40, 41, 12)]
    assert chaining.chain(runs, 20)[0] == [runs[0], runs[1], runs[3]]
    assert chaining.chain([(0, 0, 5)], 20) == []
    assert chaining.extend([1, 2], [1, 3]) == 1
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).tolist() for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert chaining.common(a, b) == best[-1, -1]


def test_chain_scores():
    """Scores equal those over all pairs of runs."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        runs = sorted({(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, 300, 30), rng.integers(0, 300, 30), rng.integers(5, 30, 30), strict=True)})
        score = []
        for a, b, n in runs:
            gaps = [(score[j], a - x - m, b - y - m) for j, (x, y, m) in enumerate(runs[: len(score)])]
            score.append(n + max([0.0, *(s - chaining.GAP_COST * (p + q) for s, p, q in gaps if p >= 0 and q >= 0)]))
        first = chaining.chain(runs, 1)[0]
        cost = sum(chaining.GAP_COST * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2]) for p, q in zip(first, first[1:], strict=False))
        assert abs(sum(r[2] for r in first) - cost - max(score)) < 1e-6


def test_aligned_splits():
    """A long run chained across a wide gap is a link of its own."""
    far = [list(range(100, 180)), list(range(300, 380))]
    got = list(chaining.aligned([[], far[0], []], [[], far[1], []], [0, 180], [0, 180], [100, 60], 40, 0.75))
    assert sorted((g[0], g[1], g[4]) for g in got) == [(0, 100, 100), (180, 240, 60)]


def test_needed():
    for n in range(1, 50):
        assert all(4 * i >= 3 * n for i in range(ngram_join.needed(n), n + 1))
        assert 4 * (ngram_join.needed(n) - 1) < 3 * n
