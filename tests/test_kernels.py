"""Kernels against brute force, and goldens worked out by hand from the rules."""

import itertools
import math
import random

import numpy as np
import pytest

from sigloom.functions.text import GAP
from sigloom.operators import align as A
from sigloom.operators import mining, probability
from sigloom.operators.cluster import Cluster, agglomerate, backtrack, edges
from sigloom.operators.scoring import float_step
from sigloom.operators.signatures import AnyOf, Bayes, BayesTree, Innocuous, LongestSubstring, Ordered, OrderedTree, Pattern, Substring, presets, settled, token_places

THREE = ["gagghua one afehauifheau two heuighriga three", "afeaffeafea one grhugeegvbn two agrgexz three", "one ghuah two paenv three feahuone"]


def brute_substrings(samples, min_len, min_occ):
    found = {}
    for i, s in enumerate(samples):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                n, nexts, _ = found.setdefault(s[a:b], ({}, set(), 0))
                n[i] = n.get(i, 0) + 1
                nexts.add(s[b] if b < len(s) else ("end", i))
    return {t: n for t, (n, nexts, _) in found.items() if len(t) >= min_len and len(n) >= min_occ and len(nexts) > 1}


@pytest.mark.parametrize("seed", range(60))
def test_common_substrings(seed):
    rng = random.Random(seed)
    samples = ["".join(rng.choice("ab" if seed % 2 else "abc\0é") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
    for occ in (1, 2, len(samples)):
        assert mining.common_substrings(samples, 1, occ) == brute_substrings(samples, 1, occ)


@pytest.mark.parametrize("seed", range(6))
def test_pruning_needs_no_strings_without_occurrences_of_their_own(seed):
    rng = random.Random(seed)
    for _ in range(150):
        alphabet = "ab" if rng.random() < 0.5 else "abcdef"
        samples = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(rng.randint(2, 5))]
        samples += [rng.choice(samples) + rng.choice(["", "a", samples[0]]) for _ in range(2)] + [rng.choice(samples) * 2]
        for occ in (2, 3):
            some = mining.common_substrings(samples, 1, occ, False)
            want = mining.pruned(mining.common_substrings(samples, 1, occ), occ)
            assert list(mining.pruned(some, occ).items()) == list(want.items())


def test_long_copies_make_few_tokens():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20000))
    found = mining.common_substrings([text, "x" + text], 6, 2, False)
    assert text in found and len(found) < 100
    assert mining.pruned(found, 2)[text] == {0: 1, 1: 1}


def test_pruning_takes_what_lies_in_longer_tokens():
    tokens = mining.common_substrings(["xabc1", "yabc2"], 2, 2)
    assert set(tokens) == {"abc", "bc"}
    assert mining.pruned(tokens, 2) == {"abc": {0: 1, 1: 1}}
    # overlapping occurrences are counted, disjoint ones subtracted
    assert mining.common_substrings(["aaaa", "aaab"], 2, 2)["aa"] == {0: 3, 1: 2}


def brute_align(a, b, gap):
    gap = np.float32(gap)
    n, m = len(a), len(b)
    cost, way = np.zeros((n + 1, m + 1), np.float32), {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d = cost[i - 1, j - 1]
            if a[i - 1] == b[j - 1] and a[i - 1] != GAP:
                d = d + np.float32(1)
            elif i > 1 and j > 1 and a[i - 2] == b[j - 2]:
                d = d - gap
            left = cost[i, j - 1] - (gap if j > 1 and a[i - 1] == b[j - 2] else np.float32(0))
            up = cost[i - 1, j] - (gap if i > 1 and a[i - 2] == b[j - 1] else np.float32(0))
            best, move = d, "d"
            if left > best:
                best, move = left, "l"
            if up > best:
                best, move = up, "u"
            cost[i, j], way[i, j] = best, move
    out, i, j, last = [], n, m, False
    while i and j:
        if way[i, j] == "d" and a[i - 1] == b[j - 1] and a[i - 1] != GAP:
            out, last = [a[i - 1], *out], True
        else:
            out, last = ([GAP, *out] if last else out), False
        i, j = i - (way[i, j] != "l"), j - (way[i, j] != "u")
    return out


@pytest.mark.parametrize("seed", range(60))
def test_alignment(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice([1, 2, 3, GAP]) for _ in range(rng.randint(0, 12))] for _ in range(2))
    got = A.align(a, b, 0.8)
    assert got == brute_align(a, b, 0.8)
    if GAP not in a + b:
        text = lambda s: "".join(map(chr, s))
        assert Ordered(A.tokens_of(got)).match(text(a)) and Ordered(A.tokens_of(got)).match(text(b))


def test_alignment_helpers():
    assert A.tokens_of([97, GAP, 98, 99]) == ["a", "bc"]
    assert A.pattern_of([97, GAP, 46]) == r"a.*\."
    assert A.painted("xabyab", ["ab"]) == [GAP, 97, 98, GAP, 97, 98]
    assert A.escaped("a b\x01.") == r"a\ b\x01\."


def test_conflicts():
    scores = {"ab": 1.0, "bc": 2.0, "abc": 0.5, "c": 3.0}
    assert token_places("abc", ["ab", "abc", "c"]) == {0: "abc", 2: "c"}
    assert settled({0: "ab", 1: "bc"}, scores, False, False) == ["bc"]
    assert settled({0: "abc", 2: "c"}, scores, False, True) == ["c"]
    assert settled({0: "ab", 1: "bc"}, scores) == ["ab", "bc"]


def brute_partition(token, share, least):
    best = 0
    for cuts in itertools.product((0, 1), repeat=len(token) - 1):
        parts, part = [], token[0]
        for c, cut in zip(token[1:], cuts, strict=True):
            if cut:
                parts.append(part)
                part = ""
            part += c
        parts.append(part)
        if all(len(p) > least for p in parts[:-1]):
            best = max(best, math.prod(min(0.999, share(p)) for p in parts))
    return best


@pytest.mark.parametrize("seed", range(20))
def test_partition(seed):
    rng = random.Random(seed)
    token = "".join(rng.choice("ab") for _ in range(7))
    shares = {p: rng.random() for p in probability.pieces_of(token)}
    p, pieces = probability.best_partition(token, shares.get, least=seed % 3)
    assert "".join(pieces) == token and p == pytest.approx(brute_partition(token, shares.get, seed % 3))


def test_chains():
    # an even stream of bits holds "1" after one symbol half of the time, and "11" is the slower the longer
    assert probability.token_prob("1", 3, symbols=2) == pytest.approx([0, 0.5, 0.75, 0.875])
    assert probability.pattern_prob("a.*b", 2)[2] == pytest.approx(1 / 256**2)
    assert probability.literal_pieces(".*a.{2}b.*c.*") == [("ab", 2), ("c", 0)]
    rng = random.Random(1)
    hits = sum(sum(rng.randrange(4) == 0 for _ in range(10)) >= 2 for _ in range(4000)) / 4000
    assert probability.subsequence_prob(2, 10, 4) == pytest.approx(hits, abs=0.03)
    stats = {"": (10, {"a": 5, "b": 5}), "a": (5, {"b": 5})}
    assert probability.symbol_prob("a", "b", stats) == 1
    assert probability.symbol_prob("", "z", stats) == 0.1


def test_estimate_is_no_less_than_the_share():
    pool = Innocuous(["xxabcyy", "abczz", "qq", "abab"])
    assert pool.chance("abc") >= 0.5
    assert pool.chance(".*") < 0.5  # a token is literal


def test_float_step():
    for x in (0.0, 1.0, 3.7, 1e20, -5.0):
        e = float_step(x)
        assert x + e != x and x - e != x


def test_learners():
    assert LongestSubstring().train(THREE) == [Substring(" three")] or all(LongestSubstring().train(THREE)[0].token in s for s in THREE)
    with pytest.raises(ValueError):
        LongestSubstring().train(["ab", "cd"])
    assert Substring("").match("anything") and Ordered([]).match("x") and Pattern("a.c").match("a\nc") and not Pattern("b").match("ab")
    seq = OrderedTree(kfrac=1.0, tokenize_all=True, do_cluster=False).train(THREE)[0]
    assert all(seq.match(s) for s in THREE) and any("two" in t for t in seq.tokens)
    background = Innocuous(["nothing of the kind", "one and only", "feahu"] * 3)
    bayes = Bayes(innocuous=background).train(THREE)[0]
    assert all(bayes.match(s) for s in THREE) and not any(bayes.match(s) for s in background.streams)
    with pytest.raises(ValueError):
        Bayes().train(["one"])
    with pytest.raises(NotImplementedError):
        OrderedTree(use_fixed_gaps=True)
    for name, learner in presets(background).items():
        for sig in learner.train(THREE + THREE[:1]):
            assert isinstance(str(sig), str), name


def test_bounded_threshold():
    background = Innocuous([f"one {i} three" for i in range(20)])
    for style in ("bound", "bound_aggressive"):
        sig = Bayes(threshold=style, max_fpos=2, innocuous=background).train(THREE)[0]
        assert sum(sig.match(s) for s in background.streams) <= 2


def test_clusters():
    points = [0, 1, 10, 11, 50]

    def merge(a: Cluster, b: Cluster):
        own = [points[i] for i in a.samples + b.samples]
        return tuple(sorted(own)), 100 - (max(own) - min(own))

    for bound in (False, True):
        roots = agglomerate(5, merge, 80, bound)
        assert sorted(sorted(c.samples) for c in roots) == [[0, 1, 2, 3], [4]]
    left = backtrack(roots, lambda cs: {c.index: 9 if len(c.samples) > 2 else 0 for c in cs}, 5, 2)
    assert sorted(sorted(c.samples) for c in left) == [[0, 1], [2, 3], [4]]
    assert len(edges(roots)) == 6
    two = ["aa shared x bb"] * 3 + ["cc other y dd"] * 3
    sigs = BayesTree(spec_threshold=3, innocuous=Innocuous(["zz"])).train(two)
    assert AnyOf(sigs).match(two[0]) and AnyOf(sigs).match(two[5])


def test_pruning_equals_subtracting_from_the_longest():
    rng = random.Random(11)
    for _ in range(60):
        tokens = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))): {s: rng.randint(1, 5) for s in range(4) if rng.random() < 0.7} for _ in range(9)}
        want = {}
        for t in sorted(tokens, key=len, reverse=True):
            want[t] = [tokens[t].get(s, 0) - sum(want[u][s] * u.count(t) for u in want if len(u) > len(t)) for s in range(4)]
        rows = {t: {s: n for s, n in enumerate(c) if n > 0} for t, c in want.items()}
        assert mining.pruned(tokens, 2) == {t: c for t, c in rows.items() if len(c) >= 2}
