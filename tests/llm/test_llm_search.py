"""Clustering, tensored MinHash and lexical search against plain versions, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from gridmeter.llm import drift, lexical, tensored

# --- clustering


def plain_clusters(rows, k=8, rounds=10):
    """(clusters by row, centroids) by comparing every vector with every centroid in every round."""
    x = [[math.floor(1024 * float(v)) for v in e] for _, e in rows]
    order = sorted(range(len(rows)), key=lambda i: ("~" if rows[i][0] is None else hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), x[i]))[:k]
    centroids = [x[i] for i in order]
    for turn in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in x]
        own = [min(range(len(centroids)), key=lambda i: (row[i], i)) for row in d]
        if turn < rounds:
            for i in range(len(centroids)):
                mine = [v for v, o in zip(x, own, strict=True) if o == i]
                if mine:
                    centroids[i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return own, [row[o] for row, o in zip(d, own, strict=True)], centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, cluster int, block string")


def clumps(n, seed, dims=64, middles=12, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (middles, dims))
    x = centre[rng.integers(0, middles, n)] + rng.normal(0, spread, (n, dims))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def test_clusters_equal_comparing_all(spark):
    rows = clumps(600, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a third are one vector
    rows += [(None, rows[5][1]), (7, rows[7][1])]
    scanned = []
    found, centroids = drift.cluster(frame(spark, rows), block=64, scanned=scanned)
    own, distance, want = plain_clusters(rows)
    assert centroids.tolist() == want
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(zip([i for i, _ in rows], own, distance, strict=True), key=key)
    assert scanned[0] == len(rows) and min(scanned[1:]) < 0.2 * len(rows)
    told = drift.with_inertia(found, centroids).collect()
    assert {r.inertia for r in told} == {sum(distance)}
    assert all(r.cluster_inertia == sum(d for o, d in zip(own, distance, strict=True) if o == r.cluster) for r in told)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, want[r.cluster])).encode()).hexdigest() for r in told)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_of_nearing_hold_and_are_below_the_move(seed):
    rng = np.random.default_rng(seed)
    tighter = 0
    for _ in range(200):
        dims = int(rng.integers(2, 6))
        ball, old = rng.normal(0, 1, dims), rng.normal(0, 3, dims)
        new, radius = old + rng.normal(0, 1, dims), abs(rng.normal(0, 0.5))
        bound = drift.nearing(ball, radius, old, new)
        way = rng.normal(0, 1, (2000, dims))
        x = ball + radius * way / np.linalg.norm(way, axis=1)[:, None] * rng.uniform(0, 1, (2000, 1)) ** 0.2
        assert (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max() <= bound + 1e-9
        assert bound <= np.linalg.norm(new - old) + 1e-9
        tighter += bound < 0.9 * np.linalg.norm(new - old)
    assert tighter > 50


def test_vectors_that_do_not_count(spark):
    good = clumps(20, 4)
    bad = [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [1.0] * 63 + [float("nan")]), (104, [float("inf")] * 64), (105, [])]
    found, _ = drift.cluster(frame(spark, good + bad))
    assert sorted(r.vec_id for r in found.collect()) == list(range(20))
    few, centroids = drift.cluster(frame(spark, good[:3]))
    assert len(centroids) == 3 and {r.distance for r in few.collect()} == {0}
    none, centroids = drift.cluster(frame(spark, bad))
    assert none.columns == ["vec_id", "cluster", "distance"] and drift.with_inertia(none, centroids).collect() == []
    with pytest.raises(Exception, match="components must be below"):
        drift.cluster(frame(spark, [(1, [1e9] * 64)]))


def test_equal_distances_and_wide_components(spark):
    wide = [(i, [float((i * 7919 + j * 104729) % 200_001 - 100_000) for j in range(64)]) for i in range(40)]
    found, _ = drift.cluster(frame(spark, wide))
    own, distance, _ = plain_clusters(wide)
    assert sorted(map(tuple, found.collect())) == sorted(zip(range(40), own, distance, strict=True))
    same = [(i, [0.5] * 64) for i in range(30)]
    found, centroids = drift.cluster(frame(spark, same))
    assert len(centroids) == 8 and {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)}


# --- tensored MinHash


def plain_components(texts, width=5):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, groups=12, large=60):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 300))]
        texts += [edited(base, rng, rng.randrange(0, 5)) for _ in range(large if g == 0 else rng.randrange(1, 6))]
    chain = [f"c{i}" for i in range(200)]  # each similar to the next, not to all
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[4:] + [f"d{rng.randrange(10**6)}" for _ in range(4)]
    texts += ["", None, "  \n", "one two", "ONE\ttwo", "one two three four five", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [512, 8])
def test_components_equal_all_pairs(spark, block):
    texts = corpus(block)
    want, sizes = plain_components(texts)
    found = tensored.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, want, strict=True))}


def test_one_large_group_of_near_copies_stays_linear(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(base, rng, 1)) for i in range(1500)]
    points = tensored.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 5, "text", "doc_id").select("fp", "bands").dropDuplicates(["fp"])
    assert tensored.meetings(points).count() <= tensored.SIDE**2 * len(rows)
    found = tensored.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=128).collect()
    assert len(found) == len(rows) and {r.component_id for r in found} == {0}


def test_odd_documents(spark):
    schema = "doc_id long, text string, fp long, label long, key string, bands string, size int"
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " tail"), (2, long + " tail"), (None, long), (None, None), (5, None), (5, ""), (6, "a b c d e f"), (7, "A b c d e f")]
    found = tensored.near_duplicates(spark.createDataFrame([(i, t, 1, 1, "k", "b", 2) for i, t in rows], schema)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.component_id) for r in found), key=key) == sorted(
        [(1, 1), (2, 1), (2, 1), (None, 1), (None, None), (5, 5), (5, 5), (6, 6), (7, 6)], key=key)
    assert tensored.near_duplicates(spark.createDataFrame([], schema)).collect() == []


# --- lexical search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, top=10):
    terms = [(i, plain_terms(t)) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    big_n, big_l = len(terms), sum(len(t) for _, t in terms)
    out = []
    for item, text in items:
        want = plain_terms(text)
        w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * sum(t in d for _, d in terms) + 1))) for t in set(want)} if big_n else {}
        told = []
        for i, d in terms:
            m = 100 - 75 + (75 * len(d) * big_n) // big_l
            score = sum(w[t] * ((1_000_000_000 * d.count(t)) // (1000 * d.count(t) + 8 * m)) for t in want)
            if score > 0:
                told.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(told)[:top], 1)]
    return out


def search(spark, docs, items, **settings):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, score long, rank string, item_id int")
    items = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    found = lexical.rank(docs, items, **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=lambda r: tuple(map(repr, r)))


ALPHABET = ["alpha", "Beta", "gam", "gamma", "é", "É", "été", "naïve", "x1", "1", "日本", "日", "🙂", "ßa", "beta"]
SEPARATORS = [" ", "  ", "\n", "-", "_", "\x00", "\x7f", ", ", "'", "\t"]


def text(rng, n):
    return "".join(rng.choice(ALPHABET) + rng.choice(SEPARATORS) for _ in range(n))


@pytest.mark.parametrize("pairs", [lexical.PAIRS, 15])
def test_ranks_equal_a_plain_version(spark, pairs):
    rng = random.Random(pairs)
    docs = [(i, text(rng, rng.randrange(0, 40))) for i in range(150)] + [(200 + i, "alpha beta") for i in range(40)]
    docs += [(None, "alpha gamma"), (None, None), (7, "alpha"), (8, ""), (9, "--- \x00"), (300, "alpha " * 50_000 + "gamma")]
    items = [(i, text(rng, rng.randrange(1, 12))) for i in range(12)] + [(50, None), (51, " - "), (52, "nowhere"), (None, "beta É"), (53, "gam gam alpha")]
    assert search(spark, docs, items, pairs=pairs) == sorted(plain_ranks(docs, items), key=lambda r: tuple(map(repr, r)))


def test_repeated_items_and_empty_tables(spark):
    docs, items = [(1, "a b c"), (2, "a a")], [(1, "a"), (1, "a"), (1, "b")]
    assert search(spark, docs, items) == sorted(plain_ranks(docs, [(1, "a"), (1, "b")]), key=lambda r: tuple(map(repr, r)))
    assert search(spark, [], items) == [] and search(spark, docs, []) == [] and search(spark, [(1, " ")], items) == []


def test_scores_are_exact_integers():
    value = np.array([(1 << 40) + 1, (1 << 41) + 3, 5])
    postings = (np.array([0, 2, 2]), np.array([2, 0, 1]), np.array([0, 1, 1]), np.array([3, 70_001, 1]))
    found = lexical.scores(np.array([0, 2, 0]), value, np.array([0, 0, 1]), 2, postings, 2)
    assert found.tolist() == [[3 * ((1 << 40) + 1), 70_001 * ((1 << 40) + 1) + (1 << 41) + 3], [15, 350_005]]
