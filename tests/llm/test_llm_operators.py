"""The training-data operators against brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from gridmeter.llm import components, golay, langid, lines, mixing, multiset, packing, rangecoder, sharding, simhash, similar, substrings, tokenfiles, tokens, warc
from gridmeter.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, rank int, row string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, l, s, None if t is None else len(t), "x", 7, "y") for i, t, l, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int, stock: int = 400) -> list[str]:
    return [f"w{rng.randrange(stock)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, shared passages, a row given twice."""
    rng = random.Random(3)
    passage = prose(rng, 30)
    base = prose(rng, 120)
    rows = [(i, " ".join(prose(rng, rng.randrange(1, 90))), "en", "a") for i in range(40)]
    rows += [(100 + i, " ".join(base), "en", "b") for i in range(12)]
    rows += [(200 + i, " ".join([*base[:60], f"n{i}", *base[61:]]), "en", "b") for i in range(12)]
    rows += [(300 + i, " ".join([*prose(rng, 20), *passage[: rng.randrange(12, 31)], *prose(rng, 20)]), "de", "c") for i in range(12)]
    rows += [(400, None, None, None), (401, "", "en", None), (402, " \t\n", None, "a"), (403, "éè 你好", "fr", "a"), (None, " ".join(passage), "en", "a")]
    rows += [(404, " ".join(prose(rng, 30_000, 10**6)), "en", "a"), (405, "A b\nA b\n\na  B\n" * 30, "en", "a"), (405, "A b\nA b\n\na  B\n" * 30, "en", "a")]
    return rows


def brute_passages(rows, width=13):
    docs = [(float("inf") if i is None else i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for d, w in docs:
        for k in range(len(w) - width + 1):
            gram = tuple(w[k : k + width])
            first[gram] = min(first.get(gram, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < d:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if d == float("inf") else d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=repr)


# 1 language


def test_language_held_out_accuracy_and_rejection(spark):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "th", "and", "er"], "fr": ["eau", "ée", "que", "oi", "ment"], "de": ["sch", "ung", "ü", "ein", "keit"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(60))
    rows = [(i, text(lang), lang, "s") for i, lang in enumerate(list(parts) * 40)]
    docs = table(spark, [*rows, (900, None, "en", "s"), (901, "12 34 !!", None, None), (902, "你好世界" * 40, None, "s"), (903, "qu", None, "s"), rows[0]])
    model = langid.fit(docs.filter(~langid.is_held_out(F.col("doc_id"))))
    found = langid.identify(docs.withColumn("held_out", langid.is_held_out(F.col("doc_id"))), model, ["doc_id", "held_out"]).collect()
    assert len(found) == len(rows) + 5
    by_id = {r.doc_id: r for r in found}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(by_id[i].lang_pred == lang and not by_id[i].rejected and 0 <= by_id[i].score <= 1 for i, _, lang, _ in rows)
    assert [by_id[i].lang_pred for i in (900, 901)] == ["und", "und"] and by_id[900].rejected and by_id[901].score == 0
    assert by_id[902].rejected and not by_id[903].rejected and by_id[902].lang_pred in parts


def test_language_of_empty_and_unlabelled_tables(spark):
    empty = table(spark, [(1, "abc", None, None)])
    model = langid.fit(empty)
    assert [(r.lang_pred, r.score) for r in langid.identify(empty, model, ["doc_id"]).collect()] == [("und", 0.0)]
    assert langid.identify(empty.limit(0), model, ["doc_id"]).count() == 0


# 2 near-duplicates


def test_golay_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 400)
    assert ((golay.keys(words) >= 0).sum(axis=1) <= 6).all()
    for flips in ([], [3], [0, 22], [7, 11], [5, 6]):
        other = words ^ sum(1 << b for b in flips)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(golay.keys(words), golay.keys(other), strict=True))


def brute_fingerprint(text, width=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(points, most):
    label = dict.fromkeys(points)
    for p in points:
        if label[p] is None:
            todo = [p]
            while todo:
                q = todo.pop()
                for r in points:
                    if label[r] is None and bin(q ^ r).count("1") <= most:
                        label[r] = p
                        todo.append(r)
                label[q] = p
    return label


@pytest.mark.parametrize("run", [4096, 3])
def test_links_equal_all_pairs(spark, run):
    rng = random.Random(run)
    points = set()
    for _ in range(25):
        seed = rng.getrandbits(64)
        for _ in range(12):
            points.add(seed ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    edges = simhash.links(df, 4, run=run, partitions=4)
    root = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    want = brute_groups(sorted(points), 4)
    groups = lambda label: {frozenset(p for p in points if label(p) == g) for g in {label(p) for p in points}}
    assert groups(lambda p: root.get(signed(p), signed(p))) == groups(want.get)


def test_near_duplicates_of_odd_rows(spark, odd_rows):
    docs = table(spark, odd_rows)
    found = simhash.near_duplicates(docs, 4).collect()
    want = [(i, brute_fingerprint(t)) for i, t, *_ in odd_rows]
    assert key((r.doc_id, r.fp % (1 << 64)) for r in found) == key(want)
    label = brute_groups(sorted({f for _, f in want}), 4)
    least = {}
    for i, f in want:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    assert all(r.component_id == least.get(label[r.fp % (1 << 64)]) for r in found)
    kept = simhash.deduplicate(docs, simhash.near_duplicates(docs, 4))
    assert kept.columns == docs.columns and kept.count() == len({label[f] for _, f in want})
    assert simhash.near_duplicates(docs.limit(0), 4).count() == 0


def shingle_set(text, width=5):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


@pytest.mark.parametrize("run", [4096, 40])
def test_similar_texts_share_a_group(spark, run):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randrange(60, 400), 10**5)
        texts.append(base)
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 60))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(copy)
    # A crowd: many copies of one text, each with an edit of its own.
    base = prose(rng, 300, 10**5)
    texts += [[*base[:k], f"c{k}", *base[k + 1 :]] for k in range(200)]
    texts += [prose(rng, 100, 10**5) for _ in range(100)]
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(table(spark, rows), 5, run=run).collect()}
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    near = missed = 0
    for i in sets:
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                near += 1
                missed += got[i] != got[j]
            elif not same:
                assert got[i] != got[j]
    assert near > 10_000 and missed <= near / 100
    assert {got[i] for i in range(120, 320)} == {120} and all(got[i] == i for i in range(320, 420))


@pytest.mark.parametrize("run", [4096, 16])
def test_texts_are_linked_at_a_similarity_of_four_fifths_exactly(spark, run):
    # Texts that share their first words with a common text, at similarities from 0.6 to 0.95: groups are those of the exact similarities.
    rng = random.Random(21)
    texts = []
    for _ in range(30):
        base = prose(rng, 204, 10**6)
        texts += [base, *([*base[:n], *prose(rng, 204 - n, 10**6)] for n in (rng.randrange(150, 202) for _ in range(4)))]
    crowd = prose(rng, 204, 10**6)
    texts += [[*crowd[:n], *prose(rng, 204 - n, 10**6)] for n in (rng.randrange(172, 200) for _ in range(120))]
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(table(spark, rows), 5, run=run).collect()}
    sets, want = [shingle_set(t) for _, t, *_ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 5 * same >= 4 * (len(sets[i]) + len(sets[j]) - same) and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    assert len(set(want)) > 60 and got == dict(enumerate(want))


def test_crowded_keys_link_every_pair(spark):
    # Chains whose neighbours are within the limit and all others beyond it; they agree in the first segment, so one key holds them all.
    rng = np.random.default_rng(5)
    free = np.setdiff1d(np.arange(256), similar.segments()[0])
    bits = [rng.integers(0, 2, 256).astype(np.uint8)]
    for _ in range(199):
        bits.append(bits[-1].copy())
        bits[-1][rng.choice(free, similar.MOST_BITS, replace=False)] ^= 1
    words = np.packbits(np.array(bits), axis=1, bitorder="little").view("<u8")
    points = spark.createDataFrame(words.view(np.int64).tolist(), ", ".join(f"{c} long" for c in similar.COLUMNS))
    whole, cut = (similar.links(points, run=run, partitions=4) for run in (4096, 4))
    groups = [{r.node: r.root for r in components.components(edges, "a", "b").collect()} for edges in (whole, cut)]
    assert groups[0] == groups[1] and len(groups[0]) == 200 and len(set(groups[0].values())) == 1


def test_similar_texts_of_odd_rows(spark, odd_rows):
    docs = table(spark, odd_rows)
    found = similar.near_duplicates(docs, 5).collect()
    assert key(r.doc_id for r in found) == key(i for i, *_ in odd_rows)
    group = {r.doc_id: r.component_id for r in found}
    assert {group[i] for i in [*range(100, 112), *range(200, 212)]} == {100}
    assert {group[i] for i in (400, 401, 402)} == {400} and group[None] is None and group[405] == 405
    kept = simhash.deduplicate(docs, similar.near_duplicates(docs, 5))
    assert kept.columns == docs.columns and kept.count() == len(set(group.values()))
    assert similar.near_duplicates(docs.limit(0), 5).count() == 0


# 3 lines


def test_line_quality_of_odd_rows(spark, odd_rows):
    boiler = "Same footer line here"
    rows = [*odd_rows, *[(1000 + i, f"{' '.join(prose(random.Random(i), 40))}\n{boiler}", "en", "h") for i in range(9)]]
    rows += [(2000 + i, "\n".join([boiler] * 6), "en", "h") for i in range(3)]
    limits = lines.Limits(documents=5, share=0.0)
    found = {r.doc_id: r for r in lines.line_quality(table(spark, rows), limits=limits).collect()}
    for i, text, *_ in rows:
        words, r = WORD.findall(text or ""), found[i]
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(words) < 1000 else set()
        with_word = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(with_word) - len(set(with_word)))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    assert found[1000].n_words_left == 40 and found[1000].kept
    assert found[2000].n_words_left == 0 and not found[2000].kept
    assert found[405].n_words_left == found[405].n_words
    assert lines.line_quality(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed,limits", [(1, lines.Limits(documents=3, share=0.0)), (2, lines.Limits(documents=1, share=0.1, left_words=5, left_share=0.6))])
def test_frequent_lines_equal_a_plain_count_over_random_hosts(spark, seed, limits):
    rng = random.Random(seed)
    pool = [" ".join(prose(rng, rng.randrange(1, 9))) for _ in range(14)]
    rows = []
    for i in range(90):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(prose(rng, rng.randrange(1, 12), 5000)) for _ in range(rng.randrange(0, 9))]
        parts = [x.upper() if rng.random() < 0.2 else f"  {x.replace(' ', '  ')}" if rng.random() < 0.2 else x for x in parts]
        rows.append((i, "\n".join(parts), "en", rng.choice(["a", "a", "a", "b", None])))
    plain = lambda x: " ".join(WORD.findall(x)).lower()
    holders, in_host = {}, {}
    for i, text, _, host in rows:
        in_host[host] = in_host.get(host, 0) + 1
        for x in text.split("\n"):
            holders.setdefault((host, plain(x)), set()).add(i)
    often = {k for k, ids in holders.items() if len(ids) > limits.documents and len(ids) > limits.share * in_host[k[0]] and k[1]}
    assert often
    found = {r.doc_id: r for r in lines.line_quality(table(spark, rows), limits=limits).collect()}
    verdicts = set()
    for i, text, _, host in rows:
        total = len(WORD.findall(text))
        left = total - sum(len(plain(x).split()) for x in text.split("\n") if (host, plain(x)) in often)
        assert found[i].n_words_left == left
        depleted = left < limits.left_words or left < limits.left_share * total
        assert found[i].kept == (not found[i].base_failed and not depleted)
        verdicts.add((found[i].base_failed, depleted))
    assert {(False, False), (False, True)} <= verdicts


# 4 fingerprints


def test_multiset_hash_is_homomorphic(spark):
    texts = [(1, "One a. Two b.\nThree c."), (2, "Three c.\nTwo b. One a."), (3, "One a. Two b."), (4, "Three c."), (5, "Other. Words."), (6, None)]
    rows = spark.createDataFrame(texts, "id int, text string")
    v = {r.id: r.v0 for r in multiset.vectors(rows, ["id"], [F.col("text")]).collect()}
    assert v[1] == v[2] and v[1] != v[3] and set(v[6]) == {0}
    pair = spark.createDataFrame([(v[1], v[3], v[4], v[5])], "whole array<int>, two array<int>, one array<int>, other array<int>")
    r = pair.select(
        multiset.combine(F.col("two"), F.col("one")).alias("plus"), multiset.without(F.col("whole"), F.col("one")).alias("minus"),
        multiset.likeness(F.col("whole"), F.col("two")).alias("near"), multiset.likeness(F.col("whole"), F.col("other")).alias("far"),
    ).first()
    assert r.plus == v[1] and r.minus == v[3] and r.near > 0.6 and r.far < 0.4


@pytest.mark.parametrize("partitions", [1, 5, 64])
def test_edited_texts(spark, odd_rows, partitions):
    rows = [(i, t or "") for i, t, *_ in odd_rows]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        third, after = len(t) // 3, order[(k + 1) % len(order)][1]
        want.append((i, t[: len(t) - third] + after[:third]))
    found = multiset.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], partitions=partitions).collect()
    got = [(r.doc_id, r.text[: len(r.text) - len(r.text) // 3] + r.next.text[: len(r.text) // 3]) for r in found]
    assert key(got) == key(want)
    if partitions == 5:
        out = multiset.edited_fingerprints(table(spark, odd_rows)).collect()
        assert key((r.doc_id, r.edited_sha256) for r in out) == key((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
        assert multiset.edited_fingerprints(table(spark, odd_rows).limit(0)).count() == 0


# 5 passages


def test_passages_equal_brute_force(spark, odd_rows, monkeypatch):
    found = substrings.remove_repeats(table(spark, odd_rows))
    assert key(map(tuple, found.collect())) == key(brute_passages(odd_rows))
    monkeypatch.setattr(substrings, "PACK", 2000)
    assert key(map(tuple, substrings.remove_repeats(table(spark, odd_rows).repartition(5)).collect())) == key(brute_passages(odd_rows))
    clash = table(spark, odd_rows).withColumns({"none": F.lit(1), "_none": F.lit(2), "rest": F.lit(3)})
    assert substrings.remove_repeats(clash, texts=True).columns == clash.columns
    assert substrings.remove_repeats(clash, texts=True).agg(F.sum("none"), F.sum("_none"), F.sum("rest")).first()[1] > 0
    assert substrings.remove_repeats(table(spark, odd_rows).limit(0)).count() == 0


def test_passages_keep_other_columns(spark, odd_rows):
    docs = table(spark, odd_rows)
    out = substrings.remove_repeats(docs, texts=True)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[100].text == odd_rows[40][1] and 101 not in texts and texts[405].rank == 7 and texts[405].text == odd_rows[-1][1]


def test_cover_meets_every_pair_of_positions():
    assert all(any((i + s) % 7 in substrings.COVER and (j + s) % 7 in substrings.COVER for s in range(7)) for i in range(7) for j in range(7))


# 6 shards


def test_shards_are_exact_and_gapless(spark, odd_rows):
    rows = table(spark, odd_rows).select("doc_id", "source")
    out = sharding.assign(rows, 4, F.col("doc_id"), block=10).collect()
    assert key((r.doc_id, r.source) for r in out) == key((i, s) for i, _, _, s in odd_rows)
    slots = [sorted(r.slot for r in out if r.shard == s) for s in range(4)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert sharding.assign(rows.limit(0), 4, F.col("doc_id")).count() == 0


def test_communication_matrix_sums():
    sources, targets = np.array([5, 0, 17, 8]), np.array([10, 9, 11])
    sends = sharding.matrix(sources, targets, 1)
    assert (sends.sum(axis=1) == sources).all() and (sends.sum(axis=0) == targets).all() and (sends >= 0).all()


# 7 mixing


def test_raking_meets_targets(spark, odd_rows):
    cells = spark.createDataFrame([(s, t, 10 * (i + 1) + 3 * j) for i, s in enumerate("abc") for j, t in enumerate("xy")], "s string, t string, tokens long")
    targets = {
        "s": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("gone", 0.4)], "s string, share double"),
        "t": spark.createDataFrame([("x", 1.0), ("y", 3.0)], "t string, share double"),
    }
    for local in (0, 100):
        out = mixing.rake(cells, targets, local=local).collect()
        total = sum(r.tokens * r.weight for r in out)
        assert abs(sum(r.tokens * r.weight for r in out if r.s == "a") / total - 0.5) < 1e-4
        assert abs(sum(r.tokens * r.weight for r in out if r.t == "y") / total - 0.75) < 1e-4
    docs = table(spark, odd_rows)
    drawn = mixing.sample(docs, mixing.document_dims(), mixing.document_tokens()).collect()
    assert len(drawn) == len(odd_rows) and max(r.probability for r in drawn) == 1.0
    assert mixing.sample(docs.limit(0), mixing.document_dims(), mixing.document_tokens()).count() == 0


def test_a_rare_source_does_not_set_how_much_is_kept(spark):
    # One document of a source of its own among 3,000: its weight is about 11, and the sample is as large as the table.
    text = " ".join(["word"] * 50)
    docs = table(spark, [(i, text, "en", "rare" if i == 0 else "ab"[i % 2]) for i in range(3000)])
    drawn = mixing.sample(docs, {"by_source": F.col("source")}, mixing.document_tokens()).collect()
    tokens = sum(r.tokens * r.copies for r in drawn)
    assert abs(tokens / (3000 * 50) - 1) < 0.03 and sum(r.kept for r in drawn) > 2900
    rare = next(r for r in drawn if r.row.doc_id == 0)
    assert rare.weight > 5 and abs(rare.copies - rare.weight) < 1 and all(r.kept == (r.copies > 0) for r in drawn)
    half = mixing.sample(docs, {"by_source": F.col("source")}, mixing.document_tokens(), share=0.5).collect()
    assert abs(sum(r.tokens * r.copies for r in half) / (3000 * 50) - 0.5) < 0.03


# 8 packing


def test_patterns_hold_the_histogram():
    rng = random.Random(0)
    for _ in range(50):
        sizes = [rng.randrange(1, 17) for _ in range(rng.randrange(300))]
        histogram = {n: sizes.count(n) for n in set(sizes)}
        found = packing.patterns(histogram, 16)
        held: dict[int, int] = {}
        for inside, count in found:
            assert sum(inside) <= 16 and count > 0
            for n in inside:
                held[n] = held.get(n, 0) + count
        assert held == histogram


def test_packing_round_trip(spark, odd_rows):
    docs = table(spark, odd_rows)
    path = tokens.vocabulary()
    out = packing.pack(packing.token_pieces(docs, path)).collect()
    encode = tokens.encoder(path).tokenizer.encode
    for i, t, *_ in odd_rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out if r.doc_id == i})
        assert sum(n for _, n, *_ in mine) == len(ids) == mine[0][3]
        assert all(zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) == c for s, n, c, _ in mine)
    seen: dict[int, list] = {}
    for r in out:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seen) == list(range(len(seen)))
    for parts in seen.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(packing.token_pieces(docs.limit(0), path)).count() == 0


def test_cached_pieces_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    own, rng = tokens.Encoder(tokens.vocabulary()), random.Random(5)
    texts = ["", " ", "a  b", "don't x's", "<|endoftext|>", "a\n\nb \n c", " x   y\r\n"]
    texts += ["".join(rng.choice("ab' \n\t.,1é你s|#") for _ in range(rng.randrange(80))) for _ in range(400)]
    for lo in range(0, len(texts), 20):
        part = texts[lo : lo + 20]
        ids, counts = own.encode(part, 2)
        want = [[*e.ids, 2] for e in own.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_pieces_are_cut_where_no_id_reaches_across():
    own, rng = tokens.Encoder(tokens.vocabulary()), random.Random(8)
    signs = "ab1 \n\t.,'(’é你ا\x1c\x85\xa0\u1680\u2000\u2009\u2014\u2028\u202f\u205f\u3000\x00😀"
    texts = ["", " ", "", "a.", ".b", " c", "\n", "d\n", "\ne", "x’s it's", "<|endoftext|>.", "", *("".join(rng.choices(signs + 9 * "ab \n", k=rng.randrange(30))) for _ in range(3000))]
    whole = [[*e.ids, 7] for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for lo, hi in ((0, len(texts)), (5, 900)):
        ids, counts = own.encode(pa.array(texts).slice(lo, hi - lo), 7)
        assert ids.tolist() == [i for w in whole[lo:hi] for i in w] and counts.tolist() == [len(w) for w in whole[lo:hi]]
    assert own.encode([None, ""])[1].tolist() == [0, 0] and own.encode([])[0].tolist() == []
    pieces, before = tokens.split(pa.array(["One word, a word.\nword", "", "word"]))
    assert pieces.to_pylist() == ["One", " word", ",", " a", " word", ".", "\n", "word", "word"] and before.tolist() == [0, 8, 8, 9]


def test_batches_are_encoded_together(monkeypatch):
    batches = [pa.record_batch([pa.array([i, i + 1]), pa.array(["x" * 10, "y"])], ["k", "t"]) for i in range(0, 10, 2)]
    monkeypatch.setattr(tokens, "GROUP", 2 * batches[0].nbytes)
    found = list(tokens.grouped(iter(batches)))
    assert [k.to_pylist() for k, _ in found] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]] and found[2][1].to_pylist() == ["x" * 10, "y"]


# 9 token files


def test_range_coder_round_trip():
    rng = np.random.default_rng(2)
    blocks = [np.zeros(0, np.uint32), np.full(300, 65535, np.uint32), *(rng.integers(0, 1 << rng.integers(1, 17), rng.integers(0, 60)).astype(np.uint32) for _ in range(30))]
    coded = rangecoder.encode(blocks)
    assert all((a == b).all() for a, b in zip(rangecoder.decode(coded, [len(b) for b in blocks]), blocks, strict=True))
    assert len(coded[1]) < 60
    with pytest.raises(ValueError, match="65,536"):
        rangecoder.encode([np.array([65536], np.uint32)])


def coded_bits(blocks):
    coded = rangecoder.encode(blocks)
    assert all((a == b).all() for a, b in zip(rangecoder.decode(coded, [len(b) for b in blocks]), blocks, strict=True))
    return 8 * sum(map(len, coded)) / sum(map(len, blocks))


def test_blocks_share_a_model_of_three_orders():
    rng = np.random.default_rng(4)
    few, some = rng.permutation(50_000)[:256].astype(np.uint32), rng.permutation(50_000)[:16].astype(np.uint32)
    assert coded_bits([rng.choice(few, 256) for _ in range(200)]) < 9.5  # order 0: 8 bits
    after = dict(zip(few.tolist(), rng.permutation(few).tolist(), strict=True))
    chains = []
    for _ in range(100):
        chain = [int(rng.choice(few))]
        while len(chain) < 256:
            chain.append(after[chain[-1]])
        chains.append(np.array(chain, np.uint32))
    assert coded_bits(chains) < 1  # order 1
    sums = []
    for _ in range(100):
        at = [int(rng.integers(16)), int(rng.integers(16))]
        while len(at) < 256:
            at.append((at[-1] * 7 + at[-2] * 3 + 1) % 16)
        sums.append(some[at])
    assert coded_bits(sums) < 1  # order 2


def test_range_coder_carries_and_groups(monkeypatch):
    monkeypatch.setattr(rangecoder, "LANES", 7)
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, [1, 2, 300, 65536][i % 4], 400 - i).astype(np.uint32) for i in range(30)]
    assert coded_bits([*blocks, np.full(400, 65535, np.uint32)]) > 0


def test_coded_bytes_stay():
    rng = np.random.default_rng(11)
    blocks = [(rng.zipf(1.2, 90 - i) % 40_000).astype(np.uint32) for i in range(60)]
    blocks += [np.tile(rng.integers(0, 65536, 5), 12).astype(np.uint32), np.zeros(100, np.uint32), np.zeros(0, np.uint32)]
    assert zlib.crc32(b"".join(rangecoder.encode(blocks))) == 0xeb2e524c


def test_token_files_round_trip(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE", 3000)
    rows = [r for r in odd_rows if r[0] != 404]
    manifest = tokenfiles.write(table(spark, rows), tokens.vocabulary())
    assert manifest.count() > 1
    found = tokenfiles.read(manifest).collect()
    encode, start = tokens.encoder(tokens.vocabulary()).tokenizer.encode, 0
    want = []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert key(map(tuple, found)) == key(want)
    assert tokenfiles.read(tokenfiles.write(table(spark, rows).limit(0), tokens.vocabulary())).count() == 0


def test_damaged_token_file():
    data = tokenfiles.to_bytes([1, None], np.array([2, 1]), np.array([5, 2, 2], dtype=np.uint32))
    assert tokenfiles.from_bytes(data)[0] == [1, None]
    for at in (0, 30, len(data) - 1):
        with pytest.raises(ValueError):
            tokenfiles.from_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


# 10 archives


def test_archives_round_trip(spark):
    long = "<p>" + "x" * 200
    rows = [(3, "u3", long), (1, "u\r\nWARC-Type: x", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "n", long), (8, "z", "é" * 5000), (8, "z", "é" * 5000)]
    rows += [(10 + i, "v", f"<html>{i} " + "body text " * 30) for i in range(30)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    out = warc.read(warc.write(pages), payloads=True).collect()
    assert len(out) == len(rows)
    by_id = {r.page_id: r for r in out}
    assert (by_id[1].record_type, by_id[1].refers_to, by_id[1].url) == ("response", None, "u\r\nWARC-Type: x")
    assert [(by_id[i].record_type, by_id[i].refers_to, by_id[i].payload) for i in (2, 3)] == [("revisit", 1, b"")] * 2
    assert by_id[2].payload_digest == hashlib.sha256(long.encode()).hexdigest() and by_id[2].payload_bytes == len(long)
    assert all(r.record_type == "response" for r in out if r.page_id in (None, 4, 5, 6, 7, 8))
    assert all(by_id[i].payload.decode() == (h or "") for i, _, h in rows if i and by_id[i].record_type == "response")
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_archive_faults():
    body = b"payload" * 20
    record = warc.record(1, "u", body, hashlib.sha256(body).hexdigest(), len(body), None)
    data = warc.archive([record, record], b"")
    assert list(warc.records(data)) == [record, record]
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    for bad in (data[8:], data[:-3]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.records(bad))
    for bad in (record.replace(b"payload", b"Payload", 1), record[:-1], record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"Content-Length: ", b"X: ")):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(n) for n in range(1, 11)}


def test_one_large_group_of_near_copies_emits_few_edges(spark):
    rng = random.Random(9)
    base = prose(rng, 250, 10**6)
    rows = [(i, " ".join([*base[: i % 240], f"e{i}", *base[i % 240 + 1 :]]), "en", "a") for i in range(2000)]
    points = similar.fingerprints(table(spark, rows), 5).dropDuplicates(["node"]).cache()
    n = points.count()
    labels = points.select("node", F.col("node").alias("label"), *similar.COLUMNS)
    first = similar._links_of(labels, 0, 1, similar.MOST_BITS, 4 * similar.RUN, 4)
    assert n > 1500 and first.count() <= 6 * n
    assert similar.links(points, partitions=8).count() == n - 1
    points.unpersist()
